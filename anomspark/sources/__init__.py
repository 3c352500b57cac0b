from anomspark.sources.io import (companion_graph_files, has_companion_graph, 
                                  normalize_missing, read_table, write_table)

__all__ = ["companion_graph_files", "has_companion_graph", "normalize_missing",
           "read_table", "write_table"]
