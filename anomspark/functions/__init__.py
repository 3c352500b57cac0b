from anomspark.functions import rules
from anomspark.functions.rules import (graph_structural_columns, has_temporal_name, has_text_name,
                                       is_id_name, is_label_name, parse_datetime)

__all__ = ["rules", "graph_structural_columns", "has_temporal_name", "has_text_name",
           "is_id_name", "is_label_name", "parse_datetime"]
