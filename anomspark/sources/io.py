"""Scans and sinks (A1, A2, A4) plus the NaN-to-NULL ingest rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_TYPES = (T.FloatType, T.DoubleType)

# Texts that a CSV cell may hold for a missing value, and for truth values.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL for float/double columns and decimals into double.

    pandas counts NaN and None alike as missing; Spark keeps them apart, so on ingest
    every NaN becomes NULL.  Decimals are cast to double (pandas has no decimal dtype).
    """
    cols = []
    changed = False
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, FLOAT_TYPES):
            cols.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(c.cast("double").alias(f.name))
            changed = True
        else:
            cols.append(c)
    return df.select(*cols) if changed else df


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               min_partitions: int | None = None, **options) -> DataFrame:
    """Read a table the way the reference reads its input.

    Parquet is read as is; CSV (A1) by :func:`read_csv`.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        df = read_csv(spark, path, **options)
    else:
        df = spark.read.options(**options).format(fmt).load(path)
    if min_partitions:
        df = spread(df, min_partitions)
    return normalize_missing(df)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV scan with a header whose types are inferred from the cells that are not missing.

    Cells that hold one of :data:`MISSING_TOKENS` are null before a type is chosen, so ``NA`` does not make a
    column of numbers a text.  One aggregate over the file then decides for each column: whole numbers of 64
    bits are ``bigint`` (``double`` if any cell is missing), other numbers ``double``, truth values
    ``boolean`` (text if any is missing), a column without values ``double``, everything else text.  Dates
    stay text: the profiler decides about them (C5).
    """
    text = spark.read.option("header", "true").options(**options).option("inferSchema", "false").csv(path)
    cell = {n: F.when(~F.col(f"`{n}`").isin(MISSING_TOKENS), F.col(f"`{n}`")) for n in text.columns}
    facts = []
    for i, v in enumerate(cell.values()):
        tests = {"whole": v.rlike(WHOLE_NUMBER) & v.try_cast("bigint").isNotNull(),
                 "number": v.try_cast("double").isNotNull() & ~v.rlike(r"[0-9.][dDfF]\s*$"),
                 "truth": v.isin(TRUE_TOKENS + FALSE_TOKENS)}
        facts += [F.count(v).alias(f"n{i}"), *[F.coalesce(F.min(F.when(v.isNotNull(), t)), F.lit(False)).alias(f"{x}{i}")
                                               for x, t in tests.items()]]
    row = text.agg(F.count(F.lit(1)).alias("rows"), *facts).first()
    out = []
    for i, (n, v) in enumerate(cell.items()):
        some, full = row[f"n{i}"], row[f"n{i}"] == row["rows"]
        if row[f"whole{i}"] and full:
            v = F.trim(v).cast("bigint")
        elif row[f"number{i}"] or not some:
            v = v.try_cast("double")
        elif row[f"truth{i}"] and full:
            v = v.isin(TRUE_TOKENS)
        out.append(v.alias(n))
    return text.select(*out)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan that arrived in fewer partitions than the cluster has cores.

    A single large row group is one task whatever the file size; on a real cluster the
    input already has thousands of splits and this is a no-op (no extra shuffle).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def companion_graph_files(spark: SparkSession, data_dir: str | None) -> DataFrame | None:
    """A2: files directly in ``data_dir`` named ``*.json`` whose name contains "graph".

    Only file paths are listed (the binary content column is pruned, so no file is
    read).  Returns ``None`` for an empty or missing directory setting.
    """
    if not data_dir:
        return None
    try:
        listing = (spark.read.format("binaryFile")
                   .option("pathGlobFilter", "*.json")
                   .option("recursiveFileLookup", "false")
                   .load(data_dir)
                   .select("path"))
    except Exception:  # directory missing or unreadable: ignored, like the reference
        return None
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return listing.where(F.lower(name).contains("graph")).select(name.alias("file_name"))


def has_companion_graph(spark: SparkSession, data_dir: str | None) -> bool:
    files = companion_graph_files(spark, data_dir)
    return bool(files is not None and files.limit(1).count() > 0)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """A4 sink: write a result table."""
    df.write.mode(mode).format(fmt).save(path)
