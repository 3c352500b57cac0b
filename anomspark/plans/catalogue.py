"""Query catalogue: one Spark DataFrame per operator of SURVEY §2, each over whole
driver tables, plus the DuckDB SQL that states the same result independently.

Float outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomspark.functions import rules as R
from anomspark.operators import features as FE
from anomspark.operators import scoring as SC
from anomspark.operators import temporal as TM
from anomspark.operators.detectors.ecod import ecod
from anomspark.operators.histogram import distinct_counts, frequencies, long_values, value_histogram
from anomspark.operators.profile import (column_stats_of, dataset_types, implicit_votes, role_ratios, role_table)
from anomspark.plans import oracle as O
from anomspark.plans.ordering import c, group_index, tail_rows
from anomspark.sources.io import read_table, spread
from anomspark.session import prepare_session, reliable_checkpoint

ROLE_TABLES = [("events", ["event_id"]), ("documents", ["doc_id"]), ("orders", ["o_orderkey"]),
               ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("labels", ["doc_id"]),
               ("conversations", ["conv_id", "turn"]), ("supplier", ["s_suppkey"]),
               ("nation", ["n_nationkey"]), ("region", ["r_regionkey"]), ("pages", ["page_id"]),
               ("benchmark", ["item_id"]), ("lineitem", ["l_orderkey", "l_linenumber"])]
ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Rows of the tail report.
TAIL_ROWS = 2500


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare_session(spark)
    return read_table(spark, f"{sf}/{name}.parquet")


def r6(col) -> "F.Column":
    return F.round(col.cast("double"), 6)


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


# ---------------------------------------------------------------------------
# B / C: roles and column facts
# ---------------------------------------------------------------------------

def _roles_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Role tables of several tables, worked out by one plan; the result has one row per column."""
    out = role_table(column_stats_of(tables)).select(
        "table_name", F.col("column").alias("column_name"), F.col("pos").cast("int").alias("pos"), "family",
        "n_rows", "n_distinct", "n_nonnull", "role", "temporal_candidate", "high_cardinality",
        F.col("label_rank").cast("int").alias("label_rank"), "graph_structural")
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(out.collect(), out.schema)


def _role_tables(spark, sf, more=()):
    """Role tables of thirteen driver tables (and ``more``, of (name, frame, key))."""
    return _roles_of({t: _t(spark, sf, t) for t, _ in ROLE_TABLES} | {t: df for t, df, _ in more})


def q_column_roles(spark, sf):
    return _role_tables(spark, sf).drop("graph_structural")


def q_id_columns(spark, sf):
    return q_column_roles(spark, sf).where("role = 'id'").select("table_name", "column_name")


def q_text_columns(spark, sf):
    return q_column_roles(spark, sf).where("role = 'text'").select("table_name", "column_name")


def q_label_columns(spark, sf):
    return q_column_roles(spark, sf).where("role = 'label'").select("table_name", "column_name", "label_rank")


def q_numeric_categorical(spark, sf):
    return (q_column_roles(spark, sf).where("family = 'numeric' AND role IN ('categorical', 'continuous')")
            .select("table_name", "column_name", (F.col("role") == "categorical").alias("is_categorical")))


def q_numeric_temporal(spark, sf):
    """C8 on orders with a derived integer ``order_year`` column."""
    o = _t(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))
    return _roles_of({"orders_year": o}).select(
        "column_name", "role", "temporal_candidate")


def q_high_cardinality(spark, sf):
    return (q_column_roles(spark, sf).where("high_cardinality")
            .select("table_name", "column_name", "n_distinct"))


def q_graph_columns(spark, sf):
    """C3 on orders seen as an edge list: o_custkey -> source, o_orderkey -> target."""
    edges = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "source").withColumnRenamed("o_orderkey", "target")
    return _roles_of({"orders_edges": edges}).select("column_name", "role", "graph_structural")


def q_string_datetime(spark, sf):
    """o_orderdate as text is still recognised as a timestamp."""
    o = _t(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return _roles_of({"orders_text_dates": o}).select("column_name", "family", "role")


def q_role_ratios(spark, sf):
    ratios = role_ratios(_role_tables(spark, sf))
    return ratios.select("table_name", *[r6(F.col(x)).alias(x) for x in ratios.columns[1:]])


def _typed_tables(spark, sf):
    """An edge list, and parts in the order of their price, whose columns make an implicit series."""
    edges = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "source").withColumnRenamed("o_orderkey", "target")
    parts = _t(spark, sf, "part").select(
        (F.col("p_retailprice") * 100).cast("long").alias("cents"), "p_partkey",
        F.floor(F.col("p_retailprice") / 10).alias("tens"), F.floor(F.col("p_retailprice") / 25).alias("steps"), "p_size")
    return [("orders_edges", edges, ["target"]), ("parts_by_price", parts, ["cents", "p_partkey"])]


def q_dataset_type(spark, sf):
    """C11 / C12 of the driver tables, an edge list (graph rule) and a table with an implicit series (D3 vote)."""
    more = _typed_tables(spark, sf)
    roles = _role_tables(spark, sf, more)
    frames = {t: (df, k) for t, df, k in [(t, _t(spark, sf, t), k) for t, k in ROLE_TABLES] + more}
    continuous: dict[str, list[str]] = {t: [] for t in frames}
    rows = {}
    for r in roles.select("table_name", "column_name", "role", "n_rows").collect():  # one row for each column
        rows[r["table_name"]] = r["n_rows"]
        if r["role"] == "continuous":
            continuous[r["table_name"]].append(r["column_name"])
    tables = {t: (TM.series_long(df, continuous[t], k), continuous[t], rows[t], len(df.columns))
              for t, (df, k) in frames.items() if rows.get(t, 0) >= 50 and len(continuous[t]) / len(df.columns) >= 0.7}
    return dataset_types(roles, implicit_votes(tables))


def q_table_shape(spark, sf):
    frames = []
    for t in ALL_TABLES:
        df = _t(spark, sf, t)
        frames.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(t).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols")))
    return _union(frames)


def q_feature_sample_ratio(spark, sf):
    s = q_table_shape(spark, sf)
    ratio = F.col("n_cols") / F.col("n_rows")
    high = (F.col("n_cols") >= 100) | ((F.col("n_rows") >= 50) & (ratio >= 0.1))
    return s.select("table_name", r6(ratio).alias("feature_to_sample_ratio"), high.alias("high_dimensionality"))


def q_missing_ratio(spark, sf):
    frames = []
    for t in ["events", "orders", "documents", "lineitem", "customer"]:
        df = _t(spark, sf, t)
        nulls = sum((F.count_if(c(x).isNull()) for x in df.columns), F.lit(0))
        frames.append(df.agg((nulls / (F.count(F.lit(1)) * len(df.columns))).alias("m")).select(
            F.lit(t).alias("table_name"), r6(F.col("m")).alias("missing_ratio")))
    return _union(frames)


def q_column_cardinality(spark, sf):
    frames = []
    for t in ["events", "documents", "orders"]:
        df = _t(spark, sf, t)
        n = df.count()
        frames.append(distinct_counts(df, df.columns).select(
            F.lit(t).alias("table_name"), F.col("column").alias("column_name"), "n_distinct",
            r6(F.col("n_distinct") / F.lit(n)).alias("unique_ratio")))
    return _union(frames)


def q_avg_text_length(spark, sf):
    tables = {t: _t(spark, sf, t) for t in ["documents", "conversations", "pages", "benchmark"]}
    return column_stats_of(tables).where("family = 'string'").select(
        "table_name", F.col("column").alias("column_name"), r6(F.col("avg_len")).alias("avg_len"))


def q_null_columns(spark, sf):
    stats = column_stats_of({"events": _nulled_events(spark, sf)})
    return stats.select(F.col("column").alias("column_name"), (F.col("n_null") > 0).alias("has_missing"), "n_null")


def q_obs_per_entity(spark, sf):
    ev = _t(spark, sf, "events")
    rows = []
    for t, ids in [("events", ["user_id"]), ("events", ["user_id", "event_type"]), ("orders", ["o_custkey"])]:
        df = ev if t == "events" else _t(spark, sf, t)
        sizes = df.dropna(subset=ids).groupBy(*ids).count()
        rows.append(sizes.agg(r6(F.avg("count")).alias("observations_per_entity")).select(
            F.lit(t).alias("table_name"), F.lit(",".join(ids)).alias("id_columns"), "observations_per_entity"))
    return _union(rows)


def q_temporal_min_max(spark, sf):
    ev = _t(spark, sf, "events")
    o = _t(spark, sf, "orders")
    oc = o.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return _union([
        ev.agg(F.min("ts").alias("mn"), F.max("ts").alias("mx")).select(F.lit("events.ts").alias("column_name"), "mn", "mx"),
        o.agg(F.min("o_orderdate").alias("mn"), F.max("o_orderdate").alias("mx")).select(
            F.lit("orders.o_orderdate").alias("column_name"), "mn", "mx"),
        oc.agg(F.min(R.parse_datetime(F.col("o_orderdate"))).alias("mn"),
               F.max(R.parse_datetime(F.col("o_orderdate"))).alias("mx")).select(
            F.lit("orders.o_orderdate_text").alias("column_name"), "mn", "mx"),
    ]).select("column_name", F.col("mn").cast("timestamp_ntz").alias("min_value"),
              F.col("mx").cast("timestamp_ntz").alias("max_value"))


def q_class_balance(spark, sf):
    """B12 / B13 for two label-like columns: class shares and the supervision level."""
    from anomspark.operators.profile import supervision
    lab = _t(spark, sf, "labels")
    out = []
    for col in ["toxic", "quality"]:
        fr = frequencies(value_histogram(lab, [col]))
        level, imbalance = supervision(lab, col)
        out.append(fr.select(F.col("column").alias("label_column"), F.col("value").cast("int").alias("value"),
                             F.col("cnt").cast("long").alias("cnt"), r6(F.col("share")).alias("share"),
                             F.lit(level).alias("supervision_level"),
                             F.round(F.lit(float(imbalance)), 6).alias("imbalance_ratio")))
    return _union(out)


# ---------------------------------------------------------------------------
# D: ordered statistics
# ---------------------------------------------------------------------------

def _events_long(spark, sf, cols=("value", "user_id")):
    ev = _t(spark, sf, "events")
    return TM.series_long(ev, list(cols), ["event_id"])


def q_lag_autocorr(spark, sf):
    ac = TM.lag_autocorr(_events_long(spark, sf), [1, 2, 7, 12, 24])
    return ac.select(F.col("column").alias("column_name"), "lag", r6(F.col("autocorr")).alias("autocorr"),
                     F.col("n").cast("long").alias("n"))


def q_implicit_series(spark, sf):
    """D3 vote over events' numeric columns by event_id (all rows, no tail)."""
    ac = TM.lag_autocorr(_events_long(spark, sf), [1])
    hit = (F.col("n") >= 20) & (F.abs(F.col("autocorr")) > 0.7)
    return ac.select(F.col("column").alias("column_name"), r6(F.col("autocorr")).alias("autocorr"),
                     F.coalesce(hit, F.lit(False)).alias("high_autocorr"))


def _daily_orders(spark, sf):
    o = _t(spark, sf, "orders")
    daily = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x"))
    return TM.series_long(daily.withColumn("x", F.col("x")), ["x"], ["day"])


def q_acf_values(spark, sf):
    a = TM.acf(_daily_orders(spark, sf), TM.ACF_MAX_LAGS, 2)
    return a.select("lag", r6(F.col("acf")).alias("acf"), F.col("n").cast("long").alias("n"))


def q_acf_flags(spark, sf):
    a = TM.acf(_daily_orders(spark, sf), TM.ACF_MAX_LAGS, 2)
    return TM.acf_flags(a).select("has_trend", "has_seasonality")


def q_adf_stationarity(spark, sf):
    res = TM.adf_test(_daily_orders(spark, sf).union(_events_long(spark, sf, ("value",))))
    return spark.createDataFrame([(r["column"], r["n"], r["usedlag"], r["adf_stat"], r["stationary"]) for r in res],
                                 "column_name string, n long, usedlag int, adf_stat double, stationary boolean")


def q_split_variance(spark, sf):
    s = TM.split_variance(_events_long(spark, sf))
    return s.select(F.col("column").alias("column_name"), r6(F.col("var1")).alias("var1"),
                    r6(F.col("var2")).alias("var2"), "stationary")


def q_rolling_trend(spark, sf):
    s = TM.rolling_trend(_events_long(spark, sf))
    return s.select(F.col("column").alias("column_name"), F.col("win").cast("int").alias("win"),
                    r6(F.col("var_rm")).alias("var_rm"), "trend")


def q_lag_seasonality(spark, sf):
    return TM.lag_seasonality(_events_long(spark, sf)).select(F.col("column").alias("column_name"), "seasonal")


def q_temporal_vote(spark, sf):
    lng = _events_long(spark, sf)
    sv = TM.split_variance(lng).select("column", "stationary")
    rt = TM.rolling_trend(lng).select("column", "trend")
    ls = TM.lag_seasonality(lng)
    j = sv.join(rt, "column").join(ls, "column")
    k = F.count(F.lit(1))
    return j.agg((F.count_if("stationary") >= k / 2.0).alias("is_stationary"),
                 (F.count_if("trend") >= k * 0.2).alias("has_trend"),
                 (F.count_if("seasonal") >= k * 0.2).alias("has_seasonality"))


def q_temporal_regularity(spark, sf):
    ev = _t(spark, sf, "events")
    o = _t(spark, sf, "orders")
    rows = []
    for label, df, col, is_dt in [("events.ts", ev, "ts", True), ("orders.o_orderdate", o, "o_orderdate", True),
                                  ("events.event_id", ev, "event_id", False)]:
        st = TM.regularity_stats(df, col, is_dt)
        rows.append(st.select(F.lit(label).alias("column_name"), F.col("n").cast("long").alias("n"),
                              r6(F.col("mean_gap")).alias("mean_gap"), r6(F.col("sd_gap")).alias("sd_gap"),
                              F.col("n_zero").cast("long").alias("n_zero")))
    return _union(rows)


def q_global_local_z(spark, sf):
    z = TM.global_local_z(_events_long(spark, sf, ("value",)))
    return z.select(F.col("idx").cast("long").alias("idx"), r6(F.col("global_z")).alias("global_z"),
                    r6(F.col("local_z")).alias("local_z"))


def q_collective_ratio(spark, sf):
    ct = TM.collective_test(_events_long(spark, sf), False)
    return ct.select(F.col("column").alias("column_name"), r6(F.col("mean_abs_acf")).alias("mean_abs_acf"),
                     r6(F.col("candidate_ratio")).alias("candidate_ratio"), "collective")


# ---------------------------------------------------------------------------
# A: sampling
# ---------------------------------------------------------------------------

def q_tail_sample(spark, sf):
    return tail_rows(_t(spark, sf, "events"), ["event_id"], TAIL_ROWS).select("event_id", "ts", "user_id", "value")


def q_head_sample(spark, sf):
    ev = _t(spark, sf, "events")
    lv = long_values(ev, ["event_type", "props"], "string", keep=["event_id"])
    w = Window.partitionBy("column").orderBy("event_id")
    return (lv.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= R.HEAD_VALUES)
            .select(F.col("column").alias("column_name"), F.col("rn").cast("long").alias("rn"), "value"))


# ---------------------------------------------------------------------------
# F: preprocessing
# ---------------------------------------------------------------------------

def _nulled_events(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select("event_id", "ts",
                     F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
                     F.when(F.col("value") >= 300, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                     F.when(F.col("value") >= 5, F.col("value")).alias("value"), "props")


def q_epoch_features(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"))


def q_median_impute(spark, sf):
    df = _nulled_events(spark, sf)
    steps = {"impute_missing": True, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(df.select("event_id", "user_id", "value"), steps, ["event_id"])
    return feats.select("event_id", r6(F.col("user_id")).alias("user_id"), r6(F.col("value")).alias("value"))


def q_mode_impute(spark, sf):
    df = _nulled_events(spark, sf)
    steps = {"impute_missing": True, "exclude_id_columns": [], "text_columns": [], "encode_categorical": False}
    sel = df.select("event_id", "event_type")
    feats, spec = FE.fit_transform(sel, steps, ["event_id"])
    mode = spec.modes.get("event_type")
    return sel.select("event_id", F.coalesce("event_type", F.lit(mode)).alias("event_type"))


def q_ffill_bfill(spark, sf):
    df = _nulled_events(spark, sf).select("event_id", "value", "user_id")
    out = FE.ffill_bfill(df, ["value", "user_id"], ["event_id"])
    return out.select("event_id", r6(F.col("value")).alias("value"), F.col("user_id").cast("long").alias("user_id"))


def _documents_feats(spark, sf):
    d = spread(_t(spark, sf, "documents"))
    steps = {"impute_missing": False, "scale_continuous": True, "encode_categorical": True,
             "exclude_id_columns": ["doc_id"], "exclude_label_columns": [], "text_columns": ["text"]}
    return FE.fit_transform(d, steps, ["doc_id"])


def _long_features(feats, key, names):
    lv = long_values(feats, names, "double", keep=key)
    return lv


def q_one_hot(spark, sf):
    d = _t(spark, sf, "documents")
    steps = {"encode_categorical": True, "exclude_id_columns": ["doc_id"], "text_columns": []}
    feats, spec = FE.fit_transform(d.select("doc_id", "lang"), steps, ["doc_id"])
    return _long_features(feats, ["doc_id"], spec.feature_names).select(
        "doc_id", F.col("column").alias("feature"), r6(F.col("value")).alias("value"))


def q_freq_encode(spark, sf):
    d = _t(spark, sf, "documents")
    steps = {"encode_categorical": True, "exclude_id_columns": ["doc_id"], "text_columns": []}
    feats, spec = FE.fit_transform(d.select("doc_id", "source"), steps, ["doc_id"])
    return feats.select("doc_id", r6(F.col("source")).alias("source"))


def q_robust_scale(spark, sf):
    ev = _t(spark, sf, "events")
    steps = {"scale_continuous": True, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(ev.select("event_id", "ts", "user_id", "value"), steps, ["event_id"])
    return feats.select("event_id", *[r6(F.col(n)).alias(n) for n in ["ts", "user_id", "value"]])


def q_tfidf(spark, sf):
    d = spread(_t(spark, sf, "documents"))
    vocab = FE.fit_vocabulary(d, "text")
    wide = FE.tfidf_frame(d, "text", vocab, ["doc_id"])
    names = [f"text_tfidf_{t}" for t, _ in vocab]
    lv = long_values(wide, names, "double", keep=["doc_id"])
    return lv.select("doc_id", F.regexp_replace("column", "^text_tfidf_", "").alias("term"),
                     r6(F.col("value")).alias("tfidf"))


def q_feature_matrix(spark, sf):
    feats, spec = _documents_feats(spark, sf)
    lv = _long_features(feats, ["doc_id"], spec.feature_names)
    pos = spark.createDataFrame([(n, i) for i, n in enumerate(spec.feature_names)], "column string, pos int")
    return lv.join(F.broadcast(pos), "column").select(
        "doc_id", F.col("column").alias("feature"), "pos", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------------------
# G / H: detectors and scores
# ---------------------------------------------------------------------------

EVENT_FEATURES = ["ts_s", "user_id", "value"]


def _event_matrix(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts_s"),
                     F.col("user_id").cast("double").alias("user_id"), F.col("value").cast("double").alias("value"))


def q_ecod(spark, sf):
    s = ecod(_event_matrix(spark, sf), ["event_id"], EVENT_FEATURES)
    return s.select("event_id", r6(F.col("score")).alias("score"))


def _zscore_member(spark, sf):
    m = _event_matrix(spark, sf)
    mu, sd = m.agg(F.avg("value"), F.stddev_pop("value")).first()
    return m.select("event_id", F.abs((F.col("value") - F.lit(mu)) / F.lit(sd)).alias("score"))


def _normalised_members(spark, sf):
    e = SC.minmax(ecod(_event_matrix(spark, sf), ["event_id"], EVENT_FEATURES))
    z = SC.minmax(_zscore_member(spark, sf))
    return {"ecod": e, "zscore": z}


def q_minmax_scores(spark, sf):
    e = _normalised_members(spark, sf)["ecod"]
    return e.select("event_id", r6(F.col("score")).alias("score"))


def q_ensemble(spark, sf):
    ens = SC.ensemble(_normalised_members(spark, sf), ["event_id"])
    return ens.select("event_id", r6(F.col("score_ecod")).alias("score_ecod"),
                      r6(F.col("score_zscore")).alias("score_zscore"), r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_three_sigma(spark, sf):
    ens = SC.three_sigma(SC.ensemble(_normalised_members(spark, sf), ["event_id"]))
    return ens.select("event_id", "is_anomaly")


def q_score_summary(spark, sf):
    s = SC.score_summary(SC.ensemble(_normalised_members(spark, sf), ["event_id"]))
    return s.select(F.col("rows").cast("long").alias("rows"), r6(F.col("mean_score")).alias("mean_score"),
                    r6(F.col("std_score")).alias("std_score"), r6(F.col("threshold")).alias("threshold"),
                    F.col("anomalies").cast("long").alias("anomalies"), r6(F.col("anomaly_pct")).alias("anomaly_pct"))


def q_detector_summary(spark, sf):
    m = _normalised_members(spark, sf)
    return SC.detector_summary(m, {}).select("detector", r6(F.col("mean_score")).alias("mean_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_shape": q_table_shape,
    "missing_ratio": q_missing_ratio,
    "feature_sample_ratio": q_feature_sample_ratio,
    "column_cardinality": q_column_cardinality,
    "avg_text_length": q_avg_text_length,
    "null_columns": q_null_columns,
    "obs_per_entity": q_obs_per_entity,
    "temporal_min_max": q_temporal_min_max,
    "class_balance": q_class_balance,
    "column_roles": q_column_roles,
    "id_columns": q_id_columns,
    "text_columns": q_text_columns,
    "label_columns": q_label_columns,
    "numeric_categorical": q_numeric_categorical,
    "numeric_temporal": q_numeric_temporal,
    "high_cardinality": q_high_cardinality,
    "graph_columns": q_graph_columns,
    "string_datetime": q_string_datetime,
    "role_ratios": q_role_ratios,
    "dataset_type": q_dataset_type,
    "lag_autocorr": q_lag_autocorr,
    "implicit_series": q_implicit_series,
    "acf_values": q_acf_values,
    "acf_flags": q_acf_flags,
    "adf_stationarity": q_adf_stationarity,
    "split_variance": q_split_variance,
    "rolling_trend": q_rolling_trend,
    "lag_seasonality": q_lag_seasonality,
    "temporal_vote": q_temporal_vote,
    "temporal_regularity": q_temporal_regularity,
    "global_local_z": q_global_local_z,
    "collective_ratio": q_collective_ratio,
    "tail_sample": q_tail_sample,
    "head_sample": q_head_sample,
    "epoch_features": q_epoch_features,
    "median_impute": q_median_impute,
    "mode_impute": q_mode_impute,
    "ffill_bfill": q_ffill_bfill,
    "one_hot": q_one_hot,
    "freq_encode": q_freq_encode,
    "robust_scale": q_robust_scale,
    "tfidf": q_tfidf,
    "feature_matrix": q_feature_matrix,
    "ecod": q_ecod,
    "minmax_scores": q_minmax_scores,
    "ensemble": q_ensemble,
    "three_sigma": q_three_sigma,
    "score_summary": q_score_summary,
    "detector_summary": q_detector_summary,
}


# ---------------------------------------------------------------------------
# G: detectors on real feature matrices; H2/H3/H5; full runs and profile records
# ---------------------------------------------------------------------------

def _embedding_matrix(spark, sf):
    e = _t(spark, sf, "embeddings")
    dim = len(e.select("embedding").first()["embedding"])
    names = [f"e{i}" for i in range(dim)]
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def q_knn(spark, sf):
    from anomspark.operators.detectors.lof import knn_with_keys
    m, names = _embedding_matrix(spark, sf)
    return knn_with_keys(m, "vec_id", names).select("vec_id", "nbr_vec_id", r6(F.col("dist")).alias("dist"))


def q_lof(spark, sf):
    from anomspark.operators.detectors.lof import lof
    m, names = _embedding_matrix(spark, sf)
    return lof(m, ["vec_id"], names).select("vec_id", r6(F.col("score")).alias("lof"))


def _doc_detector(name):
    def q(spark, sf):
        from anomspark.engine import DETECTORS
        feats, spec = _documents_feats(spark, sf)
        feats = reliable_checkpoint(feats)
        return DETECTORS[name](feats, ["doc_id"], spec.feature_names).select("doc_id", "score")
    q.__name__ = f"q_{name}"
    return q


def q_pca_embedding(spark, sf):
    feats, spec = _documents_feats(spark, sf)
    return SC.pca_embedding(reliable_checkpoint(feats), ["doc_id"], spec.feature_names, R.EMBEDDING_DIM)


def q_neural_embedding(spark, sf):
    from anomspark.operators.detectors.neural import neural_embedding
    feats, spec = _documents_feats(spark, sf)
    return neural_embedding("autoencoder", reliable_checkpoint(feats), ["doc_id"], spec.feature_names)


def _documents_run(spark, sf):
    from anomspark.engine import run
    return run(_t(spark, sf, "documents"), key=["doc_id"])


def q_score_table(spark, sf):
    return _documents_run(spark, sf).result


def q_detector_status(spark, sf):
    res = _documents_run(spark, sf)
    rows = [(s["detector"], s["status"], s["message"], res.embedding_source) for s in res.status]
    return spark.createDataFrame(rows, "detector string, status string, message string, embedding_source string")


PROFILED = [("events", ["event_id"]), ("documents", ["doc_id"]), ("orders", ["o_orderkey"]),
            ("labels", ["doc_id"]), ("pages", ["page_id"]), ("customer", ["c_custkey"])]


def _profiles(spark, sf):
    from concurrent.futures import ThreadPoolExecutor

    from anomspark.operators.profile import profile

    def one(tk):
        t, k = tk
        return profile(_t(spark, sf, t), order_by=k).to_df(spark).select(F.lit(t).alias("table_name"), "*")
    with ThreadPoolExecutor(max_workers=6) as pool:
        return _union(list(pool.map(one, PROFILED)))


def q_profile_record(spark, sf):
    return _profiles(spark, sf)


def q_route(spark, sf):
    from anomspark.plans.route import route_df
    return route_df(_profiles(spark, sf)).select("table_name", "dataset_type", "supervision_level", "strategy",
                                                 "recommended_models", "detectors")


def q_preprocess_plan(spark, sf):
    from anomspark.plans.route import route_df
    return route_df(_profiles(spark, sf)).select("table_name", "preprocessing_steps.*", "metadata.*")


QUERIES.update({
    "knn": q_knn,
    "lof": q_lof,
    "isolation_forest": _doc_detector("isolation_forest"),
    "one_class_svm": _doc_detector("one_class_svm"),
    "autoencoder": _doc_detector("autoencoder"),
    "vae": _doc_detector("vae"),
    "deep_svdd": _doc_detector("deep_svdd"),
    "deep_svdd_sequential": _doc_detector("deep_svdd_sequential"),
    "pca_embedding": q_pca_embedding,
    "neural_embedding": q_neural_embedding,
    "score_table": q_score_table,
    "detector_status": q_detector_status,
    "profile_record": q_profile_record,
    "route": q_route,
    "preprocess_plan": q_preprocess_plan,
})


# ---------------------------------------------------------------------------
# A1 / A2 / F10 / D1 label / ECOD on the documents feature matrix
# ---------------------------------------------------------------------------

def q_csv_roundtrip(spark, sf):
    """A1: events written as CSV into the shared checkpoint folder and scanned back with
    inferred types (date-like text stays a string)."""
    import uuid

    from anomspark.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/csv-{uuid.uuid4().hex}"
    _t(spark, sf, "events").write.option("header", "true").csv(path)
    return read_table(spark, path, fmt="csv")


def q_csv_missing(spark, sf):
    """A1: events with gaps written as CSV, the gaps as missing-value tokens, and scanned back: the token
    columns keep their number types."""
    import uuid

    from anomspark.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    token = F.element_at(F.array(*map(F.lit, ["NA", "N/A", "null", "NaN", "None", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    ev = _nulled_events(spark, sf)
    cells = ev.select("event_id", *[F.coalesce(F.col(x).cast("string"), token).alias(x)
                                    for x in ("user_id", "event_type", "value")])
    cells.write.option("header", "true").csv(path)
    back = read_table(spark, path, fmt="csv")
    types = {n: back.schema[n].dataType.simpleString() for n in back.columns}
    return back.select("event_id", r6(F.col("user_id")).alias("user_id"), "event_type", r6(F.col("value")).alias("value"),
                       F.lit(",".join(f"{n} {t}" for n, t in types.items())).alias("types"))


def q_companion_graph(spark, sf):
    """A2: ``*.json`` files whose name contains "graph" next to the tables."""
    from anomspark.sources.io import companion_graph_files
    prepare_session(spark)
    files = companion_graph_files(spark, sf)
    if files is None:
        return spark.createDataFrame([], "file_name string")
    return files


def q_drop_strings(spark, sf):
    """with encoding off, string columns leave the feature matrix."""
    ev = _t(spark, sf, "events")
    steps = {"encode_categorical": False, "exclude_id_columns": [], "text_columns": []}
    feats, spec = FE.fit_transform(ev, steps, ["event_id"])
    return _long_features(feats, ["event_id"], spec.feature_names).select(
        "event_id", F.col("column").alias("feature"), r6(F.col("value")).alias("value"))


def q_regularity_label(spark, sf):
    ev = _t(spark, sf, "events")
    o = _t(spark, sf, "orders")
    rows = []
    for label, df, col, is_dt in [("events.ts", ev, "ts", True), ("orders.o_orderdate", o, "o_orderdate", True),
                                  ("events.event_id", ev, "event_id", False)]:
        st = TM.regularity_stats(df, col, is_dt)
        lab = (F.when((F.col("n_distinct") == 1) | ((F.col("n_zero") == 0) & (F.col("min_pos_gap") == F.col("max_gap"))),
                      "regular")
               .when((F.col("mean_gap") != 0) & (F.col("sd_gap") / F.col("mean_gap") < 0.1), "near_regular")
               .otherwise("irregular"))
        rows.append(st.select(F.lit(label).alias("column_name"), lab.alias("regularity")))
    return _union(rows)


def q_ecod_documents(spark, sf):
    """G2 on the real float32 feature matrix of documents (F1-F13 then ECOD)."""
    feats, spec = _documents_feats(spark, sf)
    s = ecod(reliable_checkpoint(feats), ["doc_id"], spec.feature_names)
    return s.select("doc_id", r6(F.col("score")).alias("score"))


QUERIES.update({
    "csv_roundtrip": q_csv_roundtrip,
    "csv_missing": q_csv_missing,
    "companion_graph": q_companion_graph,
    "drop_strings": q_drop_strings,
    "regularity_label": q_regularity_label,
    "ecod_documents": q_ecod_documents,
})
