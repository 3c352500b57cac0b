"""DuckDB SQL for the query catalogue (the correctness oracle).

The SQL restates each rule independently of the Spark code; name-only predicates
(keyword lists) are evaluated here in plain Python and inlined as literals.
"""

from __future__ import annotations

import re

# Schemas of the driver tables (name, family, is_float).
SCHEMAS = {
    "events": [("event_id", "numeric", False), ("ts", "datetime", False), ("user_id", "numeric", False),
               ("event_type", "string", False), ("value", "numeric", True), ("props", "string", False)],
    "documents": [("doc_id", "numeric", False), ("text", "string", False), ("lang", "string", False),
                  ("source", "string", False), ("n_chars", "numeric", False)],
    "orders": [("o_orderkey", "numeric", False), ("o_custkey", "numeric", False),
               ("o_orderstatus", "string", False), ("o_totalprice", "numeric", True),
               ("o_orderdate", "datetime", False), ("o_orderpriority", "string", False)],
    "customer": [("c_custkey", "numeric", False), ("c_name", "string", False),
                 ("c_nationkey", "numeric", False), ("c_acctbal", "numeric", True),
                 ("c_mktsegment", "string", False)],
    "part": [("p_partkey", "numeric", False), ("p_name", "string", False), ("p_brand", "string", False),
             ("p_type", "string", False), ("p_size", "numeric", False), ("p_retailprice", "numeric", True)],
    "labels": [("doc_id", "numeric", False), ("quality", "numeric", False), ("toxic", "numeric", False)],
    "conversations": [("conv_id", "numeric", False), ("turn", "numeric", False), ("role", "string", False),
                      ("text", "string", False)],
    "supplier": [("s_suppkey", "numeric", False), ("s_name", "string", False),
                 ("s_nationkey", "numeric", False), ("s_acctbal", "numeric", True)],
    "nation": [("n_nationkey", "numeric", False), ("n_name", "string", False), ("n_regionkey", "numeric", False)],
    "region": [("r_regionkey", "numeric", False), ("r_name", "string", False)],
    "pages": [("page_id", "numeric", False), ("url", "string", False), ("html", "string", False)],
    "benchmark": [("item_id", "numeric", False), ("text", "string", False)],
    "lineitem": [("l_orderkey", "numeric", False), ("l_partkey", "numeric", False), ("l_suppkey", "numeric", False),
                 ("l_linenumber", "numeric", False), ("l_quantity", "numeric", True),
                 ("l_extendedprice", "numeric", True), ("l_discount", "numeric", True), ("l_tax", "numeric", True),
                 ("l_returnflag", "string", False), ("l_linestatus", "string", False),
                 ("l_shipdate", "datetime", False)],
}

# Keyword lists of the role rules (restated for the oracle).
_LABEL = {"label", "target", "class", "classification", "response", "ground_truth", "groundtruth",
          "anomaly", "fraud", "is_fraud", "is_anomaly", "behavior", "outlier"}
_ID = ["id", "uuid", "identifier", "customer_id", "user_id", "account_id", "transaction_id", "record_id"]
_TEXT = ["text", "message", "description", "comment", "content", "log", "error", "event"]
_TEMPORAL = ["time", "timestamp", "date", "datetime", "year", "month", "day"]
_SRC = {"source", "source_id", "src", "from"}
_TGT = {"target", "target_id", "dst", "to"}
_DUCK_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d",
                 "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y", "%Y%m%dT%H%M%S",
                 "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d %B %Y", "%H:%M:%S", "%H:%M"]
UUID_RE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _b(x: bool) -> str:
    return "TRUE" if x else "FALSE"


def _name_facts(name: str, all_names: list[str]) -> dict:
    low = name.strip().lower()
    tokens = re.split(r"[_\-\s.]+", low)
    src = [n for n in all_names if n.lower() in _SRC]
    tgt = [n for n in all_names if n.lower() in _TGT]
    structural = bool(src and tgt) and (name in src or name in tgt)
    return {
        "label": (low in _LABEL or any(t in _LABEL for t in tokens)) and not structural,
        "idname": any(re.search(rf"(^|[_\-\s]){re.escape(p)}($|[_\-\s])", low) for p in _ID),
        "textname": any(k in name.lower() for k in _TEXT),
        "tempname": any(k in name.lower() for k in _TEMPORAL),
        "structural": structural,
    }


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def duck_parse(v: str) -> str:
    fmts = ", ".join(f"'{f}'" for f in _DUCK_FORMATS)
    return f"coalesce(TRY_CAST(trim({v}) AS TIMESTAMP), try_strptime(trim({v}), [{fmts}]))"


def prof_sql(table: str, key: list[str], sample: int | None = None, source: str | None = None) -> str:
    src = source or table
    if sample is None:
        return f"(SELECT * FROM {src})"
    order = ", ".join(f"{qi(k)} DESC" for k in key)
    return f"(SELECT * FROM {src} ORDER BY {order} LIMIT {sample})"


def role_sql(table: str, key: list[str], sample: int | None = None, schema=None,
             source: str | None = None, table_label: str | None = None) -> str:
    """SQL giving (table_name, column_name, pos, family, n_rows, n_distinct, role,
    temporal_candidate, high_cardinality, label_rank)."""
    schema = schema or SCHEMAS[table]
    names = [n for n, _, _ in schema]
    ncols = len(names)
    label = table_label or table
    prof = prof_sql(table, key, sample, source)
    parts = []
    for pos, (name, fam, is_float) in enumerate(schema):
        col = qi(name)
        nf = _name_facts(name, names)
        num = fam == "numeric"
        vmin = f"min(CAST({col} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        vmax = f"max(CAST({col} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        if fam == "string":
            firsts = (f"(SELECT avg(CASE WHEN length(trim(v)) <= 64 AND {duck_parse('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS ds, "
                      f"avg(CASE WHEN regexp_matches(v, '{UUID_RE}') THEN 1.0 ELSE 0.0 END) AS us "
                      f"FROM (SELECT {col} AS v FROM p WHERE {col} IS NOT NULL))")
        else:
            firsts = "(SELECT CAST(NULL AS DOUBLE) AS ds, CAST(NULL AS DOUBLE) AS us)"
        bins = (f"(SELECT bool_or(regexp_matches(v, '[<>=!]')) AS bop, "
                f"bool_and(TRY_CAST(v AS DOUBLE) IN (0.0, 1.0) OR v IN ('true', 'false')) AS b01 "
                f"FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM p WHERE {col} IS NOT NULL))")
        parts.append(
            f"SELECT '{name}' AS column_name, {pos} AS pos, '{fam}' AS family, {_b(is_float)} AS is_float, "
            f"{_b(nf['label'])} AS name_label, {_b(nf['idname'])} AS idname, {_b(nf['textname'])} AS textname, "
            f"{_b(nf['tempname'])} AS tempname, {_b(nf['structural'])} AS structural, "
            f"s.n_rows, s.n_nonnull, s.n_distinct, s.avg_len, s.vmin, s.vmax, f.ds, f.us, b.bop, b.b01 "
            f"FROM (SELECT count(*) AS n_rows, count({col}) AS n_nonnull, count(DISTINCT {col}) AS n_distinct, "
            f"avg(length(CAST({col} AS VARCHAR))) AS avg_len, {vmin} AS vmin, {vmax} AS vmax FROM p) s, "
            f"{firsts} f, {bins} b")
    union = "\nUNION ALL\n".join(parts)
    last = ncols - 1
    return f"""
WITH p AS {prof},
st AS ({union}),
lab AS (
  SELECT *, n_distinct * 1.0 / n_rows AS ratio,
    (NOT structural AND NOT name_label AND n_distinct = 2 AND (
       (family = 'numeric' AND coalesce(b01, FALSE) AND pos = {last})
       OR (family = 'string' AND (coalesce(bop, FALSE) OR pos = {last})))) AS bin_label
  FROM st),
r AS (
  SELECT *,
    CASE WHEN idname AND ratio >= 0.5 THEN TRUE
         WHEN n_nonnull > 0 AND coalesce(us, 0.0) >= 0.8 THEN TRUE
         WHEN avg_len > 50 THEN FALSE
         WHEN n_rows >= 100 AND ratio >= 0.99 THEN TRUE
         ELSE FALSE END AS looks_id,
    CASE WHEN n_distinct <= 2 THEN TRUE
         WHEN is_float THEN FALSE
         WHEN n_nonnull = 0 THEN TRUE
         WHEN (vmax - vmin) > 20 AND n_distinct > 5 THEN FALSE
         WHEN n_distinct > greatest(10, least(20, floor(n_rows * 0.1))) THEN FALSE
         ELSE TRUE END AS num_cat
  FROM lab),
roles AS (
  SELECT *,
    CASE WHEN name_label OR bin_label THEN 'label'
         WHEN family = 'datetime' THEN 'timestamp'
         WHEN family = 'string' AND n_nonnull > 0 AND coalesce(ds, 0.0) >= 0.5 THEN 'timestamp'
         WHEN family = 'string' AND looks_id THEN 'id'
         WHEN family = 'string' AND (coalesce(avg_len, 0.0) >= 30 OR textname) THEN 'text'
         WHEN family = 'string' THEN 'categorical'
         WHEN family = 'numeric' AND looks_id THEN 'id'
         WHEN family = 'numeric' AND tempname THEN 'continuous'
         WHEN family = 'numeric' AND num_cat THEN 'categorical'
         WHEN family = 'numeric' THEN 'continuous'
         ELSE 'categorical' END AS role,
    CASE WHEN name_label THEN pos WHEN bin_label THEN {ncols} + pos END AS label_rank
  FROM r)
SELECT '{label}' AS table_name, column_name, CAST(pos AS INTEGER) AS pos, family,
  CAST(n_rows AS BIGINT) AS n_rows, CAST(n_distinct AS BIGINT) AS n_distinct,
  CAST(n_nonnull AS BIGINT) AS n_nonnull, role,
  (role = 'timestamp' OR (role = 'continuous' AND family = 'numeric' AND tempname)) AS temporal_candidate,
  (role NOT IN ('label', 'id', 'text') AND n_distinct > 20) AS high_cardinality,
  CAST(label_rank AS INTEGER) AS label_rank
FROM roles"""


# ---------------------------------------------------------------------------
# SQL of the query catalogue
# ---------------------------------------------------------------------------

ROLE_TABLES = [("events", ["event_id"]), ("documents", ["doc_id"]), ("orders", ["o_orderkey"]),
               ("customer", ["c_custkey"]), ("part", ["p_partkey"]), ("labels", ["doc_id"]),
               ("conversations", ["conv_id", "turn"]), ("supplier", ["s_suppkey"]),
               ("nation", ["n_nationkey"]), ("region", ["r_regionkey"]), ("pages", ["page_id"]),
               ("benchmark", ["item_id"]), ("lineitem", ["l_orderkey", "l_linenumber"])]
NCOLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
         "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
         "conversations": 4}


def _cols(t):
    return [n for n, _, _ in SCHEMAS[t]]


def roles_union_sql() -> str:
    return "(" + "\nUNION ALL\n".join(f"SELECT * FROM ({role_sql(t, k)})" for t, k in ROLE_TABLES) + ")"


EDGES = """(SELECT o_orderkey AS target, o_custkey AS source, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders)"""
PRICED = """(SELECT CAST(p_retailprice * 100 AS BIGINT) AS cents, p_partkey, CAST(floor(p_retailprice / 10) AS BIGINT) AS tens,
  CAST(floor(p_retailprice / 25) AS BIGINT) AS steps, p_size FROM part)"""
PRICED_SCHEMA = [(n, "numeric", False) for n in ("cents", "p_partkey", "tens", "steps", "p_size")]


def _dataset_type_sql() -> str:
    """C11 / C12 with the graph rule and the vote on lag-1 correlation in row order (D3)."""
    edges = [({"o_orderkey": "target", "o_custkey": "source"}.get(n, n), f, x) for n, f, x in SCHEMAS["orders"]]
    tables = [(t, t, SCHEMAS[t], k) for t, k in ROLE_TABLES]
    tables += [("orders_edges", EDGES, edges, ["target"]), ("parts_by_price", PRICED, PRICED_SCHEMA, ["cents", "p_partkey"])]
    roles = "\nUNION ALL\n".join(f"SELECT * FROM ({role_sql(t, k, None, sch, src, t)})" for t, src, sch, k in tables)
    corr = []
    for t, src, sch, k in tables:
        numbers = [n for n, f, _ in sch if f == "numeric"]
        if len(numbers) / len(sch) < 0.7:  # too few columns that can be continuous
            continue
        order = ", ".join(qi(x) for x in k)
        corr += [f"SELECT '{t}' AS table_name, '{n}' AS column_name, count(x) AS n, corr(x, l) AS r FROM "
                 f"(SELECT x, lag(x) OVER (ORDER BY {order}) AS l FROM (SELECT *, CAST({qi(n)} AS DOUBLE) AS x FROM {src}) "
                 f"WHERE x IS NOT NULL)" for n in numbers]
    graphs = [t for t, _, sch, _ in tables if any(_name_facts(n, [m for m, _, _ in sch])["structural"] for n, _, _ in sch)]
    return f"""
WITH roles AS ({roles}), corr AS ({" UNION ALL ".join(corr)}),
vote AS (SELECT roles.table_name, count(*) AS k, count_if(n >= 20 AND abs(r) > 0.7) AS hits
  FROM roles LEFT JOIN corr USING (table_name, column_name) WHERE role = 'continuous' GROUP BY roles.table_name),
f AS (SELECT table_name, count(*) AS ncols, max(n_rows) AS n_rows, count_if(role = 'text') AS n_text,
        count_if(role = 'timestamp') AS n_ts,
        count_if(temporal_candidate AND n_distinct >= 3 AND n_nonnull >= 10) AS n_temporal
      FROM roles GROUP BY table_name),
g AS (SELECT f.*, coalesce(n_rows >= 50 AND k / ncols >= 0.7 AND hits / k >= 0.5, FALSE) AS implicit
      FROM f LEFT JOIN vote USING (table_name))
SELECT table_name,
  CASE WHEN table_name IN ({", ".join(f"'{t}'" for t in graphs)}) THEN 'graph'
       WHEN n_text > 0 AND (n_text / ncols >= 0.3 OR n_text >= 2) THEN 'text'
       WHEN n_ts > 0 OR implicit THEN 'time_series' ELSE 'tabular' END AS dataset_type,
  (n_ts > 0 OR n_temporal > 0 OR implicit) AS is_time_series
FROM g"""


NULLED_EVENTS = """(SELECT event_id, ts,
  CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
  CASE WHEN value >= 300 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN value >= 5 THEN value END AS value, props FROM events)"""

EVENT_SERIES = """(SELECT 'value' AS column_name, value AS x, row_number() OVER (ORDER BY event_id) - 1 AS i
   FROM events WHERE value IS NOT NULL
 UNION ALL
 SELECT 'user_id', CAST(user_id AS DOUBLE), row_number() OVER (ORDER BY event_id) - 1
   FROM events WHERE user_id IS NOT NULL)"""

DAILY_ORDERS = """(SELECT 'x' AS column_name, x, row_number() OVER (ORDER BY day) - 1 AS i
   FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS x FROM orders
         WHERE o_orderdate IS NOT NULL GROUP BY 1) WHERE x IS NOT NULL)"""


def f32(expr: str) -> str:
    return f"round(CAST(CAST({expr} AS FLOAT) AS DOUBLE), 6)"


def _acf_sql(series: str, max_lags: int, cap: int) -> str:
    """(column_name, lag, acf, n) for lags 1..min(max_lags, n // cap)."""
    return f"""(WITH s AS {series},
 m AS (SELECT column_name, avg(x) AS mu, count(*) AS n FROM s GROUP BY column_name),
 dv AS (SELECT s.column_name, s.i, s.x - m.mu AS d, m.n FROM s JOIN m USING (column_name)),
 den AS (SELECT column_name, sum(d * d) AS den FROM dv GROUP BY column_name),
 ks AS (SELECT CAST(range AS INTEGER) AS lag FROM range(1, {max_lags + 1}))
 SELECT a.column_name, ks.lag, sum(a.d * b.d) / max(den.den) AS acf, max(a.n) AS n
 FROM ks JOIN dv a ON TRUE JOIN dv b ON b.column_name = a.column_name AND b.i = a.i - ks.lag
 JOIN den ON den.column_name = a.column_name
 WHERE ks.lag <= least({max_lags}, a.n // {cap})
 GROUP BY a.column_name, ks.lag)"""


def _lagged_sql(series: str, lags) -> str:
    cols = ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in lags)
    return f"(SELECT column_name, i, x, {cols} FROM {series} WINDOW w AS (PARTITION BY column_name ORDER BY i))"


def _local_z_sql(series: str) -> str:
    return f"""(WITH s AS {series},
 st AS (SELECT column_name, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM s GROUP BY column_name),
 wn AS (SELECT column_name, n, mu, sd, greatest(5, least(50, n // 20)) AS win FROM st),
 roll AS (SELECT a.column_name, a.i, a.x, avg(b.x) AS rm, stddev_samp(b.x) AS rs
          FROM s a JOIN wn ON wn.column_name = a.column_name
          JOIN s b ON b.column_name = a.column_name AND b.i BETWEEN a.i - wn.win + 1 AND a.i
          GROUP BY a.column_name, a.i, a.x)
 SELECT roll.column_name, roll.i, wn.n,
   abs((roll.x - wn.mu) / (wn.sd + 1e-8)) AS global_z,
   CASE WHEN coalesce(rs, 1e-8) = 0 THEN (CASE WHEN abs(roll.x - rm) <> 0 THEN CAST('inf' AS DOUBLE) END)
        ELSE abs(roll.x - rm) / coalesce(rs, 1e-8) END AS local_z
 FROM roll JOIN wn USING (column_name))"""


ECOD_LONG = """(SELECT event_id, 'ts_s' AS f, CAST(floor(epoch(ts)) AS DOUBLE) AS v FROM events WHERE ts IS NOT NULL
 UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id IS NOT NULL
 UNION ALL SELECT event_id, 'value', value FROM events WHERE value IS NOT NULL)"""

ECOD_RAW = f"""(WITH l AS {ECOD_LONG},
 r AS (SELECT event_id, f, v, cume_dist() OVER (PARTITION BY f ORDER BY v) AS cl,
              cume_dist() OVER (PARTITION BY f ORDER BY v DESC) AS cr FROM l),
 mu AS (SELECT f, avg(v) AS mu FROM l GROUP BY f),
 sk AS (SELECT l.f, sum(power(l.v - mu.mu, 3)) AS m3 FROM l JOIN mu USING (f) GROUP BY l.f)
 SELECT event_id, sum(CASE WHEN sign(m3) = 0 THEN -ln(cl) - ln(cr) ELSE greatest(-ln(cl), -ln(cr)) END) AS score
 FROM r JOIN sk USING (f) GROUP BY event_id)"""

ECOD_NORM = f"""(SELECT event_id, (score - mn) / (mx - mn) AS score
 FROM {ECOD_RAW} e, (SELECT min(score) AS mn, max(score) AS mx FROM {ECOD_RAW}) b)"""

ZSCORE_NORM = """(WITH z AS (SELECT event_id, abs((value - mu) / sd) AS score FROM events,
     (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events) s)
 SELECT event_id, (score - mn) / (mx - mn) AS score FROM z, (SELECT min(score) AS mn, max(score) AS mx FROM z) b)"""

ENSEMBLE = f"""(SELECT e.event_id, e.score AS score_ecod, z.score AS score_zscore,
   (e.score + z.score) / 2.0 AS anomaly_score
 FROM {ECOD_NORM} e JOIN {ZSCORE_NORM} z USING (event_id))"""

TFIDF_LONG = """(WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS toks
                FROM documents),
 terms AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(toks) AS t FROM docs) GROUP BY 1
           ORDER BY n DESC, term LIMIT 15),
 nd AS (SELECT count(*) AS n FROM docs),
 tf AS (SELECT d.doc_id, v.term, len(list_filter(d.toks, lambda x: x = v.term)) AS tf FROM docs d, terms v),
 dfc AS (SELECT term, count_if(tf > 0) AS dfc FROM tf GROUP BY term),
 w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + nd.n) / (1 + dfc.dfc)) + 1) AS w
       FROM tf JOIN dfc USING (term), nd),
 nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id)
 SELECT w.doc_id, w.term, CASE WHEN nr > 0 THEN w / nr ELSE 0.0 END AS tfidf FROM w JOIN nrm USING (doc_id))"""


def catalogue_sql() -> dict[str, str]:
    roles = roles_union_sql()
    q: dict[str, str] = {}
    q["table_shape"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_cols FROM {t}"
        for t, n in NCOLS.items())
    q["feature_sample_ratio"] = (
        "SELECT table_name, round(n_cols / n_rows, 6) AS feature_to_sample_ratio, "
        "(n_cols >= 100 OR (n_rows >= 50 AND n_cols / n_rows >= 0.1)) AS high_dimensionality "
        f"FROM ({q['table_shape']})")
    q["missing_ratio"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, round(("
        + " + ".join(f"count_if({qi(x)} IS NULL)" for x in _cols(t))
        + f") / (count(*) * {len(_cols(t))}.0), 6) AS missing_ratio FROM {t}"
        for t in ["events", "orders", "documents", "lineitem", "customer"])
    q["column_cardinality"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{x}' AS column_name, count(DISTINCT {qi(x)}) AS n_distinct, "
        f"round(count(DISTINCT {qi(x)}) / count(*), 6) AS unique_ratio FROM {t}"
        for t in ["events", "documents", "orders"] for x in _cols(t))
    strings = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"],
               "pages": ["url", "html"], "benchmark": ["text"]}
    q["avg_text_length"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{x}' AS column_name, round(avg(length({qi(x)})), 6) AS avg_len FROM {t}"
        for t, xs in strings.items() for x in xs)
    q["null_columns"] = "\nUNION ALL\n".join(
        f"SELECT '{x}' AS column_name, count_if({qi(x)} IS NULL) > 0 AS has_missing, "
        f"count_if({qi(x)} IS NULL) AS n_null FROM {NULLED_EVENTS}"
        for x in ["event_id", "ts", "user_id", "event_type", "value", "props"])
    q["obs_per_entity"] = """
SELECT 'events' AS table_name, 'user_id' AS id_columns, round(avg(cnt), 6) AS observations_per_entity
  FROM (SELECT count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
UNION ALL
SELECT 'events', 'user_id,event_type', round(avg(cnt), 6)
  FROM (SELECT count(*) AS cnt FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL
        GROUP BY user_id, event_type)
UNION ALL
SELECT 'orders', 'o_custkey', round(avg(cnt), 6)
  FROM (SELECT count(*) AS cnt FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)"""
    q["temporal_min_max"] = f"""
SELECT 'events.ts' AS column_name, min(ts) AS min_value, max(ts) AS max_value FROM events
UNION ALL SELECT 'orders.o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders
UNION ALL SELECT 'orders.o_orderdate_text', min(p), max(p)
  FROM (SELECT {duck_parse('CAST(o_orderdate AS VARCHAR)')} AS p FROM orders)"""
    q["class_balance"] = """
WITH h AS (SELECT 'toxic' AS label_column, toxic AS value, count(*) AS cnt FROM labels WHERE toxic IS NOT NULL GROUP BY toxic
           UNION ALL
           SELECT 'quality', quality, count(*) FROM labels WHERE quality IS NOT NULL GROUP BY quality),
 f AS (SELECT *, cnt * 1.0 / sum(cnt) OVER (PARTITION BY label_column) AS share FROM h),
 m AS (SELECT label_column, min(share) AS imb, count(*) AS k FROM f GROUP BY label_column)
SELECT f.label_column, CAST(f.value AS INTEGER) AS value, f.cnt, round(f.share, 6) AS share,
  CASE WHEN m.k = 1 THEN 'semi-supervised' WHEN m.imb < 0.05 THEN 'semi-supervised' ELSE 'supervised' END
    AS supervision_level,
  round(CASE WHEN m.k = 1 THEN 0.0 ELSE m.imb END, 6) AS imbalance_ratio
FROM f JOIN m USING (label_column)"""
    q["column_roles"] = f"SELECT * FROM {roles}"
    q["id_columns"] = f"SELECT table_name, column_name FROM {roles} WHERE role = 'id'"
    q["text_columns"] = f"SELECT table_name, column_name FROM {roles} WHERE role = 'text'"
    q["label_columns"] = f"SELECT table_name, column_name, label_rank FROM {roles} WHERE role = 'label'"
    q["numeric_categorical"] = (
        f"SELECT table_name, column_name, role = 'categorical' AS is_categorical FROM {roles} "
        "WHERE family = 'numeric' AND role IN ('categorical', 'continuous')")
    q["high_cardinality"] = f"SELECT table_name, column_name, n_distinct FROM {roles} WHERE high_cardinality"
    year_schema = SCHEMAS["orders"] + [("order_year", "numeric", False)]
    q["numeric_temporal"] = (
        "SELECT column_name, role, temporal_candidate FROM ("
        + role_sql("orders", ["o_orderkey"], schema=year_schema,
                   source="(SELECT *, CAST(year(o_orderdate) AS INTEGER) AS order_year FROM orders)")
        + ")")
    edge_schema = [("target", "numeric", False), ("source", "numeric", False)] + SCHEMAS["orders"][2:]
    q["graph_columns"] = (
        "SELECT column_name, role, column_name IN ('source', 'target') AS graph_structural FROM ("
        + role_sql("orders", ["target"], schema=edge_schema,
                   source="(SELECT o_orderkey AS target, o_custkey AS source, o_orderstatus, o_totalprice, "
                          "o_orderdate, o_orderpriority FROM orders)")
        + ")")
    text_schema = [(n, "string" if n == "o_orderdate" else f, fl) for n, f, fl in SCHEMAS["orders"]]
    q["string_datetime"] = (
        "SELECT column_name, family, role FROM ("
        + role_sql("orders", ["o_orderkey"], schema=text_schema,
                   source="(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                          "CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders)")
        + ")")
    q["role_ratios"] = f"""
SELECT table_name,
  round(count_if(role = 'continuous') / count(*), 6) AS numeric_ratio,
  round(count_if(role = 'categorical') / count(*), 6) AS categorical_ratio,
  round(count_if(role = 'text') / count(*), 6) AS text_ratio,
  round(count_if(role = 'id') / count(*), 6) AS id_ratio
FROM {roles} GROUP BY table_name"""
    q["dataset_type"] = _dataset_type_sql()
    lag5 = _lagged_sql(EVENT_SERIES, [1, 2, 7, 12, 24])
    q["lag_autocorr"] = "\nUNION ALL\n".join(
        f"SELECT column_name, {k} AS lag, round(corr(x, l{k}), 6) AS autocorr, count(x) AS n "
        f"FROM {lag5} GROUP BY column_name" for k in [1, 2, 7, 12, 24])
    q["implicit_series"] = (
        "SELECT column_name, round(corr(x, l1), 6) AS autocorr, "
        "coalesce(count(x) >= 20 AND abs(corr(x, l1)) > 0.7, FALSE) AS high_autocorr "
        f"FROM {_lagged_sql(EVENT_SERIES, [1])} GROUP BY column_name")
    acf40 = _acf_sql(DAILY_ORDERS, 40, 2)
    q["acf_values"] = f"SELECT lag, round(acf, 6) AS acf, n FROM {acf40}"
    q["acf_flags"] = f"""
WITH a AS (SELECT lag, acf FROM {acf40}),
 fa AS (SELECT 0 AS lag, 1.0 AS acf UNION ALL SELECT lag, acf FROM a)
SELECT coalesce((SELECT max(CASE WHEN lag = 1 THEN acf END) > 0.7 AND max(CASE WHEN lag = 5 THEN acf END) > 0.4
                 FROM fa), FALSE) AS has_trend,
       coalesce((SELECT bool_or(b.acf > a.acf AND b.acf > c.acf AND b.acf > 0.3)
                 FROM fa a JOIN fa b ON b.lag = a.lag + 1 JOIN fa c ON c.lag = b.lag + 1
                 WHERE b.lag >= 2), FALSE) AS has_seasonality"""
    sv = f"""(WITH s AS {EVENT_SERIES}, n AS (SELECT column_name, count(*) AS n FROM s GROUP BY column_name)
 SELECT s.column_name, var_samp(CASE WHEN i < n // 2 THEN x END) AS var1,
        var_samp(CASE WHEN i >= n // 2 THEN x END) AS var2
 FROM s JOIN n USING (column_name) GROUP BY s.column_name)"""
    q["split_variance"] = (
        "SELECT column_name, round(var1, 6) AS var1, round(var2, 6) AS var2, "
        "coalesce(var1 > 0 AND var2 / var1 > 0.5 AND var2 / var1 < 2.0, FALSE) AS stationary "
        f"FROM {sv}")
    rt = f"""(WITH s AS {EVENT_SERIES},
 st AS (SELECT column_name, count(*) AS n, var_samp(x) AS var_x, CAST(least(20, count(*) // 5) AS INTEGER) AS win
        FROM s GROUP BY column_name),
 rm AS (SELECT a.column_name, a.i, avg(b.x) AS rm FROM s a JOIN st ON st.column_name = a.column_name
        JOIN s b ON b.column_name = a.column_name AND b.i BETWEEN a.i - st.win + 1 AND a.i
        WHERE a.i >= st.win - 1 GROUP BY a.column_name, a.i)
 SELECT st.column_name, st.win, var_samp(rm.rm) AS var_rm, max(st.var_x) AS var_x
 FROM st JOIN rm USING (column_name) GROUP BY st.column_name, st.win)"""
    q["rolling_trend"] = ("SELECT column_name, win, round(var_rm, 6) AS var_rm, "
                          f"coalesce(var_rm > var_x * 0.5, FALSE) AS trend FROM {rt}")
    lag3 = _lagged_sql(EVENT_SERIES, [7, 12, 24])
    ls = ("(SELECT column_name, coalesce(bool_or(lag < n // 2 AND abs(r) > 0.4), FALSE) AS seasonal FROM ("
          + "\nUNION ALL\n".join(f"SELECT column_name, {k} AS lag, corr(x, l{k}) AS r, count(x) AS n "
                                 f"FROM {lag3} GROUP BY column_name" for k in [7, 12, 24])
          + ") GROUP BY column_name)")
    q["lag_seasonality"] = f"SELECT column_name, seasonal FROM {ls}"
    q["temporal_vote"] = f"""
WITH sv AS (SELECT column_name, coalesce(var1 > 0 AND var2 / var1 > 0.5 AND var2 / var1 < 2.0, FALSE) AS st FROM {sv}),
 rt AS (SELECT column_name, coalesce(var_rm > var_x * 0.5, FALSE) AS tr FROM {rt}),
 ls AS {ls},
 j AS (SELECT * FROM sv JOIN rt USING (column_name) JOIN ls USING (column_name))
SELECT count_if(st) >= count(*) / 2.0 AS is_stationary, count_if(tr) >= count(*) * 0.2 AS has_trend,
       count_if(seasonal) >= count(*) * 0.2 AS has_seasonality FROM j"""
    reg = []
    for label, expr, tbl in [("events.ts", "epoch_us(ts)", "events"),
                             ("orders.o_orderdate", "epoch_us(o_orderdate)", "orders"),
                             ("events.event_id", "CAST(event_id AS DOUBLE)", "events")]:
        reg.append(f"""SELECT '{label}' AS column_name, (SELECT count(*) FROM (SELECT {expr} AS v FROM {tbl}) WHERE v IS NOT NULL) AS n,
  round(avg(g), 6) AS mean_gap, round(stddev_samp(g), 6) AS sd_gap, count_if(g = 0) AS n_zero
FROM (SELECT (v - lag(v) OVER (ORDER BY v)) / {1e6 if 'epoch_us' in expr else 1.0} AS g FROM (SELECT {expr} AS v FROM {tbl}) WHERE v IS NOT NULL)
WHERE g IS NOT NULL""")
    q["temporal_regularity"] = "\nUNION ALL\n".join(reg)
    value_series = f"(SELECT * FROM {EVENT_SERIES} WHERE column_name = 'value')"
    q["global_local_z"] = (f"SELECT CAST(i AS BIGINT) AS idx, round(global_z, 6) AS global_z, "
                           f"round(local_z, 6) AS local_z FROM {_local_z_sql(value_series)}")
    acf10 = _acf_sql(EVENT_SERIES, 10, 4)
    q["collective_ratio"] = f"""
WITH a AS (SELECT column_name, avg(abs(acf)) AS mean_abs_acf FROM {acf10} GROUP BY column_name),
 z AS (SELECT column_name, max(n) AS n, avg(CASE WHEN global_z <= 3.0 AND local_z > 3.0 THEN 1.0 ELSE 0.0 END) AS cr
       FROM {_local_z_sql(EVENT_SERIES)} GROUP BY column_name)
SELECT z.column_name, round(a.mean_abs_acf, 6) AS mean_abs_acf, round(z.cr, 6) AS candidate_ratio,
  coalesce(z.n >= 30 AND coalesce(a.mean_abs_acf, 0.0) >= 0.25 AND z.cr > 0.01, FALSE) AS collective
FROM z LEFT JOIN a USING (column_name)"""
    q["tail_sample"] = "SELECT event_id, ts, user_id, value FROM events ORDER BY event_id DESC LIMIT 2500"
    q["head_sample"] = """
SELECT column_name, rn, value FROM (
  SELECT 'event_type' AS column_name, row_number() OVER (ORDER BY event_id) AS rn, event_type AS value
    FROM events WHERE event_type IS NOT NULL
  UNION ALL
  SELECT 'props', row_number() OVER (ORDER BY event_id), props FROM events WHERE props IS NOT NULL)
WHERE rn <= 100"""
    q["epoch_features"] = "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events"
    q["median_impute"] = f"""
WITH ne AS {NULLED_EVENTS},
 m AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), 0.5) AS mu, quantile_cont(value, 0.5) AS mv FROM ne)
SELECT event_id, {f32('coalesce(CAST(user_id AS DOUBLE), mu)')} AS user_id, {f32('coalesce(value, mv)')} AS value
FROM ne, m"""
    q["mode_impute"] = f"""
WITH ne AS {NULLED_EVENTS},
 md AS (SELECT event_type AS mode FROM ne WHERE event_type IS NOT NULL GROUP BY event_type
        ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT mode FROM md)) AS event_type FROM ne"""
    q["ffill_bfill"] = f"""
SELECT event_id,
  round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value,
  CAST(coalesce(last_value(user_id IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(user_id IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS user_id
FROM {NULLED_EVENTS}"""
    q["one_hot"] = """
WITH v AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
SELECT d.doc_id, 'lang_' || v.lang AS feature, CASE WHEN d.lang = v.lang THEN 1.0 ELSE 0.0 END AS value
FROM documents d, v"""
    freq = """(SELECT source AS v, count(*) * 1.0 / sum(count(*)) OVER () AS share
  FROM documents WHERE source IS NOT NULL GROUP BY source)"""
    q["freq_encode"] = (f"SELECT d.doc_id, {f32('coalesce(f.share, 0.0)')} AS source "
                        f"FROM documents d LEFT JOIN {freq} f ON d.source = f.v")
    rs = []
    for name, expr in [("ts", "CAST(floor(epoch(ts)) AS DOUBLE)"), ("user_id", "CAST(user_id AS DOUBLE)"),
                       ("value", "value")]:
        rs.append(f"(SELECT quantile_cont({expr}, 0.25) AS q1_{name}, quantile_cont({expr}, 0.5) AS md_{name}, "
                  f"quantile_cont({expr}, 0.75) AS q3_{name} FROM events)")
    scaled = []
    for name, expr in [("ts", "CAST(floor(epoch(ts)) AS DOUBLE)"), ("user_id", "CAST(user_id AS DOUBLE)"),
                       ("value", "value")]:
        iqr = f"(CASE WHEN q3_{name} - q1_{name} = 0 THEN 1.0 ELSE q3_{name} - q1_{name} END)"
        scaled.append(f"{f32(f'({expr} - md_{name}) / {iqr}')} AS {name}")
    q["robust_scale"] = (f"SELECT event_id, {', '.join(scaled)} FROM events, " + ", ".join(rs))
    q["tfidf"] = f"SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM {TFIDF_LONG}"
    freq_f = f"""(SELECT d.doc_id, CAST(CAST(coalesce(f.share, 0.0) AS FLOAT) AS DOUBLE) AS v
   FROM documents d LEFT JOIN {freq} f ON d.source = f.v)"""
    nchar = "(SELECT doc_id, CAST(n_chars AS DOUBLE) AS v FROM documents)"

    def scaled_long(src, name, pos):
        return f"""SELECT s.doc_id, '{name}' AS feature, {pos} AS pos,
  {f32(f'(s.v - q.md) / (CASE WHEN q.q3 - q.q1 = 0 THEN 1.0 ELSE q.q3 - q.q1 END)')} AS value
FROM {src} s, (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3 FROM {src}) q"""
    q["feature_matrix"] = f"""
{scaled_long(freq_f, 'source', 0)}
UNION ALL
{scaled_long(nchar, 'n_chars', 1)}
UNION ALL
SELECT doc_id, 'text_tfidf_' || term AS feature,
  CAST(1 + row_number() OVER (PARTITION BY doc_id ORDER BY term) AS INTEGER) AS pos, {f32('tfidf')} AS value
FROM {TFIDF_LONG}
UNION ALL
SELECT d.doc_id, 'lang_' || v.lang AS feature,
  CAST(16 + dense_rank() OVER (ORDER BY v.lang) AS INTEGER) AS pos,
  CASE WHEN d.lang = v.lang THEN 1.0 ELSE 0.0 END AS value
FROM documents d, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) v"""
    q["ecod"] = f"SELECT event_id, round(score, 6) AS score FROM {ECOD_RAW}"
    q["minmax_scores"] = f"SELECT event_id, round(score, 6) AS score FROM {ECOD_NORM}"
    q["ensemble"] = (f"SELECT event_id, round(score_ecod, 6) AS score_ecod, round(score_zscore, 6) AS score_zscore, "
                     f"round(anomaly_score, 6) AS anomaly_score FROM {ENSEMBLE}")
    q["three_sigma"] = (f"SELECT event_id, anomaly_score >= thr AS is_anomaly FROM {ENSEMBLE} e, "
                        f"(SELECT avg(anomaly_score) + 3 * stddev_pop(anomaly_score) AS thr FROM {ENSEMBLE}) t")
    q["score_summary"] = f"""
WITH e AS {ENSEMBLE}, s AS (SELECT count(anomaly_score) AS rows, avg(anomaly_score) AS mean_score,
                              stddev_pop(anomaly_score) AS std_score FROM e)
SELECT rows, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score,
  round(mean_score + 3 * std_score, 6) AS threshold,
  (SELECT count_if(anomaly_score >= mean_score + 3 * std_score) FROM e) AS anomalies,
  round((SELECT count_if(anomaly_score >= mean_score + 3 * std_score) FROM e) * 100.0 / rows, 6) AS anomaly_pct
FROM s"""
    q["detector_summary"] = (f"SELECT 'ecod' AS detector, round(avg(score), 6) AS mean_score FROM {ECOD_NORM} "
                             f"UNION ALL SELECT 'zscore', round(avg(score), 6) FROM {ZSCORE_NORM}")
    return q


KNN_PAIRS = """(WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
 d AS (SELECT a.vec_id AS q, b.vec_id AS nb, array_distance(a.v, b.v) AS dist
       FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, nb) AS rk FROM d)
 SELECT q, nb, dist FROM r WHERE rk <= 20)"""


def detector_sql() -> dict[str, str]:
    return {
        "knn": f"SELECT q AS vec_id, nb AS nbr_vec_id, round(dist, 6) AS dist FROM {KNN_PAIRS}",
        "lof": f"""
WITH k AS {KNN_PAIRS},
 kd AS (SELECT q, max(dist) AS kdist FROM k GROUP BY q),
 rd AS (SELECT k.q, greatest(k.dist, kd.kdist) AS reach FROM k JOIN kd ON kd.q = k.nb),
 lrd AS (SELECT q, 1.0 / (avg(reach) + 1e-10) AS lrd FROM rd GROUP BY q),
 lf AS (SELECT k.q, avg(l2.lrd) / max(l1.lrd) AS lof FROM k JOIN lrd l2 ON l2.q = k.nb
        JOIN lrd l1 ON l1.q = k.q GROUP BY k.q)
SELECT q AS vec_id, round(lof, 6) AS lof FROM lf""",
    }


def _doc_features_raw() -> str:
    """documents feature matrix in long form with float32 values (unrounded)."""
    freq = """(SELECT source AS v, count(*) * 1.0 / sum(count(*)) OVER () AS share
  FROM documents WHERE source IS NOT NULL GROUP BY source)"""
    freq_f = f"""(SELECT d.doc_id, CAST(CAST(coalesce(f.share, 0.0) AS FLOAT) AS DOUBLE) AS v
   FROM documents d LEFT JOIN {freq} f ON d.source = f.v)"""
    nchar = "(SELECT doc_id, CAST(n_chars AS DOUBLE) AS v FROM documents)"

    def scaled(src, name):
        return f"""SELECT s.doc_id, '{name}' AS f,
  CAST(CAST((s.v - q.md) / (CASE WHEN q.q3 - q.q1 = 0 THEN 1.0 ELSE q.q3 - q.q1 END) AS FLOAT) AS DOUBLE) AS v
FROM {src} s, (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3 FROM {src}) q"""
    return f"""({scaled(freq_f, 'source')}
UNION ALL {scaled(nchar, 'n_chars')}
UNION ALL SELECT doc_id, 'text_tfidf_' || term, CAST(CAST(tfidf AS FLOAT) AS DOUBLE) FROM {TFIDF_LONG}
UNION ALL SELECT d.doc_id, 'lang_' || v.lang, CASE WHEN d.lang = v.lang THEN 1.0 ELSE 0.0 END
  FROM documents d, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) v)"""


def extra_sql() -> dict[str, str]:
    reg = []
    for label, expr, tbl in [("events.ts", "epoch_us(ts)", "events"),
                             ("orders.o_orderdate", "epoch_us(o_orderdate)", "orders"),
                             ("events.event_id", "CAST(event_id AS DOUBLE)", "events")]:
        reg.append(f"""SELECT '{label}' AS column_name,
  CASE WHEN count(DISTINCT g) = 1 THEN 'regular'
       WHEN avg(g) <> 0 AND stddev_samp(g) / avg(g) < 0.1 THEN 'near_regular'
       ELSE 'irregular' END AS regularity
FROM (SELECT (v - lag(v) OVER (ORDER BY v)) / {1e6 if 'epoch_us' in expr else 1.0} AS g FROM (SELECT {expr} AS v FROM {tbl}) WHERE v IS NOT NULL)
WHERE g IS NOT NULL""")
    long = _doc_features_raw()
    ecod_docs = f"""
WITH l AS {long},
 r AS (SELECT doc_id, f, v, cume_dist() OVER (PARTITION BY f ORDER BY v) AS cl,
              cume_dist() OVER (PARTITION BY f ORDER BY v DESC) AS cr FROM l),
 mu AS (SELECT f, avg(v) AS mu FROM l GROUP BY f),
 sk AS (SELECT l.f, sum(power(l.v - mu.mu, 3)) AS m3 FROM l JOIN mu USING (f) GROUP BY l.f)
SELECT doc_id, round(sum(CASE WHEN sign(m3) = 0 THEN -ln(cl) - ln(cr) ELSE greatest(-ln(cl), -ln(cr)) END), 6) AS score
FROM r JOIN sk USING (f) GROUP BY doc_id"""
    return {
        "drop_strings": """
SELECT event_id, feature, value FROM (
  SELECT event_id, 'ts' AS feature, round(CAST(CAST(floor(epoch(ts)) AS FLOAT) AS DOUBLE), 6) AS value FROM events
  UNION ALL SELECT event_id, 'user_id', round(CAST(CAST(user_id AS FLOAT) AS DOUBLE), 6) FROM events
  UNION ALL SELECT event_id, 'value', round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) FROM events)
WHERE value IS NOT NULL""",
        "regularity_label": "\nUNION ALL\n".join(reg),
        "csv_missing": f"""
SELECT event_id, round(CAST(user_id AS DOUBLE), 6) AS user_id, event_type, round(value, 6) AS value,
  'event_id bigint,user_id double,event_type string,value double' AS types FROM {NULLED_EVENTS}""",
        "ecod_documents": ecod_docs,
    }
