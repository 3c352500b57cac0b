"""Preprocessing (F1-F13): from a raw table to an ordered float feature frame.

Fitting computes only small things -- vocabularies, medians, modes, one-hot value
lists, quartiles -- with aggregate jobs (histograms + exact quantiles, never a single
task per column).  Frequency tables stay DataFrames and are joined by digest (broadcast
only up to a counted number of rows).  The transform is then projections plus those joins;
it neither needs a unique key nor changes the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anomspark.functions import rules as R
from anomspark.operators.histogram import (DIGEST, by_digest, digest, digest_histogram, exact_quantiles, frequencies,
                                           modes_of, value_histogram)
from anomspark.plans.ordering import DEFAULT_BLOCK_ROWS, c, group_index
from anomspark.session import reliable_checkpoint
from anomspark.sources.io import spread

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)


@dataclass
class FeatureSpec:
    key: list[str]
    dropped: list[str] = field(default_factory=list)
    feature_names: list[str] = field(default_factory=list)
    text_vocab: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    categorical: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    freq_encoded: list[str] = field(default_factory=list)
    scaled: dict[str, tuple[float, float]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def tokens_expr(col: Column) -> Column:
    """F3 tokeniser: lower-case, runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(R.TOKEN_PATTERN), 0)


def corpus_terms(df: DataFrame, text_col: str, max_terms: int = R.TFIDF_TERMS) -> list[str]:
    """Top ``max_terms`` terms by corpus count, ties alphabetical.  Counts are summed per term in the map task
    first, so one row per task and term is shuffled."""
    rows = spread(df.select(c(text_col))).select(F.explode(tokens_expr(c(text_col))).alias("term"))
    per_term = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [r["term"] for r in per_term.orderBy(F.desc("n"), F.asc("term")).limit(max_terms).collect()]


def _idf(term: str, n_docs: int, holding: int) -> tuple[str, float]:
    return term, math.log((1 + n_docs) / (1 + holding)) + 1.0


def fit_vocabulary(df: DataFrame, text_col: str, max_terms: int = R.TFIDF_TERMS) -> list[tuple[str, float]]:
    """Top ``max_terms`` terms by corpus count (ties alphabetical) with smooth idf.

    Document frequencies are counted for the chosen terms alone, over all rows.
    Returns ``[(term, idf)]`` sorted alphabetically (the feature order)."""
    terms = corpus_terms(df, text_col, max_terms)
    if not terms:
        return []
    found = F.array_distinct(F.filter(tokens_expr(c(text_col)), lambda t: t.isin(terms)))
    holding = spread(df.select(c(text_col))).select(F.explode(found).alias("term")).groupBy("term").count()
    rows = {r["term"]: r["count"] for r in holding.collect()}
    n_docs = df.count()
    return sorted(_idf(t, n_docs, rows[t]) for t in terms)


def term_counts(text: Column, terms: list[str]) -> Column:
    """How often each of ``terms`` stands in a text, as an array: no explode, no shuffle, no key."""
    found = F.filter(tokens_expr(text), lambda t: t.isin(terms))
    # array_remove of one term leaves the others: the difference in size is the term's count
    return F.transform(F.array(found), lambda v: F.array(*[F.size(v) - F.size(F.array_remove(v, t)) for t in terms]))[0]


def _normalised(counts: Column, idfs: list[float]) -> Column:
    """L2-normalised tf-idf of an array of counts."""
    weights = F.transform(F.array(counts), lambda n: F.array(*[n[i] * F.lit(idf) for i, idf in enumerate(idfs)]))
    return F.transform(weights, lambda w: F.transform(
        F.array(F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))),
        lambda norm: F.transform(w, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))[0])[0]


def tfidf_weights(text: Column, vocab: list[tuple[str, float]]) -> Column:
    """L2-normalised tf-idf of one text as an array in vocabulary order, worked out inside the row."""
    return _normalised(term_counts(text, [t for t, _ in vocab]), [idf for _, idf in vocab])


def tfidf_columns(array: Column, text_col: str, vocab: list[tuple[str, float]]) -> list[Column]:
    """The entries of a :func:`tfidf_weights` array as ``<text_col>_tfidf_<term>`` columns."""
    return [F.get(array, F.lit(i)).alias(f"{text_col}_tfidf_{t}") for i, (t, _) in enumerate(vocab)]


def tfidf_frame(df: DataFrame, text_col: str, vocab: list[tuple[str, float]], key: Sequence[str]) -> DataFrame:
    """key... + ``<text_col>_tfidf_<term>`` columns for every row of ``df``."""
    rows = df.select(*[c(k) for k in key], tfidf_weights(c(text_col), vocab).alias("__tfidf"))
    return rows.select(*[c(k) for k in key], *tfidf_columns(F.col("__tfidf"), text_col, vocab))


def _median_map(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    if not cols:
        return {}
    hist = value_histogram(df, cols, "double")
    rows = exact_quantiles(hist, [0.5]).collect()
    return {r["column"]: r["value"] for r in rows}


def _quartiles(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    if not cols:
        return {}
    hist = value_histogram(df, cols, "double")
    out: dict[str, dict[float, float]] = {}
    for r in exact_quantiles(hist, [0.25, 0.5, 0.75]).collect():
        out.setdefault(r["column"], {})[round(r["q"], 2)] = r["value"]
    return {k: (v.get(0.25), v.get(0.5), v.get(0.75)) for k, v in out.items()}


def ffill_bfill(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str],
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """forward fill then backward fill in row order, block by block with a carry.

    Each block (``block_rows`` rows) fills from inside; the carry is the last non-null
    value of the preceding blocks (a table of one row per block), and values before
    the first non-null take the column's first non-null value.
    """
    indexed = group_index(df, order_cols, (), "_idx")
    blk = F.floor(F.col("_idx") / block_rows).cast("long")
    indexed = indexed.withColumn("_blk", blk)
    per_block = indexed.groupBy("_blk").agg(
        *[F.max_by(c(x), F.when(c(x).isNotNull(), F.col("_idx"))).alias(f"_last{i}") for i, x in enumerate(cols)])
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carry = per_block.select("_blk", *[F.last(f"_last{i}", True).over(wb).alias(f"_carry{i}")
                                       for i in range(len(cols))])
    firsts = indexed.agg(*[F.min_by(c(x), F.when(c(x).isNotNull(), F.col("_idx"))).alias(f"_first{i}")
                           for i, x in enumerate(cols)]).first()
    w = Window.partitionBy("_blk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = indexed.join(carry, "_blk", "left")
    types = dict(df.dtypes)
    filled = []
    for i, x in enumerate(cols):
        first = F.lit(firsts[i]).cast(types[x])
        filled.append(F.coalesce(F.last(c(x), True).over(w), F.col(f"_carry{i}"), first).alias(x))
    others = [c(x) for x in df.columns if x not in cols]
    return joined.select(*others, *filled, "_idx").select(*[c(x) for x in df.columns], "_idx")


def fit_transform(df: DataFrame, steps: dict[str, Any], key: Sequence[str],
                  meta: dict[str, Any] | None = None, order_by: Sequence[str] | None = None,
                  drop_all_null: bool = True) -> tuple[DataFrame, FeatureSpec]:
    """Fit the preprocessing plan on ``df`` and return (features, spec).

    ``features`` has the key columns followed by the feature columns (``float``) in
    the reference's order.  ``steps`` is the routed ``preprocessing_steps``.
    """
    key = list(key)
    spec = FeatureSpec(key=key)
    ids = [x for x in steps.get("exclude_id_columns") or [] if x in df.columns]
    labels = [x for x in steps.get("exclude_label_columns") or [] if x in df.columns]
    text_cols = list(steps.get("text_columns") or [])
    spec.dropped = list(dict.fromkeys(ids + labels))

    # F1 drop, F2 datetimes -> epoch seconds
    order: list[str] = []
    exprs: dict[str, Column] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in df.columns:
        if name in spec.dropped or name in key:
            continue
        col = c(name)
        if isinstance(types[name], DATETIME_TYPES):
            col = F.unix_seconds(col.cast("timestamp"))
            types[name] = T.LongType()
        order.append(name)
        exprs[name] = col.alias(name)

    # F3 tf-idf: one array column per text, split into columns in the final projection; tf-idf
    # columns are never imputed, encoded or scaled, so the fitting jobs prune the array.  Texts are read
    # for the terms and once more for their counts in each row, which are fixed in a checkpoint: the
    # document frequencies and all later jobs read rows without texts.
    terms: dict[str, list[str]] = {}
    arrays: dict[str, Column] = {}
    deferred: dict[str, Column] = {}
    for tcol in text_cols:
        if tcol not in order:
            continue
        found = sorted(corpus_terms(df, tcol))
        order.remove(tcol)
        del exprs[tcol]
        if not found:
            spec.notes.append(f"{tcol}: empty vocabulary, column dropped")
            continue
        terms[tcol] = found

    def live() -> list[str]:
        return [n for n in order if n not in deferred]

    if terms:
        counted = reliable_checkpoint(df.select(*[c(k) for k in key], *[exprs[n] for n in live()], *[
            term_counts(c(tcol), found).alias(f"__tfidf{i}") for i, (tcol, found) in enumerate(terms.items())]))
        n_docs, *holding = counted.agg(F.count(F.lit(1)), *[
            F.count_if(F.col(f"__tfidf{i}")[j] > 0) for i, found in enumerate(terms.values()) for j in range(len(found))]).first()
        left = iter(holding)
        for i, (tcol, found) in enumerate(terms.items()):
            vocab = spec.text_vocab[tcol] = [_idf(t, n_docs, next(left)) for t in found]
            name = f"__tfidf{i}"
            arrays[name] = _normalised(F.col(name), [idf for _, idf in vocab]).alias(name)
            for (t, _), colx in zip(vocab, tfidf_columns(F.col(name), tcol, vocab), strict=True):
                nm = f"{tcol}_tfidf_{t}"
                order.append(nm)
                deferred[nm] = colx
                types[nm] = T.DoubleType()
        work = counted.select(*[c(k) for k in key], *arrays.values(), *[c(n) for n in live()])
    else:
        work = df.select(*[c(k) for k in key], *[exprs[n] for n in live()])
    along = [*key, *arrays]  # carried through every step

    def stage(frame: DataFrame, names: list[str], ex: dict[str, Column]) -> DataFrame:
        return frame.select(*[c(k) for k in along], *[ex[n].alias(n) for n in names if n not in deferred])

    # F4 dtype split
    categorical = [n for n in live() if isinstance(types[n], T.StringType)]
    continuous = [n for n in live() if n not in categorical and isinstance(types[n], NUMERIC_TYPES + (T.LongType,))]
    spec.categorical, spec.continuous = categorical, continuous
    cur = {n: c(n) for n in live()}

    # F5 / F6 / F7 imputation
    if steps.get("impute_missing"):
        is_ts = bool(meta.get("is_time_series")) if meta else False
        if is_ts:
            work = ffill_bfill(work, live(), order_by or key)
        else:
            meds = _median_map(work, continuous)
            for n in continuous:
                if meds.get(n) is None:
                    if drop_all_null:
                        order.remove(n)
                        spec.notes.append(f"{n}: all values missing, column dropped")
                        cur.pop(n)
                    continue
                spec.medians[n] = meds[n]
                cur[n] = F.coalesce(c(n).cast("double"), F.lit(meds[n]))
            continuous = [n for n in continuous if n in order]
            if categorical:
                nulls = work.agg(*[F.count_if(c(n).isNull()).alias(f"n{i}") for i, n in enumerate(categorical)]).first()
                with_nulls = [n for i, n in enumerate(categorical) if nulls[f"n{i}"] > 0]
                for n, mode in (modes_of(work, with_nulls) if with_nulls else {}).items():
                    spec.modes[n] = mode
                    cur[n] = F.coalesce(c(n), F.lit(mode))
            work = stage(work, order, cur)
            cur = {n: c(n) for n in live()}

    # F8 / F9 / F10 encoding
    if steps.get("encode_categorical") and categorical:
        hist = digest_histogram(work, categorical)
        counts = {r["column"]: r["k"] for r in hist.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        small = [n for n in categorical if counts.get(n, 0) <= R.ONE_HOT_MAX_DISTINCT]
        if small:  # at most five values each: these few are fetched
            vals = value_histogram(work, small).select("column", "value").collect()
            for n in small:
                spec.one_hot[n] = sorted(r["value"] for r in vals if r["column"] == n)
        freq = frequencies(hist)
        for i, n in enumerate(x for x in categorical if x not in spec.one_hot):
            spec.freq_encoded.append(n)
            d = [f"__{x}_{i}" for x in DIGEST]
            share = freq.where(F.col("column") == n).select(
                *[F.col(x).alias(y) for x, y in zip(DIGEST, d, strict=True)],
                F.col("share").cast("float").cast("double").alias(f"__share_{i}"))
            own = digest(c(n), T.StringType())
            match = [F.col(y) == x for x, y in zip(own, d, strict=True)]
            work = work.join(by_digest(share, counts[n]), match[0] & match[1] & match[2], "left").drop(*d)
            cur[n] = F.coalesce(F.col(f"__share_{i}"), F.lit(0.0))
        for n in small:
            order.remove(n)
            cur.pop(n)
            for v in spec.one_hot[n]:
                nm = f"{n}_{v}"
                order.append(nm)
                cur[nm] = F.coalesce((c(n) == F.lit(v)).cast("double"), F.lit(0.0))
        work = stage(work, order, cur)
    else:
        for n in categorical:
            order.remove(n)
            cur.pop(n)
        work = stage(work, order, cur)
    cur = {n: c(n) for n in live()}

    # F11 / F12 robust scaling
    prefixes = tuple(f"{x}_" for x in categorical)
    to_scale = [n for n in live() if "_tfidf_" not in n and not (prefixes and n.startswith(prefixes))]
    if steps.get("scale_continuous") and to_scale:
        quart = _quartiles(work.select(*[c(k) for k in key], *[c(n).cast("float").cast("double").alias(n)
                                                                  if n in spec.freq_encoded else c(n).cast("double").alias(n)
                                                                  for n in to_scale]), to_scale)
        for n in to_scale:
            q1, med, q3 = quart.get(n, (None, None, None))
            if med is None:
                continue
            iqr = (q3 - q1) if q1 is not None and q3 is not None else 0.0
            scale = iqr if iqr != 0 else 1.0
            spec.scaled[n] = (med, scale)
            cur[n] = (c(n).cast("double") - F.lit(med)) / F.lit(scale)

    # F13 float32 feature matrix
    spec.feature_names = list(order)
    cur.update(deferred)
    # via double: Catalyst folds integer -> float -> double casts and would skip the
    # float32 rounding the feature matrix is defined with
    out = work.select(*[c(k) for k in key], *[cur[n].cast("double").cast("float").alias(n) for n in order])
    return out, spec
