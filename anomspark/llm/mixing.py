"""Operator 4: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words.  A source's target is its share of the
total by weight, at most ``MOST`` times its own size, the excess going to the others by weight.  A
target is met by whole passes over the source, then by documents for the remaining budget: each
length first gives its share of most of the budget (lengths from long to short, carrying the
remainder), and what is left, a few long documents' worth, is met by a bounded-knapsack dynamic programme over
the lengths and the documents still free.  Which documents of a length are taken is decided by a
seeded hash of id and text: the plan gives for each source and length a number, found as a cut of
the hash, so texts never shuffle.  Rows that repeat in id and text share a draw; where the cut falls
among them, these rows alone are numbered (in range partitions) and as many taken as the plan says.

Null texts have size 0; a null source is a source of its own and comes last; rows that repeat are rows of
their own; an empty table gives an empty result; clashing names gain underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomspark.llm.common import WORD, checked_broadcast, fresh, read, reliable_checkpoint, seeded_hash
from anomspark.plans.ordering import group_index

WEIGHTS, MOST, SEED, SUB_ROWS = (1, 2, 3), 3, 20240602, 4096
#: Words left to the dynamic programme: so many times the longest document, but no more than MOST_ROOM.
ROOM, MOST_ROOM = 4, 1 << 20


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the words come as near ``budget`` as found.

    ``length`` is distinct; the result is between 0 and ``count``.
    """
    take = np.zeros(len(length), np.int64)
    words = int((length * count).sum())
    if budget <= 0 or not words:
        return take
    budget = min(budget, words)
    # the dynamic programme gets some long documents' worth of words, so that it can balance them
    spread = budget - min(budget, ROOM * int(length.max()), MOST_ROOM)
    share, due, used = spread / words, 0.0, 0
    for i in np.argsort(-length, kind="stable"):
        if length[i] > 0:
            due += share * float(length[i]) * float(count[i])
            take[i] = min(int(count[i]), max(0, int((min(due, spread) - used) // length[i])))
            used += int(take[i] * length[i])
    return take + _knapsack(length, count - take, budget - used)


def _knapsack(length: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the sum next to ``budget`` that at most ``free`` of each length reach."""
    extra = np.zeros(len(length), np.int64)
    usable = [i for i in np.argsort(length, kind="stable") if length[i] > 0 and free[i] > 0]
    if budget <= 0 or not usable:
        return extra
    top = budget + int(length[usable[0]])  # one short document over may be nearer
    reach, by = np.zeros(top + 1, bool), np.full(top + 1, -1, np.int32)
    reach[0], pieces = True, []
    for i in usable:
        left, part = int(min(free[i], top // length[i])), 1
        while left > 0:  # 1, 2, 4, ... documents of one length as pieces taken whole or not at all
            k = min(part, left)
            w = k * int(length[i])
            if w <= top:
                new = np.flatnonzero(reach[:top + 1 - w] & ~reach[w:]) + w
                by[new] = len(pieces)
                reach[new] = True
                pieces.append((i, k, w))
            left, part = left - k, part * 2
        if reach[budget]:
            break
    at = np.flatnonzero(reach)
    s = int(at[np.argmin(np.abs(at - budget))])
    while s > 0:
        i, k, w = pieces[by[s]]
        extra[i] += k
        s -= w
    return extra


def targets(by_source: DataFrame) -> DataFrame:
    """``by_source(source, source_size)`` with ``target``; one row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)),
                                                         ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1))
    ranked = ranked.withColumn("cap", F.lit(MOST) * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    # sources reach their caps in the order of cap over weight; the rest share what remains by weight
    before = Window.orderBy("full", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped = (ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                          / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))))
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", F.col("source").isNull(), "source", "level"))
                  ).over(every)["level"]
    return capped.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", F.coalesce("target", F.col("cap").cast("double")).alias("target"))


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
    size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    passes = min(MOST, int((target + 1e-6) // size)) if size else 0
    rest = round(target - passes * size) if passes < MOST else 0
    rows["passes"] = passes
    rows["take"] = fit_budget(rows["size"].to_numpy(), rows.c.to_numpy(), rest)
    return rows[["source", "size", "c", "source_size", "target", "passes", "take"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``times`` (0 to 3)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    draw = F.shiftrightunsigned(seeded_hash(seed, F.col(id_col), text), 1)  # 63 bits, not negative
    slim = reliable_checkpoint(docs.select(F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw")))
    lengths = slim.groupBy("source", "size").agg(F.count("*").alias("c"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")))
    source_type = docs.schema[source_col].dataType.simpleString()
    plan = reliable_checkpoint(
        lengths.join(goal.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
        .groupBy("source").applyInPandas(_plan, f"source {source_type}, size long, c long, source_size long, "
                                                "target double, passes int, take long"))
    n = plan.count()
    # the take-th least draw of each source and length, by counts of its slices and one slice's rows
    part = checked_broadcast(plan.where("take > 0 and take < c").select(
        F.col("source").alias("ps"), F.col("size").alias("pz"), "take",
        F.ceil(F.col("c") / F.lit(SUB_ROWS)).alias("subs")), n)
    drawn = slim.join(part, F.expr("source <=> ps and size = pz")).select(
        F.col("ps").alias("s"), F.col("pz").alias("z"), "take", "draw",
        F.floor(F.col("draw") / F.lit(float(1 << 63)) * F.col("subs")).alias("sub"))
    upto = Window.partitionBy("s", "z").orderBy("sub")
    slices = (drawn.groupBy("s", "z", "sub").agg(F.count("*").alias("k"), F.first("take").alias("take"))
              .withColumn("upto", F.sum("k").over(upto)).where("upto >= take and upto - k < take")
              .select(F.col("s").alias("s1"), F.col("z").alias("z1"), F.col("sub").alias("sub1"),
                      (F.col("take") - F.col("upto") + F.col("k")).alias("nth")))
    # rows of one draw are counted first, so that the window sees different draws alone
    upto = Window.partitionBy("s", "z").orderBy("draw")
    cuts = (drawn.join(slices, F.expr("s <=> s1 and z = z1 and sub = sub1"))
            .groupBy("s", "z", "draw").agg(F.count("*").alias("same"), F.first("nth").alias("nth"))
            .withColumn("upto", F.sum("same").over(upto)).where("upto >= nth and upto - same < nth")
            .select(F.col("s").alias("cs"), F.col("z").alias("cz"), F.col("draw").alias("cut"), "same",
                    (F.col("nth") - F.col("upto") + F.col("same")).alias("some")))
    plan = reliable_checkpoint(plan.join(cuts, F.expr("source <=> cs and size = cz"), "left").select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target",
        "passes", F.when(F.expr("take >= c"), F.lit((1 << 63) - 1)).otherwise(F.coalesce("cut", F.lit(-1))).alias("cut"),
        F.when(F.expr("take < c and some < same"), F.col("some")).alias("some")))
    names = fresh(docs, "size", "source_size", "target", "times")
    row, key, at = fresh(docs, "row", "key", "at")
    joined = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(source_col).alias(key),
                          size.alias("_size"), draw.alias(at))
              .join(checked_broadcast(plan, n), F.expr(f"`{key}` <=> _s and _size = _z")))
    split = F.coalesce((F.col(at) == F.col("cut")) & F.col("some").isNotNull(), F.lit(False))
    taken = joined.withColumn("_more", F.col(at) <= F.col("cut"))
    if plan.where("some is not null").head(1):  # the cut falls among rows that repeat: these are numbered
        again = group_index(joined.where(split).withColumn("_by", F.xxhash64(row)), ["_by"], [key, "_size"], "_nth")
        taken = taken.where(~split).unionByName(
            again.withColumn("_more", F.col("_nth") < F.col("some")).select(*taken.columns))
    return taken.select(f"{row}.*", F.col("_size").alias(names[0]), F.col("source_size").alias(names[1]),
                        F.col("target").alias(names[2]),
                        (F.col("passes") + F.col("_more").cast("int")).alias(names[3]))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    out = mix(docs, **options)
    times = out.columns[-1]
    return (out.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*[f"`{c}`" for c in docs.columns]))


def op4_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
