"""Operator 7: benchmark decontamination by template windows, in DataFrame functions alone.

Numbers, names and units are replaced by typed placeholders, so a question that was re-used with
other values keeps its template.  Windows of ``WIDTH`` template words of the documents are
hash-joined with the windows of the benchmark items.  For each document and item the matched
windows give pairs of slot values (the item's and the document's value behind one placeholder);
the match counts if at least half of the item's windows or ``RUN`` of them are found in one run and the
slot values are consistent there: one item value stands for one document value (agreement of at least
``AGREE``).  Runs are the windows of the whole document, those at one offset to the item, and those
within bins of the item's length (a copy with words put in or left out), so several copies with
different values are judged one by one; the best run is reported.

Windows equal in all words (case and outer punctuation aside) count whatever their placeholders: half of
all windows of the item, or ``RUN`` of them, anywhere in the document are a match.  A window with more
placeholders than plain words matches in this way only.

* number: a word of digits with separators, currency or per cent signs
* name: a capitalised word that does not start a sentence
* unit: a word of ``UNITS`` right after a number

Items of fewer words than ``WIDTH`` have one window of all their words, down to ``LEAST_WORDS``
words; shorter ones cannot be told from chance and never match.  Null and empty texts match nothing; rows with equal id and text are
reported once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import checked_broadcast, read, reliable_checkpoint, seeded_hash, words_of

WIDTH, LEAST_WORDS, RUN, AGREE, SEED = 8, 5, 6, 0.75, 20240603
#: Units of measure that become placeholders after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hour", "hours", "day",
         "days", "week", "weeks", "month", "months", "year", "years", "inch", "inches", "foot", "feet", "mile",
         "miles", "pound", "pounds", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees")
NUMBER, NAME, UNIT = "⟨num⟩", "⟨name⟩", "⟨unit⟩"
#: Words a document may have before an item, that change the placeholder of its first word.
BEFORE = ("x", "1")
EDGE = r"[\x20\x09-\x0D]"


def template(text: Column) -> Column:
    """The text with placeholders, word for word (white space is kept)."""
    t = F.coalesce(text, F.lit(""))
    word_start, word_end = rf"(?<![^\x20\x09-\x0D])", rf"(?![^\x20\x09-\x0D])"
    closing = r"[\p{Punct}]*"
    t = F.regexp_replace(t, rf"(?<=[^.!?:\x20\x09-\x0D]{EDGE})\p{{Lu}}\p{{Ll}}[\p{{L}}'-]*{closing}{word_end}", NAME)
    t = F.regexp_replace(t, rf"{word_start}[\p{{Punct}}\p{{Sc}}]*\d[\d.,:/]*{closing}{word_end}", NUMBER)
    t = F.regexp_replace(t, rf"(?<={NUMBER}{EDGE})(?:{'|'.join(UNITS)}){closing}{word_end}", UNIT)
    return F.lower(t)


def _windows(table: DataFrame, width: int, exact: bool) -> DataFrame:
    """``table(key, words)`` to (key, at, hash) of its windows; ``exact``: tables of that many words."""
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    last = F.size("words") - width
    rows = table.where(F.size("words") == width if exact else F.size("words") >= width)
    rows = rows.select("key", hashes.alias("h"), last.alias("last"))
    return rows.select("key", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda i: F.xxhash64(F.lit(width), F.slice(F.col("h"), i + 1, F.lit(width))))
    ).alias("at", "hash"))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each document and benchmark item it leaks: ids, ``windows`` found of
    ``item_windows``, ``slots`` compared, ``agreement`` (0 to 1), ``same_values``, and the
    document's ``key`` (hash of id and text)."""
    bare = F.regexp_replace(F.coalesce(F.col(item_text), F.lit("")), rf"^{EDGE}+", "")
    before = F.explode(F.array(*[F.struct(F.lit(k).alias("context"), words.alias("words")) for k, words in enumerate(
        [words_of(template(bare)), *(F.slice(words_of(template(F.concat(F.lit(w + " "), bare))), 2, 1 << 30) for w in BEFORE)])]))
    items = (benchmark.select(F.col(item_col).alias("key"), words_of(F.col(item_text)).alias("raw"), before.alias("c"))
             .select("key", "raw", "c.*").where(F.size("words") >= LEAST_WORDS))
    items = items.groupBy("key", "raw", "words").agg(F.min("context").alias("context"))
    items = reliable_checkpoint(items.withColumn("key", F.struct("key", F.xxhash64("raw").alias("text"), "context")))
    short = [r[0] for r in items.where(F.size("words") < width).select(F.size("words")).distinct().collect()]  # < width values
    key = seeded_hash(SEED, F.col(id_col), F.col(text_col))
    rows = docs.select(key.alias("key"), words_of(template(F.col(text_col))).alias("words"))

    asked = _windows(items, width, False)
    for w in short:
        asked = asked.unionByName(_windows(items, w, True))
    size = F.least(F.size("words"), F.lit(width))
    slots = F.size(F.filter("slot", lambda x: x))
    asked = (asked.join(items, "key").where("key.context = 0 or at = 0").select(
        F.struct("key.key", "key.text").alias("item"), F.col("at").alias("item_at"), "hash", size.alias("w"),
        F.size("words").alias("n"), F.col("key.context").alias("context"),
        F.transform(F.slice("words", F.col("at") + 1, size), _is_slot).alias("slot"),
        F.transform(F.slice("raw", F.col("at") + 1, size), _plain).alias("theirs"))
        .withColumn("verbatim", (F.col("context") > 0) | (2 * slots > F.col("w")))
        .withColumn("raw", F.when(F.col("verbatim"), F.xxhash64("theirs")).otherwise(F.lit(0))))
    asked = reliable_checkpoint(asked)
    total = asked.where("not verbatim").select("item", "item_at", F.lit(0).alias("way")).unionByName(
        asked.select("item", "item_at", F.lit(1).alias("way")))
    total = total.groupBy("item", "way").agg(F.countDistinct("item_at").alias("item_windows"))

    seen = _windows(rows, width, False)
    for w in short:
        seen = seen.unionByName(_windows(rows, w, False))
    probe = checked_broadcast(asked.select("hash", "w", "verbatim").distinct())
    found = reliable_checkpoint(seen.join(probe, "hash").select("key", "at", "hash", "w", "verbatim").distinct())

    # the words of the documents concerned, once more, for the slot values
    hit = checked_broadcast(reliable_checkpoint(found.select("key").distinct().withColumnRenamed("key", "_k")))
    raw = (docs.select(key.alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
           .join(hit, F.expr("key = _k")).groupBy("key").agg(F.min(F.struct("id", "text")).alias("d"))
           .select("key", "d.id", words_of(F.col("d.text")).alias("raw")))
    spots = found.groupBy("key").agg(F.collect_list(F.struct("at", "hash", "w", "verbatim")).alias("spots"))
    windows = (raw.join(spots, "key").select("key", "id", F.col("raw").alias("all"), F.explode("spots").alias("s"))
               .select("key", "id", "s.at", "s.hash", "s.verbatim",
                       F.transform(F.slice("all", F.col("s.at") + 1, F.col("s.w")), _plain).alias("ours"))
               .withColumn("raw", F.when(F.col("verbatim"), F.xxhash64("ours")).otherwise(F.lit(0))))
    pair = (windows.join(checked_broadcast(asked), ["hash", "verbatim", "raw"])
            .withColumn("values", F.filter(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.struct(
                F.get("slot", i).alias("slot"), F.get("theirs", i).alias("theirs"), F.get("ours", i).alias("ours"))),
                lambda v: v["slot"])))
    # the runs a window belongs to: by template the whole document, its offset, and two rows of bins as
    # wide as the item, half a bin apart; by equal words the whole document
    offset = F.col("at") - F.col("item_at")
    runs = [F.struct(F.lit(way).alias("way"), F.lit(kind).alias("kind"), spot.cast("long").alias("spot")) for way, kind, spot in (
        (0, 0, F.lit(0)), (0, 1, offset), (0, 2, F.floor(offset / F.col("n"))), (0, 3, F.floor(offset / F.col("n") + 0.5)),
        (1, 0, F.lit(0)))]
    run = F.filter(F.array(*runs), lambda r: F.when(r["way"] == 0, ~F.col("verbatim")).otherwise(
        F.col("theirs") == F.col("ours")))
    per = pair.withColumn("run", F.explode(run)).groupBy("key", "id", "item", "run").agg(
        F.countDistinct("item_at").alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("values")).withColumn("way", F.col("run.way"))
    per = per.join(F.broadcast(total) if total.count() <= 2_000_000 else total, ["item", "way"])
    one = F.size(F.array_distinct(F.transform("values", lambda v: v["theirs"])))
    per = per.select(
        "key", "id", "item", "way", "windows", "item_windows", F.size("values").cast("long").alias("slots"),
        F.when(F.size("values") == 0, F.lit(1.0)).otherwise(one / F.size("values")).alias("agreement"),
        F.forall("values", lambda v: v["theirs"] == v["ours"]).alias("same_values")
    ).where((2 * F.col("windows") >= F.col("item_windows")) | (F.col("windows") >= RUN)).where(F.col("agreement") >= AGREE)
    best = per.groupBy("key", "id", "item").agg(F.max(F.struct(
        (-F.col("way")).alias("way"), "windows", "same_values", "agreement", "item_windows", "slots")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item.key").alias(item_col), "b.windows", "b.item_windows",
                       "b.slots", "b.agreement", "b.same_values", "key")


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak a benchmark item."""
    bad = reliable_checkpoint(leaks(docs, benchmark, id_col, text_col).select(F.col("key").alias("_bad")).distinct())
    key = seeded_hash(SEED, F.col(id_col), F.col(text_col))
    return docs.join(checked_broadcast(bad), key == F.col("_bad"), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "windows", "item_windows", "slots", "agreement", "same_values")
