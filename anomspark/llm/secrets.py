"""Operator 9: secret scan, in DataFrame functions alone.

Three fixed patterns give the base spans.  The method adds candidate strings (runs of at least
``CANDIDATE`` letters, digits and ``+/_=-``) that are random in some place: a window of ``WINDOW``
characters slides over the candidate, its character counts are updated by the character that enters
and the one that leaves, and some window must hold a letter and a digit and reach the Shannon entropy asked
of its character class (hex, letters and digits, base64).  Base spans and allow-listed parts (identifiers of
the UUID form, placeholders, plain sequences) are blanked first: a candidate ends there, so that they suppress
the windows they touch and no others.

Positions are code points, ends exclusive; matches of one kind do not overlap and are taken from the
left.  Spark tells no positions of matches, so the lengths of the matches and of the pieces between them are
added up, in chunks, in time proportional to their number.  Null and empty texts have no spans; rows that
repeat are kept; an empty table gives an empty result; clashing names gain underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import fresh, read

#: Kinds in their order, patterns and least lengths (of the secret for ``assign``).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

CANDIDATE, WINDOW = 20, 20
#: Entropy in bits a window of each class must reach; a window of 20 has at most 4.32.
THRESHOLDS = {"hex": 2.9, "alnum": 3.5, "base64": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALLOWED = (r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
           r"|example|sample|dummy|placeholder|changeme|your_|lorem|abcdefgh|12345678|([A-Za-z0-9+/_=-])\1{5,}")


CHUNK = 128
SPAN = "array<struct<start:int,order:int,kind:string,end:int,found:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once (Spark repeats an expression inside a lambda)."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (gap, found): each match of ``pattern`` and the text before it; last the rest, found null."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def _spans(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Array of (start, order, kind, end, found) of all matches of ``pattern``."""
    def chunk(k: Column, pieces: Column) -> Column:
        return F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK))

    def length(p: Column) -> Column:
        return F.length(p["gap"]) + F.length(p["found"])

    def placed(pieces: Column, start: Column) -> Column:
        """Spans of one chunk, whose first gap begins at ``start``."""
        def step(acc: Column, p: Column) -> Column:
            at = acc["at"] + F.length(p["gap"])
            span = F.struct(at.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
                            (at + F.length(p["found"])).alias("end"), p["found"].alias("found"))
            return F.struct((acc["at"] + length(p)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.aggregate(pieces, F.struct(start.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def whole(pieces: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda k: F.aggregate(chunk(k, pieces), F.lit(0), lambda a, p: a + length(p)))
        return _let(sums, lambda s: F.flatten(F.transform(chunks, lambda k: placed(
            chunk(k, pieces), F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda a, x: a + x)))))

    matched = F.filter(_pieces(text, pattern), lambda p: p["found"].isNotNull())
    return _let(matched, lambda m: F.when(F.size(m) > 0, whole(m)).otherwise(F.array().cast(SPAN)))


def _blanked(text: Column, pattern: str, kept=lambda found: F.lit(True)) -> Column:
    """``text`` with spaces in place of the matches of ``pattern`` that pass ``kept``."""
    def piece(p: Column) -> Column:
        found = F.coalesce(p["found"], F.lit(""))
        return F.concat(p["gap"], F.when(kept(found), F.repeat(F.lit(" "), F.length(found))).otherwise(found))
    return F.array_join(F.transform(_pieces(text, pattern), piece), "")


def _windows(value: Column, start: Column, best, result) -> Column:
    """Folds ``best(acc, bits, state)`` over the windows of ``value``: their entropy, and how many of the window's
    characters are not hex, neither letter nor digit, digits, letters.  The counts are a string of one character
    for each character of the alphabet, of which each step changes two."""
    term = F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(WINDOW + 1)])
    zero = ord("A")
    kinds = {"nothex": "[^0-9a-fA-F]", "other": "[^0-9A-Za-z]", "digits": "[0-9]", "letters": "[A-Za-z]"}

    def get(counts: Column, at: Column) -> Column:
        return F.ascii(F.substring(counts, at, F.lit(1))) - zero

    def put(counts: Column, at: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + zero), at, F.lit(1))

    def step(chars: Column):
        def run(acc: Column, i: Column) -> Column:
            come = F.element_at(chars, i)
            gone = F.when(i > WINDOW, F.element_at(chars, i - F.when(i > WINDOW, WINDOW).otherwise(0)))
            goes, comes = F.instr(F.lit(ALPHABET), gone), F.instr(F.lit(ALPHABET), come)
            out = get(acc["counts"], goes)
            left = F.when(i > WINDOW, put(acc["counts"], goes, out - 1)).otherwise(acc["counts"])
            less = F.when(i > WINDOW, F.get(term, out - 1) - F.get(term, out)).otherwise(0.0)
            now = get(left, comes)
            total = acc["sum"] + less + F.get(term, now + 1) - F.get(term, now)
            state = {k: acc[k] + come.rlike(p).cast("int") - F.when(i > WINDOW, gone.rlike(p).cast("int")).otherwise(0)
                     for k, p in kinds.items()}
            bits = F.lit(math.log2(WINDOW)) - total / WINDOW
            return F.struct(put(left, comes, now + 1).alias("counts"), total.alias("sum"),
                            *[v.alias(k) for k, v in state.items()],
                            F.when(i >= WINDOW, best(acc["best"], bits, state)).otherwise(acc["best"]).alias("best"))
        return run

    first = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
                     *[F.lit(0).alias(k) for k in kinds], start.alias("best"))
    return _let(F.split(value, ""), lambda chars: F.aggregate(
        F.sequence(F.lit(1), F.size(chars)), first, step(chars), lambda acc: result(acc["best"])))


def window_entropy(value: Column) -> Column:
    """Greatest entropy (bits) of a window of ``WINDOW`` characters, by incremental counts."""
    return _windows(value, F.lit(0.0), lambda best, bits, _: F.greatest(best, bits), lambda best: best)


def _random(value: Column) -> Column:
    """Whether a window holds letters and digits and reaches the entropy asked of its character class."""
    def reached(best: Column, bits: Column, n: dict[str, Column]) -> Column:
        least = (F.when(n["nothex"] == 0, THRESHOLDS["hex"]).when(n["other"] == 0, THRESHOLDS["alnum"])
                 .otherwise(THRESHOLDS["base64"]))
        return best | ((n["digits"] > 0) & (n["letters"] > 0) & (bits >= least))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.when(mixed, _windows(value, F.lit(False), reached, lambda best: best)).otherwise(False)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``base`` (array of base spans) and ``added`` (entropy spans); a
    span has start, order, kind, end, found."""
    base, added = fresh(docs, "base", "added")
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    none = F.array().cast(SPAN)

    def long_assign(found: Column) -> Column:
        return F.length(F.regexp_extract(found, ASSIGN, 2)) >= LEAST_ASSIGN

    # a greedy run is one match, so short runs can be left out of the pattern at once
    access_runs, hex_runs = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", f"[0-9a-f]{{{LEAST_HEX},}}"
    run = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}"
    named = t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)")
    assign = F.when(named, F.filter(_spans(t, ASSIGN, "assign", 0), lambda s: long_assign(s["found"]))).otherwise(none)
    access = F.when(t.rlike(access_runs), _spans(t, access_runs, "access", 1)).otherwise(none)
    hex_ = F.when(t.rlike(hex_runs), _spans(t, hex_runs, "hex", 2)).otherwise(none)
    blank = _blanked(_blanked(_blanked(_blanked(t, ASSIGN, long_assign), access_runs), hex_runs), ALLOWED)
    out = docs.withColumn(base, F.array_sort(F.concat(assign, access, hex_)))
    spans = _let(blank, lambda b: F.filter(_spans(b, run, "entropy", 3), lambda c: _random(c["found"])))
    return out.withColumn(added, F.when(t.rlike(run), spans).otherwise(none))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"),
                      F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
