"""Operator 10: quality rules and distribution divergence from language references.

Base rules: too few words, or too many words in repeated 3-word windows.  The method compares a
document's histogram of character classes, and of the languages' common words, with each language's
reference by the Jensen-Shannon distance (base 2, 0 to 1) and rejects a document that is far from
every reference.  References are gathered from all documents by their ``lang``; a word is common to
a language if it makes up at least ``COMMON_SHARE`` of the language's words.

Guards: the word histogram counts only from ``WORD_GUARD`` words on, the character classes from
``CHAR_GUARD`` characters on; shorter documents are judged by the base rules alone.  Every language
of at least ``LANG_GUARD`` words gives a reference (a null language is one too).  Documents of smaller
languages are judged by the base rules and the character classes of their own language, and have no
word distance.  Null and empty texts have no words and fail the base rule.  Rows that repeat are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import checked_broadcast, read, reliable_checkpoint
from anomspark.llm.textnum import SPACE, Words, mix, ngrams, slices

LEAST_WORDS, MOST_REPEATED = 50, 50
COMMON_SHARE, LANG_GUARD = 1e-3, 10_000
CHAR_GUARD, WORD_GUARD = 200, 80
#: Greatest distance from the nearest reference.
MOST_CHAR, MOST_WORD = 0.23, 0.455

#: Character classes: lower case, upper case, digit, blank, line end, sentence mark, symbol, other ASCII, beyond ASCII.
CLASS = np.full(256, 7, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[9, 11, 12, 13, 32]], CLASS[10] = 0, 1, 2, 3, 4
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
CLASS[[ord(c) for c in "#*$%&|<>@^~=+_{}[]\\/`"]] = 6
CLASS[128:] = 8
CLASSES = 9
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = np.ones(256, bool)
LEAD[128:192] = False  # continuation bytes: not a character of their own


def _per_doc(w: Words, what: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(what, dtype=np.int64)))
    return total[w.doc_start[1:] - 1] - total[w.doc_start[:-1]]


def char_classes(w: Words) -> np.ndarray:
    """(documents, classes) counts of characters."""
    lead = LEAD[w.buf]
    cls = CLASS[w.buf]
    return np.stack([_per_doc(w, lead & (cls == k)) for k in range(CLASSES)], axis=1)


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Words of each document in n-word windows that it has at least twice."""
    h, at = ngrams(w, n)
    if not len(h):
        return np.zeros(len(w.doc_start) - 1, np.int64)
    _, inverse, count = np.unique(mix(h ^ mix(w.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    hit = np.zeros(len(w.hash), bool)
    for j in range(n):
        hit[twice + j] = True
    return np.bincount(w.doc[hit], minlength=len(w.doc_start) - 1)


def duplicate_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q`` (rows of counts); 1 for an empty row."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)
    d = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(p.sum(axis=1) > 0, d, 1.0)


# ---- references -----------------------------------------------------------------------------

def _reference_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): class counts (kind 0), words (1), and totals of words (2), of 64 MB of text each."""
    held: dict[str | None, list[str]] = {}
    size = 0

    def flush():
        for name, texts in held.items():
            chars, words, total = np.zeros(CLASSES, np.int64), [], 0
            for i in range(0, len(texts), 512):
                w = Words(texts[i:i + 512], lower=True)
                chars += char_classes(Words(texts[i:i + 512], lower=False)).sum(axis=0)
                words.append(np.unique(w.hash, return_counts=True))
                total += len(w.hash)
            h, inverse = np.unique(np.concatenate([x[0] for x in words]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([x[1] for x in words]), len(h)).astype(np.int64)
            kind = np.repeat(np.array([0, 1, 2], np.int32), (CLASSES, len(h), 1))
            key = np.concatenate((np.arange(CLASSES), h.view(np.int64), [0]))
            n = np.concatenate((chars, c, [total]))
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(key[part])), pa.array(kind[part]),
                                                  pa.array(key[part]), pa.array(n[part])], names=["lang", "kind", "key", "n"])
    for b in slices(batches, "text"):
        for name, text in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
            held.setdefault(name, []).append(text)
        size += b.nbytes
        if size >= 64 << 20 or len(held) > 4096:
            yield from flush()
            held, size = {}, 0
    if held:
        yield from flush()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[dict, DataFrame]:
    """Histograms of the languages of at least ``LANG_GUARD`` words: ``chars`` (languages, classes), ``keys``
    (sorted common words), ``start``, ``lang`` and ``share`` (the languages of each key), ``other`` (share of
    all other words); and a table (lang, own) of the class counts of the smaller languages."""
    rows = (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
            .mapInArrow(_reference_counts, "lang string, kind int, key long, n long")
            .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    # a word common to a language of LANG_GUARD words has at least this count
    rows = reliable_checkpoint(rows.where(f"kind <> 1 or n >= {COMMON_SHARE * LANG_GUARD}"))
    totals = rows.where("kind = 2").select(F.col("lang").alias("_l"), F.col("n").alias("total"))
    rows = rows.join(checked_broadcast(totals), F.expr("lang <=> _l"))
    small = rows.where(f"kind = 0 and total < {LANG_GUARD}").groupBy(F.col("lang").alias("_l")).agg(
        F.sort_array(F.collect_list(F.struct("key", "n"))).alias("own")).select("_l", F.col("own.n").alias("own"))
    table = (rows.where(f"total >= {LANG_GUARD} and (kind = 0 or kind = 1 and n >= {COMMON_SHARE} * total)")
             .select("lang", "kind", "key", "n", "total").toPandas())  # at most 1 / COMMON_SHARE words a language
    names = {x: i for i, x in enumerate(sorted({(x is not None, x or "") for x in table.lang}))}
    at = np.array([names[x is not None, x or ""] for x in table.lang], np.int64)
    kind, key, n, total = (table[c].to_numpy(np.int64) for c in ("kind", "key", "n", "total"))
    chars, other = np.zeros((len(names), CLASSES)), np.ones(len(names))
    chars[at[kind == 0], key[kind == 0]] = n[kind == 0]
    word = kind == 1
    keys, place = np.unique(key[word].view(np.uint64), return_inverse=True)
    order = np.argsort(place, kind="stable")
    lang, share = at[word][order], (n[word] / total[word])[order]
    other -= np.bincount(lang, share, len(names))
    start = np.searchsorted(place[order], np.arange(len(keys) + 1))
    return {"chars": chars, "keys": keys, "start": start, "lang": lang, "share": share,
            "other": np.where(other > 1e-12, other, 0.0)}, small


def _nearest(ref: dict, w: Words, docs: int) -> np.ndarray:
    """Least Jensen-Shannon distance of each document's words to the references.  Only words that both
    sides have take part in the sum: with none in common the divergence is 1."""
    langs = len(ref["other"])
    n = np.bincount(w.doc, minlength=docs)
    at = np.searchsorted(ref["keys"], w.hash)
    at[at == len(ref["keys"])] = 0
    known = ref["keys"][at] == w.hash if len(ref["keys"]) else np.zeros(len(at), bool)
    wide = max(len(ref["keys"]), 1)
    entry, count = np.unique(w.doc[known] * wide + at[known], return_counts=True)
    doc, at = entry // wide, entry % wide
    p = count / n[doc]
    rest = 1 - np.bincount(w.doc[known], minlength=docs) / np.maximum(n, 1)
    rest[n == 0] = 0

    def shared(p, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            m = (p + q) / 2
            return np.where((p > 0) & (q > 0), p * np.log2(p / m) + q * np.log2(q / m) - p - q, 0.0)
    out, step = np.zeros(docs), max(1, 4_000_000 // langs)
    for lo in range(0, docs, step):
        hi = min(lo + step, docs)
        a, b = np.searchsorted(doc, (lo, hi))
        first, many = ref["start"][at[a:b]], np.diff(ref["start"])[at[a:b]]
        spot = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        part = shared(np.repeat(p[a:b], many), ref["share"][spot])
        both = np.bincount(np.repeat(doc[a:b] - lo, many) * langs + ref["lang"][spot], part, (hi - lo) * langs)
        both = both.reshape(hi - lo, langs) + shared(rest[lo:hi, None], ref["other"][None, :])
        out[lo:hi] = np.sqrt(np.clip(1 + both / 2, 0, 1)).min(axis=1)
    return out


def _judged(ref):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ref.value
        for b in slices(batches, "text"):
            texts = b.column(0).to_pylist()
            w = Words(texts, lower=False)
            n = w.counts()
            cls = char_classes(w)
            chars = cls.sum(axis=1)
            inside = _per_doc(w, LEAD[w.buf] & ~SPACE[w.buf])
            low = Words(texts, lower=True)
            own = b.column(2).to_pylist()
            alone = np.array([x is not None for x in own], bool)
            by_char = np.min([js_distance(cls, q) for q in r["chars"]], axis=0) if len(r["chars"]) else np.ones(len(texts))
            for i in np.flatnonzero(alone):
                by_char[i] = js_distance(cls[i:i + 1], np.array(own[i], float))[0]
            by_word = _nearest(r, low, len(texts)) if len(r["other"]) else np.ones(len(texts))
            again = repeated_words(w)
            failed = (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)
            far = ((chars >= CHAR_GUARD) & (by_char > MOST_CHAR)) | (~alone & (n >= WORD_GUARD) & (by_word > MOST_WORD))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), *map(pa.array, (n, inside, _per_doc(w, SYMBOL[w.buf]),
                                              np.array([duplicate_lines(t) for t in texts], np.int64), again, failed,
                                              ~failed & ~far, by_char)), pa.array(by_word, mask=alone)],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "char_distance", "word_distance"])
    return run


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept`` and the two distances."""
    table, small = references(docs, text_col, lang_col)
    ref = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"),
                       F.col(lang_col).cast("string").alias("lang"))
    small = reliable_checkpoint(small)
    if n_small := small.count():
        rows = rows.join(checked_broadcast(small, n_small), F.expr("lang <=> _l"), "left").select("text", "id", "own")
    else:
        rows = rows.select("text", "id", F.lit(None).cast("array<bigint>").alias("own"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_judged(ref), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                           "n_repeat_words long, base_failed boolean, kept boolean, char_distance double, "
                           "word_distance double").withColumnRenamed("id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
