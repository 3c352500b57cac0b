"""Operator 3: quality classifier, naive Bayes features with a linear support vector machine.

N-gram indicators of a document are scaled by the log-count ratios of the two classes and a linear
model is fitted on them by dual coordinate descent on the hinge loss.  There are two kinds of n-grams,
each scaled to its own length in a document so that neither drowns the other: words in lower case and
their bigrams; and word shapes (runs of one character class count once: ``Ab,`` and ``Cde,`` have one
shape), as unigrams with the power of two of their share in the document, bigrams, and marks of
repetition (a word like its predecessor, a repeated 3-word window, a repeated line) with their share.

Training uses at most ``TRAIN_ROWS`` labelled documents (drawn by a seeded hash) in one task, the driver gets
the weights alone; every document is scored over its whole text.  The margin becomes a score by a logistic
function whose slope is fitted on the training margins, so the score is at least 0.5 exactly if the margin is
not negative.  Null and empty texts have no n-gram and get the score of the bias; rows that repeat and null ids
are scored like others; an empty table gives an empty result; other columns, whatever their names, are ignored;
without labels of both classes every score is 1 or 0 by the only class (1 without any).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import read
from anomspark.llm.labelled import fold, training_texts
from anomspark.llm.quality_rules import CLASS, duplicate_lines, repeated_words
from anomspark.llm.textnum import Words, mix, slices

TRAIN_ROWS = 10_000
#: Numbers of hashed features: shapes below ``SHAPES``, words from there to ``DIM``; how much the words weigh.
SHAPES, DIM, WORDS_WEIGH = 1 << 18, (1 << 18) + (1 << 20), 0.5
SMOOTH, COST, EPOCHS, BLEND = 1.0, 1.0, 20, 0.75

#: Bytes of the shape alphabet, one per character class; symbols and sentence marks stay themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[CLASS == 0] = SHAPE[CLASS == 8] = ord("a")
SHAPE[CLASS == 1], SHAPE[CLASS == 2] = ord("A"), ord("0")


def _shapes(w: Words) -> Words:
    """The words' shapes, as the words of a batch of the same documents."""
    out = []
    for i in range(len(w.doc_start) - 1):
        b = SHAPE[w.buf[w.doc_start[i]:w.doc_start[i + 1] - 1]]
        keep = np.ones(len(b), bool)
        keep[1:] = b[1:] != b[:-1]
        out.append(b[keep].tobytes())
    return Words(out, lower=False)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Power of two of a share, 0 (all) to 8 (less than 1 in 128)."""
    return np.clip(np.floor(-np.log2(np.maximum(part, 1e-9) / np.maximum(whole, 1))), 0, 8).astype(np.uint64)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, by document."""
    w = Words(texts, lower=False)
    s = _shapes(w)
    n = s.counts()
    doc, part = [], []

    def add(d, h):
        doc.append(d.astype(np.int64))
        part.append(h)
    gram = mix(s.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ s.hash)
    _, first, count = np.unique(gram, return_index=True, return_counts=True)
    add(s.doc[first], mix(s.hash[first] ^ (_share(count, n[s.doc[first]]) + np.uint64(1))))
    if len(s.hash) > 1:
        pair = np.flatnonzero(s.doc[1:] == s.doc[:-1])
        add(s.doc[pair], mix(s.hash[pair] * np.uint64(3) + s.hash[pair + 1]))
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) if len(w.hash) > 1 else np.zeros(0, int)
    lines = np.array([(t or "").count("\n") + 1 for t in texts])
    for mark, (x, of) in enumerate(((np.bincount(w.doc[same], minlength=len(texts)), n), (repeated_words(w), n),
                                    (np.array([duplicate_lines(t) for t in texts]), lines))):
        add(np.arange(len(texts)), mix(_share(x, of) + np.uint64(1000 * (mark + 1))))
    shape = np.concatenate(doc) * DIM + (np.concatenate(part) % np.uint64(SHAPES)).astype(np.int64)
    low = Words(texts)
    pair = np.flatnonzero(low.doc[1:] == low.doc[:-1]) if len(low.hash) > 1 else np.zeros(0, np.int64)
    gram = np.concatenate((low.hash, mix(low.hash[pair] * np.uint64(5) + low.hash[pair + 1])))
    word = np.concatenate((low.doc, low.doc[pair])) * DIM + SHAPES + (gram % np.uint64(DIM - SHAPES)).astype(np.int64)
    key = np.unique(np.concatenate((shape, word)))
    key = key[n[key // DIM] > 0]
    return key // DIM, key % DIM


def scales(doc: np.ndarray, feat: np.ndarray, texts: int) -> np.ndarray:
    """The value of each indicator: one over the root of the document's number of its kind."""
    words = feat >= SHAPES
    size = np.bincount(doc * 2 + words, minlength=2 * texts)
    return np.where(words, WORDS_WEIGH, 1.0) / np.sqrt(size[doc * 2 + words])


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """(weight of every feature, bias, slope of the logistic function)."""
    weight = np.zeros(DIM)
    if not len(y) or y.min() == y.max():
        return weight, 30.0 if not len(y) or y.max() else -30.0, 1.0
    doc, feat = [], []
    for i in range(0, len(texts), 512):
        d, f = features(texts[i:i + 512])
        doc.append(d + i)
        feat.append(f)
    doc, feat = np.concatenate(doc), np.concatenate(feat)
    pos = np.bincount(feat[y[doc] == 1], minlength=DIM) + SMOOTH
    neg = np.bincount(feat[y[doc] == 0], minlength=DIM) + SMOOTH
    seen = np.bincount(feat, minlength=DIM) > 1
    ratio = np.where(seen, np.log((pos / pos.sum()) / (neg / neg.sum())), 0.0)

    start = np.searchsorted(doc, np.arange(len(y) + 1))
    value = scales(doc, feat, len(texts))
    rows = [(feat[a:b], ratio[feat[a:b]] * value[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))  # classes weigh alike
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(y))
    order = np.random.Generator(np.random.PCG64(seed))
    norm = np.array([x @ x for _, x in rows]) + 1.0  # 1: the constant of the bias
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            f, x = rows[i]
            g = sign[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    # blend with the mean weight, as is usual for these features
    w = (1 - BLEND) * np.abs(w).sum() / max(1, (w != 0).sum()) * (w != 0) * np.sign(w) + BLEND * w
    weight = w * ratio
    margin = np.bincount(doc, weight[feat] * value, len(texts)) + bias
    slopes = np.geomspace(0.25, 16, 25)
    loss = [np.logaddexp(0, -a * sign * margin).sum() for a in slopes]
    return weight, bias, float(slopes[int(np.argmin(loss))])


def scores(texts: list[str | None], model: tuple[np.ndarray, float, float]) -> np.ndarray:
    weight, bias, slope = model
    doc, feat = features(texts)
    margin = np.bincount(doc, weight[feat] * scales(doc, feat, len(texts)), len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scores(b.column(0).to_pylist(), model.value))],
                                             names=["id", "score"])
    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, rows: int = TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float, float]:
    sample = training_texts(docs, labels, label, keep, rows, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        weight, bias, slope = train([t for t, _ in pairs], np.array([y for _, y in pairs], np.int64))
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64)]), pa.array([weight[at]]), pa.array([float(bias)]),
                                          pa.array([float(slope)])], names=["at", "weight", "bias", "slope"])
    got = sample.repartition(1).mapInArrow(run, "at array<long>, weight array<double>, bias double, slope double").first()
    if got is None:  # no labelled document, no partition
        return train([], np.zeros(0, np.int64))
    weight = np.zeros(DIM)
    weight[np.array(got["at"], np.int64)] = got["weight"]
    return weight, got["bias"], got["slope"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: id and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels, keep=fold("doc_id", 3) != 1))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
