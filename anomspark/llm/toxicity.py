"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words, and the
document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``.  Only documents carry
labels; the sentence weights are trained through the noisy-or by maximum likelihood.  The same
sentence scores then locate the offending sentences.

Words are lower-cased runs of letters and digits; they and their first ``STEM`` bytes are hashed to
``DIM`` buckets; sentences end at
``. ! ?`` and line ends.  Training uses at most ``TRAIN_ROWS`` labelled documents (drawn by a seeded
hash); every document is scored over its whole text.  A null or empty text has no sentence and gets
score 0.  Without any labelled document every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm.common import fresh, read
from anomspark.llm.labelled import fold, training_texts
from anomspark.llm.textnum import NOT_ALNUM, Words, slices

#: Greatest number of labelled documents used for training (part of the method's documentation).
TRAIN_ROWS = 8_000
DIM, STEM, STEPS, RATE, LASSO = 1 << 18, 5, 60, 0.3, 1e-4

ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


def sentence_words(texts: list[str | None]) -> tuple[Words, np.ndarray]:
    """Words of a batch and the running sentence number of each."""
    w = Words(texts, gap=NOT_ALNUM)
    if not len(w.start):
        return w, np.zeros(0, np.int64)
    mark = np.cumsum(ENDS[w.buf], dtype=np.int64)[w.start]
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (w.doc[1:] != w.doc[:-1])
    return w, np.cumsum(new) - 1


def _features(w: Words, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, feature): words, and the first ``STEM`` bytes of longer words."""
    long_ = np.flatnonzero(w.end - w.start > STEM)
    stem = w.hashes(np.minimum(w.end, w.start + STEM))[long_] ^ np.uint64(0x5BD1E995)
    key = np.unique(np.concatenate((sentence * DIM + (w.hash % np.uint64(DIM)).astype(np.int64),
                                    sentence[long_] * DIM + (stem % np.uint64(DIM)).astype(np.int64))))
    return key // DIM, key % DIM


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Word weights and bias, by Adam steps on the noisy-or likelihood of the document labels."""
    weight = np.zeros(DIM)
    if not len(texts) or y.min() == y.max():
        return weight, -30.0 if not len(texts) or not y.max() else 30.0
    docs, sents, feats, n_sent = [], [], [], 0
    for i in range(0, len(texts), 256):  # small pieces bound the memory of the driver
        w, of_word = sentence_words(texts[i:i + 256])
        if len(of_word):
            s, f = _features(w, of_word)
            docs.append((w.doc[np.searchsorted(of_word, np.arange(of_word[-1] + 1))] + i).astype(np.int32))
            sents.append((s + n_sent).astype(np.int32))
            feats.append(f.astype(np.int32))
            n_sent += int(of_word[-1]) + 1
    if not n_sent:
        return weight, -30.0
    doc, sent, word = (np.concatenate(x) for x in (docs, sents, feats))
    df = np.zeros(DIM, np.int64)
    for i in range(0, len(texts), 256):
        lo, hi = np.searchsorted(sent, np.searchsorted(doc, [i, i + 256]))
        df += np.bincount(np.unique(doc[sent[lo:hi]] * np.int64(DIM) + word[lo:hi]) % DIM, minlength=DIM)
    use = df[word] >= max(3, len(texts) // 1500)
    ids, word = np.unique(word[use], return_inverse=True)
    sent = sent[use]
    n_docs, n_words = len(texts), len(ids)
    beta, bias = np.zeros(n_words), float(np.log(y.mean() / max(1, n_sent / n_docs)))
    m = v = np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        p = _sigmoid(bias + np.bincount(sent, beta[word], n_sent))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)  # log of prod(1 - p)
        any_ = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(y > 0, np.exp(none) / any_, -1.0)  # d log likelihood / d sum of -log(1 - p)
        dz = pull[doc] * p / n_docs
        g = np.append(np.bincount(word, dz[sent], n_words), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        beta = beta + move[:-1]
        beta = np.sign(beta) * np.maximum(np.abs(beta) - RATE * LASSO / (np.sqrt(v[:-1] / (1 - 0.99 ** step)) + 1e-6), 0)
        bias += move[-1]
    weight[ids] = beta
    return weight, bias


def sentence_scores(texts: list[str | None], weight: np.ndarray, bias: float):
    """(words, sentence number per word, document per sentence, score per sentence)."""
    w, sent = sentence_words(texts)
    if not len(sent):
        return w, sent, np.zeros(0, np.int64), np.zeros(0)
    s, k = _features(w, sent)
    p = _sigmoid(bias + np.bincount(s, weight[k], sent[-1] + 1))
    doc = w.doc[np.searchsorted(sent, np.arange(sent[-1] + 1))]
    return w, sent, doc, p


def document_scores(n: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)) if n else np.zeros(0)


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for big in batches:
            for b in slices([big], big.schema.names[0]):
                texts = b.column(0).to_pylist()
                w, sent, doc, p = sentence_scores(texts, weight, bias)
                out = pa.array(np.clip(document_scores(len(texts), doc, p), 0, 1))
                spans = [[] for _ in texts]
                bad = np.flatnonzero(p >= 0.5)
                lo, hi = np.searchsorted(sent, bad), np.searchsorted(sent, bad, "right") - 1
                for k, i, j in zip(bad, lo, hi, strict=True):
                    at = w.doc_start[doc[k]]
                    head = bytes(w.buf[at:w.end[j]])
                    a = len(head[:w.start[i] - at].decode("utf-8", "ignore"))
                    spans[doc[k]].append({"start": a, "end": len(head.decode("utf-8", "ignore")), "score": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], out, pa.array(spans, SPANS)], names=[*b.schema.names[1:], "score", "spans"])
    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, rows: int = TRAIN_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias from at most ``rows`` labelled documents, trained by one task: the driver gets
    the weights alone."""
    sample = training_texts(docs, labels, label, keep, rows, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        weight, bias = train([t for t, _ in pairs], np.array([y for _, y in pairs], np.int64))
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64)]), pa.array([weight[at]]),
                                          pa.array([float(bias)])], names=["at", "weight", "bias"])
    got = sample.repartition(1).mapInArrow(run, "at array<long>, weight array<double>, bias double").first()
    if got is None:  # no labelled document, no partition
        return train([], np.zeros(0, np.int64))
    weight = np.zeros(DIM)
    weight[np.array(got["at"], np.int64)] = got["weight"]
    return weight, got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1), ``offending`` (start, end, score of sentences
    with a score of at least 0.5; code points, end exclusive); the names gain underscores on a clash."""
    names = fresh(docs, "score", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*cols).select(F.col(cols[docs.columns.index(text_col)]).alias("t"), *cols)
    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(cols, docs.schema.fields, strict=True))
    out = rows.mapInArrow(_score(shared), f"{fields}, score double, spans array<struct<start:long,end:long,score:double>>")
    return out.toDF(*docs.columns, *names)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Documents whose score is below ``threshold``."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.where(F.col(scored.columns[-2]) < threshold).select(*docs.columns)


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels, keep=fold("doc_id", 5) != 0)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
