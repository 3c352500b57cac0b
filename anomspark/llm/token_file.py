"""Operator 5: token ids in a Huffman-coded file format.

Every document is tokenized over its whole text and ends with ``END``.  Ids are counted over all
documents; the counts give canonical Huffman codes of at most 16 bits.  The file format is a folder:

* ``codes``: one row, format name and code length of every id
* ``blocks``: rows of (part, block, ids before it in the part, documents, ids, payload)

Parts are ranges of the document id, blocks hold whole documents in ascending id order (about
``BLOCK_IDS`` ids, or one longer document) and can be decoded on their own: the payload has the
documents' ids, numbers of tokens and bytes, the bit-offset checkpoints and the code bits.

Tokenizing looks words up in a bounded table and calls the tokenizer for those not in it; white space
separates tokens in this vocabulary, so a text's ids are those of its words (checked in the tests).
Null texts count as empty and hold the end id alone; null ids come first; rows that repeat are kept;
other columns are ignored; the document id must be a number that fits 64 bits.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomspark.llm import huffman
from anomspark.llm.common import checked_broadcast, ensure_checkpoint_dir, read
from anomspark.llm.textnum import slices

TOKENIZER, END, FORMAT = "word_bpe_49k.json", 1, "huffman-blocks-1"
BLOCK_IDS, PART_BYTES, WORD_TABLE = 1 << 16, 64 << 20, 600_000
#: Bytes of text whose different words are looked up together (or one longer text).
TEXT_BYTES = 4 << 20
#: A word that ends in plain punctuation after a letter or digit is two pieces for the tokenizer.  Only
#: letters that its normal form leaves single letters count (U+0130 and others end in a combining mark there).
CUT = ("([A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E])([.,!?#*$%&|;:]+)([\t-\r ]|\\z)")
#: A sign that is one token, and how many pieces are tokenized together with it between them.
SIGN, SPACED, TOGETHER = b"\x01", b" \x01 ", 1000
#: The vocabulary is in lower case.  A-Z can be folded first unless a mark may combine with the letter, or the
#: text may hold a special token, which is told apart by case.
NO_FOLD = re.compile("[\u0300-\u036F]|<\\|")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds:
    """Ids of words as bytes (unsigned 16 bits), looked up or tokenized; the table is emptied when full."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[bytes, bytes] = {}
        self.sign, = self.tokenizer.encode(SIGN.decode(), add_special_tokens=False).ids
        #: Ids that end a word, if the tokenizer marks them.
        self.last = np.zeros(1 << 16, bool)
        if mark := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True

    def _fill(self, missing: list[bytes]) -> None:
        """Many pieces are tokenized as one text.  Between plain words stands a space, and each ends with the one
        token that ends a word; between others stands a sign that is one token."""
        alone = [w for w in missing if SIGN in w or b"<|" in w]
        plain = [w for w in missing if SIGN not in w and b"<|" not in w] if alone else missing
        words = [w for w in plain if w.isalpha()] if self.last.any() else []  # ASCII letters alone
        signed = [w for w in plain if not w.isalpha()] if words else plain
        for w, e in zip(alone, self._encode([w.decode() for w in alone]), strict=True):
            self.table[w] = np.array(e.ids, np.uint16).tobytes()
        for some, e in self._together(words, b" "):
            ids = np.array(e.ids, np.uint16)
            ends = 2 * np.flatnonzero(self.last[ids]) + 2
            if len(ends) != len(some):  # this tokenizer cuts words of letters
                signed += some
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.table.update((w, raw[lo:hi]) for w, lo, hi in zip(some, [0, *ends[:-1]], ends, strict=True))
        for some, e in self._together(signed, SPACED):
            ids = np.array(e.ids, np.uint16)
            ends = 2 * np.flatnonzero(ids == self.sign)
            raw = ids.tobytes()
            self.table.update((w, raw[lo:hi]) for w, lo, hi in zip(
                some, [0, *(ends + 2).tolist()], [*ends.tolist(), len(raw)], strict=True))

    def _together(self, pieces: list[bytes], between: bytes):
        parts = [pieces[i:i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        return zip(parts, self._encode([between.join(x).decode() for x in parts]), strict=True)

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of some different words."""
        found = list(map(self.table.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if not new:
            return found
        if len(self.table) + len(new) > WORD_TABLE:
            self.table.clear()
            new = words
        self._fill(new)
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.table[words[i]]
        return found

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and the first id of each (one more at the
        end).  Arrow cuts at the white space of ASCII alone and numbers the different words."""
        words = pc.ascii_split_whitespace(_cut(_folded(texts)))
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        # a gap gives empty words at the ends of a text, which have no ids
        coded = words.flatten().dictionary_encode()
        names, which = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        blank = names.index(b"") if b"" in names else len(names)
        found = self.ids(names[:blank] + names[blank + 1:])
        found[blank:blank] = [b""] * (blank < len(names))
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 1
        raw, start = np.frombuffer(b"".join(found), np.uint16), np.cumsum(size) - size

        per_word = size[which]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_word)))
        # 4 bytes a place, unless this is one huge text
        place = np.int32 if max(upto[-1], len(raw)) < 1 << 31 else np.int64
        last = np.cumsum(n_words)
        first = np.concatenate((np.zeros(1, np.int64), upto[last])) + np.arange(len(texts) + 1)
        out = np.empty(int(upto[-1]) + len(texts), np.uint16)
        ends = np.zeros(len(out), bool)
        ends[first[1:] - 1] = True
        out[ends] = END
        at = np.repeat((start[which] - upto[:-1]).astype(place), per_word)
        at += np.arange(len(at), dtype=place)
        out[~ends] = raw[at]
        return out, first

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids and the end id of each text."""
        out, first = self.flat(pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()))
        raw = out.tobytes()
        return [raw[2 * i:2 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z folded where that is safe; most batches hold nothing that forbids it (the bytes CC and CD
    lead the combining marks)."""
    raw = b"".join(texts.cast(pa.binary()).to_pylist())
    if not (b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw):
        return pc.ascii_lower(texts)
    return pc.if_else(pa.array([bool(NO_FOLD.search(t)) for t in texts.to_pylist()], pa.bool_()), texts,
                      pc.ascii_lower(texts))


def _cut(texts: pa.Array) -> pa.Array:
    """The texts with a space before the punctuation that ends a word and is a piece of its own (see CUT), so that
    the word is looked up, not each of its forms with punctuation."""
    return pc.replace_substring_regex(texts, pattern=CUT, replacement=r"\1 \2\3")


_WORD_IDS: dict[str, WordIds] = {}


def _tokenize(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORD_IDS:  # one table for each worker process
            _WORD_IDS[path] = WordIds(path)
        total = np.zeros(1 << 16, np.int64)
        for b in slices(batches, "text", TEXT_BYTES):
            ids, first = _WORD_IDS[path].flat(b.column(0))
            total += np.bincount(ids, minlength=1 << 16)
            ids = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((2 * first).astype(np.int32)),
                                                              pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), ids, pa.nulls(len(b), pa.binary())],
                                             names=["id", "part", "ids", "counts"])
        if total.any():  # one row for each task
            yield pa.RecordBatch.from_pylist([{"counts": total.astype("<i8").tobytes()}], pa.schema(
                [("id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())]))
    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the first id of each, read from the column's own memory; no row is null."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    ids = np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]]
    if col.buffers()[2].address + at[0] & 1:
        ids = ids.copy()
    return ids.view(np.uint16), (at - at[0]) >> 1


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for counts in b.column(0).to_pylist():
            total += np.frombuffer(counts, "<i8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])


def _encode(table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, code = table.value
        for b in slices(batches, "ids"):
            ids, first = _flat(b.column(2))
            data, start, marks, mark_at = huffman.encode(ids, first, length, code)
            bits = [data[i:j] for i, j in zip(start[:-1], start[1:], strict=True)]
            marks = [marks[i:j].astype("<u4").tobytes() for i, j in zip(mark_at[:-1], mark_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(first)), pa.array(marks, pa.binary()),
                 pa.array(bits, pa.binary())], names=["id", "part", "n", "marks", "bits"])
    return run


def _payload(docs: list[tuple]) -> bytes:
    """Null marks, ids, token and byte numbers, checkpoints, bits."""
    parts = [struct.pack("<I", len(docs)), bytes(d[0] is None for d in docs),
             np.array([d[0] or 0 for d in docs], "<i8").tobytes(), np.array([d[1] for d in docs], "<i8").tobytes(),
             np.array([len(d[3]) for d in docs], "<i8").tobytes()]
    return b"".join([*parts, *(d[2] for d in docs), *(d[3] for d in docs)])


def read_block(payload: bytes, symbol: np.ndarray, size: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, tokens of each, all ids) of one block, from its bytes alone."""
    k = struct.unpack_from("<I", payload)[0]
    null = payload[4:4 + k]
    ids, n, width = (np.frombuffer(payload, "<i8", k, 4 + k + 8 * k * i).astype(np.int64) for i in range(3))
    at = 4 + k + 24 * k
    marks = np.frombuffer(payload, "<u4", int(((n + huffman.STEP - 1) // huffman.STEP).sum()), at)
    data = payload[at + 4 * len(marks):]
    start = np.cumsum(width) - width
    names = [None if z else int(i) for z, i in zip(null, ids, strict=True)]
    return names, n, huffman.decode(data, start, n, marks, symbol, size)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, id) to blocks."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("docs", pa.int64()),
                        ("ids", pa.int64()), ("payload", pa.binary())])
    part, block, before, held, size = None, 0, 0, [], 0

    def out():
        return pa.RecordBatch.from_pylist([{"part": part, "block": block, "before": before, "docs": len(held),
                                            "ids": size, "payload": _payload(held)}], schema)
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for i, p, n, marks, bits in zip(*cols, strict=True):
            if held and (p != part or size + n > BLOCK_IDS):
                yield out()
                block, before, held, size = block + 1, before + size, [], 0
            if p != part:
                part, block, before = p, 0, 0
            held.append((i, n, marks, bits))
            size += n
    if held:
        yield out()


def _decode(table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, size = huffman.decode_table(table.value)
        for b in batches:
            for part, before, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                names, n, ids = read_block(payload, symbol, size)
                first = np.concatenate(([0], np.cumsum(n)))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()),
                     pa.array(first[:-1] + before), pa.array(n), pa.array(crc, pa.int64())],
                    names=["id", "part", "inside", "n", "crc"])
    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, part_bytes: int = PART_BYTES) -> None:
    """Tokenizes all documents and writes them to ``path`` (a shared folder) in the file format."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(100_000, -(-total // part_bytes)))
    bounds = rows.where("id is not null").agg(F.percentile_approx(
        "id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = sorted(set(bounds or []))
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("id"))), F.lit(0)) if bounds \
        else F.lit(0)
    ids = rows.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(part).cast("int"))
    scratch = f"{path}/ids"
    (ids.mapInArrow(_tokenize(tokenizer), "id long, part int, ids binary, counts binary")
     .write.option("compression", "zstd").parquet(scratch))
    found = spark.read.parquet(scratch)
    ids = found.where("counts is null").select("id", "part", "ids")

    counts = found.select("counts").where("counts is not null").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    by_id = np.zeros(1 << 16, np.int64)  # at most one row for each id of the vocabulary
    by_id[counts.token] = counts.n
    length = huffman.code_lengths(by_id)
    codes = [(FORMAT, bytearray(length.tobytes()))]
    spark.createDataFrame(codes, "format string, lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    table = spark.sparkContext.broadcast((length, huffman.canonical(length)))
    (ids.mapInArrow(_encode(table), "id long, part int, n long, marks binary, bits binary")
     .repartition(max(1, len(bounds) + 1), "part").sortWithinPartitions("part", F.asc_nulls_first("id"), "bits")
     .mapInArrow(_blocks, "part int, block long, before long, docs long, ids long, payload binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files, per document: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    row = spark.read.parquet(f"{path}/codes").first()
    if row.format != FORMAT:
        raise ValueError(f"unknown format {row.format}")
    table = spark.sparkContext.broadcast(np.frombuffer(bytes(row.lengths), np.uint8))
    blocks = spark.read.parquet(f"{path}/blocks")
    below = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = (blocks.groupBy(F.col("part").alias("_p")).agg(F.sum("ids").alias("ids"))
             .select("_p", F.coalesce(F.sum("ids").over(below), F.lit(0)).alias("base")))
    docs = blocks.select("part", "before", "payload").mapInArrow(
        _decode(table), "id long, part int, inside long, n long, crc long")
    return docs.join(checked_broadcast(parts), F.expr("part = _p")).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(spark, path)
