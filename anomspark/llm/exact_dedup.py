"""Operator 13: exact duplicates by an exchange of Golomb-coded fingerprints.

Rows are told by file and row number.  A piece is a run of at most 65,536 rows of one file that one task read:
their ids and SHA-256 digests.  Each piece cuts its digests to fingerprints (10 bits more than the number of
rows needs), sorts them and sends each owner of a range of fingerprints its part as a Golomb code.  An owner finds
the fingerprints that several pieces sent and returns each piece a bitmap of them.  Rows with such a
fingerprint, or one found twice in their own piece, are suspects; only their texts are shuffled, combined in the map
task first, and compared byte for byte.  The answers go back to the pieces, which hold the rows.

The bitmaps of suspect rows are broadcast to the scan in rounds of at most ``ROUND`` pieces (8 KB each), each over
its own files; a hot group meets as at most one row for each piece or map task, never row by row.

Results: null counts as empty; empty texts are copies of each other; of equal texts the row with the largest id
stays, a null id being the smallest; of several rows of one text and that same id, the first in the table's files
stays; every row of the table has its row in the result, repeated ones too; an empty table gives an empty result;
other columns, whatever their names, are ignored (and kept by :func:`drop_copies`).  Ids are numbers of 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomspark.llm import golomb
from anomspark.llm.common import checked_broadcast, ensure_checkpoint_dir, fresh, read, reliable_checkpoint

PIECE = 1 << 16
#: Fingerprints of one owner, pieces whose bitmaps are broadcast at a time (8 KB each), bits beyond log2(rows).
OWNED, ROUND, SPARE_BITS = 4 << 20, 4096, 10
ROWS = "file string, block long, rows binary, ids array<bigint>, digests binary"
IDS = pa.list_(pa.int64())


# ---- pieces

def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, row, id, digest) in the order of their files to pieces."""
    key, held = None, []

    def out():
        part = pa.concat_batches(held)
        rows = (part.column(1).to_numpy() % PIECE).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([rows.tobytes()], pa.binary()),
             pa.array([part.column(2)], IDS), pa.array([b"".join(part.column(3).to_pylist())], pa.binary())],
            names=["file", "block", "rows", "ids", "digests"])
    for b in batches:
        if not b.num_rows:
            continue
        name, block = b.column(0).to_pylist(), b.column(1).to_numpy() // PIECE
        cut = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1] or block[i] != block[i - 1]), len(name)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if held and key != (name[lo], int(block[lo])):
                yield out()
                held = []
            key = name[lo], int(block[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield out()


def _names(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}


def _messages(bits: int, owners: int):
    """To each owner: the sorted fingerprints of a piece in its range."""
    width = -(-(1 << bits) // owners)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _names(batches):
            prints = np.unique(golomb.fingerprints(r["digests"].as_py(), bits))
            owner = (prints // np.uint64(width)).astype(np.int64)
            to, at = np.unique(owner, return_index=True)
            code = [golomb.encode(prints[i:j] - np.uint64(o * width), width)
                    for o, i, j in zip(to.tolist(), at, [*at[1:], len(prints)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([r["piece"].as_py()] * len(to), pa.int64()),
                 pa.array(code, pa.binary())], names=["owner", "piece", "code"])
    return run


def _answers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages sorted by owner to bitmaps of the fingerprints that more than one piece sent."""
    owner, piece, lists = None, [], []

    def out():
        sent = np.concatenate(lists)
        order = np.argsort(sent, kind="stable")
        same = np.flatnonzero(sent[order[1:]] == sent[order[:-1]])
        twice = np.zeros(len(sent), bool)
        twice[order[same]] = twice[order[same + 1]] = True
        cut = np.cumsum([len(x) for x in lists])
        marks = [(p, np.packbits(m).tobytes()) for p, m in zip(piece, np.split(twice, cut[:-1]), strict=True) if m.any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in marks], pa.int64()), pa.array([owner] * len(marks), pa.int32()),
             pa.array([m for _, m in marks], pa.binary())], names=["piece", "owner", "marks"])
    for r in _names(batches):
        if r["owner"].as_py() != owner:
            if lists:
                yield out()
            owner, piece, lists = r["owner"].as_py(), [], []
        piece.append(r["piece"].as_py())
        lists.append(golomb.decode(r["code"].as_py()))
    if lists:
        yield out()


def _marked(bits: int, owners: int):
    """Pieces with the returned bitmaps to bits of the suspect rows, by row of the block."""
    width = -(-(1 << bits) // owners)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _names(batches):
            prints, row, times = np.unique(golomb.fingerprints(r["digests"].as_py(), bits), return_inverse=True,
                                           return_counts=True)
            mark = times > 1
            for a in r["answers"].as_py() or ():
                i, j = np.searchsorted(prints, np.array([a["owner"] * width, (a["owner"] + 1) * width], np.uint64))
                mark[i:j] |= np.unpackbits(np.frombuffer(a["marks"], np.uint8), count=j - i).astype(bool)
            suspect = mark[row]
            yield pa.RecordBatch.from_arrays([pa.array([r["piece"].as_py()], pa.int64()), pa.array([_bits(
                r["rows"].as_py(), suspect)], IDS), pa.array([np.packbits(suspect).tobytes()], pa.binary())],
                names=["piece", "words", "suspects"])
    return run


def _bits(rows: bytes, wanted: np.ndarray) -> list[int]:
    """The wanted rows of a block as bits of 64-bit integers, as far as the last one."""
    at = np.frombuffer(rows, "<u2")[wanted]
    words = np.zeros(int(at.max(initial=0)) // 64 + 1, np.uint64)
    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return words.view(np.int64).tolist() if len(at) else []


# ---- rows by file and number

def _stored(docs: DataFrame, scan: bool) -> DataFrame:
    """``docs`` as a scan of files; a table of another kind is written to the shared folder first."""
    if scan:
        return docs
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.parquet(path)


def _rounds(docs: DataFrame, blocks: DataFrame, size: int) -> list[DataFrame]:
    """Rows of ``docs`` whose bit is set in ``blocks(file, block, words)``, in parts of disjoint files; a part
    of more than ``size`` blocks (one enormous file) is joined without a broadcast."""
    n = blocks.count()
    rounds = max(1, -(-2 * n // size)) if n > size else 1
    file, block, words, path, row = fresh(docs, "file", "block", "words", "path", "row")
    blocks = blocks.toDF(file, block, words)
    at = docs.metadataColumn("_metadata")
    bit = f"getbit(get({words}, cast({row} % {PIECE} div 64 as int)), cast({row} % 64 as int)) = 1"
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = []
    for k in range(rounds):
        part, rows = blocks, docs.select("*", at["file_path"].alias(path), at["row_index"].alias(row))
        if rounds > 1:
            part = blocks.where(F.pmod(F.xxhash64(file), F.lit(rounds)) == k)
            rows = rows.where(F.pmod(F.xxhash64(path), F.lit(rounds)) == k)
        part = checked_broadcast(part, n if rounds == 1 else None, size)
        out.append(rows.join(part, F.expr(f"{path} = {file} and {row} div {PIECE} = {block} and {bit}")).select(*own))
    return out


def _blocks(marked: DataFrame) -> DataFrame:
    return marked.where(F.size("words") > 0).select("file", "block", "words")


# ---- verdicts

def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the digests of its suspects, and the largest id of each."""
    for r in _names(batches):
        ids, digests = r["ids"].as_py(), r["digests"].as_py()
        suspect = np.unpackbits(np.frombuffer(r["suspects"].as_py(), np.uint8), count=len(ids))
        top: dict[bytes, int | None] = {}
        for i in np.flatnonzero(suspect).tolist():
            d = digests[32 * i:32 * i + 32]
            top[d] = max((x for x in (top.get(d), ids[i]) if x is not None), default=None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["piece"].as_py()] * len(top), pa.int64()), pa.array(list(top), pa.binary()),
             pa.array(list(top.values()), pa.int64())], names=["piece", "digest", "top"])


def _judged(r: dict) -> tuple[list, list, list, list, list]:
    ids, digests = r["ids"].as_py(), r["digests"].as_py()
    found = {g["digest"]: g for g in r["groups"].as_py() or ()}
    keep, size, kept, name = [], [], [], []
    for i, x in enumerate(ids):
        d = digests[32 * i:32 * i + 32]
        g = found.get(d)
        keep.append(x if g is None else g["keep"])
        size.append(1 if g is None else g["n"])
        stays = g is None or bool(g["mine"]) and x == g["keep"]
        if g is not None and stays:
            g["mine"] = False
        kept.append(stays)
        name.append(d.hex())
    return ids, keep, size, kept, name


def _results(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _names(batches):
        ids, keep, size, kept, name = _judged(r)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(kept),
             pa.array(name)], names=["id", "keep", "n", "kept", "digest"])


def _survivors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in _names(batches):
        words = _bits(r["rows"].as_py(), np.array(_judged(r)[3], bool))
        yield pa.RecordBatch.from_arrays([pa.array([r["file"].as_py()]), pa.array(
            [r["block"].as_py()], pa.int64()), pa.array([words], IDS)], names=["file", "block", "words"])


def _verdicts(docs: DataFrame, id_col: str, text_col: str, size: int, owned: int) -> DataFrame:
    """The pieces of ``docs`` (a scan of files) with the groups their suspects belong to."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    at = docs.metadataColumn("_metadata")
    rows = docs.select(at["file_path"], at["row_index"],
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    pieces = reliable_checkpoint(rows.mapInArrow(_pieces, ROWS)).withColumn("piece", F.monotonically_increasing_id())
    n = pieces.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, owners = min(64, max(1, n).bit_length() + SPARE_BITS), max(1, tasks, -(-n // owned))

    sent = pieces.select("piece", "digests").mapInArrow(_messages(bits, owners), "owner int, piece long, code binary")
    sent = sent.repartition(owners, "owner").sortWithinPartitions("owner")
    back = (sent.mapInArrow(_answers, "piece long, owner int, marks binary")
            .groupBy("piece").agg(F.collect_list(F.struct("owner", "marks")).alias("answers")))
    marks = pieces.select("piece", "rows", "digests").join(back, "piece", "left").mapInArrow(
        _marked(bits, owners), "piece long, words array<bigint>, suspects binary")
    marked = reliable_checkpoint(pieces.join(marks, "piece"))

    parts = [p.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("digest", "text")
             .agg(F.count("*").alias("n")) for p in _rounds(docs.select(text.alias("text")), _blocks(marked), size)]
    equal = parts[0]
    if len(parts) > 1:
        path = f"{ensure_checkpoint_dir(docs.sparkSession)}/suspects-{uuid.uuid4().hex}"
        for p in parts:
            p.write.mode("append").parquet(path)
        equal = docs.sparkSession.read.parquet(path).groupBy("digest", "text").agg(F.sum("n").alias("n"))
    equal = (equal.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
             .withColumn("n", F.when(F.col("texts") == 1, F.col("n")).otherwise(
                 F.raise_error(F.lit("two texts share a SHA-256 digest"))))).where("n > 1")
    mine = marked.where(F.size("words") > 0).select("piece", "ids", "digests", "suspects").mapInArrow(
        _classes, "piece long, digest binary, top long")
    mine = reliable_checkpoint(mine)
    holder = mine.groupBy("digest").agg(F.max(F.struct("top", (-F.col("piece")).alias("before"))).alias("h"))
    groups = equal.join(holder, "digest").select("digest", "n", F.col("h.top").alias("keep"), (-F.col("h.before")).alias("at"))
    told = mine.join(groups, "digest").groupBy("piece").agg(F.collect_list(F.struct(
        "digest", "n", "keep", (F.col("at") == F.col("piece")).alias("mine"))).alias("groups"))
    return marked.select("piece", "file", "block", "rows", "ids", "digests").join(told, "piece", "left")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False,
                  size: int = ROUND, owned: int = OWNED) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``scan`` says that ``docs`` comes straight from files (``spark.read``, filters and column choice allowed),
    so that nothing is copied.
    """
    asked = _stored(docs if scan else docs.select(f"`{id_col}`", f"`{text_col}`"), scan)
    out = _verdicts(asked, id_col, text_col, size, owned).select("ids", "digests", "groups").mapInArrow(
        _results, "id long, keep long, n long, kept boolean, digest string")
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
                      F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scan: bool = False,
                size: int = ROUND, owned: int = OWNED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = _stored(docs, scan)
    found = _verdicts(docs, id_col, text_col, size, owned)
    parts = _rounds(docs, _blocks(reliable_checkpoint(
        found.mapInArrow(_survivors, "file string, block long, words array<bigint>"))), size)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(read(spark, sf_dir, "documents"), scan=True)


SQL = """
with t as (select doc_id, sha256(coalesce(text, '')) as text_sha256, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
       row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, text_sha256
from t
"""
