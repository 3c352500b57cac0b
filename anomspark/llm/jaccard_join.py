"""Operator 8: n-gram Jaccard join with a prefix tree.

A document's set holds the distinct hashes of its 5-word shingles (64 bits).  Sets are kept in
one global order: frequent shingles last (by document frequency), the others by hash.  Two sets
of Jaccard similarity of at least ``percent`` must share a shingle among the first
``n - ceil(percent * n) + 1`` of each, so only these prefixes are shuffled.  A prefix shingle that
one set alone has is dropped at once; the documents around each shared shingle are stored in a
trie of their following shared shingles, and each document traverses it: partial overlaps are
counted once per shared path, and a subtree is left when the overlap so far plus the remaining
length cannot reach the required overlap any more.  What is left is compared exactly on the whole
texts.  Documents with equal sets are collapsed into one node first.

Groups are never collected whole: a trie holds at most ``block`` documents; larger groups are
split, first by linking blocks through representatives (which joins families of near copies in
linear work), then by probing every block with the documents outside the group's largest class.  Of the
candidates a document's most promising with each class are compared first; the others only if the classes are
still apart.

Results: null or empty texts have an empty set, link with nothing and are their own class;
fewer than five words are one shingle; repeated rows and ids are kept; further columns are ignored
by :func:`jaccard_classes`.  Frequencies only choose the order, so they are gathered from all
documents but summed from shingles seen at least three times by one task; any order is exact.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomspark.llm.common import checked_broadcast, docs_without_row_once, fresh, read, release, reliable_checkpoint
from anomspark.llm.components import components
from anomspark.llm.textnum import shingle_sets, slices

WORDS, PERCENT, BLOCK = 5, 75, 4096
#: A shingle counts as frequent if it is found this often; of more than ``FREQUENT`` of them the table
#: holds the most frequent ones (16 bytes each).
LEAST_FREQUENT, FREQUENT = 20, 1 << 20
FLUSH_BYTES = 16 << 20
#: Shingles are numbered in the global order: others by 62 bits of the hash, frequent ones after them.
LAST = 1 << 62
#: Least hashes kept of each set, and how many of them group likely copies before the exact join.
LEAST, SPOTS = 24, 4
#: Pairs of a document with a class that a group gives in the rounds before the last, which gives all.
PICKS = (1, 4)
#: First shared shingles of a document by which pairs that have met before are told.
HEAD = 8


def needed(n: int, percent: int = PERCENT) -> int:
    """Least intersection of a set of size ``n`` with any linked set."""
    return -(-percent * n // 100)


def overlap_needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Least intersection at which sets of sizes ``n`` and ``m`` are linked."""
    return -(-percent * (n + m) // (100 + percent))


# ---- sets and prefixes -------------------------------------------------------------------

def _sets(words: int):
    """Of each document its set's size, name and least hashes (of copies in a task the first has them); rows with
    ``times`` say instead how often a piece of the task holds a shingle, of those it holds three times."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        seen: set[int] = set()
        size, kind = 0, None

        def rows(*cols):
            return pa.RecordBatch.from_arrays([*cols], names=["id", "n", "sig", "least", "token", "times"])

        def flush():
            h = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            held.clear()
            h.sort()
            if len(h) < 3:
                return None
            h = h[:-2][(h[:-2] == h[2:])]  # once for each time beyond the second
            h, c = np.unique(h, return_counts=True)
            return rows(*(pa.nulls(len(h), t) for t in (kind, pa.int32(), pa.int64(), pa.list_(pa.int64()))),
                        pa.array(h.view(np.int64)), pa.array(c.astype(np.int64) + 2))
        for b in slices(batches, "text"):
            kind = b.column(0).type
            sets = shingle_sets(b.column(1).to_pylist(), words)
            sig, least = [], []
            for s in sets:
                k = _key(s) if len(s) else None
                sig.append(k)
                least.append(None if k is None or k in seen else s[:LEAST].view(np.int64))
                if k is not None:
                    held[k] = s  # equal sets count once
                    seen.add(k)
            yield rows(b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.int64()),
                       pa.array(least, pa.list_(pa.int64())), *(pa.nulls(len(sets), pa.int64()) for _ in range(2)))
            size += b.column(1).nbytes
            if size >= FLUSH_BYTES:
                if (out := flush()) is not None:
                    yield out
                size = 0
        if (out := flush()) is not None:
            yield out
    return run


def frequent_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of the frequent shingles and their rank in the global order; ``counts(token, times)``."""
    found = reliable_checkpoint(counts.groupBy("token").agg(F.sum("times").alias("n")).where(F.col("n") >= LEAST_FREQUENT))
    steps = found.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = 0, 0  # steps of n: a few hundred
    for r in steps:
        held += r["count"]
        if held > FREQUENT:
            least = r["step"] + 1
            break
    found = found.where(F.floor(F.log2("n") * 8) >= least).toPandas()
    found = found.sort_values(["n", "token"], kind="stable")
    h = found.token.to_numpy(np.int64).view(np.uint64)
    rank = np.arange(len(h), dtype=np.int64)
    o = np.argsort(h)
    return h[o], rank[o]


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefixes(words: int, percent: int, frequent):
    """The prefix of each set, in the global order; copies in a task have it once."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = frequent.value
        seen: set[int] = set()
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column(0).to_pylist(), words)
            cut = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.searchsorted(heavy, flat) if len(heavy) else np.zeros(len(flat), np.int64)
            at[at == len(heavy)] = 0
            is_heavy = heavy[at] == flat if len(heavy) else np.zeros(len(flat), bool)
            sig, n, prefix = [], [], []
            for i, s in enumerate(sets):
                if not len(s) or (k := _key(s)) in seen:
                    continue
                seen.add(k)
                sig.append(k)
                n.append(len(s))
                p = len(s) - needed(len(s), percent) + 1
                m = is_heavy[cut[i]:cut[i + 1]]
                order = (s[~m] >> np.uint64(2)).view(np.int64)
                if len(order) < p:
                    order = np.concatenate((order, np.sort(rank[at[cut[i]:cut[i + 1]][m]]) + LAST))
                prefix.append(order[:p])
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int32()),
                                              pa.array(prefix, pa.list_(pa.int64()))], names=["sig", "n", "prefix"])
    return run


# ---- trie ---------------------------------------------------------------------------------

class Node:
    """A trie node; below it, ``more`` is the most shared shingles a document still has, ``low`` and
    ``high`` the least and greatest set size."""

    __slots__ = ("kids", "ends", "more", "low", "high")

    def __init__(self):
        self.kids: dict[int, Node] = {}
        self.ends: list[tuple] = []
        self.more, self.low, self.high = 0, 1 << 60, 0


class Trie:
    """Documents that share one shingle, stored by the shared shingles that follow it in order.

    An entry is (node, set size, class, following shingles).  Shingles that no other document has
    in its prefix are left out: they cannot match.
    """

    def __init__(self, percent: int):
        self.percent, self.root = percent, Node()

    def add(self, entry: tuple) -> None:
        _, n, _, toks = entry
        node, left = self.root, len(toks)
        for tok in [None, *toks]:
            if tok is not None:
                node = node.kids.setdefault(tok, Node())
                left -= 1
            node.more = max(node.more, left)
            node.low, node.high = min(node.low, n), max(node.high, n)
        node.ends.append(entry)

    def probe(self, entry: tuple) -> Iterator[tuple[tuple, int]]:
        """Stored documents that may be linked with ``entry`` (never misses a linked one), and the overlap so far."""
        _, n, _, toks = entry
        pc, mine = self.percent, {t: i for i, t in enumerate(toks)}
        small = needed(n, pc)
        stack = [(self.root, 1, len(toks))]
        while stack:
            node, have, rest = stack.pop()
            if node.high < small or node.low * pc > 100 * n:
                continue
            # the shingles after the shorter prefix are unknown; the longer of both tails bounds them
            tail = max(small, needed(node.high, pc)) - 1
            if have + min(rest, node.more) + tail < overlap_needed(n, max(node.low, small), pc):
                continue
            for y in node.ends:
                m = y[1]
                if small <= m and m * pc <= 100 * n and have + max(small, needed(m, pc)) - 1 >= overlap_needed(n, m, pc):
                    yield y, have
            for tok, kid in node.kids.items():
                i = mine.get(tok)
                if i is None:
                    stack.append((kid, have, min(rest, len(toks) - bisect_right(toks, tok))))
                else:
                    stack.append((kid, have + 1, len(toks) - i - 1))


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of batches sorted by (token, block), a list for each."""
    key, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if (row["token"], row["block"]) != key:
                if held:
                    yield held
                key, held = (row["token"], row["block"]), []
            held.append(row)
    if held:
        yield held


def _batches(pairs: Iterable[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held = []
    for p in pairs:
        held.append(p)
        if len(held) >= 50_000:
            yield _batch(held)
            held = []
    yield _batch(held)


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()),
                                       pa.array([min(p) for p in pairs], pa.int64())], names=["a", "b"])


def _likely_pairs(percent: int, kinds: int):
    """Pairs of each document of a group with the two whose hashes are most common (kinds 0 and 1) and
    with its two neighbours in trie order (2 and 3), and the share of least hashes both have."""
    def pairs(batches):
        for rows in _groups(batches):
            rows.sort(key=lambda r: r["rest"])
            sets = [set(r["rest"]) for r in rows]
            often = Counter(t for s in sets for t in s)
            hubs = sorted(range(len(rows)), key=lambda i: (-sum(often[t] for t in sets[i]), i))[:2]
            for i, x in enumerate(rows):
                for kind, j in enumerate([*hubs, i - 1, i - 2][:kinds]):
                    if j < 0 or j == i or x["comp"] == rows[j]["comp"]:
                        continue
                    both = 1 + len(sets[i] & sets[j])
                    share = both / (len(sets[i]) + len(sets[j]) + 2 - both)
                    if 100 * share >= percent - 10:
                        yield x["comp"], kind, x["sig"], rows[j]["sig"], share

    def run(batches):
        held = []
        for p in pairs(batches):
            held.append(p)
            if len(held) >= 50_000:
                yield batch(held)
                held = []
        yield batch(held)

    def batch(held):
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], t) for k, t in enumerate(types)],
                                          names=["comp", "kind", "x", "y", "share"])
    return run


def _likely(rows: DataFrame, percent: int, kinds: int) -> DataFrame:
    """The best pair of each kind for each class so far, whatever the size of its groups; only a start for the
    exact join."""
    found = _grouped(rows).mapInArrow(_likely_pairs(percent, kinds), "comp long, kind int, x long, y long, share double")
    best = found.groupBy("comp", "kind").agg(F.max(F.struct("share", "y", "x")).alias("p")).select("p.x", "p.y")
    return best.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _possible_pairs(percent: int, picks: int | None):
    """Pairs of different classes that the trie cannot rule out: of each document and class the ``picks`` with the
    greatest overlap so far, or every one."""
    def pairs(batches):
        for rows in _groups(batches):
            if not any(r["probe"] for r in rows):
                continue  # one class
            trie, often = Trie(percent), Counter()
            for r in rows:
                often.update(r["rest"])
            for r in rows:  # shingles of one document alone cannot match
                r["entry"] = (r["sig"], r["n"], r["comp"], [t for t in r["rest"] if often[t] > 1])
                if not r["probe"]:
                    trie.add(r["entry"])
            for r in sorted((r for r in rows if r["probe"]), key=lambda r: not r["index"]):
                best: dict[int, list] = {}
                for y, have in trie.probe(r["entry"]):
                    if y[2] == r["comp"]:
                        continue
                    if picks is None:
                        yield r["sig"], y[0]
                        continue
                    held = best.setdefault(y[2], [])
                    heappush(held, (have, y[0]))
                    if len(held) > picks:
                        heappop(held)
                yield from ((r["sig"], y) for held in best.values() for _, y in held)
                if r["index"]:
                    trie.add(r["entry"])
    return lambda batches: _batches(pairs(batches))


def _with_partner(percent: int):
    """Rows that sizes and positions alone allow a partner of another class in their group, with the group's largest
    class: given where the group is dealt to several blocks, else found here."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in [*batches, None]:
            if b is not None:
                held = b if held is None else pa.concat_batches([held, b])
                if held.num_rows < 20_000:
                    continue
            if held is None or not held.num_rows:
                continue
            key = [held.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            new = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1
            cut = np.concatenate(([0], new, [held.num_rows]))
            if b is not None:
                if len(cut) == 2:
                    continue
                part, held = held.slice(0, int(cut[-2])), held.slice(int(cut[-2]))
                cut = cut[:-1]
            else:
                part, held = held, None
            size = np.diff(cut)
            comp = part.column(4).to_numpy()
            several = np.minimum.reduceat(comp, cut[:-1]) != np.maximum.reduceat(comp, cut[:-1])
            if not several.any():
                continue
            part = part.filter(pa.array(np.repeat(several, size)))
            size = size[several]
            cut = np.concatenate(([0], np.cumsum(size)))
            keep = np.zeros(part.num_rows, bool)
            n, comp, pos, more, index = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6, 7))
            token, heads = part.column(0).to_numpy(), _heads(part.column(9))
            n = n.astype(np.int64)
            group = np.repeat(np.arange(len(size)), size)
            given = part.column(8).is_valid().to_numpy(zero_copy_only=False)
            top = np.where(given, part.column(8).fill_null(0).to_numpy(), _largest_class(group, comp)[group])
            probe = comp != top
            few = np.repeat(size <= 16, size)
            for d in range(1, int(min(16, size.max(initial=1)))):  # small groups, all at once
                i = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]))
                j = i + d
                i, j = np.concatenate((i, j)), np.concatenate((j, i))
                ok = np.flatnonzero(probe[i] & index[j] & _allowed(n, comp, pos, more, i, j, percent))
                ok = ok[_first_meeting(heads, token, i[ok], j[ok])]
                keep[i[ok]] = keep[j[ok]] = True
            for lo, hi in zip(cut[:-1][size > 16], cut[1:][size > 16], strict=True):
                j = np.arange(lo, hi)
                j = j[index[j]]
                for i in lo + np.flatnonzero(probe[lo:hi]):
                    ok = j[_allowed(n, comp, pos, more, i, j, percent)]
                    ok = ok[_first_meeting(heads, token, np.full(len(ok), i), ok)]
                    if len(ok):
                        keep[i] = keep[ok] = True
            sig = part.column(2).to_numpy(zero_copy_only=False)
            names = np.zeros(part.num_rows, np.int64)
            for g in np.unique(group[keep]):
                lo, hi = cut[g], cut[g + 1]
                names[lo:hi] = _key(sig[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in (0, 1, 2, 3, 4)), pa.array(top), part.column(7), pa.array(names)],
                names=["token", "block", "sig", "n", "comp", "top", "index", "members"]).filter(pa.array(keep))
    return run


def _largest_class(group: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """The class with the most rows of each group (rising from 0), of several the greatest."""
    order = np.lexsort((comp, group))
    g, c = group[order], comp[order]
    start = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
    rows = np.diff(np.concatenate((start, [len(g)])))
    best = np.lexsort((c[start], rows, g[start]))
    last = np.concatenate((g[start][best][1:] != g[start][best][:-1], [True]))
    return c[start][best][last]


def _allowed(n, comp, pos, more, i, j, percent: int) -> np.ndarray:
    """Whether rows ``i`` and ``j`` of one group may be linked, by size, position and length."""
    least = -(-percent * (n[i] + n[j]) // (100 + percent))
    ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
    ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least
    tail = -(-percent * np.maximum(n[i], n[j]) // 100) - 1
    return ok & (1 + np.minimum(more[i], more[j]) + tail >= least)


def _heads(col: pa.Array) -> np.ndarray:
    """(rows, HEAD) first shared shingles of each row's document, -1 where it has fewer."""
    out = np.full((len(col), HEAD), -1, np.int64)
    size = np.diff(col.offsets.to_numpy())
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = col.flatten().to_numpy()
    return out


def _first_meeting(heads: np.ndarray, token: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether no earlier shingle among the first of both documents brings rows ``i`` and ``j`` together."""
    met = np.zeros(len(i), bool)
    for a in range(HEAD):
        x = heads[i, a]
        met |= (x >= 0) & (x < token[i]) & (heads[j] == x[:, None]).any(axis=1)
    return ~met


def _same_set(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column(1).to_pylist(), words)
            yield b.filter(pa.array([_key(s) == k for s, k in zip(sets, b.column(0).to_pylist(), strict=True)]))
    return run


def _linked(words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text_a"):
            x, y = (shingle_sets(b.column(i).to_pylist(), words) for i in (2, 3))
            keep = []
            for s, t in zip(x, y, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])
    return run


# ---- join ---------------------------------------------------------------------------------

def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("token"), F.col("block")).sortWithinPartitions("token", "block", "n", "sig")


def _tried(rows: DataFrame, percent: int, picks: int | None) -> DataFrame:
    return _grouped(rows).mapInArrow(_possible_pairs(percent, picks), "a long, b long").distinct()


def _verified(pairs: DataFrame, text_of, words: int, percent: int) -> DataFrame:
    """The linked ones among candidate pairs; ``text_of`` gives the texts of a table of nodes."""
    ends = reliable_checkpoint(pairs)
    text = text_of(ends.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    ta = text.select(F.col("sig").alias("a"), F.col("text").alias("text_a"))
    tb = text.select(F.col("sig").alias("b"), F.col("text").alias("text_b"))
    both = ends.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return reliable_checkpoint(both.mapInArrow(_linked(words, percent), "a long, b long"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id`` (least id of the class)."""
    spark = docs.sparkSession
    # prefixes go from the texts right to their shingles; kept are small rows of the pass that counts shingles
    sets = reliable_checkpoint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sets(words), f"id {docs.schema[id_col].dataType.simpleString()}, n int, sig long, least array<long>, token long, times long"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(sets.where("times is not null").select("token", "times")))
    base = sets.where("times is null")
    prefixes = docs.select(F.col(text_col).alias("text")).mapInArrow(_prefixes(words, percent, frequent),
                                                                     "sig long, n int, prefix array<long>")

    token = Window.partitionBy("token")
    shared = (prefixes.select("sig", "n", F.posexplode("prefix").alias("pos", "token"))
              .withColumn("least", F.min("sig").over(token)).withColumn("most", F.max("sig").over(token))
              .where("least <> most").select("sig", "n", F.struct("token", "pos").alias("t")))
    nodes = reliable_checkpoint(shared.groupBy("sig", "n").agg(F.array_sort(F.collect_set("t")).alias("toks")))
    release(spark)
    heads = reliable_checkpoint(base.where("least is not null").select("sig", "n", "least")
                                .join(nodes.select("sig"), "sig", "left_semi")
                                .groupBy("sig", "n").agg(F.min("least").alias("least")))
    rows_of = reliable_checkpoint(base.select("id", "n", "sig"))
    del sets, base  # with their least hashes
    names = rows_of.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"))
    owner = reliable_checkpoint(nodes.select("sig").join(names, "sig"))
    repeats = bool(docs.groupBy(id_col).count().where("count > 1").head(1))
    release(spark)

    def text_of(asked: DataFrame) -> DataFrame:
        mine = checked_broadcast(reliable_checkpoint(owner.join(asked, "sig").withColumnRenamed("id", "_own")))
        text = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
                .join(mine, F.expr("_id <=> _own")).select("sig", "text"))
        if repeats:  # an id that repeats may name several texts
            text = text.mapInArrow(_same_set(words), "sig long, text string").dropDuplicates(["sig"])
        return text

    def relabelled(edges: DataFrame) -> DataFrame:
        return reliable_checkpoint(nodes.select("sig").join(
            components(edges).withColumnRenamed("node", "sig"), "sig", "left")
            .select("sig", F.coalesce("comp", "sig").alias("comp")))

    edges = None
    labels = heads.select("sig", F.col("sig").alias("comp"))
    # families of near copies, through their least hashes: first each document with the hub of its groups, then
    # each class so far, then classes whose groups were split into blocks, through one document of each
    for kinds, spoken in ((1, False), (4, False), (4, True)):
        first = heads.join(labels, "sig").select("sig", "n", "comp", "least", F.posexplode(F.slice("least", 1, SPOTS))
                                                 .alias("at", "token"))
        first = first.select("token", "sig", "n", "comp", F.expr("slice(least, at + 2, size(least))").alias("rest"))
        if spoken:
            row = F.struct("sig", "n", "rest")
            first = first.groupBy("token", "comp").agg(F.min_by(row, "sig").alias("r")).select("token", "comp", "r.*")
        size = reliable_checkpoint(first.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("one"),
                                                              F.max("comp").alias("other")).where("one <> other"))
        release(spark)
        rows = (first.join(checked_broadcast(size.select("token", "k")), "token")
                .withColumn("block", F.expr(f"pmod(xxhash64(sig), ceil(k / {block}))")))
        found = _verified(_likely(rows.drop("k"), percent, kinds), text_of, words, percent)
        edges = found if edges is None else edges.unionByName(found)
        labels = relabelled(edges)
        release(spark)
        if kinds > 1 and not size.where(F.col("k") > block).head(1):
            break  # no group was split, so no family can be in parts

    # exact: every shared shingle.  Its rows go to it once, and slim: they hold no list of shingles but the first ones
    # before it, and whether its documents are of several classes is seen there.  Only shingles of more than ``block``
    # documents, which are few, are dealt to several blocks by what is counted before
    every = nodes.join(labels, "sig").select("sig", "n", "comp", "toks", F.posexplode("toks").alias("at", "t")).select(
        F.col("t.token").alias("token"), "sig", "n", "comp", F.col("t.pos").alias("pos"),
        F.expr("size(toks) - at - 1").alias("more"), F.expr(f"slice(toks.token, 1, least(at, {HEAD}))").alias("head"))
    hot = reliable_checkpoint(nodes.select(F.explode("toks.token").alias("token")).groupBy("token")
                              .agg(F.count("*").alias("k")).where(F.col("k") > block))
    release(spark)
    rows = every
    if hot.head(1):
        per = every.select("token", "comp").join(checked_broadcast(hot), "token").groupBy("token", "comp").agg(
            F.count("*").alias("c"))
        split = reliable_checkpoint(per.groupBy("token").agg(
            F.sum("c").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("classes")))
        rows = rows.join(checked_broadcast(split), "token", "left").where("coalesce(classes, 2) > 1").drop("classes")
    else:
        rows = rows.selectExpr("*", "cast(null as long) as k", "cast(null as long) as top")
    rows = (rows.withColumn("blocks", F.expr(f"coalesce(cast(ceil(k / {block}) as int), 1)"))
            .withColumn("own", F.expr("cast(pmod(xxhash64(sig), blocks) as int)"))
            .withColumn("block", F.explode(F.expr("if(comp <> top, sequence(0, blocks - 1), array(own))")))
            .select("token", F.col("block").cast("long"), "sig", "n", "comp", "pos", "more",
                    F.expr("block = own").alias("index"), "top", "head"))
    rows = _grouped(rows).mapInArrow(
        _with_partner(percent), "token long, block long, sig long, n int, comp long, top long, index boolean, members long")
    # documents that share many shingles meet at the first of them
    rows = rows.withColumn("first", F.min("token").over(Window.partitionBy("members"))).where("token = first")
    rows = reliable_checkpoint(rows.drop("first", "members"))
    release(spark)
    rows = rows.join(nodes.select("sig", F.col("toks.token").alias("toks")), "sig")
    rows = reliable_checkpoint(rows.select("token", "block", "sig", "n", "comp", "top", "index",
                                           F.expr("filter(toks, t -> t > token)").alias("rest")))
    release(spark)
    # two classes need one link: a document's most promising pairs with a class are compared first, and all that
    # are left only where the classes are still apart
    done = moved = None
    tops = labels.where("sig = comp").select("sig")
    for picks in (*PICKS, None):
        now = rows
        for c in ("comp", "top") if moved is not None else ():
            now = now.join(checked_broadcast(moved.toDF(c, f"now_{c}")), c, "left").withColumn(c, F.coalesce(f"now_{c}", c))
        now = now.withColumn("probe", F.expr("comp <> top")).where("probe or index")
        pairs = _tried(now.select("token", "block", "sig", "n", "comp", "probe", "index", "rest"), percent, picks)
        pairs = reliable_checkpoint(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        release(spark)
        edges = edges.unionByName(_verified(pairs, text_of, words, percent))
        if picks:  # classes that became part of another one
            moved = reliable_checkpoint(relabelled(edges).where("sig <> comp").join(tops, "sig", "left_semi"))
            done = pairs if done is None else done.unionByName(pairs)
        release(spark)

    labels = components(edges).withColumnRenamed("node", "sig")
    keyed = rows_of.join(labels, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    keyed = reliable_checkpoint(keyed.select("id", "n", "comp"))
    low = keyed.where("comp is not null").groupBy("comp").agg(F.min("id").alias("low"))
    full = keyed.where("comp is not null").join(low, "comp").select("id", "n", "low")
    empty = keyed.where("comp is null").select("id", "n", F.col("id").alias("low"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                                          F.col("low").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document (the least id, null last) of each class stays; documents without words all stay.
    Rows are told apart by id and text, so texts that share an id, or have none, are judged one by one."""
    key, = fresh(docs, "_key")
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    full = docs.where(worded).withColumn(key, name)
    classes = jaccard_classes(full, key, text_col, **options)
    gone = reliable_checkpoint(classes.where(F.col(key) != F.col("component_id")).select(key).distinct())
    release(docs.sparkSession)
    return docs_without_row_once(full, gone, key).select(*docs.columns).unionByName(docs.where(~worded))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, md5(case when len(ws) < 5 then array_to_string(ws, ' ') || '~' || len(ws)
        else array_to_string(ws[i:i+4], ' ') end) as sh
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
      group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y
      where 100 * c >= 75 * (nx.n + ny.n - c)),
r as (select x as a, x as b from e union select r.a, e.y from r join e on e.x = r.b),
m as (select a, min(b) as b from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.b, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id
"""
