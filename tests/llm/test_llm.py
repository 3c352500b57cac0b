"""Training-data operators: brute force, round trips, and nulls, ties, empty tables, odd columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from anomspark.llm import (components, decontaminate, html_text, huffman, jaccard_join, mixing, quality_classifier,
                           quality_rules, secrets, sharding, token_file, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ROWS = [(1, words(60, 1), "en", "a", 1, "x"), (2, words(60, 1), "en", "b", 1, None), (3, None, None, None, None, None),
        (4, "", "en", "a", 0, "y"), (None, "one two", "de", None, 3, "z"), (5, words(20000, 2), "en", "b", 9, "x"),
        (6, "One two", "en", "a", 7, "x"), (6, "One two", "en", "a", 7, "x"), (7, "\n\n \t", "fr", "c", 4, "x"),
        (8, words(60, 1) + " tail", "en", "c", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 sharding
def test_shards_are_whole_and_even(spark, docs, empty):
    many = docs.unionByName(docs).unionByName(spark.createDataFrame([ROWS[0]] * 200, SCHEMA))
    out = sharding.shuffle_records(many, 4, bucket_bytes=4000).collect()
    assert len(out) == 220
    slots = collections.defaultdict(list)
    for r in out:  # the table's own ``shard`` stays, the new one gains an underscore
        slots[r["_shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [55] * 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, (tuple(r)[:6] for r in out))) == sorted(map(str, (tuple(r) for r in many.collect())))
    assert sharding.shuffle_records(empty).count() == 0
    again = sharding.shuffle_records(docs, 4, bucket_bytes=4000).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.shuffle_records(docs, 4, bucket_bytes=4000).collect()))


def test_shards_written(spark, docs, tmp_path):
    sharding.write_shards(sharding.shuffle_records(docs.drop("shard"), 2), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


# ---- 2 html
def test_html():
    page = ('<html><head><title>t</title></head><body><nav><a>x</a></nav><div class="ad">Buy</div><article><h1>T</h1>'
            '<p>a &amp; b<p>c\n  d<aside>side</aside><form>f</form><script>var a="</p>";</script></article>'
            '<section id="comments"><article><p>' + "no " * 50 + '</p></article></section><footer>f</footer>')
    assert html_text.main_text(page) == "T\na & b\nc d"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "just text", "<div")] == ["", "", "", "just text", ""]
    long_ = "<div><p>" + "word " * 50 + "</p><p>short</p></div>"
    assert html_text.main_text(long_) == ("word " * 50).strip() + "\nshort"
    assert html_text.main_text("<p>x</p>" * 5000).count("\n") == 4999


def test_html_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "k"), (1, "u", "<p>hi", "k")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(pages).collect()) == ["", "hi"]


# ---- 3, 6 classifiers
def test_quality_held_out():
    clean = [words(80, i) + "." for i in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in words(80, i).split()) for i in range(120)]
    model = quality_classifier.train(clean[:80] + junk[:80], np.array([1] * 80 + [0] * 80))
    s = quality_classifier.scores([*clean[80:], *junk[80:], "", None], model)
    assert (s[:40] >= 0.5).all() and (s[40:80] < 0.5).all() and ((s >= 0) & (s <= 1)).all()
    assert (quality_classifier.scores(["a"], quality_classifier.train([], np.zeros(0))) > 0.99).all()


def test_toxicity_sentences():
    texts = [". ".join(words(8, 7 * i + k) for k in range(5)) for i in range(300)]
    y = np.array([i % 3 == 0 for i in range(300)]).astype(int)
    texts = [t + (". you vile grompf" if v else "") + "." for t, v in zip(texts, y)]
    weight, bias = toxicity.train(texts[:200], y[:200])
    w, sent, doc, p = toxicity.sentence_scores(texts[200:], weight, bias)
    assert (((toxicity.document_scores(100, doc, p) >= 0.5) == y[200:]).mean()) > 0.95
    none = np.ones(100)
    for d, x in zip(doc, p):
        none[d] *= 1 - x
    assert np.allclose(1 - none, toxicity.document_scores(100, doc, p))


def test_toxicity_frames(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (99, 1), (8, None)], "doc_id long, toxic int")
    out = toxicity.score(docs.withColumnRenamed("shard", "score"), toxicity.fit(docs, labels))
    assert out.count() == len(ROWS) and out.columns[-2:] == ["_score", "offending"]
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert toxicity.drop_toxic(empty, labels).count() == 0


# ---- 4 mixing
def test_budget_is_met():
    r = random.Random(5)
    for _ in range(30):
        size = np.array(sorted({r.randrange(1, 60) for _ in range(12)}))
        count = np.array([r.randrange(1, 5) for _ in size])
        goal = r.randrange(0, int((size * count).sum()))
        take = mixing.fit_budget(size, count, goal)
        reach = {0}
        for s, c in zip(size, count):
            reach = {x + k * s for x in reach for k in range(c + 1)}
        assert ((take >= 0) & (take <= count)).all()
        assert abs(int((take * size).sum()) - goal) <= min(abs(x - goal) for x in reach) + size[0]


def test_mix(spark, docs, empty):
    rows = [(i, words(5 + i % 50, i), "en", f"s{i % 7}", 0, "x") for i in range(700)] + ROWS
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(out) == len(rows) and out.times.between(0, 3).all()
    total = out["size"].sum()
    by = out.assign(taken=out["size"] * out.times).groupby("source", dropna=False).agg(
        size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    names = sorted((x for x in by.index if isinstance(x, str)), key=lambda s: s.encode()) + [None]
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    capped = set()
    while True:  # excess goes to the others until none is above
        free = [n for n in names if n not in capped]
        cap = {n: 3 * int(by["size"][by.index.isna()].iloc[0] if n is None else by["size"][n]) for n in names}
        left = total - sum(cap[n] for n in capped)
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if level * weight[n] > cap[n]}
        if not over:
            break
        capped |= over
    for n in names:
        row = by[by.index.isna()].iloc[0] if n is None else by.loc[n]
        assert row.target == pytest.approx(cap[n] if n in capped else level * weight[n]) and row.told == row["size"]
        if n != "b":  # a text longer than the target cannot be cut
            assert abs(row.taken - row.target) <= max(60, 0.02 * row.target)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


# ---- 5 token file
def test_huffman_round_trip():
    r = np.random.Generator(np.random.PCG64(1))
    for n, k in ((1, 1), (5, 2), (5000, 300), (3000, 40000)):
        ids = (r.zipf(1.3, n) % k).astype(np.uint16)
        length = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
        assert length.max() <= 16 and sum(2.0 ** -int(x) for x in length[length > 0]) <= 1
        first = np.array(sorted({0, n, *(int(x) for x in r.integers(0, n + 1, 4))}))
        data, start, marks, _ = huffman.encode(ids, first, length, huffman.canonical(length))
        back = huffman.decode(data, start[:-1], np.diff(first), marks, *huffman.decode_table(length))
        assert (back == ids).all()
    skewed = huffman.code_lengths(np.array([2 ** i for i in range(40)]))
    assert skewed.max() == 16


def test_token_file(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_file.tokenizer_path())
    extra = spark.createDataFrame([(50, "It's a—test… café! 5-6 $7.00 <|endoftext|> x" * 3, "en", "a", 0, "x")], SCHEMA)
    table = docs.unionByName(extra)
    token_file.write_tokens(table, str(tmp_path / "t"), part_bytes=20_000)
    got = token_file.read_tokens(spark, str(tmp_path / "t")).collect()
    want, start = [], 0
    for r in sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    token_file.write_tokens(empty, str(tmp_path / "e"))
    assert token_file.read_tokens(spark, str(tmp_path / "e")).count() == 0


# ---- 7 decontamination
def test_leaks(spark, empty):
    item = "A train leaves Berlin at 9 and drives 120 km to Hamburg, how many minutes does the whole trip take her"
    other = item.replace("Berlin", "Munich").replace("120", "250").replace("Hamburg", "Vienna")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "five words are just enough")], "item_id long, text string")
    rows = [(1, words(50, 3) + " " + item + " " + words(30, 4)), (2, words(20, 5) + " " + other), (3, words(90, 6)),
            (4, None), (5, ""), (None, item), (6, "x five words are just enough y"), (7, "too short"), (1, words(50, 3) + " " + item + " " + words(30, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (None, 1), (6, 4)}
    assert out[1, 1].same_values and not out[2, 1].same_values
    assert sorted(str(r.doc_id) for r in decontaminate.drop_leaks(docs, bench).collect()) == ["3", "4", "5", "7"]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_several_copies(spark):
    item = "A train leaves Berlin at 9 and drives 120 km to Hamburg, how many minutes does the whole trip take her"
    other = item.replace("Berlin", "Munich").replace("9", "7").replace("120", "250").replace("Hamburg", "Vienna")
    third = other.replace("Munich", "Rome").replace("7", "8").replace("250", "77").replace("Vienna", "Turin")
    longer = third.replace("Turin,", "Turin in the south,")  # copies whose offset moves within the item
    again = "she put 4 red apples into the box for him then " * 2 + "she put 5 red apples into the box for him then"
    numbers = "3 17 22 Adam Berta 40 51 66 72 x 90 Carl Dora 12 7 8"
    short = "Berlin is the only town here"
    bench = spark.createDataFrame(enumerate([item, again, numbers, short], 1), "item_id long, text string")
    rows = [(1, item + " and " + other), (2, f"{words(9, 1)} {other} {words(40, 2)} {third}"), (3, f"see {again} end"),
            (4, f"see {numbers} end"), (5, "see 4 18 23 Emil Fritz 41 52 67 73 x 91 Georg Hans 13 8 9 end"),
            (6, f"that {short} now"), (7, "that Paris is the only town here now"), (8, f"{other} {words(9, 3)} {longer}"),
            (9, words(90, 6)), (10, f"{words(9, 1)} {longer} {words(9, 5)} {longer.replace('Rome', 'Genoa').replace('77', '99')}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (3, 2), (4, 3), (6, 4), (8, 1), (10, 1)}
    assert {k for k, r in out.items() if r.same_values} == {(1, 1), (3, 2), (4, 3), (6, 4)}
    assert out[1, 1].windows == out[1, 1].item_windows == out[2, 1].windows


# ---- 8 Jaccard join
def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("block", [4096, 4])
def test_jaccard_brute_force(spark, block):
    r = random.Random(9)
    base = [words(120, s, 5000).split() for s in range(6)]
    rows = [(r[0], r[1]) for r in ROWS]
    passage = words(60, 77, 5000).split()
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"m{r.randrange(10 ** 6)}"
        if i % 5 == 0:
            w = [*words(r.randrange(5, 80), 1000 + i, 5000).split(), *passage]
        rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in jaccard_join.jaccard_classes(docs, block=block).collect()), key=str)
    assert got == classes(rows)


def test_jaccard_edges(spark, docs, empty):
    assert jaccard_join.jaccard_classes(empty).count() == 0
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "6", "7"] or len(kept) == 7
    e = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6)], "a long, b long")
    assert sorted(map(tuple, components.components(e).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_keep_one_shared_and_null_ids(spark):
    texts = [words(60, 50 + k) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " tail"), (None, None), (None, ""), (None, None), (1, texts[2]),
            (1, texts[3]), (2, texts[3] + " tail"), (1, " "), (1, " "), (2, texts[4]), (2, texts[0]), (3, texts[5]), (3, texts[5])]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r.doc_id, r.text) for r in kept)
    one = [(None, texts[1]), (None, texts[1] + " tail")]
    assert sum(got.pop(x, 0) for x in one) == 1
    assert got == collections.Counter([(None, None), (None, ""), (None, None), (1, texts[2]), (1, texts[3]), (1, " "), (1, " "),
                                       (2, texts[4]), (2, texts[0]), (3, texts[5])])


# ---- 9 secrets
def test_secrets(spark, empty):
    rows = [(1, 'é password = "abcd1234" and API_KEY: zzzzzzzzzz x token=short'), (2, "AKIA" + "A1" * 8 + " AKIA12"), (3, "0f" * 20),
            (4, None), (5, ""), (6, "key q8Zt3LmX0vR7pW2sYb9KdJ4 end"), (7, "id 123e4567-e89b-12d3-a456-426614174000"),
            (8, "word " * 3000 + "secret: 12345678"), (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1")]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assign = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
    for d, t in rows:
        t = t or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(want) == [(s.start, s.kind, s.end) for s in out[d].base]
    assert [(s.start, s.end) for s in out[6].added] == [(4, 27)]
    assert not out[7].added and not out[9].added
    assert secrets.scan(empty).count() == 0


def test_window_entropy(spark):
    from pyspark.sql import functions as F
    value = "q8Zt3LmX0vR7pW2sYb9KdJ4aaaaaaaaaaaaaa/+="
    best = max(-sum(c / 20 * math.log2(c / 20) for c in collections.Counter(value[i:i + 20]).values()) for i in range(len(value) - 19))
    got = spark.range(1).select(secrets.window_entropy(F.lit(value)).alias("e")).first().e
    assert got == pytest.approx(best)


# ---- 10 quality rules
def test_rules(spark, docs, empty):
    more = [(20, "a b c\na b c\n\n  \na b c # $", "en", "a", 0, "x"), (21, " ".join(["same"] * 80), "en", "a", 0, "x")]
    rows = ROWS + more
    out = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
                     len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert sorted((tuple(r)[:7] for r in out), key=str) == sorted(want, key=str)
    assert not any(r.kept for r in out if r.base_failed) and quality_rules.judge(empty).count() == 0


def many_languages(spark):
    r, rows = random.Random(5), []
    for k in range(20):  # half the words are 60 common ones of the language, half are rare
        name = None if k == 19 else "".join(chr(97 + (k * 7 + j) % 26) for j in range(4))
        for _ in range(100 if k < 18 else 95 if k == 19 else 3):
            t = [f"{name}{chr(97 + r.randrange(12))}{chr(97 + r.randrange(5))}" if r.random() < 0.5 else
                 "".join(chr(97 + r.randrange(26)) for _ in range(6)) for _ in range(120)]
            rows.append((len(rows), " ".join(t), name, None, None, None))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_every_language_has_a_reference(spark):
    rows, docs = many_languages(spark)
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(out) == len(rows) and all(r.kept for r in out.values())
    assert {d for d, r in out.items() if r.word_distance is None} == {1800, 1801, 1802}  # the language of 3 documents
    words_ = [WORD.findall(t) for _, t, *_ in rows]
    count = collections.defaultdict(collections.Counter)
    for (_, _, lang, *_), w in zip(rows, words_):
        count[lang].update(w)
    refs = {k: ({x: n for x, n in c.items() if n >= 1e-3 * c.total()}, c.total()) for k, c in count.items() if c.total() >= 10000}
    keys = {x: i for i, x in enumerate(sorted(set().union(*(f for f, _ in refs.values()))))}

    def hist(c, total):
        h = np.zeros(len(keys) + 1)
        for x, n in c.items():
            h[keys.get(x, -1)] += n
        h[-1] += total - sum(c.values())
        return h
    for d in (0, 500, 1799, 1850):
        h = hist(collections.Counter(words_[d]), 120)[None]
        assert np.isclose(out[d].word_distance, min(quality_rules.js_distance(h, hist(*x))[0] for x in refs.values()))


def test_references_do_not_depend_on_partitions(spark):
    docs = many_languages(spark)[1].where("doc_id < 300")
    one, many = ({r.doc_id: (r.kept, round(r.word_distance, 9), round(r.char_distance, 9)) for r in quality_rules.judge(x).collect()}
                 for x in (docs.coalesce(1), docs.repartition(60)))
    assert one == many


def test_js_distance():
    p = np.array([[1.0, 0, 3], [0, 0, 0], [2, 0, 6]])
    assert np.allclose(quality_rules.js_distance(p, np.array([1.0, 0, 3])), [0, 1, 0])
    assert np.allclose(quality_rules.js_distance(np.array([[1.0, 0]]), np.array([0, 5.0])), 1)


# ---- pipeline
def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    counts = out.groupby("shard").slot.agg(["count", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all()
    assert not out.groupby("doc_id").size().gt(3).any()


def test_letters_before_punctuation_keep_the_tokenizers_ids():
    """Every letter in front of punctuation, also those whose normal form ends in a mark."""
    ids = token_file.WordIds(token_file.tokenizer_path())
    letters = [chr(c) for c in range(0x21, 0x30000) if chr(c).isalnum()]
    texts = [f"GE{c}, {c}." for c in letters] + [
        "a\x01b \x01 \x01, GEZİ, J̌! <|ENDOFTEXT|> <|endoftext|>, I'M 's, x y\x1cz", "Å Å ǰ", ""]
    want = [e.ids + [1] for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, np.uint16).tolist() for i in range(0, len(texts), 5000) for x in ids.texts(texts[i:i + 5000])]
    assert got == want


def test_mix_counts_rows_that_repeat(spark):
    """1,000 rows of one id and text, with and without a source: each is a row of its own."""
    rows = [(1, "a b c d e", "x", 1)] * 1000 + [(2 + i, "a b c", None, 2) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, some long").repartition(5))
    got = collections.Counter()
    for r in out.collect():
        got[r["source"]] += r["size"] * r["times"]
    targets = {r["source"]: r["target"] for r in out.collect()}
    assert out.count() == 1300 and out.columns[:4] == ["doc_id", "text", "source", "some"]
    assert abs(got["x"] - targets["x"]) <= 2.5 and abs(got[None] - targets[None]) <= 1.5
    only = mixing.mix(spark.createDataFrame([(None, "a b", None, i) for i in range(99)] + [(1, "a", "s", 0)] * 60, "doc_id long, text string, source string, k int"))
    goal = {r["source"]: r["target"] for r in only.collect()}
    got = {s: sum(r["size"] * r["times"] for r in only.collect() if r["source"] == s) for s in goal}
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal) and only.count() == 159


def test_html_letters_that_grow_in_lower_case_shift_nothing():
    page = "<article>" + "İ" * 30 + "<script>a</script><p>after one</p><SCRIPT>b</Script ><p>after two</p></article>"
    assert html_text.main_text(page) == "İ" * 30 + "\nafter one\nafter two"
    assert html_text.main_text("<p>x</p><script>no </scripts> </ſcript> end") == "x"


def test_html_headings_and_article_parts_by_position():
    page = ('<nav><h2>menu</h2></nav><article><h1 class="page-header">Title</h1><p>one</p><div class="legal">The law</div>'
            '<div class="ad">buy</div><h2 class="related">more</h2></article><div class="legal">imprint</div>')
    assert html_text.main_text(page) == "Title\none\nThe law"


def test_html_is_linear_in_open_elements():
    import time
    for part, text in (("<article>", "x"), ("<div>", "x"), ("<nav><article>", "x"), ('<div class="ad">', "")):
        began = time.process_time()
        assert html_text.main_text(part * 8000 + "x") == text
        assert time.process_time() - began < 2


def test_html_empty_table_and_query(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    sf = "/root/testdata/sf0.001"
    out = html_text.op2_line_blocks(spark, sf)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:  # the given pages mark their article: its blocks, one by one
        inside = re.search(r"(?s)<article>(.*?)</article>", rows[r["page_id"]]["html"])[1]
        inside = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", inside)
        blocks = re.split(r"(?i)</?(?:p|h[1-6]|ul|li|div|section)\b[^>]*>", re.sub(r"(?i)<br\s*/?>", " ", inside))
        text = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks]
        assert r["text"] == "\n".join(x for x in text if x) and r["n_chars"] == len(r["text"])


def test_shard_query_reads_what_it_wrote(spark, empty, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = sharding.op1_two_pass_shuffle(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"),
                          ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = out.collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows.items())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    none = sharding.shuffle_records(empty.drop("shard"))
    sharding.write_shards(none, str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), none).count() == 0


def test_classifier_queries(spark, empty):
    """Types, folds and odd rows of op3 and op6 on the given tables."""
    sf = "/root/testdata/sf0.001"
    for query, modulus, rest, label in ((quality_classifier.op3_nb_svm_quality, 3, 1, "quality"),
                                        (toxicity.op6_toxicity_mil, 5, 0, "toxic")):
        out = query(spark, sf)
        assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = out.collect()
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        right = [r.predicted == known[r.doc_id] for r in rows if r.doc_id in known and not r.held_out]
        assert sum(right) >= 0.9 * len(right)


def test_quality_scores_of_odd_rows(spark, docs, empty):
    model = quality_classifier.train(["a b c"] * 5 + ["#$ ## !!"] * 5, np.array([1] * 5 + [0] * 5))
    more = docs.withColumnRenamed("shard", "score")
    got = quality_classifier.score(more, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1  # null and empty: the bias alone
    assert quality_classifier.score(empty, model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    assert quality_classifier.fit(docs, labels)[1] == 30.0  # no usable label


def test_token_batches_ask_for_each_word_once(monkeypatch):
    """Words of a batch are looked up once, whatever their number; a full table, white space at the ends, copies and
    empty texts change no ids."""
    texts = [" the cat,\n sat\x0bon ", "", "  ", "THE Cat, the cat, don't", "É É. <|endoftext|> THE", "\x85x \x1c y"] * 50
    ids = token_file.WordIds(token_file.tokenizer_path())
    want = [e.ids + [1] for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    asked, lookup = [], ids.ids
    monkeypatch.setattr(ids, "ids", lambda words: asked.extend(words) or lookup(words))
    for part in (texts, [x for x in texts if "<" not in x]):
        out, first = ids.flat(pa.array(["-", *part], pa.string()).slice(1))
        goal = [x for t, x in zip(texts, want) if t in part]
        assert out.tolist() == sum(goal, []) and np.diff(first).tolist() == [len(x) for x in goal]
        assert len(asked) == len(set(asked)) and b"" not in asked
        asked.clear()
    monkeypatch.setattr(token_file, "WORD_TABLE", 4)
    assert [np.frombuffer(x, np.uint16).tolist() for i in range(0, 300, 7) for x in ids.texts(texts[i:i + 7])] == want
    col = pa.array([b"skip", *ids.texts(texts)], pa.binary()).slice(1)
    flat, first = token_file._flat(col)
    assert flat.tolist() == sum(want, []) and first[-1] == len(flat)
