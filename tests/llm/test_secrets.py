"""Operator 9 against a plain scan in Python: base spans, blanked parts, windows, many matches."""

import collections
import hashlib
import math
import random
import re
import time

import pytest

from anomspark.llm import secrets

ASSIGN = re.compile(r'''(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', re.I | re.A)
ALLOWED = re.compile(r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])"
                     r"|example|sample|dummy|placeholder|changeme|your_|lorem|abcdefgh|12345678|([A-Za-z0-9+/_=-])\1{5,}",
                     re.I | re.A)
KINDS = ["assign", "access", "hex", "entropy"]


def base(t):
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def random_in_a_window(v):
    for i in range(len(v) - 19):
        w = v[i:i + 20]
        bits = -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(w).values())
        least = 2.9 if re.fullmatch("[0-9a-fA-F]+", w) else 3.5 if re.fullmatch("[0-9A-Za-z]+", w) else 3.7
        if re.search("[0-9]", w) and re.search("[A-Za-z]", w) and bits >= least:
            return True
    return False


def added(t):
    for pattern, fit in ((ASSIGN, lambda m: len(m[2]) >= 8), (re.compile("AKIA[A-Z0-9]{12,}"), lambda m: True),
                         (re.compile("[0-9a-f]{32,}"), lambda m: True), (ALLOWED, lambda m: True)):
        t = pattern.sub(lambda m, fit=fit: " " * len(m[0]) if fit(m) else m[0], t)
    return [(m.start(), "entropy", m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if random_in_a_window(m[0])]


def texts():
    r = random.Random(5)
    key = "q8Zt3LmX0vR7pW2sYb9KdJ4"
    out = [None, "", " ", f"é {key} end", f"{key}{'-' * 9}", f"/sample/{key}/x", f"{key}=12345678{key}", f"token={key} {key}",
           "AAAAAA" + key + "======", f"{'0f' * 20}{key}", "123e4567-e89b-12d3-a456-426614174000", "a" * 40 + "1",
           f"AKIA{'A1' * 8} api_key: 'short' secret = \"{key}\"", "x" * 19 + "1", "PASSWORD=" + "Ab3" * 9]
    parts = [key, "example", "0123456789abcdef" * 2, "token = ", "AKIAQ7", "zzzzzz", "-", " ", "\n", "Ü", "ab12CD", "+/x9"]
    return out + ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(300)]


def test_against_a_plain_scan(spark):
    rows = list(enumerate(texts()))
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        assert [(s.start, s.kind, s.end) for s in out[d].base] == base(t or ""), t
        assert [(s.start, s.kind, s.end) for s in out[d].added] == added(t or ""), t
    assert sum(len(r.added) for r in out.values()) > 50


@pytest.mark.parametrize("unit", ["token=abcdefgh1 ", "q8Zt3LmX0vR7pW2sYb9KdJ4 ", "q8Zt3LmX0vR7pW2s"])
def test_many_matches_take_linear_time(spark, unit):
    text = unit * 8000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.scan(df.limit(0)).collect()
    began = time.time()
    row = secrets.scan(df).first()
    assert time.time() - began < 15
    assert [(s.start, s.kind, s.end) for s in row.base] == base(text)
    assert [(s.start, s.kind, s.end) for s in row.added] == added(text)


def test_clashing_names(spark):
    df = spark.createDataFrame([("x", "y", "token=abcdefgh1")], "base string, added string, text string")
    out = secrets.scan(df)
    assert out.columns == ["base", "added", "text", "_base", "_added"] and len(out.first()["_base"]) == 1


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = secrets.op9_secret_scan(spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 4 + ["string"] * 2
    found = 0
    for r in out.collect():
        b = base(rows[r.doc_id])
        every = sorted(b + added(rows[r.doc_id]), key=lambda s: (s[0], KINDS.index(s[1])))
        form = [",".join(f"{k}:{i}:{j}" for i, k, j in x) for x in (b, every)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in b) for k in KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(form[0].encode()).hexdigest() and r.spans == form[1]
        found += len(b)
    assert found
