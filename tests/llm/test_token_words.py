"""Words with punctuation are looked up without it, and ids are counted where texts are tokenized."""

import numpy as np
import pyarrow as pa
import pytest

from anomspark.llm import token_file as TF

TEXTS = ["Fox, fox! fox. fox?! (fox) fox.fox, -., a;", "élan, ÉLAN! İ. ī, i̇, x́. क्, 5% a$b#\u000bq|", "",
         "x<|endoftext|>. fox| y, fox,\x1cfox:", "a,\n\nb;\tc!  d", "...", "a" * 50 + "!!", "K, ŉ. ŉ, ſ; ſ"]


@pytest.fixture(scope="module")
def words():
    return TF.WordIds(TF.tokenizer_path())


def test_words_are_kept_without_their_punctuation(words):
    words.table.clear()
    got = words.texts(TEXTS)
    plain = [np.array([*words.tokenizer.encode(t, add_special_tokens=False).ids, TF.END], np.uint16).tobytes() for t in TEXTS]
    assert got == plain
    assert not {b"fox,", b"fox!", b"fox.", b"a;"} & set(words.table)  # each form with punctuation had a row of its own


def test_tokenizing_counts_its_ids():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)), pa.int64()),
                                        pa.array([0] * len(TEXTS), pa.int32())], names=["text", "id", "part"])
    rows = [r for b in TF._tokenize(TF.tokenizer_path())([batch]) for r in b.to_pylist()]
    counts, = (np.frombuffer(r["counts"], "<i8") for r in rows if r["counts"] is not None)
    ids = np.frombuffer(b"".join(r["ids"] for r in rows if r["counts"] is None), np.uint16)
    assert len(rows) == len(TEXTS) + 1 and np.array_equal(counts, np.bincount(ids, minlength=1 << 16))
