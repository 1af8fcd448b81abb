"""Token counts against the tokenizers library."""

import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from casetrail.llm import queries, tokens
from tests.llm.test_bpe import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = open(PATH, "rb").read()


def rows():
    rnd = random.Random(8)
    odd = ["aaaaaaaaa" * k for k in range(1, 30)] + ["ab" * 2000 + "ba" * 1500, "=" * 5000, "\n" * 3000, "中文字符" * 900]
    odd += ["".join(rnd.choice("etaoinshrdlucmfw") for _ in range(6000)), "".join(chr(rnd.randint(0x4E00, 0x9FA5)) for _ in range(2000))]
    return [(i, t) for i, t in enumerate(texts() + odd + ["", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>"])]


def test_equals_library(spark):
    lib, data = Tokenizer.from_file(PATH), rows()
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in data}
    extra = [data[0], (9000, None), (None, "null key")]
    frame = spark.createDataFrame([(*r, 7, "x", True) for r in data + extra], "doc_id long, text string, n_tokens int, key string, over_limit boolean")
    got = tokens.count(frame, PATH).collect()
    assert len(got) == len(data) + 3 and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    found = {r.doc_id: r for r in got}
    for i, t in data:
        r = found[i]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[i], len(t.encode()), want[i] > 512), t
    assert (found[9000].n_bytes, found[9000].n_tokens, found[9000].over_limit) == (0, 0, False)
    assert found[None].n_tokens == 2 and sum(r.doc_id == data[0][0] for r in got) == 2


def test_query_equals_library_on_a_table(spark, tmp_path):
    """The registered query, whole texts of a table on disk."""
    lib, data = Tokenizer.from_file(PATH), rows()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in data}


def test_both_ways_agree_and_memory_is_bounded():
    words = [t.encode() for _, t in rows() if t]
    merges = tokens.Merges(DATA)
    assert merges.together(words).tolist() == [merges.alone(w) for w in words]
    small = tokens.Merges(DATA, keep_bytes=10, long=3)
    assert [small.count_all([t, t]) for _, t in rows()[:60]] == [merges.count_all([t, t]) for _, t in rows()[:60]]
    assert len(small.known) < 200


def test_long_word_in_reasonable_time():
    rnd = random.Random(1)
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    start = time.perf_counter()
    found = tokens.Merges(DATA).count_all([word])
    assert time.perf_counter() - start < 20
    assert found == [len(Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids)]


def test_order_of_merges_is_checked():
    bad = b'{"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["ab b", "a b"]}}'
    with pytest.raises(ValueError):
        tokens.Merges(bad)


def test_portions_cover_all():
    parts = list(tokens.portions(pa.array(["aa", "", "bbbb", "c", "dddddddd", ""]), 4))
    assert [t for _, p in parts for t in p] == ["aa", "", "bbbb", "c", "dddddddd", ""] and [f for f, _ in parts][0] == 0


def test_empty(spark):
    assert tokens.count(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
