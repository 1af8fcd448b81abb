"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from casetrail.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(3)
    odd = [chr(c) for c in (*range(0x00, 0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x2009, 0x200B, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x661, 0xBD, 0x301, 0x1D7D8)]
    pool = list("abcdefgh ABC.,'’!123\n\t ") + odd + ["'s", "'ll", " the", "ing", "<|endoftext|>", "  ", "über", "ñ", "\r\n"]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    out += ["a" * 3000, " " * 500, "ab" * 700, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "Hello world's tokens, don't they'll we've"]
    return out + [" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 14))) for _ in range(300)) for _ in range(40)]


def test_equals_library(spark):
    lib, rows = Tokenizer.from_file(PATH), [(i, t, t) for i, t in enumerate(texts())]
    rows += [rows[0], (5000, None, "x"), (None, "null key", None)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = lib.encode(want[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids), want[r.doc_id]
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_cache_limit_changes_nothing():
    data = open(PATH, "rb").read()
    small, large = bpe.Codec(data, keep=5), bpe.Codec(data)
    for t in texts()[:50]:
        assert small.encode_all([t, t]) == large.encode_all([t, t])


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
