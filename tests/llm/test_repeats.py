"""Both substring operators against brute force on made-up texts."""

import hashlib
import random

import pytest

from casetrail.llm import debruijn, suffixes

SCHEMA = "doc_id long, text string, start string, doc int"


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abé ñd") for _ in range(rnd.randint(1, 5))).strip() or "x" for _ in range(12)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [say(40), say(30), "a" * 250, "To " * 60, say(25) + "\x00\x00" + say(8)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else say(rnd.randint(1, 40)) for _ in range(rnd.randint(0, 5))]
        text = "\n".join(parts)
        if rows and rnd.random() < 0.2:
            text = rows[rnd.randrange(len(rows))][1] or ""
            cut = rnd.randrange(len(text) + 1)
            text = rnd.choice([text, text[:cut] + "q" + text[cut:], text[cut:]])
        rows.append((i, text, "s", 1))
    rnd.shuffle(rows)
    rows += [rows[3], (None, rows[5][1], None, None), (1000, None, None, 3), (1001, "", "", 2), (1002, " \t\n", "", 2)]
    return rows


def texts_of(rows):
    """Distinct documents in order: null key first."""
    return sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))


def brute(rows, symbols, window):
    seen, out = {}, {}
    for key, text in texts_of(rows):
        s = symbols(text)
        gone = [False] * len(s)
        for p in range(len(s) - window + 1):
            w = tuple(s[p:p + window]) if isinstance(s, list) else s[p:p + window]
            if w in seen:
                gone[p:p + window] = [True] * window
            seen.setdefault(w, (key, p))
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(s), sum(gone), spans, [x for x, g in zip(s, gone) if not g])
    return out


@pytest.mark.parametrize("many", [512, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, monkeypatch, many, seed):
    monkeypatch.setattr("casetrail.llm.repeats.MANY_CLASSES", many)
    monkeypatch.setattr(suffixes, "SORT_BYTES", 5000)
    rows = corpus(seed)
    want = brute(rows, lambda t: t.encode(), 100)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and sum(v[1] for v in want.values()) > 1000
    for r in got:
        n, gone, spans, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, gone, spans, bytes(left)), r.doc_id


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_words(spark, seed):
    rows = corpus(seed)
    want = brute(rows, lambda t: t.encode().split(), 20)
    got = debruijn.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows) and sum(v[1] for v in want.values()) > 300
    for r in got:
        n, gone, spans, left = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.n_spans, r.kept.encode()) == (n, gone, spans, b" ".join(left)), r.doc_id


def test_same_key_other_text(spark):
    """Rows that share only the key are ordered by their text's hash: exactly one of two overlapping texts loses it."""
    shared = "x".join(str(i) for i in range(80))
    got = suffixes.remove_repeats(spark.createDataFrame([(7, "a" + shared), (7, "b" + shared)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, len(shared)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.remove_repeats(none).collect() == [] and debruijn.remove_repeats(none).collect() == []


def test_factor_array():
    """The array itself against its definition on one text."""
    import numpy as np
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"ab\x00") for _ in range(400))
    got = suffixes.longest_previous_factor(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.arange(len(data)), 5)
    for p in range(len(data)):
        best = max((k for q in range(p) for k in range(len(data) - p, 0, -1) if data[q:q + k] == data[p:p + k]), default=0) if p % 7 == 0 else None
        if best is not None:
            assert got[p] == (min(best, 7) if best >= 5 else 0) or (best >= 7 and got[p] >= 7), p
    assert hashlib.sha256(data).hexdigest()
