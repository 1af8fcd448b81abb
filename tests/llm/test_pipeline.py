"""The pipeline against the brute-force versions of its stages, and odd input."""

import math
import random

import pytest

import corpus_pipeline
from casetrail.llm import packing
from tests.llm.test_lines_shards_packing import brute_lines, slow_pack
from tests.llm.test_quality_html import brute as brute_quality
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_search_near import brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=150):
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice(["the", "an", "ing", "ou", "tion", "er", "st"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared, lines = [say(40) for _ in range(3)], [say(5) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [say(rnd.randint(15, 60)) for _ in range(rnd.randint(1, 3))]
        if rnd.random() < 0.4:
            parts.append(rnd.choice(shared))
        if rnd.random() < 0.3:
            parts += lines[:4]
        text = "\n".join(parts)
        if rows and rnd.random() < 0.25:
            old = rnd.choice(rows)[1].split(" ")
            old[rnd.randrange(len(old))] = rnd.choice(vocab)
            text = " ".join(old)
        if rnd.random() < 0.08:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", f"s{rnd.randint(0, 3)}", len(text)))
    rnd.shuffle(rows)
    return rows


def through(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        df = work(spark, docs, str(tmp_path))
        df.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        out.append(docs)
    return out


def test_pipeline(spark, tmp_path):
    rows = documents()
    stages = through(spark, rows, tmp_path)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert all(s.columns == names for s in stages[:4])
    texts = [{r.doc_id: r.text for r in s.collect()} for s in stages[:4]]
    kept = {r[0] for r in brute_quality(rows, copies=False) if r[7]}
    assert texts[0] == {r[0]: r[1] for r in rows if r[0] in kept} and len(kept) < len(rows)
    now = [(k, v) for k, v in texts[0].items()]
    want = {k: v[3] for k, v in brute_lines(now, 3).items() if v[1] == 0 or v[3].strip()}
    assert texts[1] == want and want != texts[0]
    now = [(k, v) for k, v in texts[1].items()]
    kept = {r[0] for r in brute_near(now, 5) if r[3]}
    assert texts[2] == {k: v for k, v in now if k in kept} and len(kept) < len(now)
    want = {k: bytes(v[3]).decode("utf-8", "ignore") for k, v in brute_repeats([(k, v) for k, v in texts[2].items()], lambda t: t.encode(), 100).items()}
    assert texts[3] == {k: v for k, v in want.items() if v.strip()} and texts[3] != texts[2]
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())
    packed = stages[4].collect()
    source = {r[0]: r[3] for r in rows}
    assert sorted(r.doc_id for r in packed) == sorted(texts[3]) and sum(r.n_words for r in packed) == sum(len(t.split()) for t in texts[3].values())
    items = sorted(((len(t.split()), k) for k, t in texts[3].items()), key=lambda x: (-x[0], x[1]))
    numbers = {s: k for k, s in enumerate(sorted(set(source.values())))}
    bins = slow_pack([(n, numbers[source[k]], -1) for n, k in items], packing.CAPACITY)
    assert {r.doc_id: r.bin for r in packed} == {k: b for (_, k), b in zip(items, bins)}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_input(spark, tmp_path, kind):
    good = "some words that are long enough to stay in the corpus for they are many and not the same at all yes indeed"
    odd = [(1, None, None, None, None, "x"), (1, good, "en", "a", 9, "x"), (1, good, "en", "a", 9, "x"), (None, good + " too", None, "a", None, None), (2, "", "en", None, 0, "x"), (3, "w " * 30000, "en", "a", 1, "x")]
    stages = through(spark, [] if kind == "empty" else odd, tmp_path, SCHEMA + ", row_in_order string")
    assert all(s.columns == stages[0].columns for s in stages[:4]) and stages[0].columns[-1] == "row_in_order"
    assert math.isfinite(sum(s.count() for s in stages))
    if kind == "odd":
        assert stages[0].count() == 3 and stages[2].count() == 1  # the two copies and the text that adds one word
