"""MinHash near-dedup: universal hash minima, banding, signature check, full check, components.

Documents with the same shingle set are one class. Classes that share a band meet in a bucket; there each is first
compared with the bucket's earliest class, so a large group of near copies costs one pair per member. Confirmed links
give components. What remains are pairs with a common leader in different components: blocks of classes are compared
exactly by what each of them has and lacks against the leader. No link between them is lost, no row is formed for a
pair, and the classes that already hang on the leader are never compared among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base
from casetrail.llm.components import components
from casetrail.llm.symbols import chunks, mix, prefix_sums, span_hash, starts_of, words

SHINGLE, PERCENT = 5, 80
#: 32 bands of 4 minima: at a similarity of 0.8 a pair shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
#: Equal minima (of 128) under which a pair is given up; at a similarity of 0.8 that happens with probability 1e-7.
AGREE = 78
_random = np.random.default_rng(6)
_TIMES = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, in chunks: number of the first text and the sets."""
    for chunk in chunks(texts):
        found = words(chunk, lower=True)
        sums = prefix_sums(found.hash)
        at, text = starts_of(found.first, size)
        grams = span_hash(sums, at, at + size)
        bounds = np.searchsorted(text, np.arange(len(chunk) + 1))
        sets = [np.unique(grams[bounds[k]: bounds[k + 1]]) for k in range(len(chunk))]
        count = np.diff(found.first)
        for k in np.flatnonzero((count > 0) & (count < size)):
            sets[k] = span_hash(sums, found.first[k: k + 1], found.first[k + 1: k + 2])
        yield chunk.first, sets


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Signature rows (32-bit minima) of non-empty sets."""
    values = np.concatenate(sets)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat(values * _TIMES[j] + _PLUS[j], offsets) >> np.uint64(32)
    return out


#: Classes and differing shingles of one side of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
#: Differing shingles that one product of a block takes at a time.
_PRODUCT = 4096


def _differ(size: int):
    """In which shingles a class differs from its leader (those that only one of the two has)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [s for _, sets in shingle_sets(batch.column("text_a"), size) for s in sets]
            right = [s for _, sets in shingle_sets(batch.column("text_b"), size) for s in sets]
            apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_pydict({"leader": batch.column("a"), "class": batch.column("b"), "n": np.array([len(y) for y in right], np.int64),
                                              "apart": pa.array(apart, pa.list_(pa.int64()))})
    return task


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right."""
    values, owner = (np.concatenate(x) for x in (left, [np.full(len(v), k) for k, v in enumerate(left)]))
    others, other = (np.concatenate(x) for x in (right, [np.full(len(v), k) for k, v in enumerate(right)]))
    both = np.intersect1d(values, others)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out
    sides = []
    for v, o in ((values, owner), (others, other)):
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        known = both[at] == v
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], o[known][order]))
    for low in range(0, len(both), _PRODUCT):
        tables = []
        for (at, o), count in zip(sides, (len(left), len(right))):
            part = slice(*np.searchsorted(at, (low, low + _PRODUCT)))
            table = np.zeros((count, min(_PRODUCT, len(both) - low)), np.float32)
            table[o[part], at[part] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _link_blocks(percent: int):
    """Links between the two sides of a block (one side with itself if they are the same), in different components."""
    def task(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        first = np.asarray(block.column("block")) == block.column("low")[0].as_py()
        sets = [np.asarray(v) for v in block.column("apart").to_pylist()]
        columns = {c: np.asarray(block.column(c)) for c in ("class", "component", "n")}
        left = np.flatnonzero(first)
        right = left if first.all() else np.flatnonzero(~first)
        found = []
        if len(left) and len(right):
            size = np.array([len(v) for v in sets], np.int64)
            shared = _common([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
            # Both differ from the leader; they differ from each other where just one of them does.
            differ = size[left][:, None] + size[right][None, :] - 2 * shared
            both = columns["n"][left][:, None] + columns["n"][right][None, :]
            linked = (100 * (both - differ) >= percent * (both + differ)) & (both > differ)
            linked &= columns["component"][left][:, None] != columns["component"][right][None, :]
            x, y = np.nonzero(linked)
            found = np.stack([columns["class"][left[x]], columns["class"][right[y]]])
            found = np.unique(np.sort(found, axis=0), axis=1)
        a, b = found if len(found) else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return task


def in_blocks(related: DataFrame) -> DataFrame:
    """``related`` (``leader, class, component, away, n, apart``) with a row for each block it takes part in: ``block`` is its
    side, (``low``, ``high``) the pair of sides. Sides hold about ``BLOCK_ROWS`` classes, those in the leader's component
    apart from the others: no side of them meets another such side, as nothing is left to be linked there.
    """
    most = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / BLOCK_ROWS), F.ceil(F.sum(F.when(which, F.size("apart"))) / BLOCK_SHINGLES), F.lit(1))
    sides = base.store(related.groupBy("leader").agg(most(~F.col("away")).alias("inside"), most(F.col("away")).alias("outside")), "sides")
    dealt = related.join(sides, "leader").withColumn("block", F.when(F.col("away"), F.col("inside") + F.pmod(F.xxhash64("class"), F.col("outside"))).otherwise(F.pmod(F.xxhash64("class"), F.col("inside"))))
    every = F.sequence(F.lit(0), F.col("inside") + F.col("outside") - 1)
    met = F.when(F.col("away"), every).otherwise(F.filter(every, lambda k: k >= F.col("inside")))
    dealt = dealt.select("leader", "class", "component", "n", "apart", "block", F.explode(met).alias("other"))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _left_apart(members: DataFrame, groups: DataFrame, with_texts: Callable[[DataFrame], DataFrame], size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes with a common leader in different components.

    Every class of such a leader keeps the shingles in which it differs from the leader. Two classes differ from each
    other where just one of them differs from the leader, so the sizes of two such sets and of their common part tell
    exactly whether the classes are linked. The common parts of a block of classes are one product of 0/1 matrices;
    only links leave the task, and no row is formed for a pair.
    """
    placed = members.select("leader", "class").distinct().join(groups.withColumnRenamed("node", "class"), "class", "left").select(
        "leader", "class", F.coalesce("component", "class").alias("component"))
    placed = base.store(placed, "placed")
    homes = placed.where("leader = class").select("leader", F.col("component").alias("home"))
    mixed = base.store(placed.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").join(homes, "leader").select("leader", "home"), "mixed")
    apart = base.store(placed.join(mixed, "leader").where("leader <> class").withColumn("away", F.col("component") != F.col("home")), "apart")
    related = with_texts(apart.select(F.col("leader").alias("a"), F.col("class").alias("b"))).mapInArrow(_differ(size), "leader long, class long, n long, apart array<long>")
    related = base.store(related.join(apart.select("leader", "class", "component", "away"), ["leader", "class"]), "related")
    return in_blocks(related).groupBy("leader", "low", "high").applyInArrow(_link_blocks(percent), "a long, b long").distinct()


_SIGNED = "doc long, alt long, n_shingles long, class long, signature binary, bands array<long>"


def _sign(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), size):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                classes = np.zeros(len(sets), np.int64)
                signed = np.zeros((0, BANDS * ROWS), np.uint32)
                if len(full):
                    signed = minima([sets[k] for k in full])
                    classes[full] = mix(np.array([np.add.reduce(mix(sets[k] + np.uint64(77))) for k in full], np.uint64) + n[full].astype(np.uint64)).view(np.int64)
                keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signed[:, r::ROWS].astype(np.uint64) + np.uint64(1))
                signature, bands = [None] * len(sets), [None] * len(sets)
                for row, k in enumerate(full.tolist()):
                    signature[k], bands[k] = signed[row].tobytes(), keys[row].view(np.int64)
                rows = slice(first, first + len(sets))
                yield pa.RecordBatch.from_pydict({"doc": batch.column("doc")[rows], "alt": batch.column("alt")[rows], "n_shingles": n,
                                                  "class": pa.array(classes, mask=n == 0), "signature": pa.array(signature, pa.binary()),
                                                  "bands": pa.array(bands, pa.list_(pa.int64()))})
    return task


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for n in ("sig_a", "sig_b"))
        keep = pa.array((a == b).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(keep) for n in ("a", "b")})


def _confirm(size: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [s for _, sets in shingle_sets(batch.column("text_a"), size) for s in sets]
            right = [s for _, sets in shingle_sets(batch.column("text_b"), size) for s in sets]
            keep = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_pydict({n: batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")})
    return task


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_shingles`` (distinct word shingles), ``component_id`` (smallest key of its group) and ``kept``.

    Documents are linked if 100 * common >= percent * all shingles; groups are the connected components. Shorter texts
    are one shingle, texts without words (or null) are linked with nothing. A row is kept if its key is its group's
    smallest; rows that repeat that key are all kept. A null key is never smallest unless its group has no other.
    A ``percent`` under 80 is refused, as the bands would miss links.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"bands and signature check find links from {PERCENT} percent on; {percent} would lose some")
    base.small_batches(docs.sparkSession)
    rows = base.keyed(docs, key, text)
    signed = base.store(rows.select("doc", "alt", "text").mapInArrow(_sign(shingle), _SIGNED), "signed")
    classes = signed.where("class is not null").groupBy("class").agg(F.min_by(F.struct("doc", "alt", "signature", "bands"), F.struct("doc", "alt")).alias("c"))
    classes = base.store(classes.select("class", "c.*"), "classes")
    bands = classes.select("class", "doc", F.explode("bands").alias("band"))
    leaders = base.store(bands.groupBy("band").agg(F.min(F.struct("doc", "class")).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select("band", F.col("leader.class").alias("leader")), "leaders")
    members = base.store(bands.join(leaders, "band").select("band", "class", "leader"), "members")
    texts = members.select("class").distinct().join(classes.select("class", "doc", "alt"), "class")
    texts = base.store(rows.select("doc", "alt", "text").join(texts.hint("shuffle_hash"), ["doc", "alt"]).groupBy("class").agg(F.first("text").alias("text")), "texts")
    signatures = classes.select("class", "signature")

    def with_texts(pairs: DataFrame) -> DataFrame:
        return pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b): enough equal minima, then enough common shingles of the whole texts."""
        both = pairs.join(signatures.select(F.col("class").alias("a"), F.col("signature").alias("sig_a")), "a").join(
            signatures.select(F.col("class").alias("b"), F.col("signature").alias("sig_b")), "b")
        alike = base.store(both.mapInArrow(_agree, "a long, b long"), "alike")
        return base.store(with_texts(alike).mapInArrow(_confirm(shingle, percent), "a long, b long"), "confirmed")

    stars = base.store(members.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), "stars")
    links = confirmed(stars)
    groups = base.store(components(links), "components")
    links = links.unionByName(base.store(_left_apart(members, groups, with_texts, shingle, percent), "links-apart"))
    groups = base.store(components(links), "components")
    named = base.store(signed.select("doc", "alt", "n_shingles", "class").join(groups.withColumnRenamed("node", "class"), "class", "left")
                       .select("doc", "alt", "n_shingles", F.coalesce("component", "class").alias("component")), "named")
    least = base.store(named.where("component is not null").groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("doc") != base.LEAST, F.col("doc"))), F.min("doc")).alias("smallest")), "smallest")
    found = named.join(least, "component", "left").withColumn("smallest", F.coalesce("smallest", "doc"))
    kind = dict(rows.dtypes)[key]
    value = lambda c: F.when(F.col(c) != base.LEAST, F.col(c)).cast(kind)
    return found.select(value("doc").alias(key), "n_shingles", value("smallest").alias("component_id"), (F.col("doc") == F.col("smallest")).alias("kept"))
