"""Evaluation statistics as Spark aggregates.

Inputs are long score tables: label ``y`` (0/1), score ``p`` and any grouping keys (model, fold, replicate). Everything
that needs an order works on distinct scores and value bands, never on one sorted task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.operators.ordering import null_safe_join, with_key_totals
from casetrail.operators.ranks import cumulative, grouped_quantiles, hashed_rank
from casetrail.operators.sequences import normal_two_sided
from casetrail.session import cut_lineage


def _counts(y: str) -> dict[str, Column]:
    return {"pos": F.count_if(F.col(y) == 1), "neg": F.count_if(F.col(y) == 0)}


def op_metrics(df: DataFrame, threshold: Column | float, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts and the usual rates when ``p >= threshold`` flags a row."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged, positive = F.col(p) >= limit, F.col(y) == 1
    counted = df.groupBy(*keys).agg(F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
                                    F.count_if(~flagged & positive).alias("fn"),
                                    F.count_if(~flagged & ~positive).alias("tn"))
    return counted.select(*keys, "tp", "fp", "fn", "tn", *[v.alias(n) for n, v in _rates().items()])


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    precision, recall = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    return {"precision": precision, "recall": recall, "specificity": tn / F.greatest(tn + fp, one),
            "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9)),
            "flag_rate": (tp + fp) / F.greatest(tp + fp + fn + tn, one)}


def auroc(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "auroc") -> DataFrame:
    """Area under the ROC curve: share of positive-negative pairs in order, ties count half; null with one class."""
    cells = cumulative(df, keys, p, _counts(y))
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return cells.groupBy(*keys).agg(F.try_divide(wins, F.nullif(pairs, F.lit(0.0))).alias(out))


def average_precision(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p",
                      out: str = "auprc") -> DataFrame:
    """Sum over falling thresholds of recall gained times precision (steps, no interpolation)."""
    cells = cumulative(df, keys, p, _counts(y), descending=True)
    tp = F.col("pos_before") + F.col("pos")
    flagged = tp + F.col("neg_before") + F.col("neg")
    gain = F.try_divide(F.col("pos"), F.nullif(F.col("pos_total"), F.lit(0))) * (tp / flagged)
    return cells.groupBy(*keys).agg(F.sum(gain).alias(out))


def brier(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", out: str = "brier") -> DataFrame:
    error = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(error * error).alias(out))


def panel(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AUROC and average precision from one pass over the distinct scores."""
    cells = cumulative(df, keys, p, _counts(y))
    pos, neg = F.col("pos"), F.col("neg")
    wins = F.sum(pos.cast("double") * (F.col("neg_before") + neg / 2.0))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    gain = F.try_divide(pos, F.nullif(F.col("pos_total"), F.lit(0))) * (tp / (tp + fp))
    return cells.groupBy(*keys).agg(F.try_divide(wins, F.nullif(pairs, F.lit(0.0))).alias("auroc"),
                                    F.sum(gain).alias("auprc"))


# ---- threshold grids ----
def threshold_counts(df: DataFrame, grid: Sequence[float], keys: Sequence[str] = (), y: str = "y",
                     p: str = "p") -> DataFrame:
    """Confusion counts at every grid threshold.

    Rows are first counted per distinct score, then per number of thresholds the score reaches, and only that small
    table meets the grid. Rows are not repeated per threshold. Keys without a row above a threshold still get it.
    """
    grid = [float(t) for t in grid]
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.col(p) >= t))
    if grid != sorted(grid):
        raise ValueError("thresholds must ascend")
    distinct = df.groupBy(*keys, p).agg(*[v.alias(n) for n, v in _counts(y).items()])
    cells = distinct.groupBy(*keys, reached.alias("__r")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    numbered = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    spread = cells.withColumn("__g", F.explode(numbered))
    above = F.col("__r") >= F.col("__g")["i"]
    return spread.groupBy(*keys, F.col("__g")["threshold"].alias("threshold")).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"))


def best_threshold(df: DataFrame, grid: Sequence[float] | None = None, keys: Sequence[str] = (),
                   minimum_flagged: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """F1-optimal threshold, the lowest on ties: over a grid, or over the scores themselves when none is given."""
    if grid is None:
        cells = cumulative(df, keys, p, _counts(y))
        tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
        counted = cells.select(*keys, F.col(p).cast("double").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                               F.col("pos_before").alias("fn"), F.col("neg_before").alias("tn"))
    else:
        counted = threshold_counts(df, grid, keys, y, p)
    scored = counted.where(F.col("tp") + F.col("fp") >= minimum_flagged).withColumn("f1", _rates()["f1"])
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold")))
    return scored.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b")["threshold"].alias("threshold"),
                                                              F.col("__b")["f1"].alias("f1"))


def _net_benefit(tp: Column, fp: Column, n: Column, threshold: Column) -> Column:
    return tp / n - (fp / n) * (threshold / (1.0 - threshold))


def decision_curve(df: DataFrame, grid: Sequence[float], keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Net benefit of the model, of treating all and of treating none."""
    counted = threshold_counts(df, grid, keys, y, p)
    tp, fp, t = F.col("tp"), F.col("fp"), F.col("threshold")
    n = tp + fp + F.col("fn") + F.col("tn")
    prevalence = (tp + F.col("fn")) / n
    return counted.select(*keys, "threshold", _net_benefit(tp, fp, n, t).alias("net_benefit"),
                          (prevalence - (1 - prevalence) * (t / (1 - t))).alias("treat_all"),
                          F.lit(0.0).alias("treat_none"))


def alert_table(df: DataFrame, grid: Sequence[float], flag: str = "any_flag", y: str = "y", p: str = "p") -> DataFrame:
    """Risk path, rule path and their union by action threshold, with the rule-only yield and the net benefit gained."""
    counted = threshold_counts(df.withColumn("__f", F.coalesce(F.col(flag), F.lit(0))), grid, ["__f"], y, p)
    ruled = F.col("__f") == 1
    totals = counted.groupBy("threshold").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum(F.when(ruled, F.col("fn")).otherwise(0)).alias("only_pos"),
        F.sum(F.when(ruled, F.col("tn")).otherwise(0)).alias("only_neg"),
        F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    t, n = F.col("threshold"), F.col("n")
    only = F.col("only_pos") + F.col("only_neg")
    risk = _net_benefit(F.col("tp"), F.col("fp"), n, t)
    union = _net_benefit(F.col("tp") + F.col("only_pos"), F.col("fp") + F.col("only_neg"), n, t)
    return totals.select(
        "threshold", (F.col("tp") + F.col("fp")).alias("risk_n"), (F.col("tp") + F.col("fp") + only).alias("union_n"),
        only.alias("feat_only_n"),
        F.coalesce(F.try_divide(100.0 * F.col("only_pos"), only), F.lit(0.0)).alias("feat_only_pct"),
        risk.alias("nb_risk"), union.alias("nb_union"), (union - risk).alias("dnb"))


def flag_table(df: DataFrame, flags: Sequence[str], reference: float = 0.10, y: str = "y", p: str = "p") -> DataFrame:
    """Per flag: rows, event rate, and both again among rows the model leaves below the reference threshold."""
    long = df.unpivot([y, p], list(flags), "flag", "__v").where(F.col("__v") == 1)
    low = F.col(p) < reference
    total = df.agg(F.count(F.lit(1))).scalar()
    return long.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.avg(y)).alias("event_pct"), F.count_if(low).alias("missed_n"),
        F.coalesce(100.0 * F.avg(F.when(low, F.col(y))), F.lit(0.0)).alias("missed_event_pct")
    ).withColumn("pct_cohort", 100.0 * F.col("n") / total)


# ---- resampling ----
def bootstrap_replicates(df: DataFrame, ids: Sequence[str], replicates: int, seed: int = 0,
                         columns: Sequence[str] = ("y", "p")) -> DataFrame:
    """Bootstrap draws: ``replicates`` samples of n rows with replacement, as (replicate, columns, copies).

    Row number ``md5(seed:replicate:slot) mod n`` is drawn for every slot. Draws are counted per row number before the
    join, and all steps spread over row numbers, so no task sees a whole replicate.
    """
    numbered = hashed_rank(df.select(*ids, *columns), [], ids, seed, "__row", "__n")
    slots = numbered.select(F.col("__row").alias("__slot"), "__n").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("__slot").cast("string")))
    drawn = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("__n")) + 1
    copies = slots.select("replicate", drawn.alias("__row")).groupBy("replicate", "__row").agg(
        F.count(F.lit(1)).alias("copies"))
    return copies.join(numbered.select("__row", *columns), "__row").drop("__row")


def poisson_limits(steps: int = 12) -> list[str]:
    """Limits for 8 hexadecimal digits of a hash: it has more than k copies if they are at or over limit k.

    Copies follow a Poisson law with mean 1, as often as a bootstrap draws one row of many.
    """
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(steps):
        total += term
        out.append(f"{min(2**32 - 1, math.ceil(total * 2**32)):08x}")
        term /= k + 1
    return out


def _replicated_panel(draws: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """AUROC and average precision of weighted draws per replicate and key; single-class samples drop out."""
    weights = {"pos": F.sum(F.when(F.col(y) == 1, F.col("copies")).otherwise(0)),
               "neg": F.sum(F.when(F.col(y) == 0, F.col("copies")).otherwise(0))}
    cells = cumulative(draws, keys, p, weights)
    pos, neg = F.col("pos"), F.col("neg")
    wins = F.sum(pos.cast("double") * (F.col("neg_before") + neg / 2.0))
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    both = cells.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    return both.groupBy(*keys).agg(
        (wins / F.max(F.col("pos_total").cast("double") * F.col("neg_total"))).alias("auroc"),
        F.sum(F.when(pos > 0, (pos / F.col("pos_total")) * (tp / (tp + fp))).otherwise(0.0)).alias("auprc"))


#: Rows of one score in an Arrow batch from which they travel as one weighted sum; rows weighted at a time.
_TIED, _STEP = 256, 256
#: Most ranges of scores; totals of each range and replicate (16 bytes) pass through the driver.
_RANGES = 1000


#: MD5 (RFC 1321): shifts of its rounds, constants, start values.
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STARTS = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(texts: Sequence[bytes], at: int) -> list[np.ndarray]:
    """The 16 words of 64-byte blocks that hold equally long texts from byte ``at`` on."""
    block = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    block[:, at:at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return list(np.ascontiguousarray(block.view("<u4").T.astype(np.uint32)))


def md5_grid(starts: Sequence[bytes], names: Sequence[bytes]) -> np.ndarray:
    """The MD5 of every name behind every start, as 4 big-endian words: (names, starts, 4).

    All names have one length, all starts have one, and together they fit one block (55 bytes).
    """
    length = len(starts[0]) + len(names[0])
    head, tail = _words(starts, 0), _words([n + b"\x80" for n in names], len(starts[0]))
    tail[14] = tail[14] + np.uint32(8 * length)
    # A word is one number a start, one a name, or both.
    words = [h[None, :] if not t.any() else t[:, None] if not h.any() else h[None, :] | t[:, None] for h, t in zip(head, tail)]
    shape = (len(names), len(starts))
    a, b, c, d, f, g = (np.empty(shape, np.uint32) for _ in range(6))
    for x, start in zip((a, b, c, d), _STARTS):
        x.fill(start)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        f += a
        f += word + np.uint32(_SINES[i])
        turn = _SHIFTS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g), np.left_shift(f, np.uint32(turn), out=f), np.bitwise_or(f, g, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + np.uint32(start) for x, start in zip((a, b, c, d), _STARTS)], axis=2).byteswap()


class _Weights:
    """Copies of rows in all replicates: Poisson with mean 1, from the hash of (seed, replicate // 4, ids) alone."""

    def __init__(self, replicates: int, seed: int):
        self.replicates, self.starts = replicates, [f"{seed}:{four}:".encode() for four in range((replicates + 3) // 4)]
        self.tied, self.step = _TIED, _STEP
        self.limits = np.array([int(limit, 16) for limit in poisson_limits()], np.uint32)
        # Copies by the upper half of the hash; 255 where a limit lies inside.
        low = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
        first, last = (np.searchsorted(self.limits, x, side="right") for x in (low, low | np.uint32(0xFFFF)))
        self.copies = np.where(first == last, first, 255).astype(np.uint8)

    def of(self, names: Sequence[str]) -> np.ndarray:
        """A row per name and a column per replicate."""
        coded = [n.encode() for n in names]
        drawn = np.empty((len(coded), len(self.starts), 4), np.uint32)
        for size in {len(n) for n in coded}:
            rows = [k for k, n in enumerate(coded) if len(n) == size]
            for width in {len(s) for s in self.starts}:
                columns = [k for k, s in enumerate(self.starts) if len(s) == width]
                starts, some = [self.starts[k] for k in columns], [coded[k] for k in rows]
                if size + width <= 55:
                    found = md5_grid(starts, some)
                else:
                    found = np.frombuffer(b"".join(hashlib.md5(s + n).digest() for n in some for s in starts), ">u4").reshape(len(some), -1, 4)
                drawn[rows, columns[0]:columns[-1] + 1] = found
        copies = self.copies[drawn >> np.uint32(16)]
        unsure = copies == 255
        copies[unsure] = np.searchsorted(self.limits, drawn[unsure], side="right")
        return copies.reshape(len(coded), -1)[:, :self.replicates]


_RANGED = "p double, y int, name string, pos binary, neg binary"


def _tied_together(weights: _Weights):
    """Many rows of one score become one row that carries their summed copies; batches leave in order of the score.

    Before the shuffle this keeps a frequent score from being a hot range; behind it, rows of one score have met, and
    both passes read their sums in place of weighting them again.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, label = np.asarray(batch.column("p")), np.asarray(batch.column("y").fill_null(-1))
            values, place = np.unique(score, return_inverse=True)
            summed = np.asarray(batch.column("pos").is_valid())
            counts = np.bincount(place[~summed], minlength=len(values))
            single = (counts[place] < weights.tied) | summed
            parts = [batch.filter(pa.array(single))]
            for k in np.flatnonzero(counts >= weights.tied):
                sums = np.zeros((2, weights.replicates), np.int64)
                at = np.flatnonzero((place == k) & ~summed)
                for low in range(0, len(at), weights.step):
                    part = at[low:low + weights.step]
                    copies = weights.of(batch.column("name").take(pa.array(part)).to_pylist()).astype(np.float32)
                    # At most 12 copies of each of some hundred rows: whole numbers in single precision.
                    sums += (np.stack([label[part] == 1, label[part] == 0]).astype(np.float32) @ copies).astype(np.int64)
                parts.append(pa.RecordBatch.from_pydict({
                    "p": pa.array(values[k:k + 1]), "y": pa.nulls(1, pa.int32()), "name": pa.nulls(1, pa.string()),
                    "pos": pa.array([sums[0].tobytes()], pa.binary()), "neg": pa.array([sums[1].tobytes()], pa.binary())}, schema=parts[0].schema))
            if len(parts) == 1:
                yield parts[0]
                continue
            whole = pa.Table.from_batches(parts).combine_chunks()
            yield from whole.take(pa.array(np.argsort(np.asarray(whole.column("p")), kind="stable"))).combine_chunks().to_batches()
    return task


def _cells(batches: Iterator[pa.RecordBatch], weights: _Weights) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered rows as copies of positives and negatives (a row per distinct score, a column per replicate), a few at a time."""
    last, pos, neg = None, None, None
    for batch in batches:
        for low in range(0, len(batch), weights.step):
            part = batch.slice(low, weights.step)
            score, label = np.asarray(part.column("p")), np.asarray(part.column("y").fill_null(-1))
            heads = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
            summed = np.asarray(part.column("pos").is_valid())
            if summed.all():
                sides = [np.zeros((len(heads), weights.replicates), np.int64) for _ in (1, 0)]
            else:
                copies = weights.of([n or "" for n in part.column("name").to_pylist()])
                sides = [np.add.reduceat(copies * ((label == side) & ~summed)[:, None], heads, axis=0, dtype=np.int64) for side in (1, 0)]
            for k in np.flatnonzero(summed):
                for side, column in zip(sides, ("pos", "neg")):
                    side[np.searchsorted(heads, k, side="right") - 1] += np.frombuffer(part.column(column)[int(k)].as_py(), np.int64)
            # The last score of what came before may go on here.
            if last is not None and score[0] == last:
                sides[0][0] += pos[0]
                sides[1][0] += neg[0]
            elif last is not None:
                yield pos, neg
            if len(heads) > 1:
                yield sides[0][:-1], sides[1][:-1]
            last, pos, neg = score[-1], sides[0][-1:], sides[1][-1:]
    if last is not None:
        yield pos, neg


def replicated_areas(df: DataFrame, ids: Sequence[str], replicates: int, seed: int = 0, y: str = "y", p: str = "p") -> DataFrame:
    """AUROC and average precision of every Poisson replicate: ``replicate, auroc, auprc``; single-class replicates drop out.

    Rows are shuffled once, by ranges of the score; no row is formed for a pair of row and replicate. A range's task
    holds the copies of a few rows in all replicates as one array. A first pass sums them per range, a second one finds
    the areas with the sums of the ranges before it. Rows without a score are left out. The number of ranges is the
    session's number of shuffle partitions, ``_RANGES`` at most: their sums (16 bytes a range and replicate) pass
    through the driver.
    """
    weights = _Weights(replicates, seed)
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    rows = df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"), name.alias("name"),
                                               F.lit(None).cast("binary").alias("pos"), F.lit(None).cast("binary").alias("neg"))
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _RANGES)
    dealt = rows.mapInArrow(_tied_together(weights), _RANGED).repartitionByRange(ranges, "p").sortWithinPartitions("p")
    dealt = dealt.mapInArrow(_tied_together(weights), _RANGED)
    # Written once: both passes see the same ranges, and rows of a frequent score are weighted once.
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros((2, replicates), np.int64), TaskContext.get().partitionId()
        for pos, neg in _cells(batches, weights):
            sums += pos.sum(axis=0), neg.sum(axis=0)
        if sums.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    found = {r.part: np.frombuffer(bytes(r.sums), np.int64).reshape(2, -1) for r in dealt.mapInArrow(totals, "part int, sums binary").collect()}
    before, total = {}, np.zeros((2, replicates), np.int64)
    for part in sorted(found):
        before[part] = total
        total = total + found[part]
    shared = df.sparkSession.sparkContext.broadcast((before, total))

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        starts, (all_pos, all_neg) = shared.value
        if part not in starts:
            return
        pos_before, neg_before = starts[part]
        wins, precision = np.zeros(replicates, np.int64), np.zeros(replicates)
        for pos, neg in _cells(batches, weights):
            above = [now + np.cumsum(side, axis=0) - side for now, side in ((pos_before, pos), (neg_before, neg))]
            wins += (pos * (2 * above[1] + neg)).sum(axis=0)  # twice the pairs won, whole numbers in any order
            hits, flagged = all_pos - above[0], all_pos - above[0] + all_neg - above[1]
            precision += np.divide(pos * hits, flagged * np.maximum(all_pos, 1), out=np.zeros(pos.shape), where=pos > 0).sum(axis=0)
            pos_before, neg_before = pos_before + pos.sum(axis=0), neg_before + neg.sum(axis=0)
        both = np.flatnonzero((all_pos > 0) & (all_neg > 0))
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(both, pa.int32()), "wins": pa.array(wins[both]), "auprc": pa.array(precision[both]),
                                          "pairs": pa.array(2.0 * all_pos[both] * all_neg[both])})

    summed = dealt.mapInArrow(areas, "replicate int, wins long, auprc double, pairs double").groupBy("replicate").agg(
        F.sum(F.col("wins").cast("decimal(20,0)")).cast("double").alias("wins"), F.sum("auprc").alias("auprc"), F.max("pairs").alias("pairs"))
    return summed.select("replicate", (F.col("wins") / F.col("pairs")).alias("auroc"), "auprc")


def _areas(df: DataFrame, ids: Sequence[str], replicates: int, seed: int, y: str, columns: Sequence[str], exact: bool) -> DataFrame:
    """``replicate, model, auroc, auprc`` for each score column."""
    if exact:
        long = bootstrap_replicates(df, ids, replicates, seed, [y, *columns]).unpivot(["replicate", y, "copies"], list(columns), "model", "__p")
        return _replicated_panel(long, ["replicate", "model"], y, "__p")
    parts = [replicated_areas(df, ids, replicates, seed, y, c).withColumn("model", F.lit(c)) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def bootstrap_ci(df: DataFrame, ids: Sequence[str], replicates: int = 1000, seed: int = 0, alpha: float = 0.05,
                 y: str = "y", p: str = "p", exact: bool = False) -> DataFrame:
    """Percentile interval of AUROC and average precision over weighted replicates (``exact``: over drawn samples of n rows)."""
    metrics = _areas(df, ids, replicates, seed, y, [p], exact)
    long = metrics.unpivot(["replicate"], ["auroc", "auprc"], "metric", "value")
    return grouped_quantiles(long, ["metric"], "value", {"lo": alpha / 2, "hi": 1 - alpha / 2}, "n_replicates")


def paired_bootstrap(df: DataFrame, ids: Sequence[str], base: str, other: str, replicates: int = 1000, seed: int = 0,
                     y: str = "y", exact: bool = False) -> DataFrame:
    """Mean, percentile interval and share above 0 of the gap between two scores on the same draws."""
    metrics = _areas(df, ids, replicates, seed, y, [base, other], exact)
    is_other = F.col("model") == other
    gaps = metrics.groupBy("replicate").agg(*[
        (F.max(F.when(is_other, F.col(m))) - F.max(F.when(~is_other, F.col(m)))).alias(m) for m in ("auroc", "auprc")])
    rows = gaps.unpivot(["replicate"], ["auroc", "auprc"], "metric", "gap")
    means = rows.groupBy("metric").agg(F.avg("gap").alias("mean_gap"), F.avg((F.col("gap") > 0).cast("int")).alias("p_gt0"))
    return means.join(grouped_quantiles(rows, ["metric"], "gap", {"lo": 0.025, "hi": 0.975}), "metric")


# ---- comparisons ----
def delong(df: DataFrame, ids: Sequence[str], a: str, b: str, y: str = "y") -> DataFrame:
    """AUROCs of two scores on the same rows, the variance of their difference, z and the two-sided p-value.

    Placement of a row = share of the other class it beats (ties half). Variances and covariances of the placements
    are plain aggregates over rows.
    """
    long = df.select(*ids, y, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).unpivot(
        [*ids, y], ["a", "b"], "model", "p")
    cells = cumulative(long, ["model"], "p", _counts(y))
    beats_neg = (F.col("neg_before") + F.col("neg") / 2.0) / F.col("neg_total")
    loses_pos = (F.col("pos_total") - F.col("pos_before") - F.col("pos") / 2.0) / F.col("pos_total")
    placed = null_safe_join(long, cells.select("model", "p", beats_neg.alias("__x"), loses_pos.alias("__z")),
                            ["model", "p"], "inner")
    value = F.when(F.col(y) == 1, F.col("__x")).otherwise(F.col("__z"))
    wide = placed.groupBy(*ids, y).agg(F.max(F.when(F.col("model") == "a", value)).alias("va"),
                                       F.max(F.when(F.col("model") == "b", value)).alias("vb"))
    pos = F.col(y) == 1
    va1, vb1 = F.when(pos, F.col("va")), F.when(pos, F.col("vb"))
    va0, vb0 = F.when(~pos, F.col("va")), F.when(~pos, F.col("vb"))
    m, n = F.count_if(pos), F.count_if(~pos)
    var_a = F.var_samp(va1) / m + F.var_samp(va0) / n
    var_b = F.var_samp(vb1) / m + F.var_samp(vb0) / n
    cov = F.covar_samp(va1, vb1) / m + F.covar_samp(va0, vb0) / n
    result = wide.agg(F.avg(va1).alias("auroc_a"), F.avg(vb1).alias("auroc_b"), var_a.alias("var_a"),
                      var_b.alias("var_b"), cov.alias("cov_ab"))
    var = F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab")
    z = F.when(var > 1e-18, (F.col("auroc_a") - F.col("auroc_b")) / F.sqrt(var))
    return result.withColumn("z", z).withColumn("p_value", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))


def fold_deltas(scores: DataFrame, base: str, model: str = "model", fold: str = "fold", y: str = "y",
                p: str = "p") -> DataFrame:
    """Mean per-fold gain of every model over the base and the number of folds with a gain."""
    metrics = panel(scores, [model, fold], y, p)
    reference = metrics.where(F.col(model) == base).select(fold, F.col("auroc").alias("__a"), F.col("auprc").alias("__p"))
    gains = metrics.where(F.col(model) != base).join(reference, fold)
    d_auroc, d_auprc = F.col("auroc") - F.col("__a"), F.col("auprc") - F.col("__p")
    return gains.groupBy(model).agg(F.avg(d_auroc).alias("d_auroc"), F.count_if(d_auroc > 0).alias("auroc_folds_gt0"),
                                    F.avg(d_auprc).alias("d_auprc"), F.count_if(d_auprc > 0).alias("auprc_folds_gt0"),
                                    F.count(F.lit(1)).alias("folds"))


def cv_summary(scores: DataFrame, model: str = "model", fold: str = "fold", y: str = "y", p: str = "p") -> DataFrame:
    """Mean and population standard deviation of both areas over folds."""
    metrics = panel(scores, [model, fold], y, p)
    return metrics.groupBy(model).agg(F.avg("auroc").alias("auroc_mean"), F.stddev_pop("auroc").alias("auroc_sd"),
                                      F.avg("auprc").alias("auprc_mean"), F.stddev_pop("auprc").alias("auprc_sd"))


def smd(p1: Column, p2: Column, epsilon: float = 1e-6) -> Column:
    """Standardised difference of two rates."""
    return F.abs(p1 - p2) / (F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2) + epsilon)


def pairwise_smd(rates: DataFrame, group: str, rate: str, epsilon: float = 1e-6) -> DataFrame:
    """Standardised differences of all pairs of groups (the result has a row per pair, whatever their number).

    Groups are dealt into blocks and blocks meet pairwise by an equal-key join, so the pairs spread over tasks.
    """
    blocks = max(1, math.ceil(rates.count() / 500))
    block = F.pmod(F.xxhash64(group), F.lit(blocks))
    others = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    a = rates.select(F.col(group).alias("group_a"), F.col(rate).alias("__pa"), block.alias("__i"), F.explode(others).alias("__j"))
    b = rates.select(F.col(group).alias("group_b"), F.col(rate).alias("__pb"), block.alias("__j"), F.explode(others).alias("__i"))
    pairs = a.join(b, ["__i", "__j"]).where(F.col("group_a") < F.col("group_b"))
    return pairs.select("group_a", "group_b", smd(F.col("__pa"), F.col("__pb"), epsilon).alias("smd"))


def tier_table(df: DataFrame, tier: str, fold: str, y: str = "y") -> DataFrame:
    """Event rate per tier: mean and sample deviation over folds, pooled rate, rows."""
    per_fold = df.groupBy(tier, fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("x"))
    return per_fold.groupBy(tier).agg(F.sum("n").alias("n"), F.avg(F.col("x") / F.col("n")).alias("mean_rate"),
                                      F.stddev_samp(F.col("x") / F.col("n")).alias("sd_rate"),
                                      (F.sum("x") / F.sum("n")).alias("pooled_rate"))


def tier_ratio(df: DataFrame, tier: str, fold: str, y: str = "y") -> DataFrame:
    """High over low tier event rate per fold; null when the low rate is 0."""
    per_fold = df.groupBy(fold, tier).agg(F.avg(y).alias("rate"))
    ends = per_fold.groupBy(fold).agg(F.max_by("rate", F.col(tier)).alias("high"), F.min_by("rate", F.col(tier)).alias("low"))
    return ends.withColumn("ratio", F.try_divide(F.col("high"), F.nullif(F.col("low"), F.lit(0.0))))


def subgroup_by_tier(df: DataFrame, tier: str, flag: str, y: str = "y") -> DataFrame:
    """Per tier: rows, event rate and share of flagged rows; the cohort's flagged-to-unflagged risk ratio and the
    highest-to-lowest tier ratio (tiers without events left out) are repeated on every row."""
    on = F.col(flag) == 1
    tiers = df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"),
                                 F.avg(on.cast("int")).alias("flag_share"))
    overall = df.agg(F.try_divide(F.avg(F.when(on, F.col(y))), F.avg(F.when(~on, F.col(y))))).scalar()
    ratio = tiers.where(F.col("rate") > 0).agg(F.max("rate") / F.min("rate")).scalar()
    return tiers.withColumn("flag_risk_ratio", overall).withColumn("tier_ratio", ratio)


def score_rate(df: DataFrame, score: str, y: str = "y") -> DataFrame:
    """Rows with the event rate of their score value (per-score aggregate joined back)."""
    return with_key_totals(df, [score], F.avg(y).alias("rate"))


def bands(df: DataFrame, score: str, edges: Sequence[float] = (-1, 4, 7, 9, 20),
          labels: Sequence[str] = ("Low (0-4)", "Med (5-7)", "High (8-9)", "Very high (10+)"), y: str = "y") -> DataFrame:
    """Rows, share and event rate per score band (each band includes its upper edge)."""
    band = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        band = band.when((F.col(score) > low) & (F.col(score) <= high), label)
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.withColumn("band", band).where(F.col("band").isNotNull()).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(y)).alias("event_pct"))
            .withColumn("share_pct", 100.0 * F.col("n") / total))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency table."""
    def pairs(c: Column) -> Column:
        return c.cast("double") * (c - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    inside = cells.agg(F.sum(pairs(F.col("n")))).scalar()
    rows, cols = (cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar() for k in (a, b))
    one = df.agg(F.count(F.lit(1)).alias("n"))
    expected = rows * cols / F.nullif(pairs(F.col("n")), F.lit(0.0))
    middle = (rows + cols) / 2.0
    return one.select(F.coalesce(F.try_divide(inside - expected, F.nullif(middle - expected, F.lit(0.0))),
                                 F.lit(1.0)).alias("ari"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two tierings of the same rows (0 lowest risk): Cohen's kappa, Jaccard index of the high tiers, and how many rows
    are high in one and low in the other."""
    cells = df.groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    n = df.agg(F.count(F.lit(1))).scalar()
    sides = [cells.groupBy(F.col(s).alias("__t")).agg(F.sum("__n").alias(f"{s}n")) for s in ("__a", "__b")]
    chance = sides[0].join(sides[1], "__t").agg(F.coalesce(F.sum(F.col("__an").cast("double") * F.col("__bn")), F.lit(0.0))).scalar()
    top_a, top_b = (df.agg(F.max(c)).scalar() for c in (a, b))
    high_a, high_b, count = F.col("__a") == top_a, F.col("__b") == top_b, F.col("__n")
    of = lambda test: F.coalesce(F.sum(F.when(test, count)), F.lit(0))
    observed = of(F.col("__a") == F.col("__b")) / n
    expected = chance / n / n
    return cells.agg(F.coalesce(F.try_divide(observed - expected, F.nullif(1 - expected, F.lit(0.0))), F.lit(1.0)).alias("kappa"),
                     of(high_a & high_b).alias("high_both"), of(high_a | high_b).alias("high_any"),
                     (of(high_a & high_b) / F.greatest(of(high_a | high_b), F.lit(1))).alias("jaccard"),
                     of(high_a & (F.col("__b") == 0)).alias("a_high_b_low"), of(high_b & (F.col("__a") == 0)).alias("b_high_a_low"))


def high_overlap(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Sizes of the high tiers of several labellings, their union and their intersection."""
    flags = list(tests.values())
    union, common = flags[0], flags[0]
    for f in flags[1:]:
        union, common = union | f, common & f
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()], F.count_if(union).alias("union_n"),
                  F.count_if(common).alias("common_n"))


def chi_square_tail(statistic: float, df: int) -> float:
    """Upper tail of the chi-square law, by the recurrence over degrees of freedom (two scalars on the driver)."""
    x = max(float(statistic), 0.0)
    if df % 2:
        tail, step, term = math.erfc(math.sqrt(x / 2)), 1, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    else:
        tail, step, term = math.exp(-x / 2), 2, (x / 2) * math.exp(-x / 2)
    while step < df:
        tail += term
        step += 2
        term *= x / step
    return min(tail, 1.0)
