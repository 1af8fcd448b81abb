"""Embedding whitening with components from contour integrals over slices of the spectrum (FEAST).

Spark passes over the vectors give exact sums, then the covariance of centred vectors, then the whitened rows and what
their own covariance is. Of all this only sums by dimension (D) and the covariance (D x D) reach the driver, whatever
the number of vectors. The spectrum is cut into slices by inertia counts of shifted covariances, several shifts to a
job; each slice is solved in a task of its own and must give exactly as many components as its inertia count says.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components returned, quadrature nodes on the half circle, eigenvalues of a slice that is not cut any further.
COMPONENTS, NODES, SLICE = 32, 8, 8
SCALE, SHIFT = 64, 1_000_000
#: Cuts of one slice in a round, and the least width of a slice as a share of the largest eigenvalue's bound.
CUTS, NARROW = 7, 1e-9
EPS = np.finfo(float).eps
LONG = 2**63
#: Rows whitened at a time in a task.
STEP = 2000


def usable(vector: str) -> Column:
    """Not null, and every entry is a finite number."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), entry)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, held to the range of a long; Python integers where 64 bits could overflow later."""
    lowered = np.floor(SCALE * np.clip(vectors, -float(LONG), float(LONG)))
    if not lowered.size or np.abs(lowered).max() < 2**50:
        return lowered.astype(np.int64) + SHIFT
    held = [min(max(int(x) + SHIFT, -LONG), LONG - 1) for x in lowered.ravel().tolist()]
    return np.array(held, object).reshape(vectors.shape)


def batches_of(batch: pa.RecordBatch, width: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and whole vectors of a batch by vector length (only ``width`` if given), ``STEP`` rows at a time."""
    column = batch.column("vector")
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    for size in np.unique(sizes) if width is None else [width]:
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), STEP):
            part = pa.array(at[k:k + STEP])
            flat = np.asarray(column.take(part).flatten(), np.float64)
            yield batch.column("key").take(part), whole(flat.reshape(len(part), int(size)))


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where that holds it, else as Python integers."""
    if x.dtype != object and sums.dtype != object and (not x.size or float(np.abs(x).max()) * n < 2**61):
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in batches_of(batch):
            d = x.shape[1]
            part = x.sum(axis=0).astype(object) if len(x) else np.zeros(d, object)
            count[d], total[d] = count.get(d, 0) + len(x), total.get(d, 0) + part
    rows = [(d, count[d], i, Decimal(int(s))) for d in count for i, s in enumerate(total[d] if d else [0])]
    if rows:
        yield pa.RecordBatch.from_pydict({"d": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()),
                                          "i": pa.array([r[2] for r in rows], pa.int32()), "s": pa.array([r[3] for r in rows], pa.decimal128(38, 0))})


def _products(n: int, sums: np.ndarray, onto: np.ndarray | None = None):
    """Per task the rows of its sum of products of centred vectors; ``onto`` projects them first. Row -1 is their plain sum."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(sums) if onto is None else onto.shape[1]
        product, plain = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            for _, x in batches_of(batch, len(sums)):
                centred = (scaled(x, n, sums) / n).astype(float)
                if onto is not None:
                    centred = centred @ onto
                product += centred.T @ centred
                plain += centred.sum(axis=0)
        if width:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "row": pa.array([r.tobytes() for r in (plain, *product)], pa.binary())})
    return task


def _add_rows(table: pa.Table) -> pa.Table:
    rows = np.stack([np.frombuffer(r, float) for r in table.column("row").to_pylist()])
    # In a fixed order, whatever the order of arrival: the same input gives the same bits.
    total = rows[np.lexsort(rows.T)].sum(axis=0)
    return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})


def _summed(vectors: DataFrame, task) -> tuple[np.ndarray, np.ndarray]:
    """Sum of products and plain sum over all tasks; one row per dimension reaches the driver."""
    rows = vectors.mapInArrow(task, "i int, row binary").groupBy("i").applyInArrow(_add_rows, "i int, row binary").collect()
    found = {r.i: np.frombuffer(bytes(r.row), float) for r in rows}
    return np.stack([found[i] for i in range(len(found) - 1)]), found[-1]


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix over ``shift``: positive ones in the block-diagonal part of a symmetric
    factorisation with full pivoting (blocks of one or two rows), by the law of inertia."""
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        rest = np.abs(np.triu(a, 1))
        r, s = divmod(int(rest.argmax()), len(a))
        if diagonal[p] >= alpha * rest[r, s]:
            block = [p]
            count += a[p, p] > 0
        else:
            # A block of two rows with so small a diagonal has a negative determinant: one eigenvalue of each sign.
            block = [r, s]
            count += 1
        if not np.abs(a[np.ix_(block, block)]).max():
            break  # what is left is zero
        others = np.delete(np.arange(len(a)), block)
        side = a[np.ix_(others, block)]
        a = a[np.ix_(others, others)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return int(count)


def feast(matrix: np.ndarray, low: float, high: float, count: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high] and their unit vectors; ``count`` is what inertia says there are.

    A block of vectors is filtered by the quadrature of complex shifted solves around the slice, made orthonormal, and
    Ritz pairs are taken in what it spans; that repeats until the pairs of the slice are exact to rounding and are as
    many as counted. The block grows if it stalls.
    """
    d = len(matrix)
    size = np.abs(matrix).sum(axis=1).max()
    middle, radius = (low + high) / 2, max((high - low) / 2, size * EPS * 8)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(-0.5j * np.pi * (nodes - 1))
    width = min(d, count + max(8, count // 2))
    block = np.random.default_rng(13).standard_normal((d, width))
    best = np.inf
    for round_ in range(rounds):
        filtered = np.zeros(block.shape)
        for t, w in zip(turn, weights):
            filtered += 0.5 * w * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - matrix, block.astype(complex))).real
        q, _ = np.linalg.qr(filtered)
        values, turned = np.linalg.eigh(q.T @ matrix @ q)
        block = q @ turned
        # The pairs nearest to the slice, as many as there must be.
        distance = np.maximum(np.maximum(low - values, values - high), 0)
        chosen = np.sort(np.lexsort((np.abs(values - middle), distance))[:count])
        error = np.linalg.norm(matrix @ block[:, chosen] - block[:, chosen] * values[chosen], axis=0).max(initial=0)
        if error <= size * EPS * max(10, d) and distance[chosen].max(initial=0) <= size * EPS * max(10, d):
            return values[chosen], block[:, chosen]
        if error > best / 2 and round_ > 3 and width < d:
            more = min(d - width, max(8, width // 2))
            block = np.hstack([block, np.random.default_rng(round_).standard_normal((d, more))])
            width, best = width + more, np.inf
        best = min(best, error)
    raise ArithmeticError(f"a slice of {count} eigenvalues did not converge")


def _in_tasks(vectors: DataFrame, jobs: list[tuple], work, returned: str) -> list:
    """``work`` on each job (a few numbers) in a task of its own."""
    jobs = [(int(k), float(low), float(high), int(count)) for k, low, high, count in jobs]
    frame = vectors.sparkSession.createDataFrame(jobs, "job int, low double, high double, count int")
    return frame.repartition(len(jobs), "job").mapInArrow(work, returned).collect()


def slices(vectors: DataFrame, matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Slices (low, high, count) that hold the ``wanted`` largest eigenvalues, from the top; cuts lie in gaps."""
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 8 * EPS)
    # Below this an eigenvalue cannot be told from zero.
    floor = top * EPS * 16 * d
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())
            found = [(above(shared.value, low), above(shared.value, high)) for low, high in pairs]
            yield pa.RecordBatch.from_pydict({"job": batch.column("job"), "n_low": pa.array([f[0] for f in found], pa.int32()), "n_high": pa.array([f[1] for f in found], pa.int32())})

    def counted(shifts: list[float], guard: float) -> list[tuple[int, int]]:
        rows = _in_tasks(vectors, [(k, s - guard, s + guard, 0) for k, s in enumerate(shifts)], counts, "job int, n_low int, n_high int")
        return [(r.n_low, r.n_high) for r in sorted(rows)]

    rank = counted([floor], 0.0)[0][0]
    wanted = min(wanted, rank)
    open_, done = [(floor, top, 0, rank)] if wanted else [], []  # low, high, counts above high and above low
    while open_:
        shifts, guards = [], []
        for low, high, _, _ in open_:
            step = (high - low) / (CUTS + 1)
            shifts += [low + step * k for k in range(1, CUTS + 1)]
            guards.append(step)
        guard = min(guards) * 1e-3
        found = iter(zip(shifts, counted(shifts, guard)))
        parts = []
        for low, high, n_high, n_low in open_:
            # A cut with an eigenvalue within its guard is not made.
            cuts = [(s, a) for s, (a, b) in (next(found) for _ in range(CUTS)) if a == b]
            ends = [(low, n_low), *cuts, (high, n_high)]
            parts += [(ends[k][0], ends[k + 1][0], ends[k + 1][1], ends[k][1]) for k in range(len(ends) - 1)]
        parts = [p for p in parts if p[3] > p[2] and p[2] < wanted]
        close = lambda p: p[3] - p[2] <= SLICE or p[1] - p[0] <= NARROW * top
        done += [p for p in parts if close(p)]
        open_ = [p for p in parts if not close(p)]
    return [(low, high, n_low - n_high) for low, high, n_high, n_low in sorted(done, reverse=True)]


def eigenpairs(vectors: DataFrame, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling, at most ``wanted``, those over zero) and their unit vectors as columns."""
    if not len(matrix) or not np.abs(matrix).max():
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = float(np.abs(matrix).max())
    matrix = matrix / scale
    cut = slices(vectors, matrix, wanted)
    if not cut:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job, low, high, count in zip(*(batch.column(c).to_pylist() for c in ("job", "low", "high", "count"))):
                values, found = feast(shared.value, low, high, count)
                yield pa.RecordBatch.from_pydict({"job": pa.array([job] * count, pa.int32()), "value": pa.array(values, pa.float64()),
                                                  "vector": pa.array([v.tobytes() for v in np.ascontiguousarray(found.T)], pa.binary())})

    rows = _in_tasks(vectors, [(k, *c) for k, c in enumerate(cut)], solve, "job int, value double, vector binary")
    if len(rows) != sum(c[2] for c in cut):
        raise ArithmeticError("the slices gave other numbers of components than their inertia counts")
    # One more Rayleigh-Ritz step over all slices makes vectors of neighbouring slices orthogonal to rounding.
    rows.sort(key=lambda r: (r.job, -r.value))
    q, _ = np.linalg.qr(np.stack([np.frombuffer(bytes(r.vector), float) for r in rows], axis=1))
    values, turned = np.linalg.eigh(q.T @ matrix @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * scale, (q @ turned)[:, order]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries are left out. Entries become whole numbers
    (``whole``; beyond a long's range they stay at its ends). All rows must have one vector length; if they differ, the
    most frequent length counts (the longer of two equally frequent) and other rows are left out. Components with an
    eigenvalue that is zero to rounding (constant or dependent dimensions) are left out, so equal rows only, one row
    only, or an empty table give no rows. Equal eigenvalues: any orthonormal vectors of their space, the same for all
    rows. ``deviation`` is null where it exceeds a long. Repeated keys and rows each give their rows; a null key stays
    null; other columns are not looked at.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    totals = rows.mapInArrow(_sums, "d int, n long, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    per_length = totals.collect()
    if not any(r.d for r in per_length):
        return vectors.sparkSession.createDataFrame([], schema)
    n, d = max((r.n, r.d) for r in per_length if r.d)
    exact = [int(r.s) for r in sorted((r for r in per_length if r.d == d), key=lambda r: r.i)]
    sums = np.array(exact, np.int64 if max(map(abs, exact)) < 2**61 else object)
    covariance = _summed(rows, _products(n, sums))[0] / n
    covariance = (covariance + covariance.T) / 2
    values, axes = eigenpairs(rows, covariance, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    onto = axes / np.sqrt(values)
    explained = values / np.trace(covariance)
    product, plain = _summed(rows, _products(n, sums, onto))
    error = float(np.abs(product / n - np.outer(plain / n, plain / n) - np.eye(len(values))).max())
    k = len(values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, x in batches_of(batch, d):
                exact = scaled(x, n, sums)
                if exact.dtype == object or float(np.abs(exact).max(initial=0)) ** 2 * d > 2**61:
                    exact = exact.astype(object)
                far = [v if v < LONG else None for v in (exact * exact).sum(axis=1).tolist()]
                projected = (exact / n).astype(float) @ onto
                many = len(keys)
                each = np.repeat(np.arange(many), k)
                yield pa.RecordBatch.from_pydict({
                    "key": keys.take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()), "n": pa.array(np.full(many * k, n), pa.int64()),
                    "deviation": pa.array(far, pa.int64()).take(pa.array(each)), "whitened": pa.array(projected.ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, many), pa.float64()), "identity_error": pa.array(np.full(many * k, error), pa.float64())})

    return rows.mapInArrow(task, schema.replace(f"{key} ", "key ", 1)).withColumnRenamed("key", key)
