"""Repeated windows of a corpus, found by content-chosen fingerprints. Shared first part of the two substring operators.

Every window of ``window`` symbols picks one fingerprint from its own content (``symbols.anchors``), so equal windows
pick equal ones. Neighbouring windows with one fingerprint form a run. Runs are dealt out by fingerprint:

* runs with equal fingerprint and equal content are one class; all but the class's first are repeats as a whole,
* a fingerprint with one class needs nothing more,
* a fingerprint with several classes branches: its classes' first runs are compared symbol by symbol by the caller.

Tasks keep the first run of each class before anything is shuffled, so copies held by a third of all rows cost one
row per task. Rows are packed arrays of a bucket, so a shuffle moves few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base
from casetrail.llm.symbols import Anchors, Chunk, anchors, byte_values, chunks, words

#: Runs a task gathers before it sends them on (about 45 bytes each).
GATHER = 1_000_000
#: A fingerprint with more classes is compared by whole windows, which spread over the cluster.
MANY_CLASSES = 512

_RUN = {"print": np.uint64, "context": np.uint64, "doc": np.int64, "alt": np.int64, "begin": np.int32, "count": np.int32}
_SENT = "bucket int, repeat boolean, " + ", ".join(f"{n} binary" for n in _RUN)
_FOUND = "repeat boolean, print long, doc long, alt long, start int, end int, many boolean"


def byte_runs(window: int, size: int) -> Callable[[Chunk], Anchors]:
    return lambda chunk: anchors(byte_values(chunk.data), chunk.offsets, window, size)


def word_runs(window: int, size: int) -> Callable[[Chunk], Anchors]:
    def runs(chunk: Chunk) -> Anchors:
        found = words(chunk)
        return anchors(found.hash, found.first, window, size)
    return runs


def _classes(run: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Runs in class order; which one is its class's first (or the same place again); where fingerprints begin."""
    order = np.lexsort((run["begin"], run["alt"], run["doc"], run["context"], run["print"]))
    run = {n: a[order] for n, a in run.items()}
    new_print = np.ones(len(order), bool)
    new_print[1:] = run["print"][1:] != run["print"][:-1]
    new_class = new_print.copy()
    new_class[1:] |= run["context"][1:] != run["context"][:-1]
    head = np.flatnonzero(new_class)[np.cumsum(new_class) - 1] if len(order) else order
    same_place = np.ones(len(order), bool)
    for n in ("doc", "alt", "begin"):
        same_place &= run[n] == run[n][head]
    return run, new_class, same_place


def _rows(schema_types: dict[str, pa.DataType], columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(columns[n], t) for n, t in schema_types.items()})


def _repeat_spans(run: dict[str, np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """Merged spans (doc, alt, start, end) of runs that are repeats as a whole."""
    if not len(run["doc"]):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    order = np.lexsort((run["alt"], run["doc"]))
    doc, alt = run["doc"][order], run["alt"][order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1])
    owner = np.cumsum(new) - 1
    begin = run["begin"][order].astype(np.int64)
    at, start, end = base.merged(owner, begin, begin + run["count"][order] + window - 1)
    return doc[new][at], alt[new][at], start, end


_SENT_TYPES = {"bucket": pa.int32(), "repeat": pa.bool_(), **{n: pa.binary() for n in _RUN}}
_FOUND_TYPES = {"repeat": pa.bool_(), "print": pa.int64(), "doc": pa.int64(), "alt": pa.int64(), "start": pa.int32(),
                "end": pa.int32(), "many": pa.bool_()}


def _send(run: dict[str, np.ndarray], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """First runs of the classes of one gathering by bucket of the fingerprint, and the spans of the others."""
    run, new_class, same_place = _classes(run)
    doc, alt, start, end = _repeat_spans({n: a[~same_place] for n, a in run.items()}, window)
    if len(doc):
        zeros = np.zeros(len(doc), np.uint64)
        for k, part in enumerate(np.array_split(np.arange(len(doc)), min(buckets, -(-len(doc) // 2000)))):
            packed = base.pack(zeros[part], zeros[part], doc[part], alt[part], start[part].astype(np.int32), (end - start)[part].astype(np.int32))
            yield _rows(_SENT_TYPES, {"bucket": [int(doc[part[0]] + k) % buckets], "repeat": [True], **{n: [p] for n, p in zip(_RUN, packed)}})
    first = {n: a[new_class] for n, a in run.items()}
    bucket = (first["print"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(bounds))
    rows = {n: [a[order[bounds[b]: bounds[b + 1]]].tobytes() for b in full] for n, a in first.items()}
    for k in range(0, len(full), 256):
        yield _rows(_SENT_TYPES, {"bucket": full[k: k + 256], "repeat": [False] * len(full[k: k + 256]),
                                  **{n: rows[n][k: k + 256] for n in _RUN}})


def _gather(runs: Callable[[Chunk], Anchors], buckets: int, window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        held = 0
        for batch in batches:
            doc, alt = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("alt"), np.int64)
            for chunk in chunks(batch.column("text")):
                found = runs(chunk)
                row = chunk.first + found.text
                parts.append({"print": found.print, "context": found.context, "doc": doc[row], "alt": alt[row],
                              "begin": found.begin.astype(np.int32), "count": found.count.astype(np.int32)})
                held += len(row)
                if held >= GATHER:
                    yield from _send({n: np.concatenate([p[n] for p in parts]) for n in _RUN}, buckets, window)
                    parts, held = [], 0
        if held:
            yield from _send({n: np.concatenate([p[n] for p in parts]) for n in _RUN}, buckets, window)
    return task


def _meet(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        for batch in batches:
            passed = np.asarray(batch.column("repeat").to_numpy(zero_copy_only=False), bool)
            for repeat in (True, False):
                rows = batch.filter(pa.array(passed == repeat))
                if not rows.num_rows:
                    continue
                run = {n: base.unpack(rows.column(n), t) for n, t in _RUN.items()}
                if repeat:
                    yield from _found(True, run["print"], run["doc"], run["alt"], run["begin"], run["begin"] + run["count"], None)
                else:
                    parts.append(run)
        if not parts:
            return
        run, new_class, same_place = _classes({n: np.concatenate([p[n] for p in parts]) for n in _RUN})
        parts.clear()
        doc, alt, start, end = _repeat_spans({n: a[~same_place] for n, a in run.items()}, window)
        yield from _found(True, np.zeros(len(doc), np.uint64), doc, alt, start, end, None)
        run = {n: a[new_class] for n, a in run.items()}
        new = np.ones(len(run["print"]), bool)
        new[1:] = run["print"][1:] != run["print"][:-1]
        group = np.cumsum(new) - 1
        classes = np.bincount(group)[group] if len(group) else group
        branch = classes > 1
        run = {n: a[branch] for n, a in run.items()}
        yield from _found(False, run["print"], run["doc"], run["alt"], run["begin"], run["begin"] + run["count"], classes[branch] > MANY_CLASSES)
    return task


def _found(repeat: bool, print_: np.ndarray, doc: np.ndarray, alt: np.ndarray, start: np.ndarray, end: np.ndarray,
           many: np.ndarray | None, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(doc), step):
        cut = slice(k, k + step)
        n = len(doc[cut])
        yield _rows(_FOUND_TYPES, {"repeat": np.full(n, repeat), "print": print_[cut].view(np.int64), "doc": doc[cut], "alt": alt[cut],
                                   "start": start[cut].astype(np.int32), "end": end[cut].astype(np.int32),
                                   "many": np.zeros(n, bool) if many is None else many[cut]})


def repeats(docs: DataFrame, runs: Callable[[Chunk], Anchors], window: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Repeated spans ``(doc, alt, start, end)`` already certain, and branching runs ``(print, doc, alt, start, end, many)``.

    A branching run has windows that start at ``start`` up to ``end - 1``.
    """
    buckets = base.partitions(docs)
    sent = docs.select("doc", "alt", "text").mapInArrow(_gather(runs, buckets, window), _SENT)
    found = base.store(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(window), _FOUND), name)
    return (found.where("repeat").select("doc", "alt", "start", "end"),
            found.where("not repeat").select("print", "doc", "alt", "start", "end", "many"))


def by_document(branching: DataFrame) -> DataFrame:
    """Branching runs gathered per document, so that its text is read once."""
    return branching.groupBy("doc", "alt").agg(F.collect_list(F.struct("print", "start", "end", "many")).alias("runs")).hint("shuffle_hash")
