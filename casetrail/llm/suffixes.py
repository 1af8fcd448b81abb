"""Suffix-array dedup: longest-previous-factor arrays find every byte that a long enough earlier string covers.

A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document with a smaller key, or
earlier in the same one. ``repeats`` finds by fingerprints which runs of windows may repeat. Runs that branch (same
fingerprint, different surroundings) meet as short contexts; their suffix array is built by doubling, and the previous
and next smaller position in suffix order, with the common prefix on the way, give the longest previous factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base
from casetrail.llm.repeats import by_document, byte_runs, repeats
from casetrail.llm.symbols import byte_values, chunks, prefix_sums, span_hash

WINDOW = 100
PRINT_BYTES = 32
#: Bytes of contexts whose suffixes a task sorts at once.
SORT_BYTES = 1 << 20
_SYMBOLS = 7  # symbols of 9 bits (byte + 1, 0 after the end) in a 64-bit key


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    step = np.zeros(len(keys), np.int64)
    step[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def suffix_ranks(data: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """First symbols as one key, and by doubling the rank of each suffix by its first 7, 14, ... up to ``depth`` symbols.

    ``left`` is the number of bytes from each place to the end of its text; suffixes end there.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(_SYMBOLS):
        symbol = np.zeros(n, np.uint64)
        symbol[: n - j] = np.where(left[: n - j] > j, data[j:].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = (key << np.uint64(9)) | symbol
    length, levels = _SYMBOLS, [(_SYMBOLS, _dense(key))]
    while length < depth:
        rank = levels[-1][1]
        after = np.zeros(n, np.int64)
        after[: max(n - length, 0)] = np.where(left[: max(n - length, 0)] > length, rank[length:] + 1, 0)
        levels.append((2 * length, _dense(rank * (n + 1) + after)))
        length *= 2
    return key, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, left: np.ndarray, key: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to the depth of the ranks."""
    n, room = len(left), np.minimum(left[a], left[b])
    done = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        at, to = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
        done += np.where((done < room) & (rank[at] == rank[to]), length, 0)
    at, to = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
    apart = key[at] ^ key[to]
    same = sum((apart >> np.uint64(9 * (_SYMBOLS - 1 - j)) == 0).astype(np.int64) for j in range(_SYMBOLS))
    return np.minimum(done + np.where(done < room, same, 0), room)


def _smaller_before(place: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the nearest suffix before, in suffix order, that has a smaller place.

    Everyone looks one step back; who meets no smaller place takes over the answer of whom it met, until none is left.
    Searches whose common prefix fell under ``least`` end: their answer cannot matter.
    """
    seen, common = np.arange(len(place)) - 1, prefix.copy()
    open_ = np.flatnonzero(seen >= 0)
    open_ = open_[(place[seen[open_]] >= place[open_]) & (common[open_] >= least)]
    while len(open_):
        met = seen[open_]
        common[open_], seen[open_] = np.minimum(common[open_], common[met]), seen[met]
        go_on = (seen[open_] >= 0) & (common[open_] >= least)
        go_on[go_on] = place[seen[open_[go_on]]] >= place[open_[go_on]]
        open_ = open_[go_on]
    found = (seen >= 0) & (common >= least)
    found[found] = place[seen[found]] < place[found]
    return np.where(found, common, 0)


def longest_previous_factor(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of the texts ``data[offsets[i]:offsets[i+1]]``: length of the longest string starting there that
    also starts at a smaller place, 0 where it is under ``depth`` (lengths over it are cut to the sorted depth)."""
    if not len(data):
        return np.zeros(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    key, levels = suffix_ranks(data, left, depth)
    order = np.lexsort((place, levels[-1][1]))
    prefix = np.zeros(len(order), np.int64)
    prefix[1:] = common_prefixes(order[:-1], order[1:], left, key, levels)
    at = place[order]
    after = np.append(prefix[1:], 0)[::-1]
    factor = np.empty(len(order), np.int64)
    factor[order] = np.maximum(_smaller_before(at, prefix, depth), _smaller_before(at[::-1], after, depth)[::-1])
    return factor


_PART = {"print": np.uint64, "doc": np.int64, "alt": np.int64, "start": np.int32, "length": np.int32}
_PART_TYPES = {"bucket": pa.int32(), "kind": pa.int32(), **{n: pa.binary() for n in _PART}, "bytes": pa.binary()}
_PART_SCHEMA = "bucket int, kind int, " + ", ".join(f"{n} binary" for n in _PART) + ", bytes binary"
_CONTEXT, _WINDOWS, _SPANS = 0, 1, 2
_SPAN_SCHEMA = "doc long, alt long, start int, end int"


def _dealt(kind: int, part: dict[str, np.ndarray], buckets: int, data: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket of ``print``; data, if given, holds the contexts end to end in the same order."""
    bucket = (part["print"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(bounds))
    columns = {n: [a[order[bounds[b]: bounds[b + 1]]].tobytes() for b in full] for n, a in part.items()}
    if data is not None:
        begin = np.cumsum(part["length"]) - part["length"]
        pieces = [data[s: s + k].tobytes() for s, k in zip(begin[order].tolist(), part["length"][order].tolist())]
        columns["bytes"] = [b"".join(pieces[bounds[b]: bounds[b + 1]]) for b in full]
    else:
        columns["bytes"] = [None] * len(full)
    if len(full):
        yield pa.RecordBatch.from_pydict({n: pa.array(v, _PART_TYPES[n]) for n, v in
                                          {"bucket": full.astype(np.int32), "kind": [kind] * len(full), **columns}.items()})


def _contexts(window: int, buckets: int):
    """Cut the contexts of branching runs out of their texts; fingerprints of many classes go on as hashed windows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            owner = np.asarray(pa.compute.list_parent_indices(runs), np.int64)
            flat = runs.flatten()
            print_ = np.asarray(flat.field("print"), np.int64).view(np.uint64)
            start, end = (np.asarray(flat.field(n), np.int64) for n in ("start", "end"))
            many = np.asarray(flat.field("many").to_numpy(zero_copy_only=False), bool)
            doc, alt = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("alt"), np.int64)
            for chunk in chunks(batch.column("text")):
                mine = np.flatnonzero((owner >= chunk.first) & (owner < chunk.first + len(chunk)))
                base_at = chunk.offsets[owner[mine] - chunk.first]
                few = ~many[mine]
                rows = mine[few]
                length = end[rows] - start[rows] + window - 1
                index = np.arange(length.sum()) + np.repeat(base_at[few] + start[rows] - (np.cumsum(length) - length), length)
                yield from _dealt(_CONTEXT, {"print": print_[rows], "doc": doc[owner[rows]], "alt": alt[owner[rows]],
                                             "start": start[rows].astype(np.int32), "length": length.astype(np.int32)}, buckets, chunk.data[index])
                rows = mine[~few]
                if not len(rows):
                    continue
                count = end[rows] - start[rows]
                at = np.arange(count.sum()) + np.repeat(start[rows] - (np.cumsum(count) - count), count)
                begin = np.repeat(base_at[~few], count) + at
                who = np.repeat(owner[rows], count)
                hashed = span_hash(prefix_sums(byte_values(chunk.data)), begin, begin + window)
                yield from _windows(hashed, doc[who], alt[who], at, window, buckets)
    return task


def _windows(hashed: np.ndarray, doc: np.ndarray, alt: np.ndarray, start: np.ndarray, window: int, buckets: int | None):
    """First place of each window: sent on by bucket, or dropped when all have met. The other places are repeats."""
    order = np.lexsort((start, alt, doc, hashed))
    hashed, doc, alt, start = hashed[order], doc[order], alt[order], start[order].astype(np.int32)
    new = np.ones(len(order), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[head]) | (alt != alt[head]) | (start != start[head])
    length = np.full(len(order), window, np.int32)
    part = lambda keep, prints: {"print": prints[keep], "doc": doc[keep], "alt": alt[keep], "start": start[keep], "length": length[keep]}
    if buckets is None:
        yield from _spans(doc[again], alt[again], start[again], start[again] + window)
        return
    yield from _dealt(_WINDOWS, part(new, hashed), buckets)
    yield from _dealt(_SPANS, part(again, hashed // np.uint64(1 << 8)), buckets)


def _spans(doc: np.ndarray, alt: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.lexsort((alt, doc))
    doc, alt, start, end = doc[order], alt[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1])
    at, start, end = base.merged(np.cumsum(new) - 1, start, end)
    doc, alt = doc[new][at], alt[new][at]
    for k in range(0, len(doc), 20_000):
        cut = slice(k, k + 20_000)
        yield pa.RecordBatch.from_pydict({"doc": doc[cut], "alt": alt[cut], "start": pa.array(start[cut], pa.int32()), "end": pa.array(end[cut], pa.int32())})


def _factors(window: int):
    """Longest previous factors among contexts that share fingerprints; blocks are cut between fingerprints."""
    def block(part: dict[str, np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        offsets = np.concatenate(([0], np.cumsum(part["length"], dtype=np.int64)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        row = np.repeat(np.arange(len(texts)), part["length"])
        at = part["start"].astype(np.int64)[row] + np.arange(len(data)) - offsets[row]
        pairs = np.lexsort((part["alt"], part["doc"]))
        new = np.zeros(len(pairs), np.int64)
        new[1:] = (np.diff(part["doc"][pairs]) != 0) | (np.diff(part["alt"][pairs]) != 0)
        owner = np.empty(len(pairs), np.int64)
        owner[pairs] = np.cumsum(new)
        place = owner[row] * (int(at.max()) + 1) + at
        factor = longest_previous_factor(data, offsets, place, window)
        hit = np.flatnonzero(factor >= window)
        yield from _spans(part["doc"][row[hit]], part["alt"][row[hit]], at[hit], at[hit] + factor[hit])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[dict[str, np.ndarray]] = []
        windows: list[dict[str, np.ndarray]] = []
        texts: list[bytes] = []
        for batch in batches:
            for k, kind in enumerate(batch.column("kind").to_pylist()):
                part = {n: np.frombuffer(batch.column(n)[k].as_py(), t) for n, t in _PART.items()}
                if kind == _SPANS:
                    yield from _spans(part["doc"], part["alt"], part["start"], part["start"] + part["length"])
                elif kind == _WINDOWS:
                    windows.append(part)
                else:
                    contexts.append(part)
                    whole, ends = batch.column("bytes")[k].as_py(), np.cumsum(part["length"]).tolist()
                    texts += [whole[a:b] for a, b in zip([0, *ends], ends)]
        if windows:
            all_ = {n: np.concatenate([p[n] for p in windows]) for n in _PART}
            yield from _windows(all_["print"], all_["doc"], all_["alt"], all_["start"], window, None)
        if contexts:
            part = {n: np.concatenate([p[n] for p in contexts]) for n in _PART}
            order = np.argsort(part["print"], kind="stable")
            part = {n: a[order] for n, a in part.items()}
            new = np.flatnonzero(np.append(True, part["print"][1:] != part["print"][:-1]))
            size = np.cumsum(part["length"], dtype=np.int64)
            first = 0
            while first < len(order):
                full = int(np.searchsorted(size, (size[first - 1] if first else 0) + SORT_BYTES, "right"))
                later = new[np.searchsorted(new, first, "right"):]
                last = int(later[max(0, np.searchsorted(later, full, "right") - 1)]) if len(later) and full < len(order) else len(order)
                yield from block({n: a[first:last] for n, a in part.items()}, [texts[i] for i in order[first:last]])
                first = last
    return task


def _cut(as_text: bool):
    """Cut the spans out of the texts; as text, bytes of characters that a cut has split are left out."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut_batch(batch, as_text)
    return task


def _cut_batch(batch: pa.RecordBatch, as_text: bool) -> pa.RecordBatch:
    owner, start, end = base.list_bounds(batch.column("spans"))
    owner, start, end = base.merged(owner, start, end)
    bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
    n_bytes, n_removed, kept = [], [], []
    for k, text in enumerate(batch.column("text").to_pylist()):
        whole = text.encode("utf-8")
        cut = list(zip(start[bounds[k]: bounds[k + 1]].tolist(), end[bounds[k]: bounds[k + 1]].tolist()))
        kept.append(b"".join(whole[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(whole)])))
        n_bytes.append(len(whole))
        n_removed.append(len(whole) - len(kept[-1]))
    result = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    return pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names if n not in ("text", "spans", "doc", "alt")},
                                       "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                                       "n_spans": pa.array(np.diff(bounds), pa.int64()), "kept": result})


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``: the remaining bytes, or with
    ``as_text`` the text they spell, without characters that a cut has split.

    Null text is empty. Rows with equal key and equal text are one document and get the same result; rows that share
    only the key are ordered by a hash of their text; a null key comes first. Texts under ``window`` bytes stay whole.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    base.small_batches(docs.sparkSession)
    rows = base.keyed(docs, key, text)
    certain, branching = repeats(rows, byte_runs(window, min(PRINT_BYTES, window)), window, "factors")
    buckets = base.partitions(rows)
    parts = rows.select("doc", "alt", "text").join(by_document(branching), ["doc", "alt"]).mapInArrow(_contexts(window, buckets), _PART_SCHEMA)
    compared = parts.repartitionById(buckets, F.col("bucket")).mapInArrow(_factors(window), _SPAN_SCHEMA)
    spans = certain.unionByName(compared)
    kind = dict(rows.dtypes)[key]
    return base.with_spans(rows, spans).mapInArrow(
        _cut(as_text), f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
