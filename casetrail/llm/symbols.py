"""Whole-batch text work in numpy: words, word hashes, rolling hashes and winnowed anchors.

All functions work on the UTF-8 bytes of many texts at once. Hashes depend on content only, never on the place in the
batch, so equal strings in different tasks get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed by the contracts: words are runs of bytes other than space and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, hence invertible modulo 2**64
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns two of them into the hash of what lies between."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of starts and ends; it depends on the values and their number."""
    return mix((sums[end] - sums[start]) * _power_tables(len(sums))[1][start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


@dataclass
class Chunk:
    """Some whole texts of a batch: rows ``first`` up to ``first + len(offsets) - 1``."""

    first: int
    data: np.ndarray  # bytes of all texts, end to end
    offsets: np.ndarray  # where each text begins, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Whole texts in groups of about ``limit`` bytes (one longer text makes a group of its own). Null counts as empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield Chunk(first, data[ends[first]: ends[last]], ends[first: last + 1] - ends[first])
        first = last


@dataclass
class Words:
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words
    hash: np.ndarray


def words(chunk: Chunk, lower: bool = False) -> Words:
    """Words of all texts of a chunk with a 64-bit hash each."""
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    white = WHITE[data]
    edge = chunk.offsets[chunk.offsets < n]
    before = np.ones(n, bool)
    before[1:] = white[:-1]
    before[edge] = True
    after = np.ones(n, bool)
    after[:-1] = white[1:]
    after[edge[edge > 0] - 1] = True
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(~white & after) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets), span_hash(prefix_sums(byte_values(data)), start, end))


def starts_of(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place where ``size`` symbols of one text follow, and the text it lies in; ``first`` are the texts' bounds."""
    room = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    return np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(room) - room), room), text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours; by doubling, so the cost grows with log(width)."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


@dataclass
class Anchors:
    """Runs of neighbouring windows that share their fingerprint."""

    text: np.ndarray  # text in the chunk
    print: np.ndarray  # hash of the fingerprint's symbols
    begin: np.ndarray  # first window of the run, from the text's start
    count: np.ndarray  # windows in the run
    context: np.ndarray  # hash of all symbols the run covers, its length and the fingerprint's place in it


def anchors(values: np.ndarray, first: np.ndarray, window: int, size: int) -> Anchors:
    """Winnowed fingerprints of all windows of ``window`` symbols.

    Each window picks, of its grams of ``size`` symbols, the one with the least hash (the leftmost of equal ones). The
    pick depends on the window's symbols alone, so equal windows anywhere share fingerprint and place.
    """
    sums = prefix_sums(values)
    at, text = starts_of(first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Anchors(none, none.astype(np.uint64), none, none, none.astype(np.uint64))
    bits = np.uint64(max(24, int(len(values)).bit_length()))
    grams = np.arange(len(values) - size + 1)
    keyed = (span_hash(sums, grams, grams + size) >> bits << bits) | grams.astype(np.uint64)
    least = sliding_min(keyed, window - size + 1)[at]
    picked = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    begin, anchor = at[head], picked[head]
    context = span_hash(sums, begin, begin + count + window - 1)
    context = mix(context + (anchor - begin).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return Anchors(text[head], span_hash(sums, anchor, anchor + size), begin - first[text[head]], count, context)
