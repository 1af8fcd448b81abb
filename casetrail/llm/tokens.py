"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of many texts stand end to end in one array of symbols. In each round every pre-token applies
its own lowest-ranked pair, all of its places at once, and the array closes up; pre-tokens without a pair that merges
leave the array with the number of symbols they have. A merge only makes pairs of higher rank (checked when the
vocabulary is read), so taking all places of the lowest pair together gives what merging one by one gives.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.bpe import SPLIT, byte_characters

LIMIT = 512
#: Pre-tokens of more bytes than this are merged by themselves, rank by rank, so that no round reads all of them again.
LONG = 2048
#: Bytes of text taken together, and bytes of pre-tokens whose counts a worker remembers.
CHUNK_BYTES, KEEP_BYTES = 4 * 1024 * 1024, 32 * 1024 * 1024
NONE = np.iinfo(np.int32).max


def alternate(hit: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Of places ``hit`` that overlap one after the other (``joined``: the place before overlaps), each run's first, third, fifth..."""
    head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(hit))))
    return hit[(np.arange(len(hit)) - head) % 2 == 0]


class Merges:
    """The merges of one vocabulary file as sorted arrays, and the counts of the pre-tokens met so far."""

    def __init__(self, vocabulary: bytes, keep_bytes: int = KEEP_BYTES, long: int = LONG):
        spec = json.loads(vocabulary)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = np.full(max(ids.values()) + 1, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge of this vocabulary makes a pair of lower rank, or two merges make one token")
        keys = left << 32 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.order = np.append(self.order, NONE)
        self.byte = np.empty(256, np.int32)
        for c, b in byte_characters().items():
            self.byte[b] = ids[c]
        firsts = np.repeat(self.byte, 256), np.tile(self.byte, 256)
        self.first_ranks = self.ranks(*firsts).reshape(256, 256)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = set(special)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.cut = regex.compile(SPLIT).findall
        self.keep_bytes, self.long = keep_bytes, long
        self.known: dict[str, int] = {}
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where nothing merges."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def together(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty word, all words merged in step."""
        counts = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol, word = self.byte[raw], np.repeat(np.arange(len(words)), counts)
        rank = np.full(len(raw), NONE, np.int32)
        rank[:-1] = np.where(word[:-1] == word[1:], self.first_ranks[raw[:-1], raw[1:]], NONE)
        while len(rank):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(rank)))
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < NONE
            if not open_.all():
                counts[word[starts[~open_]]] = sizes[~open_]
                stays = np.repeat(open_, sizes)
                symbol, word, rank = symbol[stays], word[stays], rank[stays]
                lowest, sizes = lowest[open_], sizes[open_]
                if not len(rank):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            hit = alternate(hit, np.append(False, (hit[1:] == hit[:-1] + 1) & (word[hit[1:]] == word[hit[:-1]])))
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(len(rank), bool)
            stays[hit + 1] = False
            moved = np.cumsum(stays)[hit] - 1
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            # The pairs that begin at a merged symbol and those that end there are new.
            touched = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            inner = touched[touched < len(rank) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[touched] = NONE
            rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        return counts

    def alone(self, data: bytes) -> int:
        """Surviving symbols of one long word: ranks in rising order, each at all of its places at once."""
        symbol = self.byte[np.frombuffer(data, np.uint8)].copy()
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self.ranks(symbol[:-1], symbol[1:]), NONE).astype(np.int32)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            order = np.argsort(rank[at], kind="stable")
            found, first = np.unique(rank[at][order], return_index=True)
            for r, part in zip(found.tolist(), np.split(at[order], first[1:])):
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(part)

        enter(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            hit = np.unique(np.concatenate(places.pop(r)))
            hit = hit[rank[hit] == r]
            if not len(hit):
                continue
            hit = alternate(hit, np.append(False, after[hit[:-1]] == hit[1:]))
            gone = after[hit]
            symbol[hit], rank[gone] = self.made[r], NONE
            symbol[gone] = -1
            after[hit] = after[gone]
            inner = hit[after[hit] < n]
            before[after[inner]] = inner
            touched = np.unique(np.concatenate((hit, before[hit][before[hit] >= 0])))
            rank[touched] = NONE
            inner = touched[after[touched] < n]
            rank[inner] = self.ranks(symbol[inner], symbol[after[inner]])
            enter(inner)
        return int((symbol >= 0).sum())

    def learn(self, words: Iterable[str]) -> None:
        short: list[tuple[str, bytes]] = []
        for word in words:
            data = word.encode("utf-8")
            self.held += len(data)
            if len(data) > self.long:
                self.known[word] = self.alone(data)
            else:
                short.append((word, data))
        if short:
            self.known.update(zip((w for w, _ in short), self.together([d for _, d in short]).tolist()))

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string in a text is one token."""
        split = []
        for text in texts:
            if self.apart is not None and any(s in text for s in self.special):
                split.append([w for part in self.apart.split(text) for w in ([part] if part in self.special else self.cut(part))])
            else:
                split.append(self.cut(text))
        if self.held > self.keep_bytes:
            self.known.clear()
            self.held = 0
        new: set[str] = set()
        for words in split:
            new.update(set(words).difference(self.known))
        self.learn(new.difference(self.special))
        self.known.update((s, 1) for s in self.special)
        return [sum(map(self.known.__getitem__, words)) for words in split]


_merges: dict[int, Merges] = {}


def _of(shared) -> Merges:
    """One table per worker and vocabulary."""
    key = hash(shared.value)
    if key not in _merges:
        _merges.clear()
        _merges[key] = Merges(shared.value)
    return _merges[key]


def portions(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``limit`` bytes together (one text at least), with the number of the first."""
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield int(at[0]), texts.slice(int(at[0]), len(at)).to_pylist()


def count(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level BPE file on the driver (a few MB, whatever the input); it goes to the
    executors once. Null text is empty and has no tokens. Strings of the vocabulary's special tokens count as one.
    Repeated keys and rows stay, a null key stays null; other columns are not looked at. An empty table gives no rows.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _of(shared)
        for batch in batches:
            texts = batch.column("text")
            found = [n for _, part in portions(texts) for n in merges.count_all(part)]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                                              "n_tokens": pa.array(found, pa.int64()), "over_limit": pa.array([n > limit for n in found], pa.bool_())})

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(task, f"key {dict(rows.dtypes)['key']}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("key", key)
