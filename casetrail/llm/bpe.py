"""Byte-level BPE encoding and decoding by prefix states of a trie.

The encoding of a word is fixed by the last token of each of its prefixes: the last token of a prefix is the one suffix
``t`` of it for which (last token of the rest, ``t``) is a pair that the merges leave alone. A batch's distinct words
are taken in sorted order, which is the depth-first order of their trie, so a shared prefix gets its state once.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

# Fixed values of the public format: how its pre-tokenizer cuts a text, and the printable characters that stand for bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    """Character of the vocabulary file for each byte: itself if printable, else the next free one from 256 on."""
    hidden = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """One vocabulary: ``encode`` and ``decode`` of whole texts. Holds at most ``keep`` words' encodings."""

    def __init__(self, vocabulary: bytes, keep: int = 400_000):
        spec = json.loads(vocabulary)
        model, chars = spec["model"], byte_characters()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile(SPLIT).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _merged(self, data: bytes) -> list[bytes]:
        """Merges applied one by one, lowest rank first: only for the few bytes of a pair of tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.rank):
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are what the merges make of their bytes; left is -1 at a word's start."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            tokens = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            known = self.pairs[left, right] = self._merged(b"".join(tokens)) == tokens
        return known

    def learn(self, words: Iterable[str]) -> None:
        """Depth-first walk over the trie of new words; ``states[n]`` is the last token of the prefix of n bytes."""
        ids, pieces, stays, longest = self.ids, self.pieces, self._stays, self.longest
        states, before = [-1], b""
        for data, word in sorted((w.encode("utf-8"), w) for w in words):
            shared = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    token = ids.get(data[start:end])
                    if token is not None and stays(states[start], token):
                        states.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            found, end = [], len(data)
            while end:
                found.append(states[end])
                end -= len(pieces[states[end]])
            self.known[word] = array("I", found[::-1]).tobytes()
            before = data

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = self.cut
        split = []
        for text in texts:
            if self.apart is not None and any(s in text for s in self.special):
                split.append([w for part in self.apart.split(text) for w in ([part] if part in self.special else cut(part))])
            else:
                split.append(cut(text))
        if len(self.known) > self.keep:
            self.known.clear()
        new: set[str] = set()
        for words in split:
            new.update(set(words).difference(self.known))
        self.learn(new.difference(self.special))
        self.known.update((s, array("I", [i]).tobytes()) for s, i in self.special.items())
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker and vocabulary: what it has learned serves all tasks of the worker."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (what the ids spell).

    Null text is empty and has no ids. Strings of the vocabulary's special tokens become their ids. Repeated keys and
    rows stay; other columns are not looked at. The vocabulary file (a few MB, whatever the input) goes to the
    executors once.
    """
    base.small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            ids = codec.encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                              "ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(codec.decode, ids), pa.string())})

    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(task, f"{key} {dict(rows.dtypes)[key]}, n_tokens long, ids binary, decoded string")
