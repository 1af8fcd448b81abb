"""Substring dedup on a de Bruijn graph of word windows.

A window of ``window`` words is an edge between its first and its last ``window - 1`` words. Edges that occur once
cannot be repeats, so only windows of branching fingerprints (``repeats``) become edges at all; runs whose
fingerprint has a single surrounding are paths compacted beforehand. Spark joins find the nodes with one edge in and
one edge out, chain edges over them into unitigs along their source (first occurrence), and map every occurrence to
its unitig. An occurrence away from the source is a repeated span, checked by a second hash of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm import base
from casetrail.llm.repeats import by_document, repeats, word_runs
from casetrail.llm.symbols import chunks, mix, prefix_sums, span_hash, words

WINDOW = 20
PRINT_WORDS = 8
_EDGE = "edge long, proof long, tail long, head long, doc long, alt long, at int"


def _edges(window: int):
    """Branching runs to edges with their coordinate: one row per window."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            owner = np.asarray(pa.compute.list_parent_indices(runs), np.int64)
            flat = runs.flatten()
            start, end = (np.asarray(flat.field(n), np.int64) for n in ("start", "end"))
            doc, alt = np.asarray(batch.column("doc"), np.int64), np.asarray(batch.column("alt"), np.int64)
            for chunk in chunks(batch.column("text")):
                rows = np.flatnonzero((owner >= chunk.first) & (owner < chunk.first + len(chunk)))
                if not len(rows):
                    continue
                found = words(chunk)
                count = end[rows] - start[rows]
                at = np.arange(count.sum()) + np.repeat(start[rows] - (np.cumsum(count) - count), count)
                who = np.repeat(owner[rows], count)
                begin = found.first[who - chunk.first] + at
                sums, other = prefix_sums(found.hash), prefix_sums(mix(found.hash + np.uint64(0x5851F42D4C957F2D)))
                parts = {"edge": span_hash(sums, begin, begin + window), "proof": span_hash(other, begin, begin + window),
                         "tail": span_hash(sums, begin, begin + window - 1), "head": span_hash(sums, begin + 1, begin + window)}
                for k in range(0, len(at), 20_000):
                    cut = slice(k, k + 20_000)
                    yield pa.RecordBatch.from_pydict({**{n: a[cut].view(np.int64) for n, a in parts.items()}, "doc": doc[who[cut]],
                                                      "alt": alt[who[cut]], "at": at[cut].astype(np.int32)})
    return task


def unitigs(edges: DataFrame) -> DataFrame:
    """Repeated edges with their source and their unitig: ``edge, proof, doc, alt, at`` (source) and ``first``, ``offset``.

    ``edges`` has a row per occurrence. An edge continues its predecessor's unitig if the node between them has one
    edge in and one out and the source occurrence goes straight on.
    """
    found = edges.groupBy("edge", "proof", "tail", "head").agg(F.min(base.ordered_pair("at")).alias("source"), F.count(F.lit(1)).alias("n"))
    repeated = base.store(found.where("n > 1").select("edge", "proof", "tail", "head", "source.*"), "edges")
    into, out = (repeated.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias(name), *more) for side, name, more in (
        ("head", "n_in", [F.first(base.ordered_pair("at")).alias("before")]), ("tail", "n_out", [])))
    simple = into.where("n_in = 1").join(out.where("n_out = 1"), "node").select("node", "before")
    linked = repeated.join(simple, F.col("tail") == F.col("node"), "left").withColumn(
        "goes_on", F.coalesce((F.col("before.doc") == F.col("doc")) & (F.col("before.alt") == F.col("alt")) & (F.col("before.at") + 1 == F.col("at")), F.lit(False)))
    along = Window.partitionBy("doc", "alt").orderBy("at")
    first = F.last(F.when(~F.col("goes_on"), F.col("at")), ignorenulls=True).over(along)
    return linked.select("edge", "proof", "doc", "alt", "at", first.alias("first")).withColumn("offset", F.col("at") - F.col("first"))


def repeated_spans(edges: DataFrame, window: int) -> DataFrame:
    """Spans of words that occurrences of unitigs away from their source cover: ``doc, alt, start, end``."""
    paths = unitigs(edges).select("edge", "proof", F.struct("doc", "alt", "first").alias("unitig"), "offset",
                                  base.ordered_pair("at").alias("source"))
    here = edges.join(paths, ["edge", "proof"]).where(base.ordered_pair("at") != F.col("source"))
    spans = here.groupBy("unitig", "doc", "alt", (F.col("at") - F.col("offset")).alias("origin")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("at").alias("places"))
    whole = F.array(F.struct(F.col("low").alias("start"), (F.col("high") + window).alias("end")))
    broken = F.transform("places", lambda p: F.struct(p.alias("start"), (p + window).alias("end")))
    pieces = F.when(F.size("places") == F.col("high") - F.col("low") + 1, whole).otherwise(broken)
    return spans.select("doc", "alt", F.explode(pieces).alias("span")).select("doc", "alt", "span.start", "span.end")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, start, end = base.list_bounds(batch.column("spans"))
        owner, start, end = base.merged(owner, start, end)
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
        n_words, n_removed, kept = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            found = text.encode("utf-8").split()  # bytes split at the same six characters that the words exclude
            left: list[bytes] = []
            last = 0
            for a, b in zip(start[bounds[k]: bounds[k + 1]].tolist(), end[bounds[k]: bounds[k + 1]].tolist()):
                left += found[last:a]
                last = b
            left += found[last:]
            n_words.append(len(found))
            n_removed.append(len(found) - len(left))
            kept.append(b" ".join(left).decode("utf-8"))
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names if n not in ("text", "spans", "doc", "alt")},
                                          "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                                          "n_spans": pa.array(np.diff(bounds), pa.int64()), "kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, n_spans and ``kept`` (remaining words joined by one space).

    Null text has no words. Rows with equal key and equal text are one document and get the same result; rows that
    share only the key are ordered by a hash of their text; a null key comes first. Texts under ``window`` words stay
    whole. Other columns of ``docs`` are not looked at, whatever their names.
    """
    base.small_batches(docs.sparkSession)
    rows = base.keyed(docs, key, text)
    certain, branching = repeats(rows, word_runs(window, min(PRINT_WORDS, window)), window, "paths")
    edges = base.store(rows.select("doc", "alt", "text").join(by_document(branching), ["doc", "alt"]).mapInArrow(_edges(window), _EDGE), "occurrences")
    spans = certain.unionByName(repeated_spans(edges, window))
    kind = dict(rows.dtypes)[key]
    return base.with_spans(rows, spans).mapInArrow(_cut, f"{key} {kind}, n_words long, n_removed long, n_spans long, kept string")
