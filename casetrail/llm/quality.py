"""Quality rules: word figures and a perplexity band per language.

Spark counts the character trigrams of every document by language and derives a modified Kneser-Ney model from the
counts with joins and sums. Every n-gram of the corpus stays in the model under its own packed value. Tasks hold the
most frequent trigrams as sorted arrays; what a document has of the others is joined to the model on Spark. Perplexities of all distinct texts give each language its upper and lower band: median and
median deviation, widened for short texts. Documents outside their band are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm import base
from casetrail.llm.symbols import WHITE, Chunk, chunks, mix, prefix_sums, span_hash, starts_of, words

ORDER = 3
#: Width of a code point in a packed n-gram.
POINT_BITS = 21
#: Trigrams that each task holds at most; documents meet the rest of the model in a join.
HELD = 2**22
#: Bands: so many deviations around the language's median; the deviation of a text of n trigrams has SHORT / sqrt(n) added in squares.
DEVIATIONS, SHORT = 3.5, 0.5
#: Perplexity logarithms are counted in steps of 1/STEPS to find medians.
STEPS = 2000
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1  # fixed by the contract


# ---- figures of words and lines ----
def figures(chunk: Chunk) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(chunk)
    at = lambda per_byte: np.diff(np.concatenate(([0], np.cumsum(per_byte)))[chunk.offsets])
    white = WHITE[chunk.data]
    points = (chunk.data & 0xC0) != 0x80
    n_repeat = np.zeros(len(chunk), np.int64)
    begin, text = starts_of(found.first, REPEAT_WINDOW)
    if len(begin):
        gram = span_hash(prefix_sums(found.hash), begin, begin + REPEAT_WINDOW) ^ mix(text.astype(np.uint64))
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        again = np.zeros(len(begin), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        cover = np.zeros(len(found.start) + 1, np.int64)
        np.add.at(cover, begin[again], 1)
        np.add.at(cover, begin[again] + REPEAT_WINDOW, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
        n_repeat = np.diff(covered[found.first])
    n_dup = []
    for k in range(len(chunk)):
        lines = [x for x in chunk.data[chunk.offsets[k]: chunk.offsets[k + 1]].tobytes().split(b"\n") if x.strip()]
        n_dup.append(len(lines) - len(set(lines)))
    return {"n_words": np.diff(found.first), "word_chars": at(points & ~white), "n_symbols": at(_SYMBOL[chunk.data]),
            "n_dup_lines": np.array(n_dup, np.int64), "n_repeat_words": n_repeat}


# ---- trigrams ----
def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Packed code point trigrams of all texts, white space runs taken as one space; and the text of each."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))[chunk.offsets]
    white = (points == 32) | ((points >= 9) & (points <= 13))
    keep = np.ones(len(points), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    keep[first[first < len(points)]] = True
    values = np.where(white, np.uint32(32), points)[keep].astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(keep)))[first]
    at, text = starts_of(first, ORDER)
    bits = np.uint64(POINT_BITS)
    return (((values[at] << bits) | values[at + 1]) << bits) | values[at + 2] if len(at) else np.zeros(0, np.uint64), text


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = pc.dictionary_encode(batch.column("lang"))
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's documents, added up before they are sent."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        names, language = _languages(batch)
        for chunk in chunks(batch.column("text")):
            grams, text = trigrams(chunk)
            own = language[chunk.first + text]
            for k in np.unique(own).tolist():
                parts = held.setdefault(names[k], [])
                parts.append(np.unique(grams[own == k], return_counts=True))
                if len(parts) > 16:
                    held[names[k]] = [add_up(parts)]
    for name, parts in held.items():
        grams, count = add_up(parts)
        for k in range(0, len(grams), 20_000):
            cut = slice(k, k + 20_000)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams[cut]), "gram": grams[cut].view(np.int64), "n": count[cut]})


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 per language from the numbers of n-grams seen once to four times."""
    of = counts.groupBy("lang").agg(*[F.greatest(F.sum((F.col("n") == k).cast("double")), F.lit(1.0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    value = lambda k: k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
    return of.select("lang", *[F.greatest(F.lit(0.0), F.least(F.lit(k - 0.05), value(k))).alias(f"d{k}") for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """All n-grams of the model: ``lang, size, gram, n, p`` (interpolated) and ``g``, the weight that an unseen follower
    of the gram leaves to the next shorter n-gram. ``counts`` has ``lang, gram, n`` of the longest n-grams."""
    tables = {order: counts}
    for size in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (POINT_BITS * size)) - 1))
        tables[size] = tables[size + 1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    lower, levels = None, []
    for size in range(1, order + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        now = base.store(tables[size].join(_discounts(tables[size]), "lang").select(
            "lang", "gram", "n", taken.alias("d"), F.shiftright("gram", POINT_BITS).alias("context"),
            F.col("gram").bitwiseAND(F.lit((1 << (POINT_BITS * (size - 1))) - 1)).alias("suffix")), f"grams-{size}")
        context = base.store(now.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("g"), F.count(F.lit(1)).alias("kinds")), f"contexts-{size}")
        joined = now.join(context.drop("kinds"), ["lang", "context"])
        if lower is None:
            below = joined.join(context.select("lang", (F.lit(1.0) / F.col("kinds")).alias("q")), "lang")
        else:
            below = joined.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
            levels.append(lower.join(context.select("lang", F.col("context").alias("gram"), "g"), ["lang", "gram"], "left")
                          .select("lang", F.lit(size - 1).alias("size"), "gram", "n", "p", F.coalesce("g", F.lit(1.0)).alias("g")))
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("g") * F.col("q")
        lower = base.store(below.select("lang", "gram", "n", p.alias("p")), f"level-{size}")
    levels.append(lower.select("lang", F.lit(order).alias("size"), "gram", "n", "p", F.lit(1.0).alias("g")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


@dataclass
class Model:
    """Per language and size: sorted n-grams with the logarithms of probability and back-off weight."""

    parts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(grams: DataFrame) -> Model:
        """All rows of ``grams`` (``lang, size, gram, log_p, log_g``)."""
        table = grams.toArrow().combine_chunks()
        coded = pc.dictionary_encode(table["lang"]).combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        names, lang = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        size, gram = table["size"].to_numpy().astype(np.int64), table["gram"].to_numpy().astype(np.uint64)
        order = np.lexsort((gram, size, lang))
        both = (lang * (ORDER + 1) + size)[order]
        head = np.flatnonzero(np.diff(both, prepend=-1))
        gram, log_p, log_g = (x[order] for x in (gram, table["log_p"].to_numpy(), table["log_g"].to_numpy()))
        return Model({(names[both[a] // (ORDER + 1)], int(both[a] % (ORDER + 1))): (gram[a:b], log_p[a:b], log_g[a:b]) for a, b in zip(head, [*head[1:], len(both)])})

    def find(self, lang: str, size: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of probability and back-off weight (0 where unknown), and what is known."""
        if (lang, size) not in self.parts:
            return np.zeros(len(grams)), np.zeros(len(grams)), np.zeros(len(grams), bool)
        own, log_p, log_g = self.parts[lang, size]
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        known = own[at] == grams
        return np.where(known, log_p[at], 0.0).astype(np.float64), np.where(known, log_g[at], 0.0).astype(np.float64), known

    def log_probability(self, lang: str, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last character of each packed n-gram after the others; unseen n-grams back off."""
        out, _, seen = self.find(lang, order, grams)
        left, weight = np.flatnonzero(~seen), np.zeros(int((~seen).sum()))
        for size in range(order - 1, 0, -1):
            if not len(left):
                break
            weight += self.find(lang, size, grams[left] >> np.uint64(POINT_BITS) & np.uint64((1 << (POINT_BITS * size)) - 1))[1]
            found, _, seen = self.find(lang, size, grams[left] & np.uint64((1 << (POINT_BITS * size)) - 1))
            out[left[seen]] = weight[seen] + found[seen]
            left, weight = left[~seen], weight[~seen]
        out[left] = weight - np.log(2.0**POINT_BITS)
        return out


def estimate(rows: DataFrame) -> DataFrame:
    """All n-grams of all texts (``lang, text``, neither null): ``lang, size, gram, n, log_p, log_g``."""
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return kneser_ney(base.store(counts, "counts")).select(
        "lang", "size", "gram", "n", F.log("p").cast("float").alias("log_p"), F.log(F.greatest("g", F.lit(1e-12))).cast("float").alias("log_g"))


def train(rows: DataFrame) -> Model:
    """Whole model of texts few enough for their n-grams to fit in memory."""
    return Model.of(base.store(estimate(rows), "model"))


def split(grams: DataFrame, held: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent n-grams, at most ``held``, and the others (None if there are none), cut where ``n`` gains a binary digit."""
    digits = F.length(F.bin("n"))
    least, total = 65, 0
    classes = grams.groupBy(digits.alias("digits")).count().orderBy(F.desc("digits")).collect()
    for r in classes:
        total += r["count"]
        if total > held:
            return grams.where(digits >= least), grams.where(digits < least)
        least = r["digits"]
    return grams, None


#: Two hashes that tell the texts of a language apart.
_PRINT = ("print", "print2")
_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _apart(grams: np.ndarray, text: np.ndarray, n_texts: int) -> pa.Array:
    """Per text a list of its different n-grams with their numbers."""
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    items = pa.StructArray.from_arrays([pa.array(grams[head].view(np.int64)), pa.array(np.diff(np.append(head, len(grams))))], ["gram", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[head], np.arange(n_texts + 1)).astype(np.int32)), items)


def _score(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            names, language = _languages(batch)
            for chunk in chunks(batch.column("text")):
                grams, text = trigrams(chunk)
                logs, known = np.zeros(len(grams)), np.zeros(len(grams), bool)
                own = language[chunk.first + text]
                for k in np.unique(own).tolist():
                    logs[own == k], _, known[own == k] = model.find(names[k], ORDER, grams[own == k])
                bounds = np.searchsorted(text, np.arange(len(chunk) + 1))
                total = np.diff(np.concatenate(([0.0], np.cumsum(logs)))[bounds])
                n = np.diff(bounds)
                rows = slice(chunk.first, chunk.first + len(chunk))
                kept = {c: batch.column(c)[rows] for c in batch.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict({**kept, **figures(chunk), "n_grams": n, "loss": -total / np.maximum(n, 1), "open": _apart(grams[~known], text[~known], len(chunk))})
    return task


def closed(scored: DataFrame, rest: DataFrame) -> DataFrame:
    """Losses with the n-grams that tasks do not hold (``open``) added; equal texts are looked up once."""
    texts = scored.where(F.size("open") > 0).groupBy("lang", *_PRINT).agg(F.first("open").alias("open"))
    found = texts.select("lang", *_PRINT, F.explode("open").alias("o")).select("lang", *_PRINT, F.col("o.gram").alias("gram"), F.col("o.n").alias("times"))
    more = found.join(rest.select("lang", "gram", "log_p"), ["lang", "gram"]).groupBy("lang", *_PRINT).agg(F.sum(F.col("times") * F.col("log_p").cast("double")).alias("more"))
    joined = scored.drop("open").join(base.store(more, "more"), ["lang", *_PRINT], "left")
    return joined.withColumn("loss", F.col("loss") - F.coalesce("more", F.lit(0.0)) / F.greatest("n_grams", F.lit(1))).drop("more")


def _median(counts: DataFrame, value: str, name: str) -> DataFrame:
    """Least value with at least half of a language's documents at or under it; ``counts`` has one row per value."""
    upto = Window.partitionBy("lang").orderBy(value)
    whole = Window.partitionBy("lang")
    return (counts.withColumn("upto", F.sum("n").over(upto)).withColumn("whole", F.sum("n").over(whole))
            .where(2 * F.col("upto") >= F.col("whole")).groupBy("lang").agg(F.min(value).alias(name)))


def distinct(rows: DataFrame) -> DataFrame:
    """``lang, text`` of each distinct text of a language; tasks drop their own copies first."""
    return rows.dropDuplicates(["lang", *_PRINT]).select("lang", "text")


def bands(scored: DataFrame, copies: bool = True) -> DataFrame:
    """``lang, median, deviation`` of the logarithmic perplexity of documents that pass the base rules; without
    ``copies`` of distinct texts.

    Values are counted in steps first, so a language needs a row per step and not one per document.
    """
    steps = scored.where(~F.col("base_failed")).select("lang", *_PRINT, F.round(F.col("loss") * STEPS).cast("long").alias("step"))
    if not copies:
        steps = steps.groupBy("lang", *_PRINT).agg(F.min("step").alias("step"))
    counts = base.store(steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")), "steps")
    middle = _median(counts, "step", "median")
    apart = counts.join(middle, "lang").groupBy("lang", F.abs(F.col("step") - F.col("median")).alias("step")).agg(F.sum("n").alias("n"))
    spread = _median(apart, "step", "deviation")
    return middle.join(spread, "lang").select("lang", (F.col("median") / STEPS).alias("median"), (1.4826 * F.greatest("deviation", F.lit(1)) / STEPS).alias("deviation"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", copies: bool = True) -> DataFrame:
    """Per row: key, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity``.

    kept is false if the base rules fail, else whether the text's perplexity lies in its language's band. Null text
    has no words and fails; its perplexity is null. Null languages make one language of their own. Counts and medians
    take in every row, repeated rows as often as they come; without ``copies`` each distinct text of a language counts
    once, so that a large group of copies does not narrow the band around itself. Other columns are not looked at.
    """
    base.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"print": F.xxhash64("text"), "print2": F.xxhash64(F.lit(1), "text")})
    # Every trigram that is looked up has been counted, so no shorter n-gram is needed.
    grams = base.store(estimate(rows if copies else distinct(rows)).where(F.col("size") == ORDER), "model")
    near, rest = split(grams, HELD)
    shared = docs.sparkSession.sparkContext.broadcast(Model.of(near).parts)
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, lang string, print long, print2 long, " + ", ".join(f"{n} long" for n in _FIGURES) + ", n_grams long, loss double, open array<struct<gram: long, n: long>>"
    scored = base.store(rows.mapInArrow(_score(shared), schema).withColumn("base_failed", base_failed()), "scored")
    scored = scored.drop("open") if rest is None else base.store(closed(scored, rest), "closed")
    limits = base.store(bands(scored, copies), "bands")  # a row per language; written, so that the join can split a language that has most rows
    width = DEVIATIONS * F.sqrt(F.col("deviation") * F.col("deviation") + SHORT * SHORT / F.greatest("n_grams", F.lit(1)))
    inside = F.coalesce(F.abs(F.col("loss") - F.col("median")) <= width, F.lit(False))
    return scored.join(limits, "lang", "left").select(
        F.col("key").alias(key), *_FIGURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.when(F.col("n_grams") > 0, F.exp("loss")).alias("perplexity"))
