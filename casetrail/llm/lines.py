"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is ``run`` neighbouring lines, or fewer that hold at least ``long`` characters: a passage on one or two lines
counts as much as one broken into many. Each window picks its least line hash as fingerprint (the leftmost of equal
ones), so equal windows pick the same line. Fingerprints that occur once are dropped by a join; the windows of the others are
extended to both sides to the full window, and every window that also starts earlier is a repeat. Neighbouring
repeated windows are the maximal repeated runs; their lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

RUN = 3
#: Characters that make fewer than ``RUN`` lines a window, as many as the bytes of a repeat in the suffix-array operator.
LONG = 100


def _windows(run: int, long: int) -> Column:
    """Per window: the place of its fingerprint and its own place (from 1)."""

    def windows(size: int) -> Column:
        count = F.size("hashes") - F.lit(size - 1)
        places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        if size < run:
            held = [lambda p, k=k: F.element_at("lengths", p + F.lit(k)) for k in range(size)]
            places = F.filter(places, lambda p: sum((h(p) for h in held), F.lit(0)) >= long)

        def window(p: Column) -> Column:
            lines = F.slice("hashes", p, size)
            least = F.array_min(lines)
            return F.struct(p.alias("at"), least.alias("print"), (F.array_position(lines, least) - 1).cast("int").alias("before"), lines.alias("lines"))

        return F.transform(places, window)

    return F.concat(*[windows(size) for size in range(1, run + 1)])


def repeated_windows(rows: DataFrame, run: int, long: int) -> DataFrame:
    """Places (from 1) and lines of windows that also start earlier, per document: ``doc, alt, starts``."""
    lines = F.split("text", "\n", -1)
    hashes, lengths = F.transform(lines, lambda line: F.xxhash64(line)), F.transform(lines, F.length)
    windows = rows.select("doc", "alt", hashes.alias("hashes"), lengths.alias("lengths")).select(
        "doc", "alt", F.explode(_windows(run, long)).alias("w")).select("doc", "alt", "w.*")
    # Fingerprints: one row for each line that some window picked.
    prints = windows.groupBy("print", "doc", "alt", (F.col("at") + F.col("before")).alias("line")).agg(F.collect_list(F.struct("at", "before", "lines")).alias("around"))
    prints = base.store(prints, "prints")
    often = base.store(prints.groupBy("print").count().where("count > 1").select("print"), "often")
    matched = prints.join(often, "print").select("print", "doc", "alt", F.explode("around").alias("w")).select(
        "doc", "alt", "w.at", F.struct("print", "w.before", "w.lines").alias("window"))
    matched = base.store(matched, "matched")
    first = base.store(matched.groupBy("window").agg(F.min(base.ordered_pair("at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = matched.join(first, "window").where(base.ordered_pair("at") != F.col("first"))
    return later.groupBy("doc", "alt").agg(F.collect_set(F.struct("at", F.size("window.lines").alias("size"))).alias("starts"))


def remove_repeats(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """Per row: key, ``n_lines`` (\\n-split), ``n_removed``, ``n_runs`` (maximal removed runs) and ``kept`` text.

    A line goes if it lies in ``run`` neighbouring lines, or in fewer that together have ``long`` characters, that also
    stand, in this order, earlier: in a document with a smaller key or further up. Runs are judged on the input. Null text counts as one empty line. Rows with equal key
    and text are one document; rows that share only the key are ordered by a hash of the text; a null key comes first.
    Other columns are not looked at.
    """
    rows = base.keyed(docs, key, text)
    starts = repeated_windows(rows, run, long)
    lines = F.split("text", "\n", -1)
    found = rows.join(starts.hint("shuffle_hash"), ["doc", "alt"], "left").select(key, lines.alias("lines"), "starts")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda w: F.sequence(w["at"], w["at"] + w["size"] - F.lit(1)))))
    found = found.withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    found = found.withColumn("left", left)
    heads = F.size(F.array_except(F.col("gone"), F.transform("gone", lambda p: p + 1)))
    kept = F.array_join(F.transform("left", lambda p: F.element_at("lines", p)), "\n")
    return found.select(key, F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                        heads.cast("long").alias("n_runs"), F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(kept).alias("kept"))
