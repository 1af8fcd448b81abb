"""Corpus pipeline: quality rules, line dedup, near-dedup, suffix-array dedup, packing.

Every stage takes the documents its predecessor kept, reread from Parquet, and all but the last return the columns of
``documents``. Rows are told apart by doc_id, or by their order where doc_id repeats or is null. Further columns pass
through; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm import base, lines, minhash, packing, quality, suffixes
from casetrail.session import configure

_left_behind: list[str] = []


def stage(work: Callable[[DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage from a function of (documents, their key). Its stored intermediates go when the next stage begins, as
    its result has been written by then."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        base.discard(spark, _left_behind)
        before = len(base.WRITTEN)
        rows, key = base.one_key(docs)
        out = work(rows, key)
        _left_behind[:] = base.WRITTEN[before:]
        return out.drop(key) if key not in docs.columns else out
    return run_stage


def _with_text(docs: DataFrame, cut: DataFrame, key: str) -> DataFrame:
    """Documents with their new text; those of which nothing is left go, those that were empty before stay."""
    left = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", "[\\x09-\\x0D]", " ")) != ""))
    # The old texts stay out of the join; where the text was null it stays null.
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    slim = docs.select(*others, F.struct(F.col("text").isNull().alias("null")).alias("n_chars"))
    joined = slim.join(left.select(key, F.col("kept").alias("text")), key)
    changed = {"text": F.when(~F.col("n_chars.null"), F.col("text")), "n_chars": F.length("text").cast("long")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


@stage
def quality_rules(docs: DataFrame, key: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band accept."""
    return docs.join(quality.rules(docs, key=key, copies=False).where("kept").select(key), key, "left_semi")


@stage
def line_dedup(docs: DataFrame, key: str) -> DataFrame:
    """Runs of three lines, or of fewer with 100 characters, that stand earlier are removed from the texts."""
    return _with_text(docs, lines.remove_repeats(docs, key=key), key)


@stage
def near_dedup(docs: DataFrame, key: str) -> DataFrame:
    """The first document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return docs.join(minhash.near_duplicates(docs, key=key).where("kept").select(key), key, "left_semi")


@stage
def suffix_dedup(docs: DataFrame, key: str) -> DataFrame:
    """Bytes covered by earlier strings of 100 bytes are removed from the texts."""
    return _with_text(docs, suffixes.remove_repeats(docs, key=key, as_text=True), key)


@stage
def best_fit_packing(docs: DataFrame, key: str) -> DataFrame:
    """Places of all documents in packed sequences."""
    if key == "doc_id":
        return packing.pack(docs)
    placed = packing.pack(docs, key=key)
    return placed.join(docs.select(key, "doc_id"), key)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the perplexity of the first stage; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(configure(spark), sf_dir, "documents")
    for name, work in STAGES:
        docs = base.store(work(spark, docs, sf_dir), name)
    return docs
