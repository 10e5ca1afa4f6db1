"""From raw documents to packed token sequences, in five stages; each works on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result is
written before the next stage is called; so a stage first drops the tables that the one before left in the shared folder.
Null and empty texts, repeated rows and empty tables pass as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import packing, pii, quality, simhash, suffix_dedup
from millrace.llm.common import collected, drop_tables, table, written

#: What the last stage over a folder of tables has left.
_left: dict[str, list[tuple[str, DataFrame]]] = {}


def stage(fn: Callable) -> Callable:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(sf_dir, [])
        drop_tables(spark, left)
        with collected(left):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that another text holds too; no occurrence stays."""
    return suffix_dedup.remove_passages(docs)


@stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redact_pii(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    results: list[tuple[str, DataFrame]] = []
    for name, apply in STAGES[:-1]:
        before = list(results)
        results.clear()
        result = apply(spark, docs, sf_dir)
        with collected(results):
            docs = written(result, name)
        drop_tables(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
