"""Documents through five stages: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over all that the one before kept; all but the last return
the columns of documents. Rows with a null text go through the first stages as empty ones do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import mixing, near_dedup, packing, substring_dedup, toxicity
from lamina.llm.common import stored, table
from lamina.session import drop, recorded, scope, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the latest stage made. Its result is written by the time the next one begins, which drops them.
_made: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _made)
        with recorded(_made):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of operator 3 predicts to be toxic go. The model learns from labelled rows of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs.select(*COLUMNS), model)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 10 at the stage's threshold, a similarity of 0.8, stays: the one of the smallest doc_id. Rows that repeat this doc_id stay with it, rows without a doc_id stay."""
    kept = stored(near_dedup.near_duplicates(docs, near_dedup.STAGE_THRESHOLD).filter("kept").select("doc_id").distinct(), "kept")
    rest = docs.select(*COLUMNS)
    known = rest.filter("doc_id is not null").join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    return known.unionByName(rest.filter("doc_id is null")).select(*COLUMNS)


@stage
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that operator 1 removes leave the text, and n_chars follows; documents that lose every word go."""
    return substring_dedup.without_repeats(docs.select(*COLUMNS))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the probabilities of operator 6."""
    return mixing.sampled(docs.select(*COLUMNS))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of operator 5."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("mixing", mix), ("packing", pack)]

#: SQL can't say learned trees, sampling by a hash of the engine's own, and best fit; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again, and its input and the tables behind it go; those of the last stage live as long as the caller's scope."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, f in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scope(spark):
            f.__wrapped__(spark, docs, sf_dir).write.parquet(path)
        drop(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
