"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its result is
written as Parquet and is the next one's docs. All but the last keep the columns
of documents.

Nulls and odd input: rows are decided about one by one, by a key of their own, so ids may be null or repeat without
a row answering for another one; a null text is judged as an empty one and stays null where the row stays; equal rows are near
copies, so one of them stays; further columns are carried to the last stage, which gives digests; an empty table goes through as an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import op03_bpe, op04_quality, op06_pii, op08_simhash, op10_decontam
from tablewright.llm.common import discard, discard_paths, give_back, recorded, stage, table


#: Bytes of an Arrow batch, and the setting: workers and the JVM hold a few batches at a time.
BATCH, SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Of the Python workers' environment: memory that a worker frees goes back to the system, Arrow's too, except what the next array takes again.
RETURNS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Tables that the last step staged for itself; the next step removes them, as the last one's result is written by then.
_LEFT: list[str] = []


def lean(step):
    """step with Arrow batches of at most BATCH bytes in its session, unless the session has its own setting, and without the working tables and the unused memory of the step before."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(SETTING, None) in (None, "67108864b", "64m"):  # Spark's default
            spark.conf.set(SETTING, str(BATCH))
        for name, value in RETURNS.items():
            spark.sparkContext.environment.setdefault(name, value)
        discard_paths(spark, _LEFT)
        give_back(spark)
        with recorded() as paths:
            out = step(spark, docs, sf_dir)
        _LEFT[:] = paths
        return out

    return run


@lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    return op04_quality.keep_good(docs, table(spark, sf_dir, "labels"))


@lean
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row stays: the one with the group's smallest doc_id, whether ids are null or repeat."""
    return op08_simhash.keep_one(docs)


@lean
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return op10_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@lean
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that give it away, are replaced in the texts; n_chars follows."""
    out = op06_pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


@lean
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and their digests."""
    return op03_bpe.encode_decode(docs, keep_ids=True)


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: The learned first stage is beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if old is not None:
            discard(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
