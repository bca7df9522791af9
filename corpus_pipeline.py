"""A corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage gets the documents that its predecessor kept, as a stored table, and
drops the tables it wrote itself when the next stage begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import bpe, decontaminate, near_dedup, pii, quality
from vicinity.llm.common import forget, owned_by, release, written
from vicinity.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OWNER = "pipeline"


def _stage(work: Stage) -> Stage:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _OWNER)  # of the stage before, whose result is stored
        with owned_by(_OWNER):
            return work(spark, docs, sf_dir)

    return stage


#: One of ten operators each: documents that fail the rules go; one document of each class stays; documents that hold
#: a benchmark item go; personal data becomes its kind; the last stage returns the tokens' counts and digests.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(lambda spark, docs, at: quality.keep_good(docs, table(spark, at, "labels")))),
    ("near_duplicates", _stage(lambda spark, docs, at: near_dedup.one_of_each(docs))),
    ("decontaminate", _stage(lambda spark, docs, at: decontaminate.clean(docs, table(spark, at, "benchmark")))),
    ("personal_data", _stage(lambda spark, docs, at: pii.redact(docs))),
    ("bpe_tokens", _stage(lambda spark, docs, at: bpe.digests(docs))),
]

#: Sampling, tiling, estimation and merging have no SQL; tests hold each stage, on what the one before has left, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; every stage but the last is stored and read again, and deleted when the next one is stored.

    The last stored one stays, for the result reads it: it lies under vicinity/ in the shared folder.
    """
    docs, before = table(spark, sf_dir, "documents"), "pipeline-0"
    for k, (name, stage) in enumerate(STAGES[:-1], 1):
        out = stage(spark, docs, sf_dir)
        with owned_by(f"pipeline-{k}"):
            docs = written(out, name)
        release(spark, before)
        before = f"pipeline-{k}"
    release(spark, _OWNER)
    forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
