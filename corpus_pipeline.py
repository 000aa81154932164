"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again.

quality rules -> near-duplicates -> repeated passages -> mixture of sources -> packed sequences

What a stage wrote on its way is removed when a later stage begins, once no DataFrame reads it any more: results of
earlier runs stay readable for as long as they are held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import mixing, near_dedup, packing, quality_rules, suffix_dedup
from lacuna.llm.common import materialize, sweep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def swept(stage: Stage) -> Stage:
    """The stage, which first removes the tables that nothing reads any more."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return stage(spark, docs, sf_dir)

    return run_


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", swept(quality_rules.stage)),
    ("near_dedup", swept(near_dedup.stage)),
    ("suffix_dedup", swept(suffix_dedup.stage)),
    ("mix_sources", swept(mixing.stage)),
    ("best_fit_packing", swept(packing.stage)),
]

#: Signatures, suffix order and the packing plan are not SQL; the tests hold each stage against brute force or its invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
