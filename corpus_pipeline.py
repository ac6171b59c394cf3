"""Toxicity, line dedup, near-dedup, decontamination and mixing, one after another over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relgraph.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from relgraph.llm.common import prepare, remove, scratch, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.stage(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("mix", _mix),
]

#: Scoring and near-dedup aren't expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over all that the one before has kept, which is written as Parquet and read again.

    A stage's input is deleted once its output is written; that of the last stays, as the result reads it.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    where = scratch(spark, "pipeline")
    done = None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{where}/{n}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if done:
                remove(spark, done)
            done = path
    return docs
