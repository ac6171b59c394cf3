"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, quality, secret_scan, toxicity, warc
from .common import prepare, table
from .oracle import ORACLE


def _over(*names: str, function) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return function(*[table(spark, sf_dir, name) for name in names])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over("documents", function=secret_scan.digest),
    "op2_line_dedup": _over("documents", function=line_dedup.digest),
    "op3_source_mix": _over("documents", function=mixing.digest),
    "op4_repetition": _over("documents", function=lambda docs: quality.digest(docs).drop("longest_repeat")),  # what SQL can check
    "op5_decontaminate": _over("documents", "benchmark", function=decontaminate.digest),
    "op6_toxicity": _over("documents", "labels", function=toxicity.digest),
    "op7_near_dedup": _over("documents", function=near_dedup.digest),
    "op8_license_scan": _over("documents", function=license_scan.digest),
    "op9_warc": _over("pages", function=warc.digest),
    "op10_language_id": _over("documents", "pages", function=language_id.digest),
}



__all__ = ["ORACLE", "QUERIES"]
