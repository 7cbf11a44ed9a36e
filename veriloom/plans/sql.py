"""The engine in SQL: its similarities and parsers as functions, its store as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veriloom.functions import similarity
from veriloom.plans.engine import Engine


def register(spark: SparkSession, engine: Engine | None = None) -> None:
    """indel_ratio, token_set_ratio and partial_alignment(quote, source, at_least); views facts and fact_stats of an engine."""
    spark.udf.register("indel_ratio", similarity.indel_ratio_udf)
    spark.udf.register("token_set_ratio", similarity.token_set_ratio_udf)
    spark.udf.register("partial_alignment", similarity.partial_alignment_udf)
    if engine:
        engine.facts().createOrReplaceTempView("facts")
        engine.stats().createOrReplaceTempView("fact_stats")
