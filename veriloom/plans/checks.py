"""Invariants of stored facts and comparisons, as counts: all but `rows` should be 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import fixed
from veriloom.operators import grounding, pairs


def facts(stored: DataFrame) -> DataFrame:
    """Repeated ids, unknown types, confidences out of range, missing snippets, values that don't fit the type."""
    bad_value = (
        F.when(F.col("fact_type") == "numeric", F.col("value_num").isNull())
        .when(F.col("fact_type") == "date", ~F.coalesce(F.col("value_str").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)))
        .when(F.col("fact_type") == "time", ~F.coalesce(F.col("value_str").rlike(r"^\d{2}:\d{2}(-\d{2}:\d{2})?$"), F.lit(False)))
        .when(F.col("fact_type") == "boolean", F.col("value_bool").isNull())
        .otherwise(F.lit(False))
    )
    return stored.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(~F.coalesce(F.col("fact_type").isin(*fixed.FACT_TYPES), F.lit(False))).alias("unknown_types"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("bad_confidences"),
        F.count_if(F.coalesce(F.trim("source_snippet"), F.lit("")) == "").alias("no_snippet"),
        F.count_if(F.coalesce("source_page", F.lit(0)) < 1).alias("bad_pages"),
        F.count_if(bad_value).alias("bad_values"),
    )


def ungrounded(stored: DataFrame, pages: DataFrame, min_score: float = 60.0) -> DataFrame:
    """Facts whose stored snippet can't be found on its page any more."""
    rows = stored.select("id", "source_document", "source_page", F.col("source_snippet").alias("quote")).join(pages.select("source_document", "source_page", F.col("text").alias("source")), ["source_document", "source_page"], "left")
    return grounding.ground(rows, min_score=min_score).where(F.col("score") < min_score).select("id", "source_document", "source_page", "score")


def comparisons(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Unknown labels, unrelated pairs, and pairs within one document."""
    names = lambda i: stored.select(F.col("id").alias(f"fact{i}_id"), F.col("source_document").alias(f"d{i}"))
    rows = found.join(names(1), "fact1_id", "left").join(names(2), "fact2_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("relationship").isin(*fixed.LABELS)).alias("unknown_labels"),
        F.count_if(F.col("relationship") == "unrelated").alias("unrelated"),
        F.count_if(~pairs.different_documents(F.col("d1"), F.col("d2"))).alias("same_document"),
    )


def shares(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of pairs (fact1_id, fact2_id) that are also in `wanted`, each label's number and share."""
    rows = found.join(wanted.select("fact1_id", "fact2_id").distinct(), ["fact1_id", "fact2_id"]).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("relationship", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))
