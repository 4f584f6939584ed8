"""Reports: percents, summaries, previews, input signatures and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW = 500


def percent(score: Column) -> Column:
    """A score as a percent: up to 1 it is a fraction (not below 0), above it counts tenfold, at most 100."""
    s = score.cast("double")
    return F.when(s <= 1, F.greatest(s, F.lit(0.0)) * 100).otherwise(F.least(s * 10, F.lit(100.0)))


def preview(body: Column) -> Column:
    """The first 500 characters, and ... where there are more."""
    return F.when(F.length(body) > PREVIEW, F.concat(F.substring(body, 1, PREVIEW), F.lit("..."))).otherwise(body)


def signature(names: Column, sizes: Column) -> Column:
    """SHA-256 of the sorted name:size list: equal inputs in any order have equal signatures."""
    return F.sha2(F.array_join(F.array_sort(F.zip_with(names, sizes, lambda n, s: F.concat(n, F.lit(":"), s.cast("string")))), "|"), 256)


def summary(scored: DataFrame) -> DataFrame:
    """(file_name, verdict, confidence) of scored messages (file, score, label), by name."""
    verdict = F.when(F.col("label") == "LOW", "Legitimate").otherwise("Phishing")
    return scored.select(F.col("file").alias("file_name"), verdict.alias("verdict"), F.round(percent(F.col("score")), 2).alias("confidence")).orderBy("file_name")


def rollup(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts for each prefix of the columns, NULL standing for all, level telling how many columns are rolled up."""
    return rows.rollup(*columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
