"""Text cache: rows already recognised, rows still to do, and the new cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_split(items: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits joined with their cached columns, misses)."""
    return items.join(cache, key, "inner"), items.join(cache.select(*key), key, "left_anti")


def cache_add(cache: DataFrame, recognised: DataFrame, key: list[str]) -> DataFrame:
    """Cache with the newly recognised rows; known keys keep their entry."""
    return cache.unionByName(recognised.join(cache.select(*key), key, "left_anti"))


def cache_stats(items: DataFrame, cache: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    marks = cache.select(*key).withColumn("hit_", F.lit(True))
    return items.join(marks, key, "left").groupBy(*group).agg(
        F.expr("count_if(hit_ IS NOT NULL)").alias("hits"), F.expr("count_if(hit_ IS NULL)").alias("misses"))
