"""Set operations, upserts and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    rows = union_all(old.withColumn("_load", F.lit(0)), new.withColumn("_load", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_load")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_load")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def distinct_configs(df: DataFrame, keys: tuple[str, ...] = ("classifier", "sw_dur")) -> DataFrame:
    return df.select(*keys).distinct()


def canonical_order(df: DataFrame, keys: tuple[str, ...] = ("roi", "ms")) -> DataFrame:
    return df.orderBy(*keys)
