"""Projection, filtering and reshaping of article tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concat_text(*columns: str, sep: str = " . ") -> Column:
    return F.concat_ws(sep, *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def row_ids(df: DataFrame, order: str, start: int = 0, out: str = "row_id", ranges: int = 200) -> DataFrame:
    """Consecutive ids from ``start`` in the order of a unique column, without sorting everything in one task.

    Rows are sorted by range; an id is the row's number in its range plus the ranges before.
    """
    from ..session import cut

    part = F.spark_partition_id()
    sorted_ = cut(df.repartitionByRange(ranges, order).withColumn("_p", part))
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_p").orderBy(order)
    out_df = sorted_.join(F.broadcast(offsets), "_p").withColumn(
        out, F.row_number().over(within) - 1 + F.col("_o") + F.lit(start)
    )
    return out_df.drop("_p", "_o")


def explode_or(df: DataFrame, column: str, out: str, default: str = "Unspecified") -> DataFrame:
    """A row per element; null and empty arrays give one row with the default."""
    arr = F.col(column)
    return df.withColumn(out, F.explode(F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.array(F.lit(default))).otherwise(arr)))


def clean_array(column: str, values: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Array without the given values and without elements that begin with one of the prefixes."""
    arr = F.col(column)
    if values:
        arr = F.filter(arr, lambda x: ~x.isin(*values))
    if prefixes:
        arr = F.filter(arr, lambda x: ~x.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))
    return arr


def rename_values(df: DataFrame, key: str, column: str, mapping: DataFrame) -> DataFrame:
    """``key, renamed``: elements of an array column renamed by ``mapping(value, new)`` (1:n); others pass through.

    A join on the values; nulls in the array are dropped, the result is sorted and distinct.
    """
    each = df.select(key, F.explode_outer(column).alias("value"))
    joined = each.join(mapping, "value", "left").select(key, F.coalesce("new", "value").alias("v"))
    return joined.groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("renamed"))


def multi_hot(column: str, labels: list[str]) -> Column:
    return F.array(*(F.coalesce(F.array_contains(F.col(column), x), F.lit(False)).cast("int") for x in labels))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
