"""Aggregates behind the heat maps: pivots with fixed columns, shares, membership codes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(x: Column, edges: list[int]) -> Column:
    """Index of the half-open interval of ``edges`` that holds x, -1 outside."""
    out = F.lit(-1)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((x >= a) & (x < b), k).otherwise(out)
    return out


def label_by_bucket(df: DataFrame, labels: str, column: str, edges: list[int], share: bool = False) -> DataFrame:
    """``label, bucket, n`` and, if wanted, ``pct`` of the rows in that bucket."""
    rows = df.withColumn("bucket", bucket(F.col(column), edges)).where("bucket >= 0")
    out = rows.select(F.explode(F.array_distinct(labels)).alias("label"), "bucket").groupBy("label", "bucket").agg(F.count("*").alias("n"))
    if share:
        totals = rows.groupBy("bucket").agg(F.count("*").alias("_t"))  # a row per bucket
        out = out.join(F.broadcast(totals), "bucket").withColumn("pct", F.round(F.col("n") * 100 / F.col("_t"), 6)).drop("_t")
    return out


def pages(df: DataFrame, order: list, size: int) -> DataFrame:
    """Rank from 1 and page from 0 of a ranked list (an aggregate, small by then)."""
    r = F.row_number().over(Window.orderBy(*order))
    return df.withColumn("rank", r).withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int"))


def membership(flags: list[Column]) -> Column:
    """Bit code of which conditions hold."""
    code = F.lit(0)
    for k, f in enumerate(flags):
        code = code + F.when(F.coalesce(f, F.lit(False)), 1 << k).otherwise(0)
    return code


def co_labels(df: DataFrame, key: str, labels: str, wanted: str) -> DataFrame:
    """Labels on the rows that also hold ``wanted``, with counts."""
    own = df.where(F.array_contains(labels, wanted))
    each = own.select(key, F.explode(F.array_distinct(labels)).alias("label")).where(F.col("label") != wanted)
    return each.groupBy("label").agg(F.count("*").alias("n"))
