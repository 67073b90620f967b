"""Duplicates hidden by formatting differences: rows whose two texts agree but for white space, punctuation and case.

Every row gets two rolling hashes (see ``foldhash``); the unordered pair of them is its key, so field order doesn't
matter.  Keys are grouped with map-side combining; only rows of keys that occur twice see their texts again, each
compared with the text of the smallest id of its key by the skipping comparison.  Rows that collide without being
equal form new groups and are compared again until none is left, so the classes are exact.

Groups of any size are spread: rows of hot keys meet their group in salted parts, and a key with n rows is compared in ceil(n / ``hot``) salted parts, to each of which the
one representative is copied.

Defined results: rows where either text is null or blank have no copies; rows with a null id are left out; an id that
was delivered more than once is no copy of itself and each pair comes once; texts of punctuation only are equal to
each other; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread_join, spread_scan
from . import foldhash

HOT = 10_000
SMALL = 500_000  # ids up to which they may be broadcast


def keys(df: DataFrame, id_col: str = "id", left: str = "title", right: str = "abstract") -> DataFrame:
    """``id, k1, k2`` of every row with both texts filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = foldhash.text_hashes(b.column(1)), foldhash.text_hashes(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["id", "k1", "k2"]
            )

    return spread_scan(_filled(df, id_col, left, right)).mapInArrow(run, "id bigint, k1 bigint, k2 bigint")


def _filled(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    filled = r"(?U)\S"
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(left).alias("left"), F.col(right).alias("right")
    ).where(F.col("id").isNotNull() & F.col("left").rlike(filled) & F.col("right").rlike(filled))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, firsts, a, c, ra, rc = (b.column(k) for k in range(6))
        flags = [
            (foldhash.same(x, u) and foldhash.same(y, v)) or (foldhash.same(x, v) and foldhash.same(y, u))
            for x, y, u, v in zip(a.to_pylist(), c.to_pylist(), ra.to_pylist(), rc.to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([ids, firsts, pa.array(flags, pa.bool_())], names=["id", "first_id", "same"])


def _verified(texts: DataFrame, members: DataFrame, hot: int) -> DataFrame:
    """``members`` (id, first_id, n) compared with their representatives."""
    parts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    wanted = members.select("id").unionAll(members.select("first_id")).distinct()
    small = wanted.count() <= SMALL
    texts = texts.join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
    rows = members.withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int"))
    reps = members.groupBy("first_id").agg(F.max(parts).alias("parts"))
    reps = (
        reps.join(texts.select(F.col("id").alias("first_id"), F.col("left").alias("rl"), F.col("right").alias("rr")), "first_id")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .drop("parts")
    )
    both = rows.join(texts, "id").join(reps, ["first_id", "salt"])
    return both.select("id", "first_id", "left", "right", "rl", "rr").mapInArrow(
        _compare, "id bigint, first_id bigint, same boolean"
    )


def copies(
    df: DataFrame, id_col: str = "id", left: str = "title", right: str = "abstract", hot: int = HOT
) -> DataFrame:
    """``first_id, copy_id``: each row that is a copy of one with a smaller id, with the smallest id of its class."""
    texts = _filled(df, id_col, left, right)
    hashed = cut(keys(df, id_col, left, right))
    groups = hashed.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    members = cut(spread_join(hashed, groups, ["k1", "k2"]).where("id <> first_id").select("id", "first_id", "n"))
    found = None
    while True:
        checked = cut(_verified(texts, members, hot))
        hits = checked.where("same").select("first_id", F.col("id").alias("copy_id"))
        found = hits if found is None else found.unionAll(hits)
        rest = checked.where("not same").select("id", F.col("first_id").alias("key"))
        if rest.isEmpty():
            return found.distinct()
        # collided without being equal: the rest of each key is a group of its own
        groups = rest.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
        members = cut(spread_join(rest, groups, ["key"]).where("id <> first_id").select("id", "first_id", "n"))


def collapse(df: DataFrame, id_col: str = "id", left: str = "title", right: str = "abstract") -> DataFrame:
    """One row per class of equal articles: ``first_id, n_copies`` (1 where there is no other)."""
    found = copies(df, id_col, left, right)
    singles = _filled(df, id_col, left, right).select("id").distinct().join(
        found.select(F.col("copy_id").alias("id")), "id", "left_anti"
    )
    counts = found.groupBy("first_id").agg(F.count("*").alias("n"))
    return singles.join(counts, F.col("id") == F.col("first_id"), "left").select(
        F.col("id").alias("first_id"), (F.coalesce("n", F.lit(0)) + 1).cast("bigint").alias("n_copies")
    )
