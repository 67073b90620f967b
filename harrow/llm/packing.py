"""Filling fixed-capacity containers: best fit over a histogram of lengths.

Only the counts of the lengths reach the driver, at most ``capacity`` numbers whatever the data.  Best-fit decreasing
runs over them with runs of identical containers handled at once; its plan says, for each length, which ranks go to
which containers.  Items then take their slots by joining on (length, stretch of ranks), so that each meets the few plan
rows of its stretch; the rank within a length is a row number within a hash bucket plus the bucket's offset, and frequent
lengths have more buckets, so no task holds a whole length.

Defined results: a document above the capacity gives full pieces and one rest, each an item; others are never divided;
documents with null id, or with a null, zero or negative size, have no item; repeated documents are items of their own;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK = 200_000  # rows of one length ranked in one task
STRETCH = 4096  # ranks of one length that share a join key


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, from_rank, to_rank, first container, items of this length a container).

    Items of ``length`` with ranks in [from_rank, to_rank) go to container first + (rank - from_rank) // per.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: runs of containers (first, how many)
    spaces: list[int] = []  # its keys, ascending
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(space: int, first: int, many: int) -> None:
        if many and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, many))

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):  # the tightest fit
                space = spaces[k]
                first, many = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(k)
            else:
                space, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            per = space // length
            full = min(many, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per))
                rank += full * per
                left -= full * per
                put(space - per * length, first, full)
            if full < many:
                if left:  # the last container takes what is left, less than per
                    rows.append((length, rank, rank + left, first + full, left))
                    put(space - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(space, first + full, many - full)
    return rows


def items(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """``id, piece, pieces, size``: the items of each document; pieces are numbered from 1."""
    n, cap = F.col(size_col).cast("bigint"), F.lit(capacity).cast("bigint")
    pieces = F.ceil(n / cap).cast("bigint")
    rows = docs.where(F.col(id_col).isNotNull() & (n > 0)).select(
        F.col(id_col).alias("id"), n.alias("n"), pieces.alias("pieces")
    )
    rows = rows.select("id", "n", "pieces", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces"))).alias("piece"))
    return rows.select(
        "id", "piece", "pieces", F.least(cap, F.col("n") - (F.col("piece") - 1) * cap).cast("int").alias("size")
    )


def pack(
    docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", chunk: int = CHUNK
) -> DataFrame:
    """``id_col, piece, pieces, size, container``: every item of ``docs`` in a container of ``capacity``."""
    spark = docs.sparkSession
    rows = cut(items(docs, capacity, id_col, size_col))
    histogram = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}  # at most ``capacity`` rows
    planned = plan(histogram, capacity)
    slots = spark.createDataFrame(planned, "size int, r0 bigint, r1 bigint, c0 bigint, per bigint")
    hot = spark.createDataFrame([(k, -(-n // chunk)) for k, n in histogram.items() if n > chunk], "size int, parts bigint")
    hashed = rows.withColumn("h", F.xxhash64("id", "piece")).join(F.broadcast(hot), "size", "left")  # at most ``capacity`` rows
    hashed = hashed.withColumn("bucket", F.pmod("h", F.coalesce("parts", F.lit(1)).cast("bigint"))).drop("parts")
    offsets = hashed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("size", "bucket").orderBy("h", "id", "piece")
    ranked = hashed.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["size", "bucket"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "bucket", "h")
    # each plan row stands in every stretch of ranks it reaches: a row a stretch more at most
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    slots = slots.withColumn("stretch", F.explode(F.sequence(stretch("r0"), F.floor((F.col("r1") - 1) / STRETCH))))
    placed = ranked.withColumn("stretch", stretch("rank")).join(slots, ["size", "stretch"]).where("rank >= r0 and rank < r1")
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "pieces",
        "size",
        (F.col("c0") + F.floor((F.col("rank") - F.col("r0")) / F.col("per"))).cast("bigint").alias("container"),
    )


def divided(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` of the documents that the packing lays into more than one container."""
    return packed.groupBy(id_col).agg(F.min("container").alias("a"), F.max("container").alias("b")).where("a <> b").select(id_col)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """``container, n_items, used, unused`` of a packing."""
    return (
        packed.groupBy("container")
        .agg(F.count("*").alias("n_items"), F.sum("size").cast("bigint").alias("used"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``n_items, tokens, n_containers, overfull, unused_share``, and ``excess``, the share of containers beyond
    the fewest that the tokens would fill if items could be divided at will."""
    each = containers(packed, capacity)
    out = each.agg(
        F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("bigint").alias("tokens"),
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum(F.when(F.col("unused") < 0, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("overfull"),
    )
    room = F.greatest(F.col("n_containers"), F.lit(1)) * F.lit(capacity)
    fewest = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)), F.lit(1))
    return out.withColumn("unused_share", 1 - F.col("tokens") / room).withColumn("excess", F.col("n_containers") / fewest - 1)
