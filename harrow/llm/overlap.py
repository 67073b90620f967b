"""Same or near-same records across splits.

Records are canonicalised (markup removed, case folded, words only) and hashed to 128 bits; equal hashes are one class,
and the join of evaluation with training classes on the hash gives the exact overlaps.  The same join on hashes of parts
gives the near ones: the parts of a record are its runs of five words (ten characters in scripts without blanks), and
two records overlap if they share at least ``similar`` of the runs of the one with more.

Candidates come from an exact bound, not from a fixed number of keys.  All runs have one global order, rarest first.  Of
two records that share ``similar`` of n runs, the first  n - ceil(similar * n) + k  of either hold at least k common ones,
whatever they are; so only these are keys, and only pairs that share k of them are compared, run by run, on their texts.
k grows with the text (by one for ``SHARE`` runs), which keeps pairs apart that share a stock phrase only.

The order comes from a sketch of the frequencies of all runs of all records: ``CELLS`` counters for each side, merged in
blocks and broadcast as one byte a cell, whatever the size of the data.  A run whose counter is zero on a side occurs on
one side only; it comes first in the order and isn't shuffled.  The sketch only orders keys and skips such ones:
collisions in it can add candidates, never lose a pair.

Hot keys are salted (``spread_join``); copies of a text are one class until the final pairs.

Defined results: rows with null id, or with a null or blank abstract, have no overlaps; a null title is empty; rows of
other splits (or null) are neither training nor evaluation; an id on both sides isn't paired with itself; pairs are
distinct; an empty table gives no rows.  Texts without any word are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, hot_keys, scratch, spread_join, spread_scan
from . import wordcodes

SIMILAR = 0.63
CELLS = 1 << 24  # the first 24 bits of the hash of a run
BLOCK = 1 << 16  # cells of a block of the sketch
SMALL = 500_000  # ids up to which they may be broadcast
SHARE = 20  # a candidate shares a key, and one more for so many of its runs


def _rows(df: DataFrame, train: tuple[str, ...], evaluation: tuple[str, ...]) -> DataFrame:
    rows = df.select(
        F.col("id").cast("bigint").alias("id"), F.col("split_name").isin(*train).alias("is_train"), "title", "abstract", "split_name"
    )
    return rows.where(
        F.col("id").isNotNull() & F.col("split_name").isin(*train, *evaluation) & F.col("abstract").rlike(r"(?U)\S")
    ).drop("split_name")


def _canonical(b: pa.RecordBatch) -> list[str]:
    return [wordcodes.canonical(x, y) for x, y in zip(b.column("title").to_pylist(), b.column("abstract").to_pylist())]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(wordcodes.BITS - 24)).astype(np.int64)


_HASHED = "id bigint, is_train boolean, h bigint, g bigint, block int, offsets binary, counts binary"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record, and at the end of the partition its counts of runs, in blocks."""
    schema = pa.schema([("id", pa.int64()), ("is_train", pa.bool_()), ("h", pa.int64()), ("g", pa.int64()), ("block", pa.int32()), ("offsets", pa.binary()), ("counts", pa.binary())])
    seen = np.zeros((2, CELLS), np.int32)  # of evaluation and training records

    for b in batches:
        side = np.array(b.column("is_train").to_pylist(), bool)
        ids = b.column("id").to_numpy()
        keep, hs, gs = [], [], []
        for first, bounds, codes, single in wordcodes.coded(_canonical(b)):
            h, g = wordcodes.wholes(bounds, codes)
            filled = np.flatnonzero(np.diff(bounds))
            keep.append(first + filled), hs.append(h[filled]), gs.append(g[filled])
            t, r = wordcodes.runs(bounds, codes, single)
            of = side[first + t]
            for k in (0, 1):
                own, n = np.unique(_cells(r[of == bool(k)]), return_counts=True)
                seen[k, own] += n.astype(np.int32)
        at = np.concatenate(keep) if keep else np.empty(0, np.int64)
        none = pa.nulls(len(at))
        if len(at):
            columns = [pa.array(ids[at]), pa.array(side[at]), pa.array(np.concatenate(hs)), pa.array(np.concatenate(gs))]
            yield pa.RecordBatch.from_arrays([*columns, none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], schema=schema)
    for k in (0, 1):
        u = np.flatnonzero(seen[k])
        total = seen[k, u]
        edges = np.searchsorted(u, np.arange(0, CELLS + 1, BLOCK))
        blocks = np.flatnonzero(np.diff(edges))
        if len(blocks):
            low, n = (u % BLOCK).astype(np.uint16), np.minimum(total, 255).astype(np.uint8)
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    none,
                    pa.array([bool(k)] * len(blocks)),
                    none,
                    none,
                    pa.array(blocks.astype(np.int32)),
                    pa.array([low[edges[x] : edges[x + 1]].tobytes() for x in blocks], pa.binary()),
                    pa.array([n[edges[x] : edges[x + 1]].tobytes() for x in blocks], pa.binary()),
                ],
                schema=schema,
            )


def _added(parts: pa.Table) -> np.ndarray:
    """Sums of the counts of one block, a row for each side; counts have one byte each or four."""
    counts = np.zeros((2, BLOCK), np.int64)
    for side, offsets, n in zip(*(parts.column(c).to_pylist() for c in ("is_train", "offsets", "counts"))):
        at = np.frombuffer(offsets, np.uint16)
        counts[int(side), at] += np.frombuffer(n, np.uint8 if len(n) == len(at) else np.uint32)  # offsets are distinct
    return counts


_PARTS = "is_train boolean, block int, offsets binary, counts binary"


def _sum(parts: pa.Table) -> pa.Table:
    counts = _added(parts)
    held = [np.flatnonzero(c) for c in counts]
    return pa.table(
        {
            "is_train": pa.array([False, True]),
            "block": pa.array([parts.column("block")[0].as_py()] * 2, pa.int32()),
            "offsets": pa.array([at.astype(np.uint16).tobytes() for at in held], pa.binary()),
            "counts": pa.array([np.minimum(c[at], 2**32 - 1).astype(np.uint32).tobytes() for c, at in zip(counts, held)], pa.binary()),
        }
    )


def _merge(parts: pa.Table) -> pa.Table:
    """The bytes of one block: 0 where a side has no run, else a step of the logarithm of the count of both."""
    counts = _added(parts)
    step = np.minimum(255, 1 + np.floor(np.log2(np.maximum(1, counts.sum(0))) * 8)).astype(np.uint8)
    step[(counts == 0).any(0)] = 0
    return pa.table({"block": parts.column("block").slice(0, 1), "steps": pa.array([step.tobytes()], pa.binary())})


def sketch(hashed: DataFrame, most: int = 64) -> np.ndarray:
    """``CELLS`` bytes on the driver: how frequent the runs of each cell are.

    A block has two rows from each task of the scan; more than ``most`` are summed in rounds, so many at a time, so that
    no task holds more of them however many tasks there were.
    """
    parts = hashed.where("block is not null").select("is_train", "block", "offsets", "counts")
    while (n := parts.groupBy("block").count().agg(F.max("count")).first()[0] or 0) > most:
        group = F.pmod(F.monotonically_increasing_id(), F.lit(-(-n // most)))  # rows of a block lie in many partitions
        parts = cut(parts.withColumn("g", F.xxhash64(group)).groupBy("block", "g").applyInArrow(_sum, _PARTS))
    out = np.zeros(CELLS, np.uint8)
    for block, steps in parts.groupBy("block").applyInArrow(_merge, "block int, steps binary").collect():  # CELLS / BLOCK rows
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(steps, np.uint8)
    return out


def least_shared(n: np.ndarray) -> np.ndarray:
    """Keys that a record of n runs shares at least with any that overlaps it and isn't larger: k of the bound."""
    return 1 + n // SHARE


def keys(rows: DataFrame, steps: np.ndarray, similar: float) -> DataFrame:
    """``x, h, n, is_train``: keys of every class, once a partition; n is the class's number of runs."""
    shared = rows.sparkSession.sparkContext.broadcast(steps)  # CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of = shared.value
        known: set[tuple[int, bool]] = set()
        for b in batches:
            side = np.array(b.column("is_train").to_pylist(), bool)
            for first, bounds, codes, single in wordcodes.coded(_canonical(b)):
                h, _ = wordcodes.wholes(bounds, codes)
                if len(known) > 2_000_000:
                    known.clear()
                new = np.zeros(len(h), bool)
                for k, key in enumerate(zip(h.tolist(), side[first : first + len(h)].tolist())):
                    if key not in known:
                        known.add(key)
                        new[k] = True
                t, r = wordcodes.runs(bounds, codes, single)
                t, r = t[new[t]], r[new[t]]
                if not len(t):
                    continue
                n = np.bincount(t, minlength=len(h))
                step = order_of[_cells(r)]
                # rarest first: texts stay together, equal steps go by the hash, whose last bits may be left out
                low = np.uint64(wordcodes.BITS - 42)
                order = np.argsort(t.astype(np.uint64) << np.uint64(wordcodes.BITS) | step.astype(np.uint64) << np.uint64(42) | r >> low, kind="stable")
                r, step = r[order], step[order]
                place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                length = n - np.ceil(similar * n - 1e-9).astype(np.int64) + least_shared(n)
                keep = (place < length[t]) & (step > 0)
                # fewer keys that both sides may hold than a pair must share: no partner
                keep &= np.bincount(t[keep], minlength=len(h))[t] >= least_shared(np.ceil(similar * n).astype(np.int64))[t]
                t, r = t[keep], r[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.view(np.int64)), pa.array(h[t]), pa.array(n[t].astype(np.int32)), pa.array(side[first + t])],
                    names=["x", "h", "n", "is_train"],
                )

    return spread_scan(rows).mapInArrow(run, "x bigint, h bigint, n int, is_train boolean")


def candidates(found: DataFrame, similar: float) -> DataFrame:
    """``h_a, h_b``: evaluation and training classes that share as many keys as an overlap takes."""
    if hot_keys(found, ["x"]):
        one = found.dropDuplicates(["x", "h", "is_train"])
        met = spread_join(_side(one, False), _side(one, True), ["x"])
    else:  # one exchange serves both sides and the join
        one = found.repartition("x").dropDuplicates(["x", "h", "is_train"])
        met = _side(one, False).join(_side(one, True), "x")
    met = met.where((F.col("h_a") != F.col("h_b")) & (F.least("n_a", "n_b") >= F.lit(similar - 1e-9) * F.greatest("n_a", "n_b")))
    shared = met.groupBy("h_a", "h_b").agg(F.count("*").alias("shared"), F.min(F.least("n_a", "n_b")).alias("n"))
    return shared.where(F.col("shared") >= 1 + F.floor(F.col("n") / SHARE)).select("h_a", "h_b")


def _side(one: DataFrame, train: bool) -> DataFrame:
    end = "b" if train else "a"
    return one.where(F.col("is_train") == train).select("x", F.col("h").alias(f"h_{end}"), F.col("n").alias(f"n_{end}"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = []
        for title, abstract in (("title", "abstract"), ("title_b", "abstract_b")):
            texts = [wordcodes.canonical(x, y) for x, y in zip(b.column(title).to_pylist(), b.column(abstract).to_pylist())]
            own: list[np.ndarray] = []
            for _, bounds, codes, single in wordcodes.coded(texts):
                t, r = wordcodes.runs(bounds, codes, single)
                own += np.split(r, np.searchsorted(t, np.arange(1, len(bounds) - 1)))
            sets.append(own)
        value = [len(np.intersect1d(x, y, assume_unique=True)) / max(1, len(x), len(y)) for x, y in zip(*sets)]
        yield pa.RecordBatch.from_arrays([b.column("h_a"), b.column("h_b"), pa.array(value, pa.float64())], names=["h_a", "h_b", "similarity"])


def compared(pairs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``h_a, h_b, similarity`` of candidate classes, from the whole texts of one record of each.

    ``pairs``: ``h_a, h_b``; ``ids``: ``h, eval_id, train_id``, the records that stand for each class on either side.
    """
    a = ids.select(F.col("h").alias("h_a"), F.col("eval_id").alias("id_a"))
    b = ids.select(F.col("h").alias("h_b"), F.col("train_id").alias("id_b"))
    pairs = cut(pairs.join(a, "h_a").join(b, "h_b"))
    wanted = pairs.select(F.col("id_a").alias("id")).unionAll(pairs.select("id_b")).distinct()
    small = wanted.count() <= SMALL
    texts = rows.join(F.broadcast(wanted) if small else wanted, "id", "left_semi").dropDuplicates(["id", "is_train"])
    a = texts.where("not is_train").select(F.col("id").alias("id_a"), "title", "abstract")
    b = texts.where("is_train").select(F.col("id").alias("id_b"), F.col("title").alias("title_b"), F.col("abstract").alias("abstract_b"))
    both = spread_join(pairs, a, ["id_a"], least=2000)
    both = spread_join(cut(both), b, ["id_b"], least=2000) if hot_keys(pairs, ["id_b"], 2000) else both.join(b, "id_b")
    return both.select("h_a", "h_b", "title", "abstract", "title_b", "abstract_b").mapInArrow(_compare, "h_a bigint, h_b bigint, similarity double")


def overlaps(
    df: DataFrame, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("test", "dev"), similar: float = SIMILAR
) -> DataFrame:
    """``eval_id, train_id, similarity`` (1.0: equal but for formatting) of all overlapping records."""
    spark = df.sparkSession
    rows = _rows(df, train, evaluation)
    path = scratch(spark, "hashed")
    spread_scan(rows).mapInArrow(_hash, _HASHED).write.parquet(path)
    hashed = spark.read.schema(_HASHED).parquet(path)
    path = scratch(spark, "keys")
    keys(rows, sketch(hashed), similar).write.parquet(path)
    found = spark.read.schema("x bigint, h bigint, n int, is_train boolean").parquet(path)
    members = hashed.where("id is not null").select("id", "is_train", "h", "g")
    mine = lambda flag: F.min(F.when(flag, F.col("id")))
    classes = members.groupBy("h", "g").agg(mine(~F.col("is_train")).alias("eval_id"), mine(F.col("is_train")).alias("train_id"))
    path = scratch(spark, "classes")
    classes.write.parquet(path)
    classes = spark.read.schema("h bigint, g bigint, eval_id bigint, train_id bigint").parquet(path)
    near = compared(cut(candidates(found, similar)), rows, classes).where(F.col("similarity") >= F.lit(similar - 1e-9))
    exact = classes.where("eval_id is not null and train_id is not null")
    exact = exact.select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(1.0).alias("similarity"))
    linked = cut(near.unionAll(exact))
    # the records of the linked classes only; copies are paired at the end
    ends = linked.select(F.col("h_a").alias("h")).unionAll(linked.select("h_b")).distinct()
    held = cut(members.join(F.broadcast(ends) if linked.count() <= SMALL else ends, "h", "left_semi"))
    # copies of one class meet each other here, hot classes in salted parts
    evals = held.where("not is_train").select(F.col("h").alias("h_a"), F.col("g").alias("g_a"), F.col("id").alias("eval_id")).distinct()
    trains = held.where("is_train").select(F.col("h").alias("h_b"), F.col("g").alias("g_b"), F.col("id").alias("train_id")).distinct()
    out = spread_join(cut(spread_join(evals, linked, ["h_a"], least=2000)), trains, ["h_b"], least=2000)
    out = out.where((F.col("h_a") != F.col("h_b")) | (F.col("g_a") == F.col("g_b"))).where("eval_id <> train_id")
    return out.groupBy("eval_id", "train_id").agg(F.max("similarity").alias("similarity"))


def report(df: DataFrame, found: DataFrame) -> DataFrame:
    """``split_name, dataset, n_records, n_overlapping, n_exact, n_pairs`` for each evaluation split and source."""
    per = found.groupBy("eval_id").agg(F.count("*").alias("pairs"), F.max("similarity").alias("best"))
    rows = df.where(F.col("split_name") != "train").select("id", "split_name", "dataset")
    joined = rows.join(per, F.col("id") == F.col("eval_id"), "left")
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return joined.groupBy("split_name", "dataset").agg(
        F.count("*").alias("n_records"),
        flag(F.col("pairs").isNotNull()).alias("n_overlapping"),
        flag(F.col("best") >= 1).alias("n_exact"),
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("n_pairs"),
    )
