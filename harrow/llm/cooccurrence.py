"""Items that appear together: an incremental table of pair counts and association scores.

A *basket* is one record: its id, the time of its delivery and the sorted set of its items.  Changed baskets emit
signed deltas, +1 for every item and pair of the new content and -1 for the content it replaces; the deltas are summed
map-side before the only shuffle, merged into counts that are kept in hash buckets, and the pairs whose counts or
marginals changed are scored again.  What depends on the number of all records (lift, PMI) is taken from it at reading.

Defined results: null arrays, null labels, null, empty and blank elements are no items; repeated items count once;
records without items count in ``n`` only; rows without an id are no records; of several deliveries of an id the one
with the greatest ``loaded_at`` (null is earliest) counts, of equal ones the one with the greater item list; an empty
table has n = 0 and no pairs.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, scratch, spread_join

COUNTS = "a string, b string, cnt bigint"
SCORED = "item_a string, item_b string, n_ab bigint, n_a bigint, n_b bigint"


def item_list(topics: Column, labels: Column) -> Column:
    """Sorted distinct items of a record: lower case, no blanks at the ends, inner blanks reduced to one."""
    raw = F.concat(
        F.coalesce(topics, F.array().cast("array<string>")),
        F.split(F.coalesce(labels, F.lit("")), ";"),
    )
    clean = F.transform(raw, lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))


def baskets(df: DataFrame) -> DataFrame:
    """Latest delivery of every record: ``id, loaded_at, items``."""
    rows = df.where(F.col("id").isNotNull()).select(
        "id", F.struct("loaded_at", item_list(F.col("topics"), F.col("intervention_labels")).alias("items")).alias("v")
    )
    return rows.groupBy("id").agg(F.max("v").alias("v")).select("id", "v.loaded_at", "v.items")


def deltas(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Signed count changes ``a, b, delta`` from replacing the baskets ``old`` by ``new`` (pre-aggregated map-side).

    A record counts as (null, null), an item as (a, null), a pair as (a, b).  Each item is exploded with the items after
    it, so no array is longer than a basket.
    """
    signed = new.select("items", F.lit(1).cast("bigint").alias("d"))
    if old is not None:
        signed = signed.unionAll(old.select("items", F.lit(-1).cast("bigint").alias("d")))
    none = F.array(F.lit(None).cast("string"))
    each = signed.select("items", "d", F.posexplode(F.concat(none, "items")).alias("i", "a"))
    rest = F.when(F.col("a").isNotNull(), F.slice("items", F.col("i") + 1, F.greatest(F.size("items"), F.lit(1))))
    each = each.select("a", "d", F.explode(F.concat(none, F.coalesce(rest, F.array().cast("array<string>")))).alias("b"))
    return each.groupBy("a", "b").agg(F.sum("d").alias("delta")).where("delta <> 0")


def marginals(counts: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b`` of all pairs in ``counts`` (a, b, cnt).

    With ``affected`` (item names in column ``a``), only of pairs with such an item.
    """
    pairs = counts.where("b is not null and cnt > 0").select("a", "b", F.col("cnt").alias("n_ab"))
    items = counts.where("a is not null and b is null").select("a", F.col("cnt").alias("n_a"))
    if affected is not None:
        first = affected.select("a").distinct().withColumn("hit_a", F.lit(True))
        pairs = spread_join(pairs, first, ["a"], "left")
        pairs = spread_join(pairs, first.select(F.col("a").alias("b"), F.col("hit_a").alias("hit_b")), ["b"], "left")
        pairs = pairs.where("hit_a or hit_b").select("a", "b", "n_ab")
    out = spread_join(spread_join(pairs, items, ["a"]), items.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), ["b"])
    return out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b")


def association(pairs: DataFrame, n: int) -> DataFrame:
    """``pairs`` with ``n, lift, pmi`` for n records; these follow n, so they are taken when the pairs are read."""
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.withColumns({"n": F.lit(n).cast("bigint"), "lift": lift, "pmi": F.log2(lift)})


def pair_counts(df: DataFrame) -> DataFrame:
    """Scores of all pairs of a whole table, counted in one go: what a ``PairTable`` of the same rows must hold."""
    counts = deltas(baskets(df)).withColumnRenamed("delta", "cnt")
    n = counts.where("a is null").agg(F.sum("cnt")).first()[0] or 0
    return association(marginals(counts), n)


def frequent_pairs(scored: DataFrame, support: int = 250, factor: int = 3) -> DataFrame:
    """Pairs in at least n/``support`` records and ``factor`` times as often as chance; exact integer arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return scored.where(
        (wide("n_ab") * F.lit(support) >= wide("n"))
        & (wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(factor))
    )


@dataclass
class PairTable:
    """Persistent counts under ``path``, in hash buckets.

    ``baskets`` grows by a segment for each batch: the baskets it changed, beside what they replaced.  ``counts``
    (a, b, cnt) and ``scored`` (pairs with their marginals) are merged: a batch writes the buckets it touches, under its
    own version.  ``manifest-<version>.json`` names the version of every bucket and the number of records and is written
    last, so a failed batch leaves the former state readable.  The number of buckets is fixed when the table is made.
    """

    spark: SparkSession
    path: str
    buckets: int | None = None

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        jvm, fs, at = self._fs()
        found = []
        if fs.exists(at):
            names = [s.getPath().getName() for s in fs.listStatus(at)]
            found = sorted(int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json"))
        if not found:
            many = self.buckets or max(16, parallelism(self.spark))
            return {"version": 0, "buckets": many, "n": 0, "baskets": [], "counts": {}, "scored": {}}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(self.path, f"manifest-{found[-1]}.json"))
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        jvm, fs, _ = self._fs()
        temp = jvm.org.apache.hadoop.fs.Path(self.path, f"_writing-{os.urandom(4).hex()}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.rename(temp, jvm.org.apache.hadoop.fs.Path(self.path, f"manifest-{manifest['version']}.json"))

    def _baskets(self, manifest: dict, schema: str) -> DataFrame:
        """Latest basket of every record over all segments."""
        paths = [f"{self.path}/baskets/v{v}" for v in manifest["baskets"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if len(paths) < 2:
            return rows
        return rows.groupBy("id").agg(F.max(F.struct("loaded_at", "items")).alias("v")).select("id", "v.loaded_at", "v.items")

    def _read(self, kind: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = COUNTS if kind == "counts" else SCORED
        paths = [f"{self.path}/{kind}/v{v}/bucket={k}" for k, v in manifest[kind].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, manifest: dict, touched: list[int]) -> None:
        """One version of the touched buckets; those left without rows leave the manifest."""
        version = manifest["version"]
        path = f"{self.path}/{kind}/v{version}"
        df.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        jvm, fs, _ = self._fs()
        there = {s.getPath().getName()[7:] for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().startswith("bucket=")}
        for k in map(str, touched):
            manifest[kind].pop(k, None)
            if k in there:
                manifest[kind][k] = version

    def apply(self, batch: DataFrame) -> DataFrame:
        """Merge a batch of deliveries; returns the association scores of the affected pairs."""
        manifest = self.manifest()
        manifest["version"] = version = manifest["version"] + 1
        bucket = lambda a, b: F.pmod(F.xxhash64(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), F.lit(manifest["buckets"])).cast("int")
        schema = f"id bigint, loaded_at {batch.schema['loaded_at'].dataType.simpleString()}, items array<string>"

        new = baskets(batch)
        if manifest["baskets"]:
            old = self._baskets(manifest, schema).select("id", F.col("loaded_at").alias("at"), F.col("items").alias("before"))
            joined = new.join(old, "id", "left")
            later = F.struct("loaded_at", "items") > F.struct(F.col("at"), F.col("before"))
            new = joined.where(F.col("before").isNull() | later).drop("at")
        else:
            new = new.withColumn("before", F.lit(None).cast("array<string>"))
        segment = f"{self.path}/baskets/v{version}"
        new.select("id", "loaded_at", "items", "before").write.mode("overwrite").parquet(segment)
        changed = self.spark.read.schema(schema + ", before array<string>").parquet(segment)
        manifest["baskets"].append(version)

        replaced = changed.where("before is not null").select(F.col("before").alias("items"))
        first = version == 1
        path = scratch(self.spark, "delta")
        deltas(changed, None if first else replaced).withColumn("bucket", bucket(F.col("a"), F.col("b"))).write.parquet(path)
        change = self.spark.read.schema("a string, b string, delta bigint, bucket int").parquet(path)
        manifest["n"] += change.where("a is null").agg(F.sum("delta")).first()[0] or 0
        touched = [r[0] for r in change.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        merged = (
            self._read("counts", manifest, touched)
            .unionAll(change.select("a", "b", F.col("delta").alias("cnt")))
            .groupBy("a", "b")
            .agg(F.sum("cnt").alias("cnt"))
            .where("cnt <> 0")
        )
        self._write(merged.withColumn("bucket", bucket(F.col("a"), F.col("b"))), "counts", manifest, touched)

        # pairs whose own count or whose items' counts changed
        items = change.where("a is not null").select("a").unionAll(change.where("b is not null").select(F.col("b").alias("a"))).distinct()
        path = scratch(self.spark, "rescored")
        marginals(self._read("counts", manifest), None if first else items).write.parquet(path)
        rescored = self.spark.read.schema(SCORED).parquet(path)
        keyed = rescored.withColumn("bucket", bucket(F.col("item_a"), F.col("item_b")))
        hit = sorted({r[0] for r in keyed.select("bucket").distinct().collect()} | set(touched))
        kept = self._read("scored", manifest, hit)
        kept = kept.join(rescored.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
        gone = change.where("b is not null and delta < 0").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"))
        kept = kept.join(gone, ["item_a", "item_b"], "left_anti")  # a pair that is left at all was scored again
        self._write(kept.withColumn("bucket", bucket(F.col("item_a"), F.col("item_b"))).unionAll(keyed), "scored", manifest, hit)
        self._publish(manifest)
        return association(rescored, manifest["n"])

    def counts(self) -> DataFrame:
        """All current counts ``a, b, cnt``."""
        return self._read("counts", self.manifest())

    def scored(self) -> DataFrame:
        """All current pairs: ``item_a, item_b, n_ab, n_a, n_b, n, lift, pmi``."""
        manifest = self.manifest()
        return association(self._read("scored", manifest), manifest["n"])
