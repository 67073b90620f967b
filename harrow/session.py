"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever their working directory is.

    On machines that don't see that folder the package is given to Spark as usual (``--py-files``).
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a folder of its own that is removed at exit; a cluster, whose
    executors don't share local folders, is refused.
    """
    ready(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="harrow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    made = _made.get()
    if made is not None:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            made.append(file.get())
    return out


_scratch: list[str] = []
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that ``scratch`` and ``cut`` give to this thread within the block."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and broadcasts that nothing refers to any more; else they wait until the driver's
    heap happens to be full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table; ``cleanup`` or the end of the process removes it."""
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")
    if not _scratch:
        atexit.register(_leave)
    _scratch.append(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def written(path: str) -> bool:
    """Was this path given by ``scratch`` and not removed since?"""
    return path in _scratch


def cleanup(spark: SparkSession) -> None:
    """Remove the tables written by ``scratch``, once no DataFrame that reads them is wanted any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        at = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        at.getFileSystem(conf).delete(at, True)


def _leave() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            cleanup(spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing is left to do then
            return


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at the path?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def removed(spark: SparkSession, path: str) -> None:
    """Remove one written table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _scratch:
        _scratch.remove(path)


HOT_KEYS = 4096


def hot_keys(big: DataFrame, on: list[str], least: int = 20_000) -> list[tuple[int, int]]:
    """(hash of the key, parts) of the keys that hold more than ``least`` rows and more than about 1/9,000 of all.

    A frequent-items sketch finds them map-side, without a shuffle of the keys; it misses none above that share, and
    so many can't be more than some thousands, whatever the data.
    """
    sketch = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {HOT_KEYS}, {8 * HOT_KEYS})")
    found = big.agg(sketch.alias("top")).first()[0] or []
    return [(r["item"], -(-r["count"] // least)) for r in found if r["count"] > least]


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", least: int = 20_000) -> DataFrame:
    """``big`` joined with ``small`` on equal columns; rows of hot keys of ``big`` are salted, those of ``small`` copied to each salt.

    ``how``: inner, left, left_semi or left_anti (of ``big``).  Columns besides ``on`` must differ in name.  ``big`` is
    read twice, so it should be a table or a checkpoint.
    """
    hot = hot_keys(big, on, least)
    if not hot:
        return big.join(small, on, how)
    parts = F.broadcast(big.sparkSession.createDataFrame(hot, "_key bigint, _parts bigint"))  # at most HOT_KEYS rows

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64(*on)).join(parts, "_key", "left").drop("_key")

    row = F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")])
    salt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(row, F.col("_parts"))).cast("bigint")
    salted = marked(big).withColumn("_salt", salt).drop("_parts")
    last = F.coalesce(F.col("_parts") - 1, F.lit(0).cast("bigint"))
    copied = marked(small).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_parts")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions configured for the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Even out rows that came through a shuffle before CPU-heavy Python work."""
    return df.repartition(max(parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))


def spread_scan(df: DataFrame) -> DataFrame:
    """A projected and filtered scan, shuffled only if it has fewer partitions than the session has cores.

    A table with as many splits as cores isn't moved; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else spread(df)
