"""Metrics of labels and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, n`` of rows with both."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        F.col(truth).alias("truth"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, precision, recall, f1, support`` (0 where a share has nothing to count)."""
    c = confusion(df, truth, predicted)
    hit = c.where("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    true = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    pred = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    j = true.join(pred, "label", "full").join(hit, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumn("precision", share("tp", "predicted")).withColumn("recall", share("tp", "support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.select("label", "precision", "recall", f1.alias("f1"), "support")


def set_scores(truth: Column, predicted: Column) -> Column:
    """(precision, recall, f1, any hit) of two label sets; two empty sets agree."""
    hit = F.size(F.array_intersect(truth, predicted))
    p = F.when(F.size(predicted) > 0, hit / F.size(predicted)).otherwise((F.size(truth) == 0).cast("double"))
    r = F.when(F.size(truth) > 0, hit / F.size(truth)).otherwise((F.size(predicted) == 0).cast("double"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("p"), r.alias("r"), f1.alias("f1"), (hit > 0).cast("int").alias("any"))


def draw(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) that any engine can compute from the key."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 7)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(16**7))


def split(df: DataFrame, key: str, share: float, seed: str = "") -> DataFrame:
    """``part`` test for the share of smallest draws, else train; each row by itself, so strata keep their shares."""
    return df.withColumn("part", F.when(draw(F.col(key), seed) < share, "test").otherwise("train"))


def choose(df: DataFrame, group: str, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows of each group at random."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def at_thresholds(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """``threshold, tp, found, wanted`` of a score for each threshold."""
    each = df.select(F.col(score).alias("_s"), F.col(truth).alias("_t"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    hit = F.col("_s") >= F.col("threshold")
    return each.groupBy("threshold").agg(count(hit & F.col("_t")).alias("tp"), count(hit).alias("found"), count(F.col("_t")).alias("wanted"))
