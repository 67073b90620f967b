"""A trained tagger of entities in text, its training rows, spans and scores.

A token is inside or outside an entity; a logistic regression decides by hashed signs of the token and its neighbours.
It stands behind the same ``fit`` and ``predict`` as the other models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SAMPLE = 20_000  # texts a tagger is trained on at most


def last_span(text: str, entity: str) -> Column:
    """Position (from 1) of the last mention of an entity in a text, 0 if there is none; letter case doesn't count."""
    found = F.expr(f"locate(reverse(lower({entity})), reverse(lower({text})))")
    return F.when(found > 0, F.length(text) - found - F.length(entity) + 2).otherwise(0)


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, at, w``: words of each text."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return df.select(id_col, words.alias("ws"))


def _signs(words: str) -> Column:
    """For each word the signs it is judged by."""
    w = lambda i: F.coalesce(F.lower(F.try_element_at(words, i)), F.lit("-"))

    def of(x: Column, i: Column) -> Column:
        low = F.lower(x)
        shape = F.when(x == F.upper(x), "A").when(F.substring(x, 1, 1) == F.upper(F.substring(x, 1, 1)), "Aa").otherwise("a")
        before = F.when(i > 0, w(F.greatest(i, F.lit(1)))).otherwise(F.lit("^"))
        return F.array(F.concat(F.lit("w="), low), F.concat(F.lit("p="), before), F.concat(F.lit("n="), w(i + 2)), F.concat(F.lit("s="), F.right(low, F.lit(3))), F.concat(F.lit("f="), shape))

    return F.transform(words, of)


class Tagger:
    """Learns which words of a text belong to entities; ``entities``: an array column of training rows."""

    def __init__(self, text: str = "text", entities: str = "entities", features: int = 1 << 14, sample: int = SAMPLE):
        self.text, self.entities, self.features, self.sample = text, entities, features, sample
        self.model = None

    def _rows(self, df: DataFrame, id_col: str) -> DataFrame:
        keep = [self.entities] if self.entities in df.columns else []
        x = tokens(df, id_col, self.text).join(df.select(id_col, *keep), id_col) if keep else tokens(df, id_col, self.text)
        x = x.select(id_col, *keep, F.posexplode(F.arrays_zip(F.col("ws").alias("w"), _signs("ws").alias("s"))).alias("at", "z"))
        return x.select(id_col, *keep, "at", F.col("z.w").alias("w"), F.col("z.s").alias("signs"))

    def fit(self, df: DataFrame, id_col: str = "id") -> Tagger:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF

        df = df.orderBy(F.xxhash64(id_col), id_col).limit(self.sample)
        names = F.flatten(F.transform(self.entities, lambda e: F.split(F.lower(e), " ")))
        rows = cut(self._rows(df, id_col).withColumn("_y", F.array_contains(names, F.lower("w")).cast("double")).select("signs", "_y"))
        stages = [
            HashingTF(inputCol="signs", outputCol="_x", numFeatures=self.features, binary=True),
            LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=15, regParam=0.001, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r"),
        ]
        self.model = Pipeline(stages=stages).fit(rows)
        return self

    def predict(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """``id_col, found``: runs of words taken for entities, distinct and in small letters."""
        x = self.model.transform(self._rows(df.select(id_col, self.text), id_col)).where("_p = 1")
        x = x.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", F.lower("w").alias("w")))).alias("t"))
        kind = "array<struct<at:int,w:string>>"
        join = lambda acc, y: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1).at == y.at - 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(y.at.alias("at"), F.concat_ws(" ", F.element_at(acc, -1).w, y.w).alias("w")))),
        ).otherwise(F.concat(acc, F.array(F.struct(y.at.alias("at"), y.w.alias("w")))))
        runs = F.aggregate("t", F.array().cast(kind), join)
        got = x.select(id_col, F.array_sort(F.array_distinct(F.transform(runs, lambda r: r.w))).alias("found"))
        return df.select(id_col).join(got, id_col, "left").select(id_col, F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def scores(predicted: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """One row ``precision, recall, f1`` over entities; a text without any, for which none is found, counts as right."""
    j = predicted.join(wanted, id_col)
    both = F.size(F.array_intersect("found", "entities"))
    empty = ((F.size("found") == 0) & (F.size("entities") == 0)).cast("int")
    s = j.agg(F.sum(both + empty).alias("tp"), F.sum(F.size("found") + empty).alias("p"), F.sum(F.size("entities") + empty).alias("r"))
    p, r = F.col("tp") / F.greatest("p", F.lit(1)), F.col("tp") / F.greatest("r", F.lit(1))
    return s.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 4).alias("f1"))
