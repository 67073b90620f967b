"""Vectors, phrases, topics, nearest neighbours and classifiers.

Models that the collection of documents bounds are trained here with Spark ML; a model is a ``Predictor``, so that
another (a transformer, say) takes its place without other changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, parallelism, scratch, spread_scan

SAMPLE = 20_000  # labelled rows a classifier is fitted on at most
BLOCK = 4_096  # vectors of a side that a task compares
BUCKET = 20_000  # documents that are weighed together


class Predictor(Protocol):
    def fit(self, df: DataFrame) -> Predictor: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


class TextClassifier:
    """Hashed TF-IDF words into a logistic regression; fitted on at most ``sample`` rows, chosen by hash order."""

    def __init__(self, text: str = "text", label: str = "label", features: int = 1 << 14, sample: int = SAMPLE):
        self.text, self.label, self.features, self.sample = text, label, features, sample
        self.model = None

    def _words(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_w", T.token_list(self.text))

    def fit(self, df: DataFrame) -> TextClassifier:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import IDF, HashingTF, StringIndexer

        rows = self._words(df.where(F.col(self.label).isNotNull())).select("_w", self.label)
        rows = cut(rows.orderBy(F.xxhash64(F.array_join("_w", " "))).limit(self.sample))
        stages = [
            StringIndexer(inputCol=self.label, outputCol="_y", stringOrderType="alphabetAsc"),
            HashingTF(inputCol="_w", outputCol="_tf", numFeatures=self.features),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r"),
        ]
        self.model = Pipeline(stages=stages).fit(rows)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        labels = self.model.stages[0].labels
        out = self._words(df).drop(self.label) if self.label in df.columns else self._words(df)
        for stage in self.model.stages[1:]:
            out = stage.transform(out)
        names = F.array(*map(F.lit, labels))
        out = out.withColumn("predicted", F.element_at(names, F.col("_p").cast("int") + 1))
        return out.withColumn("probability", F.array_max(vector_to_array("_q"))).drop("_w", "_tf", "_x", "_p", "_q", "_r")


def phrases(words: DataFrame, id_col: str, column: str, least: int = 5, threshold: float = 10.0) -> DataFrame:
    """``a, b, n_ab, score`` of word pairs that stand together more often than their words let expect."""
    words = cut(words.select(column))
    w = words.select(F.explode(column).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select(F.explode(T.bigrams(F.col(column))).alias("p")).groupBy("p").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= least)
    size = w.count()
    pairs = pairs.select(F.split_part("p", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p", F.lit(" "), F.lit(2)).alias("b"), "n_ab")
    j = pairs.join(w.toDF("a", "n_a"), "a").join(w.toDF("b", "n_b"), "b")
    score = (F.col("n_ab") - least) * F.lit(size) / (F.col("n_a") * F.col("n_b"))
    return j.withColumn("score", score).where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def phrased(words: DataFrame, id_col: str, column: str, found: DataFrame) -> DataFrame:
    """``id_col, column``: word lists in which pairs of ``found`` (``a, b``) are one element, from left to right."""
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size(column) - 1, F.lit(1)))).alias("i")
    pairs = words.where(F.size(column) > 1).select(id_col, at, column)
    pairs = pairs.select(id_col, "i", F.element_at(column, F.col("i")).alias("a"), F.element_at(column, F.col("i") + 1).alias("b"))
    hits = pairs.join(found.select("a", "b").distinct(), ["a", "b"]).groupBy(id_col).agg(F.array_sort(F.collect_list("i")).alias("h"))
    # a pair begins at a hit unless one began just before
    first = F.aggregate("h", F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) < i - 1), F.concat(acc, F.array(i))).otherwise(acc))
    j = words.select(id_col, column).join(hits, id_col, "left").withColumn("h", F.when(F.col("h").isNotNull(), first).otherwise(F.array().cast("array<int>")))
    put = F.transform(
        column,
        lambda w, k: F.when(F.array_contains("h", k + 1), F.concat_ws(" ", w, F.try_element_at(column, k + 2))).when(~F.array_contains("h", k), w),
    )
    return j.select(id_col, F.array_compact(put).alias(column))


class Stacked:
    """Classifiers over texts, and a forest over their probabilities; fitted on at most ``sample`` labelled rows.

    ``bases``: (text column, "logistic" or "bayes").  The first learn from one half of the rows, told by a hash; the
    forest learns from what they say of the other.
    """

    def __init__(self, bases: list[tuple[str, str]], label: str = "label", id_col: str = "id", features: int = 1 << 12, sample: int = SAMPLE, trees: int = 30):
        self.bases, self.label, self.id_col, self.features, self.sample, self.trees = bases, label, id_col, features, sample, trees

    def fit(self, df: DataFrame) -> Stacked:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
        from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler

        rows = df.where(F.col(self.label).isNotNull()).orderBy(F.xxhash64(self.id_col), self.id_col).limit(self.sample)
        self.indexer = StringIndexer(inputCol=self.label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
        rows = cut(self._words(self.indexer.transform(rows)))
        half = F.pmod(F.xxhash64(F.lit(1), F.col(self.id_col)), F.lit(2)) == 0
        self.models = []
        for k, (_, kind) in enumerate(self.bases):
            names = {"featuresCol": f"_x{k}", "labelCol": "_y", "predictionCol": f"_p{k}", "probabilityCol": f"_q{k}", "rawPredictionCol": f"_r{k}"}
            last = LogisticRegression(maxIter=20, regParam=0.01, **names) if kind == "logistic" else NaiveBayes(**names)
            stages = [HashingTF(inputCol=f"_w{k}", outputCol=f"_t{k}", numFeatures=self.features), IDF(inputCol=f"_t{k}", outputCol=f"_x{k}"), last]
            self.models.append(Pipeline(stages=stages).fit(rows.where(half)))
        self.assembler = VectorAssembler(inputCols=[f"_q{k}" for k in range(len(self.bases))], outputCol="_x")
        said = self.assembler.transform(self._said(rows.where(~half)))
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", numTrees=self.trees, maxDepth=5, seed=7)
        self.model = forest.fit(cut(said.select("_x", "_y")))
        return self

    def _words(self, df: DataFrame) -> DataFrame:
        return df.select(self.id_col, self.label, "_y", *(T.token_list(c).alias(f"_w{k}") for k, (c, _) in enumerate(self.bases)))

    def _said(self, rows: DataFrame) -> DataFrame:
        for m in self.models:
            rows = m.transform(rows)
        return rows

    def predict(self, df: DataFrame) -> DataFrame:
        """``id_col, label`` (if known), ``predicted`` and what each base says as ``base_<k>``."""
        known = df if self.label in df.columns else df.withColumn(self.label, F.lit(self.indexer.labels[0]))
        out = self.model.transform(self.assembler.transform(self._said(self._words(self.indexer.transform(known)))))
        names = F.array(*map(F.lit, self.indexer.labels))
        name = lambda c: F.element_at(names, F.col(c).cast("int") + 1)
        return out.select(self.id_col, self.label, name("_p").alias("predicted"), *(name(f"_p{k}").alias(f"base_{k}") for k in range(len(self.bases))))

    def scored(self, df: DataFrame) -> DataFrame:
        """``model, macro_f1`` of every base and of the whole."""
        from .evaluation import report

        said = cut(self.predict(df))
        out = None
        for name, column in [(f"{c} {k}", f"base_{i}") for i, (c, k) in enumerate(self.bases)] + [("stacked", "predicted")]:
            one = report(said, self.label, column).agg(F.lit(name).alias("model"), F.round(F.avg("f1"), 4).alias("macro_f1"))
            out = one if out is None else out.unionAll(one)
        return out


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda i, j: i + j)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-12))


def term_vectors(words: DataFrame) -> DataFrame:
    """``term, v``: weights of each term in all topics, in their order."""
    return words.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "weight"))), lambda x: x.weight).alias("v"))


def _block_pairs(queries: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """``a, b, s``: for each query (``id, v, g``) the k rows of its group of highest cosine, itself excluded.

    Both sides are cut into blocks of about ``BLOCK`` rows of a group by a hash; a pair of blocks is a task's work and
    leaves k rows a query, so that neither the driver nor a task holds more than two blocks.
    """
    count = lambda df: df.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    nq, nr = -(-count(queries) // BLOCK) or 1, -(-count(rows) // BLOCK) or 1
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("g", own(nq).alias("i"), every(nr).alias("j"), "id", "v")
    right = rows.select("g", every(nq).alias("i"), own(nr).alias("j"), "id", "v")

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "s": []}
        if q.num_rows and r.num_rows:
            a, b = (np.array(t.column("id").to_pylist(), np.int64) for t in (q, r))
            x, y = (np.array(t.column("v").to_pylist(), np.float64) for t in (q, r))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
            order = np.argsort(b, kind="stable")
            b, sim = b[order], (x @ y.T)[:, order]
            sim[a[:, None] == b[None, :]] = -2
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(sim, top, 1)
            keep = (near >= least) & (near > -2)
            out = {"a": np.repeat(a, top.shape[1])[keep.ravel()], "b": b[top][keep], "s": near[keep]}
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "s": pa.array(out["s"], pa.float64())})

    near = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(run, "a bigint, b bigint, s double")
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return near.withColumn("r", r).where(F.col("r") <= k).drop("r")


def _vectors(rows: DataFrame, id_col: str, vector: str, group) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), group.alias("g"))


def mutual_neighbours(rows: DataFrame, k: int, least: float, id_col: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """``a, b``: rows of one group that are each among the other's k of highest cosine, at least ``least``.

    All rows are compared with all of their group, block by block.
    """
    rows = cut(_vectors(rows, id_col, vector, F.col(group)))
    near = cut(_block_pairs(rows, rows, k, least).select("a", "b"))
    return near.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, id, similarity``: the k rows of highest cosine for each query, itself excluded; exact, block by block."""
    one = F.lit(0)
    found = _block_pairs(cut(_vectors(queries, id_col, vector, one)), cut(_vectors(rows, id_col, vector, one)), k, least)
    return found.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.col("s").alias("similarity"))


def nmf(weights: DataFrame, k: int = 8, rounds: int = 6, seed: int = 0, min_df: float = 0.0015, max_df: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Topics of ``id, term, w``: (``id, topic, weight``), (``term, topic, weight``) by multiplicative updates.

    Terms are those in a share of the documents between ``min_df`` and ``max_df``, so there are at most the mean number
    of terms of a document over ``min_df`` of them, however many documents there are; the term side (terms x k) is held
    by the driver and broadcast, documents stay distributed.  Documents without such a term have weights of zero.  Each
    round every partition solves its documents against the terms and sends back sums of size terms x k.
    """
    n = weights.select("id").distinct().count()
    top = weights.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= min_df * n) & (F.col("n") <= max(1.0, max_df * n)))
    names = sorted(r["term"] for r in top.collect())
    index = weights.sparkSession.createDataFrame([(t, j) for j, t in enumerate(names)], "term string, j int")
    docs = weights.join(F.broadcast(index), "term", "left").groupBy("id")
    docs = docs.agg(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "w"))).alias("x")).select("id", F.col("x.j").alias("j"), F.col("x.w").alias("w"), F.lit(1.0).alias("norm"))
    return _factors(cut(docs), names, np.ones(len(names)), k, rounds, seed)


def text_topics(df: DataFrame, column: str, k: int = 8, rounds: int = 6, seed: int = 0, min_df: float = 0.0015, max_df: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """``nmf`` of the tf-idf weights of a text column, without a row for each term of each document.

    The words are written once.  Documents go to buckets with the idf of their own terms (no vocabulary is broadcast),
    where their lengths are taken; what is kept of each are its frequent terms' numbers and counts, and that length.
    """
    spark = df.sparkSession
    path = scratch(spark, "words")
    spread_scan(df.select("id", column)).select("id", T.token_list(column).alias("l")).write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.count()
    rows = rows.where("size(l) > 0")
    n = rows.count()
    seen = cut(rows.select(F.explode(F.array_distinct("l")).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    top = seen.where((F.col("n") >= min_df * n) & (F.col("n") <= max(1.0, max_df * n)))
    often = sorted((r["term"], r["n"]) for r in top.collect())
    names = [t for t, _ in often]
    index = spark.createDataFrame([(t, j) for j, t in enumerate(names)], "term string, j int")
    weight = (F.log((1 + F.lit(total)) / (1 + F.col("n"))) + 1).alias("idf")
    terms = seen.join(F.broadcast(index), "term", "left").select(F.xxhash64("term").alias("code"), weight, F.coalesce("j", F.lit(-1)).alias("j"))
    buckets = max(parallelism(spark), spark.sparkContext.defaultParallelism, -(-n // BUCKET))
    laid = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "id", F.transform("l", lambda w: F.xxhash64(w)).alias("codes"))
    used = laid.select(F.col("bucket").alias("for"), F.explode("codes").alias("code")).distinct().join(terms, "code")
    docs = laid.groupBy("bucket").cogroup(used.groupBy("for")).applyInArrow(_counted, "id bigint, j array<int>, w array<double>, norm double")
    path = scratch(spark, "counts")
    docs.write.parquet(path)
    idf = np.log((1 + total) / (1 + np.array([c for _, c in often], np.float64))) + 1
    return _factors(spark.read.parquet(path), names, idf, k, rounds, seed)


def _counted(rows: pa.Table, terms: pa.Table) -> pa.Table:
    """Of each document the numbers and counts of its frequent terms, and the length of the weights of all its terms."""
    n = rows.num_rows
    if not n:
        return pa.table({"id": pa.array([], pa.int64()), "j": pa.array([], pa.list_(pa.int32())), "w": pa.array([], pa.list_(pa.float64())), "norm": pa.array([], pa.float64())})
    order = np.argsort(terms["code"].to_numpy())
    code, idf, place = (terms[c].to_numpy()[order] for c in ("code", "idf", "j"))
    lists = rows["codes"].combine_chunks()
    row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    key, tf = np.unique(row * len(code) + np.searchsorted(code, lists.flatten().to_numpy()), return_counts=True)
    row, term = key // len(code), key % len(code)
    norm = np.sqrt(np.bincount(row, (tf * idf[term]) ** 2, minlength=n))
    kept = place[term] >= 0
    at = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=n))]).astype(np.int32)
    j = pa.ListArray.from_arrays(at, pa.array(place[term][kept], pa.int32()))
    return pa.table({"id": rows["id"].combine_chunks(), "j": j, "w": pa.ListArray.from_arrays(at, pa.array(tf[kept], pa.float64())), "norm": norm})


def _factors(docs: DataFrame, names: list[str], scale: np.ndarray, k: int, rounds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The updates of ``nmf`` over ``id, j, w, norm``: a document's weight of term j is w x scale[j] / norm."""
    spark = docs.sparkSession
    h = np.random.default_rng(seed).random((len(names), k)) + 0.1

    def solve(b: pa.RecordBatch, h: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of each entry of a batch, and the weights of its documents, all documents at once."""
        offsets = np.asarray(b.column(1).offsets) - b.column(1).offsets[0].as_py()
        j = b.column(1).flatten().to_numpy()
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        w = b.column(2).flatten().to_numpy() * scale[j] / b.column(3).to_numpy()[row]
        target = np.stack([np.bincount(row, w * h[j, c], minlength=b.num_rows) for c in range(h.shape[1])], axis=1)
        v = np.where(np.diff(offsets)[:, None] > 0, 0.5, 0.0) * np.ones((1, h.shape[1]))
        for _ in range(25):
            v *= target / np.maximum(v @ gram, 1e-12)
        return row, j, w, v

    for _ in range(rounds):
        gram = h.T @ h

        def sums(batches: Iterator[pa.RecordBatch], h=h, gram=gram) -> Iterator[pa.RecordBatch]:
            up, down = np.zeros_like(h), np.zeros((h.shape[1], h.shape[1]))
            for b in batches:
                row, j, w, v = solve(b, h, gram)
                for c in range(h.shape[1]):
                    up[:, c] += np.bincount(j, w * v[row, c], minlength=len(h))
                down += v.T @ v
            used = np.flatnonzero(up.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int32()), pa.array([*up[used].tolist(), down.ravel().tolist()], pa.list_(pa.float64()))], names=["j", "v"])

        parts = docs.mapInArrow(sums, "j int, v array<double>").select("j", F.posexplode("v").alias("p", "x")).groupBy("j", "p").agg(F.sum("x").alias("x"))
        up, down = np.zeros_like(h), np.zeros(k * k)
        got = parts.toArrow()  # terms x k numbers
        j, p, x = (got[c].to_numpy() for c in ("j", "p", "x"))
        down[p[j < 0]] = x[j < 0]
        up[j[j >= 0], p[j >= 0]] = x[j >= 0]
        h = h * up / np.maximum(h @ down.reshape(k, k), 1e-12)
    gram = h.T @ h

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = solve(b, h, gram)[3]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    own = docs.mapInArrow(final, "id bigint, v array<double>").select("id", F.posexplode("v").alias("topic", "weight"))
    words = spark.createDataFrame([(t, c, float(h[j, c])) for j, t in enumerate(names) for c in range(k)], "term string, topic int, weight double")
    return own, words


def topics_of(own: DataFrame, top: int = 3, share: float = 0.3) -> DataFrame:
    """Topics among a document's first ``top``, or near the topic's greatest weight."""
    best = own.groupBy("topic").agg(F.max("weight").alias("hi"))  # a row per topic
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "topic"))
    return own.join(F.broadcast(best), "topic").withColumn("r", r).where((F.col("r") <= top) | (F.col("weight") / F.col("hi") >= share)).select("id", "topic", "weight")


def class_distances(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``id, scores``: softmax of standardised distances to the class means, minus one half, by class in order."""
    e = rows.select(label, F.posexplode(vector).alias("p", "x")).groupBy(label, "p").agg(F.avg("x").alias("m"))
    means = e.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s.m).alias("mean"))
    all_means = means.agg(F.transform(F.array_sort(F.collect_list(F.struct(label, "mean"))), lambda s: s["mean"]).alias("means"))
    x = rows.select(id_col, vector).join(F.broadcast(all_means))  # one row: an array per class
    square = lambda m: F.sqrt(F.aggregate(F.zip_with(F.col(vector), m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    x = x.select(id_col, F.transform("means", square).alias("d"))
    n, total = F.size("d"), F.aggregate("d", F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("mu", total / n)
    x = x.withColumn("sd", F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu"))) / n))
    x = x.withColumn("e", F.transform("d", lambda v: F.exp((v - F.col("mu")) / F.greatest("sd", F.lit(1e-12)))))
    whole = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    return x.select(id_col, F.transform("e", lambda v: v / whole - 0.5).alias("scores"))


def pagerank(edges: DataFrame, alpha: float = 0.9, rounds: int = 20) -> DataFrame:
    """``node, rank`` of a weighted directed graph ``a, b, w``; nodes without edges out share theirs among all."""
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    n = nodes.count()
    out = edges.groupBy("a").agg(F.sum("w").alias("t"))
    links = cut(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("t")).alias("p")))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        moved = links.join(rank, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("in"))
        kept = moved.agg(F.coalesce(F.sum("in"), F.lit(0.0)).alias("kept"))  # one row
        rank = nodes.join(moved, "node", "left").join(F.broadcast(kept)).select("node", (alpha * (F.coalesce("in", F.lit(0.0)) + (1 - F.col("kept")) / n) + (1 - alpha) / n).alias("rank"))
        if k % 5 == 4:
            rank = cut(rank)
    return rank
