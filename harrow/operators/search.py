"""Inverted index with exact, phrase, wildcard and spelling-tolerant search.

The index is a table of distinct postings ``term, doc_id``: one- and two-word terms of all searched texts.  The
vocabulary is the aggregate ``term, df`` with the three-letter prefix that fuzzy and wildcard search are blocked on.
A query is a row of a table too, so any number of keywords is searched in one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, scratch, spread_scan
from .merging import near_pairs, sibilant_pairs

THRESHOLD = 0.85
KEYS = 100_000  # terms of queries that are sent to the tasks


@dataclass
class Index:
    """Postings and vocabulary of a collection."""

    postings: DataFrame
    vocabulary: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, columns: list[str], id_col: str = "id", path: str | None = None) -> Index:
        """Index the texts of ``columns`` together; terms never span two of them.

        Postings and vocabulary are written tables, by default in the shared folder: searches read them and neither
        tokenise nor count again.
        """
        words = spread_scan(docs.select(id_col, *(c for c in columns if c != id_col))).select(F.col(id_col).alias("doc_id"), *(T.token_list(c).alias(f"w{k}") for k, c in enumerate(columns)))
        terms = [x for k in range(len(columns)) for x in (F.col(f"w{k}"), T.bigrams(F.col(f"w{k}")))]
        path = path or scratch(docs.sparkSession, "index")
        words.select("doc_id", F.explode(F.array_distinct(F.concat(*terms))).alias("term")).write.parquet(f"{path}/postings")
        vocabulary = docs.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
        vocabulary = vocabulary.withColumn("prefix", F.substring("term", 1, 3)).withColumn("n_words", F.size(F.split("term", " ")))
        vocabulary.write.parquet(f"{path}/vocabulary")
        return cls.load(docs.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        kinds = "term string, df bigint, prefix string, n_words int"
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.schema(kinds).parquet(f"{path}/vocabulary"))

    def lookup(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id")

    def wildcard(self, pattern: str) -> DataFrame:
        """Single words that match a pattern with ``*``; the prefix before it prunes the vocabulary."""
        head = pattern.split("*")[0][:3]
        words = self.vocabulary.where("n_words = 1")
        if head:
            words = words.where(F.col("term").startswith(head))
        regex = "^" + "[A-Za-z0-9_]*".join(pattern.split("*")) + "$"
        return words.where(F.col("term").rlike(regex)).select("term")

    def fuzzy(self, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """``word, term``: indexed words like each ``word``: itself, spellings at least ``threshold`` similar that are
        less than four times as frequent, and s/z variants."""
        v = self.vocabulary.where("n_words = 1").select("term", "df", "prefix")
        words = words.select("word").distinct()
        a, b = words.select(F.col("word").alias("item")), v.select(F.col("term").alias("other"))
        forth = near_pairs(a, b, threshold).toDF("word", "term")
        back = near_pairs(v.select(F.col("term").alias("item")), words.select(F.col("word").alias("other")), threshold).toDF("term", "word").select("word", "term")
        alike = forth.unionAll(back).distinct().where((T.similarity("word", "term") >= threshold) & (F.length("word") >= 3))
        alike = alike.where(F.substring("word", 1, 3) == F.substring("term", 1, 3)).join(v.select("term", "df"), "term")
        own = v.select(F.col("term").alias("word"), F.col("df").alias("own"))
        alike = alike.join(own, "word", "left").where(F.col("own").isNull() | (F.col("df") < 4 * F.col("own"))).select("word", "term")
        same = words.join(own, "word").select("word", F.col("word").alias("term"))
        return same.unionAll(alike).unionAll(sibilant_pairs(words.where("length(word) >= 3").toDF("item"), v.select(F.col("term").alias("other")))).distinct()

    def search(self, queries: DataFrame, threshold: float | None = None) -> DataFrame:
        """``query, doc_id`` of all texts that hold a query: one or two words as a term, more as all their pairs.

        ``queries``: a column ``query``.  With a threshold, single words also find their spelling variants.
        """
        keyed = query_terms(queries)
        if threshold is not None:
            single = keyed.where("n_terms = 1 and not contains(term, ' ')")
            variants = self.fuzzy(single.select(F.col("term").alias("word")).distinct(), threshold)
            spread = single.join(variants.withColumnRenamed("term", "variant"), F.col("term") == F.col("word"))
            spread = spread.select("query", F.col("variant").alias("term"), "n_terms")
            keyed = keyed.where("n_terms > 1 or contains(term, ' ')").unionAll(spread)
        keyed = cut(keyed)
        few = keyed.count() <= KEYS  # then no posting is moved
        hits = self.postings.join(F.broadcast(keyed) if few else keyed, "term")
        one = hits.where("n_terms = 1").select("query", "doc_id").distinct()
        many = hits.where("n_terms > 1").groupBy("query", "doc_id", "n_terms").agg(F.count_distinct("term").alias("n"))
        return one.unionAll(many.where("n = n_terms").select("query", "doc_id"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query, term, n_terms``: the index keys of each query; an empty query has none."""
    queries = queries.select("query").distinct().select("query", T.token_list("query").alias("w"))
    words = F.col("w")
    terms = F.when(F.size(words) > 2, F.array_distinct(T.bigrams(words))).when(
        F.size(words) > 0, F.array(F.array_join(words, " "))
    ).otherwise(F.array().cast("array<string>"))
    return queries.select("query", F.explode(terms).alias("term"), F.size(terms).alias("n_terms"))


def exclusion(found: DataFrame, wanted: str, unwanted: str) -> DataFrame:
    """Documents of one query without those of another ("a - b")."""
    a = found.where(F.col("query") == wanted).select("doc_id")
    return a.join(found.where(F.col("query") == unwanted).select("doc_id"), "doc_id", "left_anti")


def dictionary_label(index: Index, dictionary: DataFrame, threshold: float | None = None, hierarchy: bool = False) -> DataFrame:
    """``doc_id, labels, details``: labels of a dictionary ``keyword, label`` whose keywords a text holds.

    With ``hierarchy``, ``label/`` and ``label/keyword`` instead of the label alone.
    """
    found = index.search(dictionary.select(F.col("keyword").alias("query")), threshold)
    hits = found.join(dictionary.select(F.col("keyword").alias("query"), "label").distinct(), "query")
    label = F.array(F.concat("label", F.lit("/")), F.concat_ws("/", "label", "query")) if hierarchy else F.array("label")
    return hits.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(label)))).alias("labels"),
        F.array_sort(F.collect_set("query")).alias("details"),
    )


def taxonomy_label(index: Index, taxonomy: DataFrame) -> DataFrame:
    """``doc_id, values, broad, details`` from a taxonomy ``narrow, broad``: a key of either level labels the text."""
    keys = taxonomy.select(F.col("narrow").alias("key"), F.concat_ws("/", "broad", "narrow").alias("value"), "broad")
    keys = keys.unionAll(taxonomy.select(F.col("broad").alias("key"), F.concat("broad", F.lit("/")).alias("value"), "broad").distinct())
    found = index.search(keys.select(F.col("key").alias("query")))
    hits = found.join(keys.withColumnRenamed("key", "query"), "query")
    return hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("value")).alias("values"),
        F.array_sort(F.collect_set("broad")).alias("broad"),
        F.array_sort(F.collect_set("query")).alias("details"),
    )


def population_tags(df: DataFrame, text: str, id_col: str = "id", distance: int = 5) -> DataFrame:
    """``id, tag``: small-scale farmers by name or by nearness of a small-scale word to a farm word, else farmers."""
    words = T.normal_words(text)

    def positions(which: list[str]) -> Column:
        return F.filter(F.transform("w", lambda w, i: F.when(w.isin(*which), i)), lambda i: i.isNotNull())

    rows = spread_scan(df.select(id_col, text)).select(id_col, words.alias("w")).withColumn("text", F.array_join("w", " "))
    small, farm = positions(["small", "subsistence", "marginal"]), positions(["farm", "farms", "farmer", "farmers", "plot", "plots"])
    near = F.exists(small, lambda i: F.exists(farm, lambda j: F.abs(i - j) <= distance))
    named = F.col("text").rlike("(^| )small ?holders?( |$)")
    tag = F.when(named | near, "Small scale farmers").when(F.col("text").rlike("(^| )farmers?( |$)"), "Farmers")
    return rows.select(id_col, tag.alias("tag")).where("tag is not null")


def keyword_labels(index: Index, rules: list[tuple[str, str]], default: str = "No category") -> DataFrame:
    """``doc_id, label, priority`` from ordered rules (keyword or "keyword - excluded", label)."""
    spark = index.postings.sparkSession
    parsed = [(k, *(x.strip() for x in (rule.split(" - ") + [""])[:2]), label) for k, (rule, label) in enumerate(rules) if label]
    table = spark.createDataFrame(parsed, "priority int, wanted string, unwanted string, label string")
    queries = table.select(F.col("wanted").alias("query")).unionAll(table.where("unwanted <> ''").select("unwanted"))
    found = index.search(queries)
    hit = found.join(table.withColumnRenamed("wanted", "query"), "query").select("doc_id", "priority", "label", "unwanted")
    bad = found.select("doc_id", F.col("query").alias("unwanted"))
    return hit.join(bad, ["doc_id", "unwanted"], "left_anti").select("doc_id", "label", "priority").distinct()
