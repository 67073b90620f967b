"""Labels from dictionaries, patterns and numbers: interventions, measurements, programmes, compared terms, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread_scan
from . import relations, search

# fixed values: last words that don't change what an intervention is
EXTENSIONS = (
    "action algorithm approach concept definition developing development effort framework facility implementation initiative "
    "instrument intervention infrastructure measure method methodology model option outcome paradigm perspective policy principle "
    "procedure program project scheme service strategy targeting technique theory tool programme"
).split()
# fixed values: words that a programme's name ends in
PROGRAMME = "Program Programme Project Initiative Scheme Trust".split()
NUMBER = r"\b\d+[\w.,]*\d*\b"


def joined(df: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """``id_col, text``: the columns of a row as one text."""
    return df.select(id_col, F.concat_ws(". ", *(F.coalesce(c, F.lit("")) for c in columns)).alias("text"))


def compared_terms(df: DataFrame, columns: list[str], id_col: str = "id", out: str = "compared") -> DataFrame:
    """``id_col, out``: the terms that a text compares with each other, in order; texts that compare nothing have no row.

    "compared A and B for their effect" is read as a comparison of A and B.
    """
    low = F.lower(F.regexp_replace("text", r"\s+", " "))
    low = F.regexp_replace(low, "compared ([a-z -]+) and ([a-z -]+) for their effect", "comparison of $1 and $2 with")
    found = relations.hearst(joined(df, columns, id_col).select(id_col, low.alias("text")), id_col, "text", comparison=True)
    return found.where("general = 'compared'").groupBy(id_col).agg(F.array_sort(F.collect_set("special")).alias(out))


def families(taxonomy: DataFrame) -> DataFrame:
    """``concept, name, raw``: what a concept of the taxonomy is called in the labels.

    Concepts that differ in their last word only, all of these being ``EXTENSIONS``, are one: "<first words> intervention".
    Others are themselves.
    """
    c = taxonomy.select(F.regexp_replace("concept", r"\bprogramme\b", "program").alias("concept")).distinct()
    words = F.split("concept", " ")
    c = c.select("concept", F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("first"), F.element_at(words, -1).alias("last"))
    open_ = c.where("first <> ''").groupBy("first").agg(F.bool_and(F.col("last").isin(*EXTENSIONS)).alias("all"))
    c = c.join(open_, "first", "left")
    family = F.coalesce("all", F.lit(False))
    return c.select(
        "concept", F.when(family, F.concat("first", F.lit(" intervention"))).otherwise(F.col("concept")).alias("name"), F.when(family, F.col("first")).otherwise(F.col("concept")).alias("raw")
    )


def interventions(index: search.Index, taxonomy: DataFrame, threshold: float | None = None) -> DataFrame:
    """``doc_id, classes, raw, found`` from a taxonomy ``concept, class, middle`` (a list; empty: none).

    ``found`` holds ``class/name`` or ``class/middle/name`` and, for a middle layer other than "other", ``class/middle/``.
    """
    t = taxonomy.select(F.regexp_replace("concept", r"\bprogramme\b", "program").alias("concept"), "class", "middle")
    t = t.join(families(taxonomy), "concept")
    hits = index.search(t.select(F.col("concept").alias("query")), threshold).join(t.withColumnRenamed("concept", "query"), "query")
    middle = F.when(F.size("middle") > 0, F.col("middle")).otherwise(F.array(F.lit("")))
    hits = hits.select("doc_id", "class", "name", "raw", F.explode(middle).alias("m"))
    path = F.when(F.col("m") == "", F.concat_ws("/", "class", "name")).otherwise(F.concat_ws("/", "class", "m", "name"))
    layer = F.when(~F.col("m").isin("", "other"), F.concat(F.col("class"), F.lit("/"), F.col("m"), F.lit("/")))
    return hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("class")).alias("classes"),
        F.array_sort(F.collect_set("raw")).alias("raw"),
        F.array_sort(F.array_union(F.collect_set(path), F.collect_set(layer))).alias("found"),
    )


def measurements(df: DataFrame, columns: list[str], terms: str, id_col: str = "id") -> DataFrame:
    """``id_col, number, term``: each number of a sentence with the term of the row's list nearest to it.

    ``terms``: an array column; a term counts where the sentence, in small letters, holds it as words.  Distances are in
    words; of equal ones the earlier term, then the smaller string wins.  Sentences without one of the terms give none.
    """
    rows = df.select(id_col, F.col(terms).alias("terms"), F.concat_ws(". ", *(F.coalesce(c, F.lit("")) for c in columns)).alias("text"))
    rows = spread_scan(rows.where("size(terms) > 0"))
    s = rows.select(id_col, "terms", F.explode(T.split_sentences("text")).alias("s"))
    s = s.select(id_col, "terms", F.split(F.trim(F.regexp_replace(F.lower("s"), r"[^\w.,%-]+", " ")), " ").alias("w"))
    n = F.filter(F.transform("w", lambda w, i: F.when(w.rlike(NUMBER), F.struct(i.alias("p"), F.regexp_extract(w, NUMBER, 0).alias("x")))), lambda x: x.isNotNull())
    bare = F.transform("w", lambda w: F.regexp_replace(w, r"[.,]+$", ""))
    s = s.select(id_col, "terms", bare.alias("w"), n.alias("n")).where("size(n) > 0")

    def places(t: Column) -> Column:
        words = F.split(F.lower(t), " ")
        at = F.transform("w", lambda w, i: F.when(F.slice("w", i + 1, F.size(words)) == words, F.struct(i.alias("p"), F.lower(t).alias("t"))))
        return F.filter(at, lambda x: x.isNotNull())

    s = s.withColumn("c", F.flatten(F.transform("terms", places))).where("size(c) > 0")
    s = s.select(id_col, "c", F.explode("n").alias("n"))
    near = F.array_min(F.transform("c", lambda x: F.struct(F.abs(x.p - F.col("n.p")).alias("d"), x.p.alias("p"), x.t.alias("t"))))
    return s.select(id_col, F.col("n.x").alias("number"), near.t.alias("term"))


def programmes(df: DataFrame, columns: list[str], id_col: str = "id", ends: list[str] = PROGRAMME) -> DataFrame:
    """``id_col, programme``: runs of capitalised words that end in a word for a programme; two words at least."""
    pattern = r"((?:[A-Z][A-Za-z&-]+ (?:(?:of|for|and|the) )*)+(?:" + "|".join(ends) + r"))\b"
    found = joined(df, columns, id_col).select(id_col, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("programme"))
    return found.select(id_col, F.regexp_replace("programme", "^(?:The|A|An|In|Under) ", "").alias("programme")).where("contains(programme, ' ')").distinct()


def sentence_labels(df: DataFrame, columns: list[str], words: dict[str, list[str]], id_col: str = "id") -> DataFrame:
    """``id_col, s, label``: sentences with a label for each list of words they hold one of; the plainest predictor."""
    own = F.split(F.regexp_replace(F.lower("s"), "[^a-z]+", " "), " ")
    label = F.array_compact(F.array(*(F.when(F.arrays_overlap(own, F.array(*map(F.lit, ws))), k) for k, ws in words.items())))
    s = spread_scan(joined(df, columns, id_col)).select(id_col, F.explode(T.split_sentences("text")).alias("s"))
    return s.select(id_col, "s", F.explode(label).alias("label"))


def united(labelled: DataFrame, id_col: str = "id") -> DataFrame:
    """``id_col, labels, details``: labels of a text's sentences united, with the sentences that gave them."""
    detail = F.concat(F.lit("["), "label", F.lit("]"), "s")
    return labelled.groupBy(id_col).agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set(detail)).alias("details"))


def by_majority(votes: DataFrame, keys: list[str], label: str, share: float = 0.5) -> DataFrame:
    """``keys, majority, all_labels, agreed``: of several labels for one thing the most frequent (ties: the smaller),
    all of them, and whether the first has more than ``share`` of the votes."""
    c = votes.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(
        F.min(F.struct(-F.col("n"), F.col(label).alias("l"))).alias("b"), F.array_sort(F.collect_set(label)).alias("all_labels"), F.max("n").alias("n"), F.sum("n").alias("whole")
    ).select(*keys, F.col("b.l").alias("majority"), "all_labels", (F.col("n") > F.col("whole") * share).alias("agreed"))


def meanings_in(docs: DataFrame, text: str, dictionary: DataFrame, id_col: str = "id") -> DataFrame:
    """``id_col, w, hits``: words of each text and the dictionary's meanings in them as structs (at, size, abbr, meaning).

    ``dictionary``: ``abbr, meaning`` (in small letters).  Every run of words as long as a meaning may be is joined with
    the meanings, so that the dictionary may be of any size.  Longer ones go first, then earlier ones; no two overlap.
    """
    d = dictionary.groupBy("meaning").agg(F.min("abbr").alias("abbr")).withColumn("size", F.size(F.split("meaning", " ")))
    most = d.agg(F.max("size")).first()[0] or 0
    docs = spread_scan(docs.select(id_col, F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ").alias("w")))
    bare = F.transform("w", lambda w: F.regexp_replace(F.lower(w), r"^\W+|[\W]+$", ""))
    runs = docs.select(id_col, bare.alias("b")).select(id_col, "b", F.posexplode("b").alias("at", "_x"))
    runs = runs.select(id_col, "at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, most))), lambda k: F.array_join(F.slice("b", F.col("at") + 1, k), " "))).alias("meaning"))
    hits = runs.distinct().join(d, "meaning").groupBy(id_col).agg(F.collect_list(F.struct((-F.col("size")).alias("neg"), "at", "size", "abbr", "meaning")).alias("h"))
    kind = "array<struct<at:int,size:int,abbr:string,meaning:string>>"
    free = lambda acc, x: ~F.exists(acc, lambda y: (x.at < y.at + y["size"]) & (y.at < x.at + x["size"]))
    kept = F.aggregate(
        F.array_sort("h"), F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x.at.alias("at"), x["size"].alias("size"), x.abbr.alias("abbr"), x.meaning.alias("meaning"))))).otherwise(acc)
    )
    return docs.join(hits, id_col, "left").select(id_col, "w", F.when(F.col("h").isNotNull(), kept).otherwise(F.array().cast(kind)).alias("hits"))


def replaced_meanings(found: DataFrame, id_col: str = "id") -> DataFrame:
    """``id_col, text``: every meaning followed by its abbreviation in brackets."""
    after = F.map_from_entries(F.transform("hits", lambda h: F.struct((h.at + h["size"] - 1).alias("k"), h.abbr.alias("v"))))
    f = found.withColumn("after", after)
    put = F.transform("w", lambda w, i: F.when(F.map_contains_key("after", i), F.concat(w, F.lit(" ("), F.try_element_at("after", i), F.lit(")"))).otherwise(w))
    return f.select(id_col, F.array_join(put, " ").alias("text"))


# fixed values: verbs of storing and closing, and words for what holds grain
STORING = "store stored stores storing seal sealed sealing reuse reused immerse immersed prevent prevented prevents keep kept".split()
CONTAINERS = "bag bags silo silos bin bins jar jars sack sacks drum drums granary granaries".split()


def storage(df: DataFrame, columns: list[str], names: list[str], id_col: str = "id", reach: int = 8) -> DataFrame:
    """``id_col, verb, argument``: what a verb of storing says of a container at most ``reach`` words behind it.

    The argument runs from the verb to the container, without stop words, words with digits and the ``names`` (places,
    crops), in order; of several containers behind a verb the first counts.
    """
    s = spread_scan(joined(df, columns, id_col)).select(id_col, F.explode(T.split_sentences("text")).alias("s"))
    s = s.select(id_col, F.split(F.trim(F.regexp_replace(F.lower("s"), "[^a-z0-9]+", " ")), " ").alias("w"))
    at = lambda words: F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(*words), i)))
    s = s.select(id_col, "w", F.explode(at(STORING)).alias("v"), at(CONTAINERS).alias("cs"))
    s = s.withColumn("c", F.array_min(F.filter("cs", lambda c: (c > F.col("v")) & (c - F.col("v") <= reach)))).where("c is not null")
    between = F.slice("w", F.col("v") + 2, F.col("c") - F.col("v"))
    kept = F.filter(between, lambda w: ~w.isin(*T.STOP_WORDS, *names) & ~w.rlike("[0-9]"))
    return s.select(id_col, F.element_at("w", F.col("v") + 1).alias("verb"), F.array_join(kept, " ").alias("argument"))


def contexts(df: DataFrame, text: str, terms: list[str], id_col: str = "id") -> DataFrame:
    """``id_col, term, context``: the text once for each term it holds as a word, in small letters, without the others."""
    low = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), F.lit(" "))
    whole = r"(^|[^a-z])({})(?=[^a-z]|$)"
    held = F.array_compact(F.array(*(F.when(low.rlike(whole.format(t)), F.lit(t)) for t in terms)))
    rows = df.select(id_col, low.alias("t"), F.explode(held).alias("term"))
    out = F.lit(None).cast("string")
    for t in terms:
        others = "|".join(x for x in terms if x != t)
        out = F.when(F.col("term") == t, F.regexp_replace("t", whole.format(others), "$1") if others else F.col("t")).otherwise(out)
    return rows.select(id_col, "term", F.trim(F.regexp_replace(out, " +", " ")).alias("context"))


def derived_taxonomy(concepts: DataFrame, keywords: list[str], generic: list[str], abstract: list[str], least: float = 0.3) -> DataFrame:
    """``concept, name, middle``: concepts without leading ``abstract`` words, generic ones left out, each under the most
    similar keyword of the middle layer (ties: the smaller), or "other" below ``least``."""
    name = F.col("concept")
    head = r"^(?:(?:" + "|".join(abstract) + r") (?:of )?)+"
    c = concepts.select("concept", F.regexp_replace(name, head, "").alias("name")).where(~F.col("name").isin(*generic) & (F.col("name") != ""))
    best = F.array_min(F.array(*(F.struct((-T.similarity("name", F.lit(k))).alias("s"), F.lit(k).alias("k")) for k in keywords)))
    return c.select("concept", "name", F.when(best.s <= -least, best.k).otherwise("other").alias("middle"))


def any_match(df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """``text, labels...``: one row for each text (small letters, trimmed); a 0/1 label is 1 if any row of the text has it."""
    key = F.lower(F.trim(text)).alias("text")
    return df.where(F.col(text).isNotNull()).select(key, *labels).groupBy("text").agg(*(F.max(F.coalesce(F.col(c), F.lit(0))).cast("int").alias(c) for c in labels))
