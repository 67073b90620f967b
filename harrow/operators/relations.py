"""Term relations from text patterns, their statistics, and corpus-driven word repair."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, spread_scan

# fixed values: cues that stand after the general term and before the special ones
GENERAL_FIRST = (
    "such as", "including", "especially", "like", "for example", "mainly", "mostly", "notably", "particularly", "principally",
    "in particular", "except", "other than", r"e\.g\.", r"i\.e\.", "which is similar to", "which are similar to",
    "examples of this is", "examples of this are", "types", "compared to", "among them",
)
# fixed values: cues that stand after the special terms and before the general one
SPECIAL_FIRST = (
    "any other", "some other", "like other", "other", "is an? example of", "is example of", "are examples of", "which is called", "which is named",
    "which looks like", "which sounds like", "(?:is |was )?an? (?:kind|form|type|sort) of", "(?:is |are |were |was )?(?:kinds?|forms?|types?|sorts?) of",
    "is", "are", "was", "were",
)
BASIC = ("such as", "including", "especially")
COMPARISON = ("of", "between", "to", "with", "among")
# fixed values: words that end a noun phrase, and words that only begin one
BETWEEN = (
    "of in on at by from to with without for as than that which who where when while after before during since until under over into "
    "between among about because if but not nor so then there here also however they we it he she i you has have had be been being "
    "do does did can could may might must should would will explained reported measured used showed found rose fell grew remained using"
).split()
ARTICLES = "a an the this these those their its our his her some any all each most many several both".split()
MOST_WORDS = 4  # of a term
FIXES = 500_000  # words to be put right that are sent to the tasks
_LETTERS = re.compile("[A-Za-z]+")

Step = tuple[str, str]


def steps(extended: bool = True, comparison: bool = False) -> list[Step]:
    """Replacements (pattern, by what) that turn a lower-case text into terms, commas, cues ``<1>`` and ``<2>`` and bars.

    The same regular expressions are understood by the JVM and by RE2, so another engine can state the rule with them.
    """
    first = GENERAL_FIRST if extended else BASIC
    out = [(r"[0-9]+", "|"), (r"\s+", " ")]
    if comparison:
        return [*out, (r"\bcomparisons? (?:" + "|".join(COMPARISON) + r") ", " compared <1> "), *_rest()]
    out += [
        (r"\bsuch ([a-z -]+?),? as ", "$1 <1> "),
        (r"\bexamples of ([a-z -]+?),? (?:is|are) ", "$1 <1> "),
        (r"\bcompare ([a-z ,-]+?) with ", "$1 <2> "),
        (r"\b(?:" + "|".join(sorted(first, key=len, reverse=True)) + r")( |$)", " <1> "),
    ]
    if extended:
        out.append((r"\b(?:and |or )?(?:" + "|".join(SPECIAL_FIRST) + r")( |$)", " <2> "))
    return out + _rest()


def _rest() -> list[Step]:
    return [
        (r"\b(?:and|or)\b", ","),
        (r"\b(?:" + "|".join(ARTICLES) + r")\b", " "),
        (r"\b(?:" + "|".join(BETWEEN) + r")\b", "|"),
        (r"[^a-z ,<>12|-]+", "|"),
        (r"\s*,[\s,]*", ","),
        (r" +", " "),
    ]


FIRST_FOUND = r"([a-z -]+),? ?<1>[ ,]?([a-z ,-]+)"
LAST_FOUND = r"([a-z ,-]+)<2> ?([a-z -]+)"


def hearst(docs: DataFrame, id_col: str, text: str, extended: bool = True, comparison: bool = False) -> DataFrame:
    """``id_col, general, special`` of every pattern found: noun phrases on either side of a cue.

    A noun phrase is what stands between cues, commas, "and" and "or", and words that end one (prepositions, pronouns,
    verbs); articles don't count.  Terms have at most ``MOST_WORDS`` words.  ``comparison``: what is compared with each
    other ("comparison of a and b"), all under the general term "compared".
    """
    marked = F.lower(F.col(text))
    for pattern, by in steps(extended, comparison):
        marked = F.regexp_replace(marked, pattern, by)
    docs = spread_scan(docs.select(id_col, text)).select(id_col, marked.alias("t"))
    first = docs.select(id_col, F.explode(F.regexp_extract_all("t", F.lit(FIRST_FOUND), F.lit(0))).alias("m"))
    first = first.select(id_col, F.regexp_extract("m", FIRST_FOUND, 1).alias("general"), F.regexp_extract("m", FIRST_FOUND, 2).alias("l"))
    last = docs.select(id_col, F.explode(F.regexp_extract_all("t", F.lit(LAST_FOUND), F.lit(0))).alias("m"))
    last = last.select(id_col, F.regexp_extract("m", LAST_FOUND, 2).alias("general"), F.regexp_extract("m", LAST_FOUND, 1).alias("l"))
    both = first.unionAll(last).select(id_col, F.trim("general").alias("general"), F.explode(F.split("l", ",")).alias("special"))
    both = both.select(id_col, "general", F.trim("special").alias("special"))
    short = lambda c: F.size(F.split(c, " ")) <= MOST_WORDS
    return both.where((F.length("special") > 1) & (F.length("general") > 1) & (F.col("special") != F.col("general")) & short("special") & short("general"))


def hearst_sql(table: str = "articles_df", id_col: str = "id", text: str = "abstract", extended: bool = True, comparison: bool = False) -> str:
    """The same as a common table expression ``rel`` (id, general, special)."""
    quoted = lambda x: x.replace("'", "''")
    marked = f"lower({text})"
    for pattern, by in steps(extended, comparison):
        marked = f"regexp_replace({marked}, '{quoted(pattern)}', '{by.replace('$', chr(92))}', 'g')"
    short = lambda c: f"length(string_split({c}, ' ')) <= {MOST_WORDS} AND length({c}) > 1"
    return f"""marked AS (SELECT {id_col} AS id, {marked} AS t FROM {table}),
found AS (SELECT id, regexp_extract(m, '{FIRST_FOUND}', 1) AS general, regexp_extract(m, '{FIRST_FOUND}', 2) AS l FROM (SELECT id, unnest(regexp_extract_all(t, '{FIRST_FOUND}')) AS m FROM marked)
  UNION ALL SELECT id, regexp_extract(m, '{LAST_FOUND}', 2), regexp_extract(m, '{LAST_FOUND}', 1) FROM (SELECT id, unnest(regexp_extract_all(t, '{LAST_FOUND}')) AS m FROM marked)),
each_of AS (SELECT id, trim(general) AS general, trim(unnest(string_split(l, ','))) AS special FROM found),
rel AS (SELECT * FROM each_of WHERE special <> general AND {short('special')} AND {short('general')})"""


def pair_counts(relations: DataFrame, id_col: str) -> DataFrame:
    """``general, special, n, n_docs``."""
    return relations.groupBy("general", "special").agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("n_docs"))


def edges(relations: DataFrame, id_col: str) -> DataFrame:
    """``source, target, type, weight``: relation edges, and edges from each term to its last word."""
    rel = relations.groupBy(F.col("special").alias("source"), F.col("general").alias("target")).agg(F.count_distinct(id_col).alias("weight"))
    rel = rel.select("source", "target", F.lit("relation").alias("type"), "weight")
    head = relations.where("contains(special, ' ')").groupBy(F.col("special").alias("source")).agg(F.count_distinct(id_col).alias("weight"))
    head = head.select("source", F.element_at(F.split("source", " "), -1).alias("target"), F.lit("last word").alias("type"), "weight")
    return rel.unionAll(head)


def word_df(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``w, df`` of words as they are written."""
    words = F.array_distinct(F.split(F.regexp_replace(T.unaccent(text), "[^A-Za-z]+", " "), " "))
    return docs.where(F.col(text).isNotNull()).select(id_col, F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("df"))


def upper_to_lower(freq: DataFrame) -> DataFrame:
    """``w, low`` of capital words whose lower form is more than three times as frequent."""
    up = freq.where("w = upper(w) and length(w) > 1").select("w", F.lower("w").alias("low"), "df")
    low = freq.select(F.col("w").alias("low"), F.col("df").alias("df_low"))
    return up.join(low, "low").where("low <> w and df_low > 3 * df").select("w", "low")


def glued(freq: DataFrame, rare: int = 5, often: int = 70) -> DataFrame:
    """``w, fixed`` of rare words that are a stop word and a frequent word run together."""
    stop = freq.sparkSession.createDataFrame([(s,) for s in T.STOP_WORDS if len(s) > 1], "stop string")
    low = freq.where("w = lower(w)")
    rare_words = low.where(F.col("df") <= rare).select("w")
    common = low.where((F.col("df") > often) & (F.length("w") > 3)).select(F.col("w").alias("rest"))
    cuts = rare_words.select("w", F.explode(F.sequence(F.lit(2), F.greatest(F.length("w") - 2, F.lit(2)))).alias("k"))
    cuts = cuts.select("w", F.expr("substring(w, 1, k)").alias("a"), F.expr("substring(w, k + 1)").alias("b"))
    front = cuts.join(F.broadcast(stop), F.col("a") == F.col("stop")).select("w", "a", "b", F.col("b").alias("rest"))
    back = cuts.join(F.broadcast(stop), F.col("b") == F.col("stop")).select("w", "a", "b", F.col("a").alias("rest"))
    return front.unionAll(back).join(common, "rest").select("w", F.concat_ws(" ", "a", "b").alias("fixed")).distinct()


def mended(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``df`` with the words of ``text`` that the collection shows to be capitals of small words, or two words run together, put right.

    The words to be put right are counted; up to ``FIXES`` go to the tasks, and no word of a text is moved.
    """
    freq = cut(word_df(df.select(id_col, text), id_col, text))
    fixes = upper_to_lower(freq).toDF("w", "fixed").unionAll(glued(freq).groupBy("w").agg(F.min("fixed").alias("fixed")))
    fixes = cut(fixes.groupBy("w").agg(F.min("fixed").alias("fixed")))
    if fixes.count() > FIXES:
        return _mended_by_join(df, fixes, id_col, text)
    known = df.sparkSession.sparkContext.broadcast({r["w"]: r["fixed"] for r in fixes.collect()})
    at, schema = df.columns.index(text), df.schema

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = known.value
        fix = lambda m: found.get(m[0], m[0])
        for b in batches:
            texts = [t and _LETTERS.sub(fix, t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(put, schema)


def _mended_by_join(df: DataFrame, fixes: DataFrame, id_col: str, text: str) -> DataFrame:
    """The same for any number of words, by a row for each word of each text."""
    each = df.where(F.col(text).isNotNull()).select(id_col, F.posexplode(F.split(text, r"(?<=[A-Za-z])(?![A-Za-z])|(?<![A-Za-z])(?=[A-Za-z])")).alias("at", "w"))
    hit = each.join(fixes, "w").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "fixed"))).alias("_fix"))
    parts = F.split(text, r"(?<=[A-Za-z])(?![A-Za-z])|(?<![A-Za-z])(?=[A-Za-z])")
    put = F.array_join(F.transform(parts, lambda w, i: F.coalesce(F.try_element_at("_fix", i), w)), "")
    return df.join(hit, id_col, "left").withColumn(text, F.when(F.col("_fix").isNotNull(), put).otherwise(F.col(text))).drop("_fix")
