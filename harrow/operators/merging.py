"""Greedy merging of similar names without a loop over them, connected groups, abbreviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


def roots(parents: DataFrame) -> DataFrame:
    """``item, root`` from ``item, parent`` links that rise in rank, by pointer doubling (log-many joins)."""
    links = cut(parents.select("item", F.col("parent").alias("root")))
    while True:
        up = links.select(F.col("item").alias("root"), F.col("root").alias("next"))
        stepped = cut(links.join(up, "root", "left").select("item", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = stepped.select("item", "root")
        if stepped.where("moved").isEmpty():
            return links


def near_pairs(longer: DataFrame, shorter: DataFrame, threshold: float) -> DataFrame:
    """``item, other``: candidates for a similarity of ``threshold`` or more of distinct strings, exactly all of them.

    ``longer`` holds ``item``, ``shorter`` ``other``, which is of the same length or less.  Two strings within d edits,
    d being what the threshold allows for the longer, share at least one of d + 1 segments of the shorter, moved by d
    places at most; so pairs are joined on segments, which are far rarer than first letters, and no bucket is compared
    with itself.
    """
    left = 1 - threshold + 1e-9
    edits = lambda n: F.floor(n * F.lit(left)).cast("int")
    n = F.col("l")
    begin = F.floor(F.col("i") * n / (F.col("d") + 1)).cast("int")
    size = F.floor((F.col("i") + 1) * n / (F.col("d") + 1)).cast("int") - begin
    every = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(a, b)))
    index = shorter.select("other", F.length("other").alias("l")).where("l > 0")
    index = every(index, edits(n), edits(F.floor(n / F.lit(threshold - 1e-9))), "d")
    index = every(index, F.lit(0), F.col("d"), "i").select("other", "l", "d", "i", F.substring("other", begin + 1, size).alias("seg"))
    probe = longer.select("item", F.length("item").alias("n")).where("n > 0").withColumn("d", edits(F.col("n")))
    probe = every(probe, F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(threshold - 1e-9)).cast("int")), F.col("n"), "l")
    probe = every(probe, F.lit(0), F.col("d"), "i")
    at = F.greatest(F.lit(0), begin - F.col("d")), F.least(F.col("n") - size, begin + F.col("d"))
    probe = probe.withColumn("p", F.explode(F.when(at[0] <= at[1], F.sequence(*at)).otherwise(F.array().cast("array<int>"))))
    probe = probe.select("item", "l", "d", "i", F.substring("item", F.col("p") + 1, size).alias("seg")).distinct()
    return probe.join(index, ["l", "d", "i", "seg"]).select("item", "other").distinct()


def similar_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """``item, other`` of different strings of column ``item`` whose edit similarity is ``threshold`` or more, both ways."""
    x = items.select("item").distinct()
    found = near_pairs(x, x.withColumnRenamed("item", "other"), threshold).where("item <> other")
    found = cut(found.where(T.similarity("item", "other") >= threshold))
    return found.unionAll(found.select(F.col("other").alias("item"), F.col("item").alias("other"))).distinct()


def sibilant_pairs(items: DataFrame, others: DataFrame) -> DataFrame:
    """``item, other``: words that differ in one s or z after the second letter; the key is the word with a gap there."""

    def keys(c: str) -> Column:
        part = lambda i, n: F.substring(F.col(c), i, n)
        gap = lambda i: F.concat(part(F.lit(1), i - 1), F.lit("_"), part(i + 1, F.length(c)))
        places = F.sequence(F.lit(3), F.greatest(F.length(c), F.lit(3)))
        return F.explode(F.array_compact(F.transform(places, lambda i: F.when(part(i, F.lit(1)).isin("s", "z"), gap(i))))).alias("key")

    a, b = items.select("item", keys("item")), others.select("other", keys("other"))
    return a.join(b, "key").where((F.col("item") != F.col("other")) & T.zs_variant("item", "other")).select("item", "other")


def merge_similar(items: DataFrame, threshold: float, block: int = 5, keep: str = "last", group: str | None = None) -> DataFrame:
    """``item, root``: items (``item, weight``) joined to a similar one of greater weight in their prefix block.

    Of several, the parent is the last (lightest) or the first (heaviest) of them, as ``keep`` says; items that stay by
    themselves are their own root.  Similar are those of one prefix of ``block`` letters; they are found by segments.
    With ``group``, a string column of ``items``, only items of one group are joined, and the result has that column too.
    """
    own = F.lit("") if group is None else F.coalesce(group, F.lit(""))
    x = items.where("item is not null and item <> ''").select("item", "weight", own.alias("g"))
    x = cut(x.groupBy("item", "g").agg(F.max("weight").alias("weight")))
    words = x.select("item").distinct()
    pairs = similar_pairs(words, threshold).unionAll(sibilant_pairs(words, words.select(F.col("item").alias("other")))).distinct()
    pairs = pairs.where(F.substring("item", 1, block) == F.substring("other", 1, block))
    pairs = pairs.join(x, "item").join(x.select(F.col("item").alias("other"), "g", F.col("weight").alias("w2")), ["other", "g"])
    heavier = (F.col("w2") > F.col("weight")) | ((F.col("w2") == F.col("weight")) & (F.col("other") < F.col("item")))
    near = pairs.where(heavier & T.similar("item", "other", threshold))
    best = F.min if keep == "first" else F.max
    chosen = near.groupBy("g", "item").agg(best(F.struct((-F.col("w2")).alias("k"), "other")).alias("b"))
    key = lambda c: F.concat_ws("\u0001", "g", c)
    found = roots(chosen.select(key("item").alias("item"), key("b.other").alias("parent"))).withColumnRenamed("item", "k")
    out = x.withColumn("k", key("item")).join(found, "k", "left")
    root = F.coalesce(F.substring_index("root", "\u0001", -1), "item").alias("root")
    return out.select("item", root) if group is None else out.select(F.col("g").alias(group), "item", root)


def components(edges: DataFrame) -> DataFrame:
    """``node, group`` (the least node) of an undirected graph ``a, b``.

    Rounds of minimum label over neighbours and of the label's own label; each round's table is a checkpoint.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).select(F.col("a").alias("node"), "l"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m"))
        jumped = labels.join(labels.select(F.col("node").alias("l"), F.col("l").alias("j")), "l", "left")
        new = jumped.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.least("l", F.coalesce("j", "l"), F.coalesce("m", "l")).alias("n"), "l"
        )
        new = cut(new)
        labels = new.select("node", F.col("n").alias("l"))
        if new.where("n <> l").isEmpty():
            return labels.select("node", F.col("l").alias("group"))


SKIPPED = "of for the and in on de".split()  # words that an abbreviation may pass over
BRACKETED = r"((?:[A-Za-z-]+ ){2,9})\(([A-Z]{2,7})s?\)"


def abbreviation_pairs(df: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """``id, abbr, meaning``: the words before a bracketed abbreviation that it is made of.

    Each word gives its first letter or two, words of ``SKIPPED`` may give none.  As many words as the abbreviation has
    letters are tried first, then one and two more, then fewer, down to two.
    """
    rows = df.select(id_col, F.explode(F.regexp_extract_all(F.col(text), F.lit(BRACKETED), F.lit(0))).alias("m"))
    words = F.split(F.trim(F.regexp_extract("m", BRACKETED, 1)), " ")
    rows = rows.select(id_col, F.regexp_extract("m", BRACKETED, 2).alias("abbr"), words.alias("words"))
    n = F.length("abbr")
    lengths = F.concat(F.array(n, n + 1, n + 2), F.when(n > 2, F.reverse(F.sequence(F.lit(2), n - 1))).otherwise(F.array().cast("array<int>")))
    skipped = lambda w: F.lower(w).isin(*SKIPPED)

    def made_of(tail: Column) -> Column:
        first, second = (lambda w: F.upper(F.substring(w, 1, 1))), (lambda w: F.upper(F.substring(w, 2, 1)))
        one = lambda w: F.concat(first(w), F.lit("(?:"), second(w), F.lit(")?"))
        return F.array_join(F.transform(tail, lambda w: F.when(skipped(w), F.concat(F.lit("(?:"), one(w), F.lit(")?"))).otherwise(one(w))), "")

    tails = F.transform(F.filter(lengths, lambda k: k <= F.size("words")), lambda k: F.slice("words", F.size("words") - k + 1, k))
    fits = lambda t: F.rlike(F.col("abbr"), F.concat(F.lit("^"), made_of(t), F.lit("$"))) & ~skipped(F.element_at(t, 1))
    found = rows.withColumn("t", F.try_element_at(F.filter(tails, fits), F.lit(1))).where("t is not null")
    return found.select(id_col, "abbr", F.lower(F.array_join("t", " ")).alias("meaning"))


def ranked_meanings(pairs: DataFrame) -> DataFrame:
    """``abbr, meaning, n, rank`` by number of documents."""
    c = pairs.groupBy("abbr", "meaning").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("abbr").orderBy(F.desc("n"), "meaning")))
