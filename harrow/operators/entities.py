"""Authors, affiliations and geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: signs of an institution in the order they are tried
INSTITUTION = (
    "univ", "inst", "college", "academy", "r&d", "foundation", "research center", "hochschul", "centre", "center",
    "organis", "dept", "depart", "school", "research", "division", "program", "project",
)
GENERIC = ("university", "institute", "research", "center", "centre", "department", "college")


def author_names(x: T.Text) -> Column:
    """Names between separators, without brackets, numbers and "et al."; a leading initial goes to the end."""
    raw = F.regexp_replace(F.regexp_replace(T.col(x), r"\bet al\.?|\([^()]*\)|\[[^\[\]]*\]|[0-9]+", " "), r"\band\b", ";")
    names = F.transform(F.split(raw, ";"), lambda w: T.squeeze(F.regexp_replace(w, ",", " ")))

    def turned(w: Column) -> Column:
        head, tail = F.split_part(w, F.lit(" "), F.lit(1)), F.regexp_extract(w, r"^[^ ]+ (.*)$", 1)
        leading = ((F.length(head) < 3) | F.contains(head, F.lit("."))) & (tail != "")
        return F.regexp_replace(F.when(leading, F.concat_ws(" ", tail, head)).otherwise(w), r"\.", "")

    return F.filter(F.transform(names, turned), lambda w: (F.length(w) > 3) & ~F.contains(w, F.lit("?")))


def affiliation_parts(x: Column) -> Column:
    """Lower-case parts between commas without boxes, brackets, numbers and stop words."""
    part = lambda w: T.squeeze(F.regexp_replace(F.regexp_replace(F.lower(w), r"p\.? ?o\.? box *[0-9]*|\([^()]*\)|[0-9]+|campus", " "), r"[^a-z' ]", " "))
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    words = lambda w: F.array_join(F.filter(F.split(part(w), " "), lambda v: (F.length(v) > 1) & ~F.array_contains(stop, v)), " ")
    return F.filter(F.transform(F.split(x, ","), words), lambda w: w != "")


def institution(parts: Column) -> Column:
    """The last part that holds the first sign of an institution that any part holds; else all of them."""
    picks = [F.try_element_at(F.filter(parts, _holds(m)), F.lit(-1)) for m in INSTITUTION]
    return F.coalesce(*picks, F.array_join(parts, " "))


def _holds(sign: str):
    return lambda w: F.contains(w, F.lit(sign))


def core_name(x: Column) -> Column:
    """A name without the words most institutions have, for comparing."""
    for w in GENERIC:
        x = F.replace(x, F.lit(w), F.lit(" "))
    return T.squeeze(x)


def place_mentions(docs: DataFrame, id_col: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """``id_col, name, pos`` of gazetteer names (column ``name``, one or two words) in a text, by joins on its words."""
    words = F.split(F.regexp_replace(F.col(text), T.WORD_GAP, " "), " ")
    tokens = docs.where(F.col(text).isNotNull()).select(id_col, words.alias("w"))
    pairs = F.concat(F.transform("w", lambda v, i: F.struct(v.alias("name"), i.alias("pos"))), F.transform(T.bigrams(F.col("w")), lambda v, i: F.struct(v.alias("name"), i.alias("pos"))))
    each = tokens.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.name", "p.pos").where("name rlike '^[A-Z]'")
    return each.join(gazetteer.select("name").distinct(), "name", "left_semi")
