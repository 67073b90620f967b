"""Mapping typed values to a reference list with a BK-tree under the Levenshtein metric.

Each reference entry stands in the tree under every way it is usually written; a typed value is looked up under its
normal forms; abbreviated words are read as those of every entry that has words for all of them.  Every entry within the
radius of a form is found by triangle-inequality pruning, the nearest wins, ties go to the smallest reference id.  A form
of seven letters or fewer is taken for a slip only at one edit or two swapped neighbours, and only if the entry is
written rightly at least ``RARER`` times as often as the value is typed: a frequent value near a short name is a name of
its own.  Distinct values are mapped once, whatever their number of rows.

A reference list of at most ``shard`` entries is one tree, made on the driver and sent to the tasks.  A longer one never
reaches the driver: it is cut into shards, each task builds the tree of one shard and searches a part of the values in
it, and the winners of the shards are merged by smallest distance.

Defined results: null and blank values give no row; a value near no entry has ``ref_id`` 0; an empty reference list
gives 0 for every value; repeated rows are mapped alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread, spread_join
from . import name_forms
from .bktree import BKTree

SHARD = 50_000
CHUNK = 20_000  # values searched in one tree of a shard at a time
RARER = 20  # times that a short name is written rightly for one slip
FOUND = "value string, mentions bigint, distance int, ref_id int, short boolean"


def radius(form: str, letters: int = 6) -> int:
    """Edits a form is searched with: up to 3 letters none, up to 7 two, then one for every ``letters``, at most 4."""
    n = len(form)
    return 0 if n < 4 else 2 if n < 8 else min(4, n // letters)


def slip(form: str, entry: str, d: int) -> bool:
    """For short forms: is the distance ``d`` one edit, or two neighbours swapped?"""
    if d < 2:
        return True
    off = [k for k, (a, b) in enumerate(zip(form, entry)) if a != b]
    return len(form) == len(entry) and len(off) == 2 and off[1] == off[0] + 1 and form[off[0]] == entry[off[1]] and form[off[1]] == entry[off[0]]


def search(tree: BKTree, forms: Callable[[str], list[str]], letters: int, values: list[str]) -> list[tuple[int, int, bool]]:
    """(distance, ref_id, by a slip in a short form) of the nearest entry of each value; ref_id 0: none."""
    best, open_ = [(10**6, 0, False)] * len(values), {}
    for k, v in enumerate(values):
        own = forms(v)
        hit = [(0, r, False) for f in own if f in tree.exact for r in tree.values[tree.exact[f]]]
        if hit:
            best[k] = min(hit)
        else:
            open_[k] = own
    # all entries within a smaller radius are nearer than any found later, so growing radii give the same winner
    for most in (1, 2, 4):
        queries = sorted({f for own in open_.values() for f in own if radius(f, letters) > most // 2})
        near = {}
        for q, found in zip(queries, tree.search(queries, lambda q: min(most, radius(q, letters)))):
            if len(q) < 8:
                found = [(d, r) for d, r in found if any(slip(q, w, d) for w in tree.names_of[r])]
            if found:
                near[q] = (*min(found), len(q) < 8)
        for k in list(open_):
            if hit := [near[f] for f in open_[k] if f in near]:
                best[k] = min(hit)
                del open_[k]
    return best


def build(rows: list[tuple], entries: Callable[..., list[str]]) -> BKTree:
    """Tree of reference rows (id, then what ``entries`` takes)."""
    tree = BKTree([(text, r[0]) for r in rows for text in entries(*r[1:])])
    tree.names_of = {}
    for r in rows:
        tree.names_of.setdefault(r[0], []).extend(entries(*r[1:]))
    return tree


def _found(values: pa.Array, mentions: pa.Array, best: list[tuple[int, int, bool]]) -> list[pa.Array]:
    return [values, mentions, *(pa.array([b[k] for b in best], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.bool_())))]


NAMES = ["value", "mentions", "distance", "ref_id", "short"]


def map_values(
    values: DataFrame,
    reference: DataFrame,
    forms: Callable[[list], Callable[[str], list[str]]],
    entries: Callable[..., list[str]],
    shard: int = SHARD,
    letters: int = 6,
) -> DataFrame:
    """``value, ref_id, distance, mentions`` for each distinct ``value``.

    ``reference``: first the id, then what ``entries`` takes; ``forms`` gets the reference rows (of a shard) and returns
    the function that gives a value's forms.
    """
    reference = reference.where(F.col(reference.columns[0]).isNotNull())
    n = reference.count()
    counted = values.groupBy("value").agg(F.count("*").alias("mentions"))
    if n <= shard:
        rows = sorted(tuple(r) for r in reference.collect())  # at most ``shard`` rows
        tree, own = build(rows, entries), forms(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays(_found(b.column(0), b.column(1), search(tree, own, letters, b.column(0).to_pylist())), names=NAMES)

        found = cut(spread(counted).mapInArrow(run, FOUND))
    else:
        counted = cut(counted)
        parts, chunks = -(-n // shard), max(1, -(-counted.count() // CHUNK))
        order = reference.columns

        def of_shard(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = sorted(zip(*(right.column(c).to_pylist() for c in order)))
            best = search(build(rows, entries), forms(rows), letters, left.column("value").to_pylist())
            return pa.table(_found(left.column("value"), left.column("mentions"), best), names=NAMES)

        each = lambda k, n, name: k.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        cut_up = each(reference.withColumn("_shard", F.pmod(F.xxhash64(order[0]), F.lit(parts)).cast("int")), chunks, "_chunk")
        asked = each(counted.withColumn("_chunk", F.pmod(F.xxhash64("value"), F.lit(chunks)).cast("int")), parts, "_shard")
        hits = asked.groupBy("_shard", "_chunk").cogroup(cut_up.groupBy("_shard", "_chunk")).applyInArrow(of_shard, FOUND)
        best = F.min(F.struct("distance", F.when(F.col("ref_id") == 0, 1).otherwise(0).alias("none"), "ref_id", "short")).alias("b")
        found = cut(hits.groupBy("value", "mentions").agg(best).select("value", "mentions", "b.distance", "b.ref_id", "b.short"))
    # a slip in a short name must be rare beside the name itself
    right = found.where("distance = 0").groupBy("ref_id").agg(F.sum("mentions").alias("rightly"))
    told = found.join(right, "ref_id", "left")
    own = F.col("short") & (F.col("mentions") * RARER > F.coalesce("rightly", F.lit(0)))
    return told.select("value", F.when(own, F.lit(0)).otherwise(F.col("ref_id")).alias("ref_id"), "distance", "mentions")


def journals(values: DataFrame, journal_list: DataFrame, shard: int = SHARD) -> DataFrame:
    """Typed journals (column ``value``) mapped to ``journal_list``."""

    def forms(rows):
        vocabulary = name_forms.Vocabulary(r[1] for r in rows)
        return lambda v: name_forms.journal_forms(v, vocabulary)

    reference = journal_list.select("journal_id", "journal_name", "short_name").where("journal_name is not null")
    return map_values(values, reference, forms, name_forms.journal_entries, shard, letters=5)


def organisations(values: DataFrame, affiliation_map: DataFrame, shard: int = SHARD) -> DataFrame:
    """Typed organisations (column ``value``) mapped to ``affiliation_map``."""

    def forms(rows):
        vocabulary = name_forms.Vocabulary(f"{r[2]} {r[3] or ''} {r[4] or ''}" for r in rows)
        return lambda v: name_forms.organisation_forms(v, vocabulary)

    reference = affiliation_map.select(
        "affiliation_id", "raw_university_name", "normalized_name", "city", "country"
    ).where("normalized_name is not null and raw_university_name is not null")
    return map_values(values, reference, forms, name_forms.organisation_entries, shard)


def parts(df: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """``id, value``: the texts between ``;`` of a column, without blanks at their ends; empty ones are none."""
    value = F.explode(F.split(column, ";")).alias("value")
    return (
        df.where(F.col(column).isNotNull())
        .select(F.col(id_col).alias("id"), value)
        .select("id", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))
        .where("value <> ''")
    )


def articles(articles_df: DataFrame, journal_list: DataFrame, affiliation_map: DataFrame) -> DataFrame:
    """``id, field, ref_id``, once for each article and entry it names."""
    whole = articles_df.where(F.col("journal").rlike(r"(?U)\S")).select("id", F.col("journal").alias("value"))
    split = parts(articles_df, "raw_affiliation")
    named = lambda rows, mapping, field: spread_join(rows, mapping.select("value", "ref_id"), ["value"]).select(
        "id", F.lit(field).alias("field"), "ref_id"
    )
    j = named(whole, journals(whole, journal_list), "journal")
    a = named(split, organisations(split, affiliation_map), "raw_affiliation")
    return j.unionAll(a.dropDuplicates())
