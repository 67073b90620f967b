"""Queries of the ten problems: each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch, table
from . import (
    canonical,
    cooccurrence,
    format_copies,
    mixing,
    name_variants,
    overlap,
    packing,
    plain_text,
    sentences,
    splitting,
    tokens,
)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.segment(table(spark, d, "articles_df"), with_text=False, plain_only=True).select("id", "start_pos")


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.segment(table(spark, d, "articles_df"))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each abstract, without white space, that its sentences hold: all of them."""
    rows = sentences.segment(table(spark, d, "articles_df"))
    bare = F.regexp_replace("sentence", r"[\s\p{Z}\x1c-\x1f\x85]", "")
    return rows.groupBy("id").agg(F.sum(F.length(bare)).cast("bigint").alias("n_chars"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copies(table(spark, d, "articles_df"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.collapse(table(spark, d, "articles_df"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.persons(table(spark, d, "articles_df"), table(spark, d, "given_name_forms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    people = name_variants.pairs(_people(spark, d)).select(F.lit("raw_authors").alias("field"), "name_a", "name_b")
    places = name_variants.pairs(name_variants.organisations(table(spark, d, "articles_df")))
    return people.unionAll(places.select(F.lit("raw_affiliation").alias("field"), "name_a", "name_b"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d).select(F.lit("raw_authors").alias("field"), "entity", "value", "mentions")
    places = name_variants.organisations(table(spark, d, "articles_df"))
    return people.unionAll(places.select(F.lit("raw_affiliation").alias("field"), "entity", "value", "mentions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.articles(
        table(spark, d, "articles_df"), table(spark, d, "journal_list"), table(spark, d, "affiliation_map")
    )


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Articles with at least one row of each field, listed or not: all that have a value."""
    return p4_found(spark, d).groupBy("field").agg(F.count_distinct("id").alias("n_articles"))


def p4_unlisted(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that name no entry, with their numbers of mentions."""
    df = table(spark, d, "articles_df")
    whole = df.where(F.col("journal").rlike(r"(?U)\S")).select(F.col("journal").alias("value"))
    split = canonical.parts(df, "raw_affiliation").select("value")
    missed = lambda field, mapped: mapped.where("ref_id = 0").select(F.lit(field).alias("field"), "value", "mentions")
    j = missed("journal", canonical.journals(whole, table(spark, d, "journal_list")))
    return j.unionAll(missed("raw_affiliation", canonical.organisations(split, table(spark, d, "affiliation_map"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.overlaps(table(spark, d, "study_type_df"))
    return found.select(
        F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")
    ).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "study_type_df")
    return overlap.report(df, overlap.overlaps(df))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.cleaned(table(spark, d, "articles_df")).select("id", "field")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.cleaned(table(spark, d, "articles_df")).select(
        "id", "field", F.array_join("kinds", ",").alias("kinds"), "clean_text"
    )


def p6_dropped(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that the text densities of HTML texts leave out."""
    return plain_text.dropped(table(spark, d, "articles_df"))


def _pair_table(spark: SparkSession, d: str) -> cooccurrence.PairTable:
    """The persistent table of ``big_dataset`` after two batches: the deliveries that came late, then the others."""
    df = table(spark, d, "big_dataset")
    late = F.coalesce(F.col("loaded_at") >= F.col("labelled_at") + F.expr("INTERVAL 1 DAY"), F.lit(False))
    state = cooccurrence.PairTable(spark, scratch(spark, "pairs"))
    state.apply(df.where(late))
    state.apply(df.where(~late))
    return state


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.frequent_pairs(_pair_table(spark, d).scored()).select("item_a", "item_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, counted in one batch."""
    return cooccurrence.pair_counts(table(spark, d, "big_dataset")).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def p7_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same from the persistent table that got the deliveries in two batches."""
    return _pair_table(spark, d).scored().select("item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def _limit(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(F.col("purpose") == purpose).select("max_tokens", "overlap_tokens").first()
    return int(row[0]), int(row[1] or 0)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limit(spark, d, "container")
    sizes = tokens.counted(table(spark, d, "documents").select("doc_id", "text"))
    return packing.divided(packing.pack(sizes, capacity))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Containers filled by the tokens of a public tokenizer."""
    capacity, _ = _limit(spark, d, "container")
    sizes = tokens.counted(table(spark, d, "documents").select("doc_id", "text"), path=tokens.named(spark))
    return packing.pack(sizes, capacity)


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by the rule's tokens; ``near_full``: at most 1 % more of them than the fewest."""
    capacity, _ = _limit(spark, d, "container")
    packed = packing.pack(tokens.counted(table(spark, d, "documents").select("doc_id", "text")), capacity)
    return packing.summary(packed, capacity).select("n_items", "tokens", "overfull", (F.col("excess") <= 0.01).alias("near_full"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tokens.counted(table(spark, d, "documents").select("doc_id", "source", "text"), path=tokens.named(spark))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source whether no document is used too often, and whether its tokens are those the caps allow, but
    for one document."""
    docs, targets = _sized(spark, d), table(spark, d, "mix_targets")
    mixed = cut(mixing.mixture(docs, targets))
    sums = {r[0]: (r[1], r[2]) for r in docs.groupBy("source").agg(F.sum("n_tokens"), F.max("n_tokens")).collect()}  # a row per source
    rows = [r for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None]
    tokens_of = {r[0]: sums.get(r[0], (0, 0))[0] or 0 for r in rows}
    wanted = mixing.allocate(tokens_of, {r[0]: r[1] or 0.0 for r in rows}, {r[0]: r[2] or 0 for r in rows}, sum(tokens_of.values()))
    plan = spark.createDataFrame([(s, float(w), int(sums.get(s, (0, 0))[1] or 0)) for s, w in wanted.items()], "source string, wanted double, largest bigint")
    most = mixed.groupBy("source").agg(F.max("copies").alias("most"))
    got = mixing.report(mixed, targets).join(plan, "source").join(most, "source", "left")
    return got.select(
        "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("tokens") - F.col("wanted")) <= F.col("largest")).alias("on_target")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap_tokens = _limit(spark, d, "piece")
    return splitting.split(table(spark, d, "documents"), limit, overlap_tokens, with_text=False).where("piece = 2").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents by the tokens of a public tokenizer."""
    limit, overlap_tokens = _limit(spark, d, "piece")
    return splitting.split(table(spark, d, "documents"), limit, overlap_tokens, path=tokens.named(spark))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each document by the rule's tokens: how many it has, and whether its pieces keep limit, overlap and text."""
    limit, overlap_tokens = _limit(spark, d, "piece")
    docs = table(spark, d, "documents")
    cut_up = splitting.split(docs, limit, overlap_tokens)
    back = F.when(F.col("piece") > 1, F.least(F.lit(overlap_tokens), F.lit((limit - 1) // 2))).otherwise(0)
    each = cut_up.groupBy("doc_id").agg(
        F.sum(F.col("n_tokens") - back).cast("bigint").alias("n_tokens"),
        (F.max("n_tokens") <= limit).alias("within"),
        F.bool_and(F.col("n_tokens") == tokens.rule_count(F.col("piece_text"))).alias("counted"),
    )
    return each


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_sentences, p1_cover, p2_found, p2_collapsed, p3_found, p3_entities, p4_found, p4_cover, p4_unlisted, p5_found,
            p5_report, p6_found, p6_clean, p6_dropped, p7_found, p7_pairs, p7_incremental, p8_found, p8_unused, p8_packed, p9_mixture,
            p9_shares, p9_kept, p10_found, p10_pieces,
            p10_limits,
        )
    }
