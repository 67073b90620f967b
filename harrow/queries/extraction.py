"""Abbreviations in search, further extractors, sinks and preparation of training rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, search
from ..session import scratch, table
from ..sources import files
from ..streaming import incremental
from . import query, sql
from .knowledge import _REL, relations
from .searching import _POST, A, index

_MEAN = r"""mean AS (SELECT abbr, arg_min(meaning, (-n, meaning)) AS meaning FROM (SELECT regexp_extract(raw_university_name, '\(([A-Z]{4,})\)', 1) AS abbr, lower(normalized_name) AS meaning, count_mentions AS n FROM affiliation_map WHERE regexp_matches(raw_university_name, '\([A-Z]{4,}\)')) GROUP BY abbr)"""
_OCC = r"occ AS (SELECT DISTINCT id, unnest(regexp_extract_all(raw_affiliation, '\b[A-Z]{4,}\b')) AS abbr FROM articles_df)"


def meanings(spark, d):
    """``abbr, meaning``: the most mentioned meaning of each acronym of the reference list."""
    a = table(spark, d, "affiliation_map").where(r"raw_university_name rlike '\\([A-Z]{4,}\\)'")
    a = a.select(F.regexp_extract("raw_university_name", r"\(([A-Z]{4,})\)", 1).alias("abbr"), F.lower("normalized_name").alias("meaning"), "count_mentions")
    return a.groupBy("abbr").agg(F.min(F.struct(-F.col("count_mentions"), "meaning")).alias("b")).select("abbr", F.col("b.meaning").alias("meaning"))


def occurrences(spark, d):
    found = F.regexp_extract_all("raw_affiliation", F.lit(r"\b[A-Z]{4,}\b"), F.lit(0))
    return table(spark, d, A).select("id", F.explode(found).alias("abbr")).distinct()


@query(f"WITH {_MEAN}, {_OCC} SELECT id, abbr, meaning FROM occ JOIN mean USING (abbr)")
def se_abbr_docs(spark, d):
    """Meanings of the acronyms in each article's affiliations."""
    return occurrences(spark, d).join(meanings(spark, d), "abbr").select("id", "abbr", "meaning")


@query(f"WITH {_MEAN} SELECT abbr || ' soils' AS query, meaning || ' soils' AS expanded FROM mean UNION ALL SELECT meaning || ' soils', abbr || ' soils' FROM mean")
def se_abbr_expand(spark, d):
    """Queries with an acronym or its meaning, and what each becomes by the other."""
    m = meanings(spark, d).select(F.concat("abbr", F.lit(" soils")).alias("a"), F.concat("meaning", F.lit(" soils")).alias("b"))
    return m.select(F.col("a").alias("query"), F.col("b").alias("expanded")).unionAll(m.select("b", "a"))


@query(f"WITH {_MEAN}, {_OCC} SELECT DISTINCT id FROM occ JOIN mean USING (abbr) WHERE contains(meaning, 'fisheries')")
def se_abbr_filter(spark, d):
    """Articles where an acronym stands for a meaning with the word."""
    wanted = meanings(spark, d).where("contains(meaning, 'fisheries')")
    return occurrences(spark, d).join(wanted, "abbr", "left_semi").select("id").distinct()


@query(f"WITH {_MEAN} SELECT meaning, count(*) AS n, list_sort(list(abbr)) AS abbrs FROM mean GROUP BY meaning")
def ab_merge(spark, d):
    return meanings(spark, d).groupBy("meaning").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("abbr")).alias("abbrs"))


@query("SELECT id, CASE WHEN length(e) > 0 THEN array_to_string(e, ';') ELSE title END AS out FROM (SELECT id, title, list_filter(string_split(title, ';'), lambda w: list_has_any(string_split(regexp_replace(lower(w), '[^a-z]+', ' ', 'g'), ' '), ['the', 'of', 'and', 'in', 'for', 'with', 'on', 'to', 'under'])) AS e FROM articles_df)")
def str_english_part(spark, d):
    return table(spark, d, A).select("id", T.english_parts("title").alias("out"))


@query(rf"SELECT id, regexp_extract_all({sql.unaccent('abstract')}, '\b[A-Z]{{2,}}(?: [A-Z]{{2,}})+\b') AS runs FROM articles_df")
def str_abbr_seq(spark, d):
    return table(spark, d, A).select("id", T.abbreviation_runs(T.unaccent("abstract")).alias("runs"))


@query()
def str_last_sq(spark, d):
    """Titles without bracketed remarks at their end, to a fixpoint."""
    return table(spark, d, A).select("id", T.drop_last_brackets("title").alias("out"))


@query("""WITH RECURSIVE w AS (SELECT journal_id, list_filter(string_split(lower(journal_name), ' '), lambda x: x <> '') AS l FROM journal_list),
r AS (SELECT journal_id, l, 1::BIGINT AS p, []::VARCHAR[] AS parts FROM w UNION ALL SELECT journal_id, l, p + k, list_append(parts, array_to_string(l[p:p + k - 1], ' ')) FROM r, (SELECT unnest([1, 2, 3]) AS k) WHERE p + k - 1 <= length(l))
SELECT journal_id, list_sort(list(parts)) AS parts FROM r WHERE p > length(l) GROUP BY journal_id""")
def str_partitions(spark, d):
    return table(spark, d, "journal_list").select("journal_id", F.array_sort(T.partitions(F.lower("journal_name"))).alias("parts"))


# fixed values: endings and beginnings that a word is looked up without
_SUFFIX = [("ing$", ""), ("ing$", "e"), ("s$", ""), ("es$", ""), ("ed$", ""), ("d$", "")]
_PREFIX = ["in", "un", "im", "ir", "sub"]


@query(f"""WITH df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT id, unnest({sql.words('title')}) AS w FROM articles_df) GROUP BY w), r AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM df QUALIFY r <= 5000),
v AS (SELECT w, unnest([w, {', '.join(f"regexp_replace(w, '{a}', '{b}')" for a, b in _SUFFIX)}] || CASE WHEN length(w) >= 7 THEN [{', '.join(f"regexp_replace(w, '^{p}', '')" for p in _PREFIX)}] ELSE [] END) AS f FROM df)
SELECT v.w AS word, round(least(min(coalesce(r.r, 5000)), 5000) / 5000, 6) AS rank FROM v LEFT JOIN r ON r.w = f GROUP BY v.w""")
def str_rank(spark, d):
    """Frequency rank of words (of 5000), by their likeliest form without usual endings and beginnings."""
    df = table(spark, d, A).select("id", F.explode(F.array_distinct(T.normal_words("title"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = df.orderBy(F.desc("n"), "w").limit(5000).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "w"))).select(F.col("w").alias("f"), "r")
    forms = F.array("w", *(F.regexp_replace("w", a, b) for a, b in _SUFFIX))
    more = F.array(*(F.regexp_replace("w", f"^{p}", "") for p in _PREFIX))
    v = df.select("w", F.explode(F.when(F.length("w") >= 7, F.concat(forms, more)).otherwise(forms)).alias("f"))
    return v.join(F.broadcast(top), "f", "left").groupBy(F.col("w").alias("word")).agg(F.round(F.min(F.coalesce("r", F.lit(5000))) / 5000, 6).alias("rank"))


@query(f"WITH {_POST} SELECT doc_id, list_sort(list_distinct(list(name || ' # ' || meaning))) AS programs FROM post JOIN (VALUES ('drip irrigation', 'water'), ('voucher scheme', 'inputs'), ('school attendance', 'education')) p(name, meaning) ON term = name GROUP BY doc_id")
def lb_programs_kw(spark, d):
    ix = index(spark, d)
    p = spark.createDataFrame([("drip irrigation", "water"), ("voucher scheme", "inputs"), ("school attendance", "education")], "query string, meaning string")
    hits = ix.search(p.select("query")).join(p, "query")
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(" # ", "query", "meaning"))).alias("programs"))


@query()
def lb_study_full(spark, d):
    """Keyword labels united with a model's labels of at least one half; "No category" only alone."""
    s = table(spark, d, "study_type_df").where("abstract is not null")
    rows = s.select("id", "split_name", F.concat_ws(". ", "title", "abstract").alias("text"), F.col("exact_study_type").alias("label"))
    model = models.TextClassifier().fit(rows.where("split_name = 'train' and label is not null"))
    guessed = model.predict(rows.select("id", "text")).where("probability >= 0.5").select("id", F.col("predicted").alias("label"))
    words = search.keyword_labels(search.Index.build(s, ["title", "abstract"]), [("survey", "Observational study"), ("trial", "Experimental study")])
    both = guessed.unionAll(words.select(F.col("doc_id").alias("id"), "label")).where("label <> 'No category'")
    found = both.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return s.select("id").join(found, "id", "left").select("id", F.coalesce("labels", F.array(F.lit("No category"))).alias("labels"))


@query()
def lb_interv_class(spark, d):
    """Classes of distinct topic names by a classifier fitted on records with one label."""
    b = table(spark, d, "big_dataset").where("not contains(intervention_labels, ';') and trim(intervention_labels) <> '' and size(topics) > 0")
    rows = b.select(F.array_join("topics", " ").alias("text"), F.lower(F.trim("intervention_labels")).alias("label"))
    topics = table(spark, d, "big_dataset").select(F.explode("topics").alias("x")).select(F.lower(F.trim("x")).alias("text")).where("text <> ''").distinct()
    return models.TextClassifier(features=4096).fit(rows).predict(topics).select("text", "predicted", F.round("probability", 4).alias("probability"))


@query(f"WITH {_REL} SELECT string_split(special, ' ')[-1] AS head, list_sort(list_distinct(list(special))) AS terms FROM rel GROUP BY 1")
def rx_coref(spark, d):
    """Terms with the same head word, which stands for one referent where no model resolves it."""
    return relations(spark, d).groupBy(F.element_at(F.split("special", " "), -1).alias("head")).agg(F.array_sort(F.collect_set("special")).alias("terms"))




@query(f"""WITH {_REL} SELECT DISTINCT special AS source, CASE WHEN contains(special, ' ') THEN string_split(special, ' ')[-1] ELSE 'intervention' END AS target FROM rel""")
def hs_edges_inv(spark, d):
    """Each term under its last word, single words under the root."""
    head = F.when(F.contains("special", F.lit(" ")), F.element_at(F.split("special", " "), -1)).otherwise("intervention")
    return relations(spark, d).select(F.col("special").alias("source"), head.alias("target")).distinct()


# ---- sinks and incremental runs


@query("SELECT to_base64((r_regionkey || ',' || r_name)::BLOB) AS line FROM region")
def snk_base64(spark, d):
    return files.base64_csv(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("SELECT id, colour FROM study_type_df LEFT JOIN (VALUES ('No category', 'grey'), ('Observational study', 'blue')) c(label, colour) ON exact_study_type = label")
def fmt_colorize(spark, d):
    c = spark.createDataFrame([("No category", "grey"), ("Observational study", "blue")], "label string, colour string")
    s = table(spark, d, "study_type_df")
    return s.join(F.broadcast(c), F.col("exact_study_type") == F.col("label"), "left").select("id", "colour")


@query("SELECT 'region' AS tab, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def snk_excel_tabs(spark, d):
    path = scratch(spark, "tabs")
    files.write_tabs({t: table(spark, d, t) for t in ("region", "nation")}, path)
    counts = [spark.read.parquet(f"{path}/{t}").agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t in ("region", "nation")]
    return counts[0].unionAll(counts[1])


@query(f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def snk_model(spark, d):
    """An index written and loaded again."""
    path = scratch(spark, "saved")
    index(spark, d, path)
    return search.Index.load(spark, path).vocabulary.select("term", "df")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def src_sequential(spark, d):
    """Part files read one after another by a stream, with bounded memory."""
    e = table(spark, d, "events").select("event_id", "event_type")
    source, target, point = (scratch(spark, x) for x in ("source", "target", "point"))
    e.repartition(4).write.parquet(source)
    return incremental.run_available(spark, source, e.schema, lambda s: s, target, point).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT id, 'left' AS is_deleted FROM study_type_df UNION ALL SELECT id, 'deleted' FROM study_type_df")
def in_append_log(spark, d):
    path = scratch(spark, "log")
    for state in ("left", "deleted"):
        table(spark, d, "study_type_df").select("id", F.lit(state).alias("is_deleted")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_type AS step, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def ag_min_batch(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT id, list_filter(regexp_split_to_array(lower(title), '[^A-Za-z0-9_]+'), lambda w: w <> '' AND NOT list_contains({sql.STOP}, w)) AS tokens FROM articles_df WHERE title IS NOT NULL")
def snk_elastic_create(spark, d):
    """The analyser of the search index: words, lower case, stop words out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    rows = table(spark, d, A).where("title is not null").select("id", "title")
    stages = [
        RegexTokenizer(inputCol="title", outputCol="w", pattern="[^A-Za-z0-9_]+"),
        StopWordsRemover(inputCol="w", outputCol="tokens", stopWords=list(T.STOP_WORDS), caseSensitive=True),
    ]
    return Pipeline(stages=stages).fit(rows).transform(rows).select("id", "tokens")


@query("SELECT event_id::VARCHAR AS _id, event_type FROM events")
def snk_elastic_big(spark, d):
    """Documents for a bulk index, part by part."""
    e = table(spark, d, "events").select("event_id", "event_type")
    source, target, point = (scratch(spark, x) for x in ("source", "target", "point"))
    e.repartition(3).write.parquet(source)
    docs = incremental.run_available(spark, source, e.schema, lambda s: files.documents(s, ["event_id", "event_type"], "event_id"), target, point)
    return docs.select("_id", F.get_json_object("doc", "$.event_type").alias("event_type"))


@query()
def ml_outcome_select(spark, d):
    """Scores of two classifiers on the dev split; the better one is marked."""
    s = table(spark, d, "study_type_df").where("abstract is not null and exact_study_type is not null")
    rows = s.select("id", "split_name", F.concat_ws(". ", "title", "abstract").alias("text"), F.col("exact_study_type").alias("label"))
    scored = []
    for features in (1024, 8192):
        model = models.TextClassifier(features=features).fit(rows.where("split_name = 'train'"))
        dev = rows.where("split_name = 'dev'")
        got = model.predict(dev.select("id", "text")).join(dev.select("id", "label"), "id")
        scored.append(got.agg(F.lit(features).alias("features"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 4).alias("accuracy")))
    both = scored[0].unionAll(scored[1])  # a row per model
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), "features")) == 1
    return both.withColumn("chosen", best)
