"""Projections, joins, aggregations, rankings, set operations and dashboard aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dashboards as D
from ..operators import merging
from ..operators import reshape as R
from ..session import spread_join, table
from . import query, sql

# ---- projection, filter, reshaping


@query("SELECT id, title, year, 'articles' AS kind FROM articles_df")
def sel_cols(spark, d):
    return table(spark, d, "articles_df").select("id", "title", "year", F.lit("articles").alias("kind"))


@query("SELECT id, journal AS source_title FROM articles_df")
def ren_cols(spark, d):
    return table(spark, d, "articles_df").select("id", "journal").withColumnRenamed("journal", "source_title")


@query("SELECT * EXCLUDE (added_at, loaded_at, url, abstract) FROM articles_df")
def drop_col(spark, d):
    return table(spark, d, "articles_df").drop("added_at", "loaded_at", "url", "abstract")


@query("SELECT id, coalesce(title, '') || ' . ' || coalesce(keywords, '') || ' . ' || coalesce(identificators, '') AS text FROM articles_df")
def concat_text(spark, d):
    return table(spark, d, "articles_df").select("id", R.concat_text("title", "keywords", "identificators").alias("text"))


@query("SELECT id FROM study_type_df WHERE exact_study_type <> 'No category' AND coalesce(abstract, '') <> ''")
def flt_bool(spark, d):
    return table(spark, d, "study_type_df").where("exact_study_type <> 'No category' and coalesce(abstract, '') <> ''").select("id")


@query("SELECT id FROM articles_df WHERE contains(lower(title), 'report') OR contains(lower(title), 'draft') OR contains(lower(title), 'trial')")
def flt_kw_sub(spark, d):
    return table(spark, d, "articles_df").where(T.contains_any(F.lower("title"), ["report", "draft", "trial"])).select("id")


@query("SELECT id, title FROM articles_df WHERE id IN (SELECT article_id FROM big_dataset WHERE dataset = 'tillage_core')")
def flt_take(spark, d):
    ids = table(spark, d, "big_dataset").where("dataset = 'tillage_core'").select(F.col("article_id").alias("id"))
    return R.keep_ids(table(spark, d, "articles_df").select("id", "title"), ids)


@query("SELECT id, loaded_at FROM big_dataset WHERE list_has_any(topics, ['maize', 'rice']) AND NOT list_contains(topics, 'insurance')")
def flt_label(spark, d):
    t = table(spark, d, "big_dataset")
    return t.where(F.arrays_overlap("topics", F.array(F.lit("maize"), F.lit("rice"))) & ~F.array_contains("topics", "insurance")).select("id", "loaded_at")


@query(r"SELECT id FROM articles_df WHERE NOT regexp_matches(title, '\b(Study|Survey)\b')")
def flt_regex(spark, d):
    return table(spark, d, "articles_df").where(~F.col("title").rlike(r"\b(Study|Survey)\b")).select("id")


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 + 1000 AS row_id FROM articles_df")
def add_rowid(spark, d):
    return R.row_ids(table(spark, d, "articles_df").select("id"), "id", 1000)


@query(r"SELECT id, sentence FROM (SELECT id, unnest(list_filter(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '')) AS sentence FROM articles_df) WHERE NOT contains(sentence, '?')")
def explode_sent(spark, d):
    return table(spark, d, "articles_df").select("id", F.explode(T.split_sentences("abstract")).alias("sentence")).where("not contains(sentence, '?')")


@query("SELECT id, loaded_at, unnest(CASE WHEN coalesce(length(topics), 0) = 0 THEN ['Unspecified'] ELSE topics END) AS topic FROM big_dataset")
def explode_list(spark, d):
    return R.explode_or(table(spark, d, "big_dataset").select("id", "loaded_at", "topics"), "topics", "topic").drop("topics")


@query("SELECT id, loaded_at, list_filter(topics, lambda x: x NOT IN ('maize') AND NOT starts_with(x, 'soil')) AS topics FROM big_dataset")
def arr_clean(spark, d):
    return table(spark, d, "big_dataset").select("id", "loaded_at", R.clean_array("topics", ["maize"], ["soil"]).alias("topics"))


@query("SELECT id, loaded_at, coalesce(topics, []) AS topics FROM big_dataset")
def arr_default(spark, d):
    return table(spark, d, "big_dataset").select("id", "loaded_at", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


_MAP = [("maize", "cereals"), ("rice", "cereals"), ("rice", "paddy crops"), ("pulses", "legumes"), ("goat keeping", "livestock")]


@query("WITH m(value, new) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + """),
k AS (SELECT id, loaded_at, intervention_labels, topics FROM big_dataset), e AS (SELECT id, unnest(topics) AS value FROM k),
j AS (SELECT id, coalesce(new, value) AS v FROM e LEFT JOIN m USING (value) WHERE value IS NOT NULL),
g AS (SELECT id, list_sort(list_distinct(list(v))) AS renamed FROM j GROUP BY id)
SELECT id, coalesce(renamed, []) AS renamed FROM (SELECT DISTINCT id FROM k) LEFT JOIN g USING (id)""")
def map_rename(spark, d):
    mapping = spark.createDataFrame(_MAP, "value string, new string")
    return R.rename_values(table(spark, d, "big_dataset").select("id", "topics"), "id", "topics", F.broadcast(mapping))


@query("SELECT d.doc_id, a.journal, a.year AS article_year FROM documents d LEFT JOIN articles_df a ON d.article_id = a.id")
def map_table(spark, d):
    a = table(spark, d, "articles_df").select(F.col("id").alias("article_id"), "journal", F.col("year").alias("article_year"))
    return table(spark, d, "documents").select("doc_id", "article_id").join(a, "article_id", "left").drop("article_id")


_LABELS = ["maize", "rice", "cassava", "vegetables"]


@query("SELECT id, loaded_at, [" + ", ".join(f"coalesce(list_contains(topics, '{x}'), false)::INT" for x in _LABELS) + "] AS vec FROM big_dataset WHERE topics IS NULL OR length(list_filter(topics, lambda x: x IS NULL)) = 0")
def multi_hot(spark, d):
    t = table(spark, d, "big_dataset").where("topics is null or not exists(topics, x -> x is null)")
    return t.select("id", "loaded_at", R.multi_hot("topics", _LABELS).alias("vec"))


# ---- joins


@query("""WITH k AS (SELECT id, year, lower(split_part(title, ' ', 1)) || ' ' || lower(split_part(title, ' ', 2)) AS k FROM articles_df WHERE title IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.year = b.year AND a.k = b.k AND a.id < b.id JOIN articles_df x ON x.id = a.id JOIN articles_df y ON y.id = b.id WHERE x.journal = y.journal""")
def jn_block(spark, d):
    """Pairs in one block of year and first two title words, of the same journal (which joins the key)."""
    first_two = F.concat_ws(" ", F.lower(F.split_part("title", F.lit(" "), F.lit(1))), F.lower(F.split_part("title", F.lit(" "), F.lit(2))))
    k = table(spark, d, "articles_df").where("title is not null").select("id", "year", "journal", first_two.alias("k"))
    return spread_join(k.withColumnRenamed("id", "id_a"), k.withColumnRenamed("id", "id_b"), ["year", "k", "journal"], least=2000).where("id_a < id_b").select("id_a", "id_b")


@query("SELECT a.id AS article_id, s.id AS study_id FROM articles_df a JOIN study_type_df s ON lower(trim(a.title)) = lower(trim(s.title))")
def jn_block2(spark, d):
    a = table(spark, d, "articles_df").select(F.col("id").alias("article_id"), F.lower(F.trim("title")).alias("k"))
    s = table(spark, d, "study_type_df").select(F.col("id").alias("study_id"), F.lower(F.trim("title")).alias("k"))
    return a.join(s, "k").drop("k")


@query(f"""WITH v AS (SELECT DISTINCT w FROM (SELECT unnest({sql.words('keywords')}) AS w FROM articles_df) WHERE length(w) > 4 AND regexp_matches(w, '^[a-z]+$'))
SELECT a.w AS word_a, b.w AS word_b FROM v a JOIN v b ON substr(a.w, 1, 3) = substr(b.w, 1, 3) AND a.w < b.w AND abs(length(a.w) - length(b.w)) <= 2
WHERE 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) >= 0.8""")
def jn_fuzzy(spark, d):
    """Similar words with the same first three letters; candidates share a segment."""
    v = table(spark, d, "articles_df").select(F.explode(T.normal_words("keywords")).alias("item")).distinct().where("length(item) > 4 and item rlike '^[a-z]+$'")
    pairs = merging.similar_pairs(v, 0.8).where("item < other and left(item, 3) = left(other, 3) and abs(length(item) - length(other)) <= 2")
    return pairs.toDF("word_a", "word_b")


@query("SELECT id, title FROM articles_df a WHERE EXISTS (SELECT 1 FROM documents d WHERE d.article_id = a.id)")
def jn_semi(spark, d):
    docs = table(spark, d, "documents").select(F.col("article_id").alias("id"))
    return R.keep_ids(table(spark, d, "articles_df").select("id", "title"), docs)


@query("SELECT id, title FROM articles_df a WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.article_id = a.id)")
def jn_anti(spark, d):
    docs = table(spark, d, "documents").select(F.col("article_id").alias("id")).where("id is not null")
    return R.drop_ids(table(spark, d, "articles_df").select("id", "title"), docs)


_POS = "SELECT id, unnest(l) AS w, unnest(range(0, length(l))) AS p FROM (SELECT id, {t} AS l FROM articles_df)"


@query(f"""WITH t AS ({_POS.format(t=sql.words('abstract'))}) SELECT DISTINCT a.id FROM t a JOIN t b ON a.id = b.id AND abs(a.p - b.p) <= 5
WHERE a.w IN ('small', 'smallholder', 'smallholders') AND b.w IN ('farm', 'farms', 'plots', 'farmers')""")
def jn_prox(spark, d):
    """Articles with a word of one class within five words of one of another."""
    a = table(spark, d, "articles_df").select("id", T.normal_words("abstract").alias("w"))
    at = lambda words: F.filter(F.transform("w", lambda w, i: F.when(w.isin(*words), i)), lambda i: i.isNotNull())
    x, y = at(["small", "smallholder", "smallholders"]), at(["farm", "farms", "plots", "farmers"])
    return a.where(F.exists(x, lambda i: F.exists(y, lambda j: F.abs(i - j) <= 5))).select("id")


@query(r"""WITH t AS (SELECT id, unnest(l) AS w, unnest(range(0, length(l))) AS p FROM (SELECT id, string_split(regexp_replace(lower(abstract), '\s+', ' ', 'g'), ' ') AS l FROM articles_df)),
n AS (SELECT id, p, w FROM t WHERE regexp_matches(w, '^[0-9]+$')), m AS (SELECT id, p, w FROM t WHERE w IN ('plots', 'villages', 'households', 'sites'))
SELECT id, p::INT AS at, number, unit FROM (SELECT n.id, n.p, n.w AS number, m.w AS unit, row_number() OVER (PARTITION BY n.id, n.p ORDER BY abs(n.p - m.p), m.p) AS r FROM n JOIN m ON n.id = m.id) WHERE r = 1""")
def jn_nearest(spark, d):
    """The nearest unit word of each number, by positions inside the article's array: no join."""
    a = table(spark, d, "articles_df").select("id", F.split(F.regexp_replace(F.lower("abstract"), r"\s+", " "), " ").alias("l"))
    number = F.filter(F.transform("l", lambda w, i: F.when(w.rlike("^[0-9]+$"), F.struct(i.alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    unit = F.filter(F.transform("l", lambda w, i: F.when(w.isin("plots", "villages", "households", "sites"), F.struct(i.alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    a = a.select("id", unit.alias("u"), F.explode(number).alias("n")).where("size(u) > 0")
    nearest = F.array_min(F.transform("u", lambda x: F.struct(F.abs(x.p - F.col("n.p")).alias("d"), x.p.alias("p"), x.w.alias("w"))))
    return a.select("id", F.col("n.p").alias("at"), F.col("n.w").alias("number"), nearest.w.alias("unit"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_bcast_geo(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""WITH k AS (SELECT journal_id, lower(journal_name) AS k, 1 AS p FROM journal_list UNION ALL SELECT journal_id, lower(short_name), 2 FROM journal_list WHERE short_name IS NOT NULL
UNION ALL SELECT journal_id, lower(replace(journal_name, ' of', '')), 3 FROM journal_list),
v AS (SELECT DISTINCT journal, lower(regexp_replace(journal, '^ +| +$', '', 'g')) AS k FROM articles_df WHERE journal IS NOT NULL)
SELECT journal, journal_id FROM (SELECT journal, journal_id, row_number() OVER (PARTITION BY journal ORDER BY p, journal_id) AS r FROM v JOIN k USING (k)) WHERE r = 1""")
def jn_hier_lookup(spark, d):
    j = table(spark, d, "journal_list")
    keys = j.select("journal_id", F.lower("journal_name").alias("k"), F.lit(1).alias("p"))
    keys = keys.unionAll(j.where("short_name is not null").select("journal_id", F.lower("short_name"), F.lit(2)))
    keys = keys.unionAll(j.select("journal_id", F.lower(F.regexp_replace("journal_name", " of", "")), F.lit(3)))
    best = keys.groupBy("k").agg(F.min(F.struct("p", "journal_id")).alias("b"))
    v = table(spark, d, "articles_df").where("journal is not null").select("journal").distinct().withColumn("k", F.lower(F.trim("journal")))
    return v.join(best, "k").select("journal", F.col("b.journal_id").alias("journal_id"))


@query("WITH c AS (SELECT DISTINCT lower(exact_study_type) AS c FROM study_type_df WHERE exact_study_type IS NOT NULL) SELECT id, c AS concept FROM study_type_df, c WHERE contains(lower(title), c)")
def jn_contains(spark, d):
    """Titles that contain a concept: concepts sharing a word with the title first, then the containment."""
    s = table(spark, d, "study_type_df")
    c = s.where("exact_study_type is not null").select(F.lower("exact_study_type").alias("concept")).distinct()
    c = c.withColumn("w", F.split_part("concept", F.lit(" "), F.lit(1)))
    t = s.select("id", F.lower("title").alias("t"))
    words = t.select("id", "t", F.explode(F.array_distinct(F.split("t", "[^a-z]+"))).alias("w"))
    return words.join(c, "w").where("contains(t, concept)").select("id", "concept")


@query("""SELECT a.affiliation_id AS id_a, b.affiliation_id AS id_b FROM affiliation_map a JOIN affiliation_map b ON a.country = b.country AND a.affiliation_id < b.affiliation_id
WHERE 1 - levenshtein(lower(a.normalized_name), lower(b.normalized_name)) / greatest(length(a.normalized_name), length(b.normalized_name)) >= 0.7""")
def jn_pair_cross(spark, d):
    """Similar names within one country; similar names first, by shared segments, then the country."""
    a = table(spark, d, "affiliation_map").select("affiliation_id", "country", F.lower("normalized_name").alias("n"))
    near = merging.similar_pairs(a.select(F.col("n").alias("item")), 0.7)
    near = near.unionAll(a.select(F.col("n").alias("item"), F.col("n").alias("other")).distinct()).toDF("na", "nb")
    pairs = near.join(a.toDF("id_a", "country_a", "na"), "na").join(a.toDF("id_b", "country_b", "nb"), "nb")
    return pairs.where("id_a < id_b and country_a = country_b").select("id_a", "id_b")


# ---- aggregations

_COUNTS = {
    "ag_value_counts": ("SELECT dataset, count(*) AS n FROM articles_df GROUP BY dataset", lambda s, d: table(s, d, "articles_df").groupBy("dataset").agg(F.count("*").alias("n"))),
    "ag_cat_count": ("SELECT split_name, count(*) AS n, count(*) FILTER (WHERE exact_study_type <> 'No category') AS n_labelled FROM study_type_df GROUP BY split_name",
                     lambda s, d: table(s, d, "study_type_df").groupBy("split_name").agg(F.count("*").alias("n"), F.count_if(F.col("exact_study_type") != "No category").alias("n_labelled"))),
    "ag_counter_list": ("SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM big_dataset) GROUP BY topic", lambda s, d: table(s, d, "big_dataset").select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))),
    "ag_collect_set": ("SELECT dataset, list_sort(list_distinct(list(topic))) AS topics FROM (SELECT dataset, unnest(topics) AS topic FROM big_dataset) WHERE topic IS NOT NULL GROUP BY dataset",
                       lambda s, d: table(s, d, "big_dataset").select("dataset", F.explode("topics").alias("t")).where("t is not null").distinct().groupBy("dataset").agg(F.array_sort(F.collect_set("t")).alias("topics"))),
    "ag_distinct_docs": ("SELECT dataset, count(DISTINCT article_id) AS n_articles, count(DISTINCT id) AS n_records FROM big_dataset GROUP BY dataset",
                         lambda s, d: table(s, d, "big_dataset").groupBy("dataset").agg(F.count_distinct("article_id").alias("n_articles"), F.count_distinct("id").alias("n_records"))),
    "ag_doc_freq": (f"SELECT w, count(DISTINCT id) AS df FROM (SELECT id, unnest({sql.tokens('title')}) AS w FROM articles_df) GROUP BY w",
                    lambda s, d: table(s, d, "articles_df").select("id", F.explode(F.array_distinct(T.token_list("title"))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))),
    "ag_mean_list": ("SELECT label, round(avg(x), 3) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label",
                     lambda s, d: table(s, d, "embeddings").select("label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("t"), F.size("embedding").alias("n")).groupBy("label").agg((F.round(F.sum("t") / F.sum("n"), 3) + F.lit(0.0)).alias("mean"))),
    "ag_norm_stats": ("SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
                      lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))),
    "ag_topic_max": ("SELECT event_type, max(value) AS hi, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY event_type",
                     lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.max("value").alias("hi"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))),
}
for _name, (_sql, _run) in _COUNTS.items():
    query(_sql, _name)(_run)


@query("""WITH c AS (SELECT article_id, topic, count(*) AS n FROM (SELECT article_id, unnest(topics) AS topic FROM big_dataset WHERE article_id IS NOT NULL) WHERE topic IS NOT NULL GROUP BY ALL)
SELECT article_id, list_sort(list(topic)) AS top FROM (SELECT *, rank() OVER (PARTITION BY article_id ORDER BY n DESC) AS r FROM c) WHERE r = 1 GROUP BY article_id""")
def ag_max_ties(spark, d):
    c = table(spark, d, "big_dataset").where("article_id is not null").select("article_id", F.explode("topics").alias("topic")).where("topic is not null")
    c = c.groupBy("article_id", "topic").agg(F.count("*").alias("n"))
    r = F.rank().over(Window.partitionBy("article_id").orderBy(F.desc("n")))
    return c.withColumn("r", r).where("r = 1").groupBy("article_id").agg(F.array_sort(F.collect_list("topic")).alias("top"))


@query("""WITH c AS (SELECT journal, dataset, count(*) AS n FROM articles_df WHERE journal IS NOT NULL AND dataset IS NOT NULL GROUP BY ALL)
SELECT journal, dataset AS main_dataset FROM (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY n DESC, dataset) AS r FROM c) WHERE r = 1""")
def ag_major(spark, d):
    c = table(spark, d, "articles_df").where("journal is not null and dataset is not null").groupBy("journal", "dataset").agg(F.count("*").alias("n"))
    return c.groupBy("journal").agg(F.min(F.struct(-F.col("n"), "dataset")).alias("b")).select("journal", F.col("b.dataset").alias("main_dataset"))


_CLUSTERS = r"""r AS (SELECT id, unnest(string_split(intervention_labels, ';')) AS x, topics FROM big_dataset WHERE id IS NOT NULL),
c AS (SELECT DISTINCT id, trim(lower(x)) AS cluster, topics FROM r WHERE trim(x) <> ''),
f AS (SELECT DISTINCT id, lower(trim(t)) AS focus FROM (SELECT id, unnest(topics) AS t FROM big_dataset WHERE id IS NOT NULL) WHERE trim(t) <> ''),
n AS (SELECT focus, floor(count(*) * 0.02)::BIGINT AS least FROM f GROUP BY focus),
m AS (SELECT cluster, min(least) AS least FROM (SELECT DISTINCT cluster, focus FROM (SELECT cluster, lower(trim(unnest(topics))) AS focus FROM c)) JOIN n USING (focus) GROUP BY cluster)"""


@query(f"""WITH {_CLUSTERS} SELECT cluster, count(DISTINCT id) AS n_docs, least(10, coalesce(any_value(least), 10))::BIGINT AS threshold FROM c LEFT JOIN m USING (cluster)
GROUP BY cluster HAVING count(DISTINCT id) >= least(10, coalesce(any_value(least), 10))""")
def ag_min_thr(spark, d):
    """Clusters (labels) in at least as many documents as 2 % of those of their rarest focus (topic), 10 at most; without any focus 10."""
    b = table(spark, d, "big_dataset").where("id is not null")
    c = b.select("id", "topics", F.explode(F.split("intervention_labels", ";")).alias("x"))
    c = c.select("id", "topics", F.trim(F.lower("x")).alias("cluster")).where("cluster <> ''")
    clean = F.lower(F.trim("t")).alias("focus")
    f = b.select("id", F.explode("topics").alias("t")).select("id", clean).where("focus <> ''").distinct()
    n = f.groupBy("focus").agg(F.floor(F.count("*") * 0.02).alias("least"))
    m = c.select("cluster", F.explode("topics").alias("t")).select("cluster", clean).distinct().join(n, "focus").groupBy("cluster").agg(F.min("least").alias("least"))
    docs = c.groupBy("cluster").agg(F.count_distinct("id").alias("n_docs"))
    out = docs.join(m, "cluster", "left").select("cluster", "n_docs", F.least(F.lit(10), F.coalesce("least", F.lit(10))).cast("bigint").alias("threshold"))
    return out.where("n_docs >= threshold")


@query("""WITH a AS (SELECT dataset, bool_or(list_contains(topics, 'maize')) AS m, bool_or(list_contains(topics, 'rice')) AS r, bool_or(list_contains(topics, 'honey')) AS h FROM big_dataset GROUP BY dataset)
SELECT (m::INT + 2 * r::INT + 4 * h::INT) AS code, count(*) AS n FROM (SELECT coalesce(m, false) AS m, coalesce(r, false) AS r, coalesce(h, false) AS h FROM a) GROUP BY code""")
def ag_overlap_code(spark, d):
    has = lambda x: F.max(F.array_contains("topics", x))
    a = table(spark, d, "big_dataset").groupBy("dataset").agg(has("maize").alias("m"), has("rice").alias("r"), has("honey").alias("h"))
    return a.select(D.membership([F.col("m"), F.col("r"), F.col("h")]).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, length(embedding))) AS p FROM embeddings)
SELECT label, p::INT AS dim, round(avg(x), 5) AS mean FROM e GROUP BY label, p""")
def ag_class_mean(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("""SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY id) AS r FROM articles_df WHERE title IS NOT NULL) WHERE r = 1""")
def ag_dedup_first(spark, d):
    a = table(spark, d, "articles_df").where("title is not null").select("id", "title", F.lower(F.trim("title")).alias("k"))
    return a.groupBy("k").agg(F.min(F.struct("id", "title")).alias("b")).select("b.id", "b.title")


@query("""SELECT article_id, list_sort(list_distinct(list(topic))) AS topics FROM (SELECT article_id, unnest(topics) AS topic FROM big_dataset WHERE article_id IS NOT NULL) WHERE topic IS NOT NULL GROUP BY article_id""")
def ag_merge_dups(spark, d):
    e = table(spark, d, "big_dataset").where("article_id is not null").select("article_id", F.explode("topics").alias("t")).where("t is not null")
    return e.groupBy("article_id").agg(F.array_sort(F.collect_set("t")).alias("topics"))


# ---- windows, ranking, limits


@query("SELECT dataset, journal, n FROM (SELECT dataset, journal, count(*) AS n, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, journal) AS r FROM articles_df WHERE journal IS NOT NULL GROUP BY dataset, journal) WHERE r = 1")
def wn_rank_count(spark, d):
    c = table(spark, d, "articles_df").where("journal is not null").groupBy("dataset", "journal").agg(F.count("*").alias("n"))
    return R.first_of(c, ["dataset"], [F.desc("n"), "journal"])


@query("""WITH c AS (SELECT dataset, topic, count(*) AS n FROM (SELECT dataset, unnest(topics) AS topic FROM big_dataset) WHERE topic IS NOT NULL GROUP BY ALL)
SELECT dataset, topic, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, topic) AS r FROM c) WHERE r <= 5""")
def wn_topn_group(spark, d):
    c = table(spark, d, "big_dataset").select("dataset", F.explode("topics").alias("topic")).where("topic is not null").groupBy("dataset", "topic").agg(F.count("*").alias("n"))
    return R.first_n(c, ["dataset"], [F.desc("n"), "topic"], 5)


_SHARES = """t AS (SELECT dataset, lower(trim(unnest(topics))) AS topic FROM big_dataset WHERE dataset IS NOT NULL),
c AS (SELECT dataset, topic, count(*) AS n FROM t WHERE topic <> '' GROUP BY ALL), p AS (SELECT dataset, topic, n / sum(n) OVER (PARTITION BY dataset) AS p FROM c)"""


def _shares(spark, d):
    """``dataset, topic, p``: share of each topic in the topics of a source."""
    t = table(spark, d, "big_dataset").where("dataset is not null").select("dataset", F.explode("topics").alias("t"))
    c = t.select("dataset", F.lower(F.trim("t")).alias("topic")).where("topic <> ''").groupBy("dataset", "topic").agg(F.count("*").alias("n"))
    return c.join(c.groupBy("dataset").agg(F.sum("n").alias("whole")), "dataset").select("dataset", "topic", (F.col("n") / F.col("whole")).alias("p"))


@query(f"""WITH {_SHARES} SELECT dataset, topic FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p DESC, topic) AS r, p / max(p) OVER (PARTITION BY topic) AS q FROM p) WHERE r <= 3 OR q >= 0.3""")
def wn_top3_thr(spark, d):
    """Topics among a source's top three, or at 0.3 of the topic's maximum; the maxima are an aggregate, not a window."""
    p = _shares(spark, d)
    top = p.groupBy("topic").agg(F.max("p").alias("hi"))
    r = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("p"), "topic"))
    return p.join(top, "topic").withColumn("r", r).where("r <= 3 or p / hi >= 0.3").select("dataset", "topic")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(0, length(v))) AS p FROM e) GROUP BY label, p),
c AS (SELECT label, list(x ORDER BY p) AS mean FROM m GROUP BY label), s AS (SELECT vec_id, e.label, round(list_cosine_similarity(v, mean), 9) AS s FROM e JOIN c USING (label))
SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 20 OR s >= 0.5""")
def wn_topn_or_sim(spark, d):
    """Of each label the 20 vectors nearest to its mean, and all others of cosine 0.5 or more."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda y: y.x).alias("mean"))  # a row per label
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda i, j: i + j)
    s = F.round(dot("v", "mean") / F.sqrt(dot("v", "v") * dot("mean", "mean")), 9)
    scored = e.join(c, "label").select("vec_id", "label", s.alias("s"))
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))
    return scored.withColumn("r", r).where("r <= 20 or s >= 0.5").select("vec_id", "label")


@query("SELECT id, exact_study_type FROM (SELECT id, exact_study_type, row_number() OVER (PARTITION BY exact_study_type ORDER BY id) AS r FROM study_type_df WHERE exact_study_type IS NOT NULL) WHERE r <= 20")
def wn_first_n(spark, d):
    s = table(spark, d, "study_type_df").where("exact_study_type is not null").select("id", "exact_study_type")
    return R.first_n(s, ["exact_study_type"], ["id"], 20)


@query("SELECT journal, n, row_number() OVER (ORDER BY n DESC, length(journal), journal) AS pos FROM (SELECT journal, count(*) AS n FROM articles_df WHERE journal IS NOT NULL GROUP BY journal) QUALIFY pos <= 50")
def srt_multi(spark, d):
    c = table(spark, d, "articles_df").where("journal is not null").groupBy("journal").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), F.length("journal"), "journal").limit(50)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), F.length("journal"), "journal")).cast("bigint"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT dataset, n, rank::INT AS rank, ((rank - 1) // 25)::INT AS page FROM (SELECT dataset, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, dataset) AS rank FROM big_dataset GROUP BY dataset)")
def lim_page(spark, d):
    return D.pages(table(spark, d, "big_dataset").groupBy("dataset").agg(F.count("*").alias("n")), [F.desc("n"), "dataset"], 25)


@query("SELECT journal_id, list_transform(list_sort(list_transform(string_split(lower(journal_name), ' '), lambda w: {'n': -length(w), 'w': w})), lambda s: s.w) AS words FROM journal_list")
def srt_len_words(spark, d):
    w = F.array_sort(F.transform(F.split(F.lower("journal_name"), " "), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return table(spark, d, "journal_list").select("journal_id", F.transform(w, lambda s: s.w).alias("words"))


@query(r"""WITH t AS (SELECT id, string_split(regexp_replace(lower(title), '\s+', ' ', 'g'), ' ') AS l FROM articles_df), p AS (SELECT id, l, unnest(l) AS w, unnest(range(0, length(l))) AS i FROM t)
SELECT id, i::INT AS at, w AS number, array_to_string(l[greatest(i - 3, 0) + 1:i + 4], ' ') AS context FROM p WHERE regexp_matches(w, '^[0-9]+$')""")
def win_ctx(spark, d):
    t = table(spark, d, "articles_df").select("id", F.split(F.regexp_replace(F.lower("title"), r"\s+", " "), " ").alias("l"))
    p = t.select("id", "l", F.posexplode("l").alias("at", "number")).where("number rlike '^[0-9]+$'")
    start = F.greatest(F.col("at") - 3, F.lit(0))
    return p.select("id", "at", "number", F.array_join(F.slice("l", start + 1, F.col("at") - start + 4), " ").alias("context"))


# ---- set operations


@query("SELECT id, title, journal, NULL AS exact_study_type FROM articles_df UNION ALL SELECT id, title, NULL, exact_study_type FROM study_type_df")
def set_union_all(spark, d):
    a = table(spark, d, "articles_df").select("id", "title", "journal")
    return a.unionByName(table(spark, d, "study_type_df").select("id", "title", "exact_study_type"), allowMissingColumns=True)


_HAS = "SELECT DISTINCT id FROM (SELECT id, unnest(" + sql.tokens("title") + ") AS w FROM articles_df) WHERE w = '@'"


def _having(spark, d, word):
    return table(spark, d, "articles_df").where(F.array_contains(T.token_list("title"), word)).select("id")


@query(f"({_HAS.replace('@', 'maize')}) UNION ({_HAS.replace('@', 'sorghum')})")
def set_union_docs(spark, d):
    return _having(spark, d, "maize").union(_having(spark, d, "sorghum")).distinct()


@query(f"({_HAS.replace('@', 'maize')}) INTERSECT ({_HAS.replace('@', 'evidence')})")
def set_intersect_docs(spark, d):
    return _having(spark, d, "maize").intersect(_having(spark, d, "evidence"))


@query(f"({_HAS.replace('@', 'maize')}) EXCEPT ({_HAS.replace('@', 'evidence')})")
def set_minus_docs(spark, d):
    return _having(spark, d, "maize").join(_having(spark, d, "evidence"), "id", "left_anti")


@query("""SELECT id, CASE WHEN length(l) > 1 THEN list_filter(l, lambda x: x <> 'No category') ELSE l END AS labels
FROM (SELECT id, list_filter(list_distinct([extended_study_type, exact_study_type]), lambda x: x IS NOT NULL) AS l FROM study_type_df WHERE extended_study_type IS NOT NULL AND exact_study_type IS NOT NULL AND extended_study_type < exact_study_type)""")
def set_except_labels(spark, d):
    s = table(spark, d, "study_type_df").where("extended_study_type < exact_study_type")
    l = F.array_distinct(F.array("extended_study_type", "exact_study_type"))
    s = s.select("id", F.when(F.size(l) > 1, F.array_except(l, F.array(F.lit("No category")))).otherwise(l).alias("labels"))
    return s.select("id", F.array_sort("labels").alias("labels"))


@query("""SELECT min(id) AS id, list_sort(list_distinct(list(dataset))) AS datasets FROM articles_df WHERE title IS NOT NULL GROUP BY lower(title), year, lower(coalesce(journal, ''))""")
def set_dedup_key(spark, d):
    a = table(spark, d, "articles_df").where("title is not null")
    g = a.groupBy(F.lower("title").alias("t"), "year", F.lower(F.coalesce("journal", F.lit(""))).alias("j"))
    return g.agg(F.min("id").alias("id"), F.array_sort(F.collect_set("dataset")).alias("datasets")).select("id", "datasets")


@query("""SELECT affiliation_id, array_to_string(list_reverse(list_transform(list_sort(list_transform(list_distinct(r), lambda w: {'p': list_position(r, w), 'w': w})), lambda s: s.w)), ' ') AS last_kept,
array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda w: {'p': list_position(l, w), 'w': w})), lambda s: s.w), ' ') AS first_kept
FROM (SELECT affiliation_id, string_split(normalized_name || ' ' || city || ' ' || country, ' ') AS l, list_reverse(string_split(normalized_name || ' ' || city || ' ' || country, ' ')) AS r FROM affiliation_map)""")
def set_dedup_words(spark, d):
    w = F.split(F.concat_ws(" ", "normalized_name", "city", "country"), " ")
    return table(spark, d, "affiliation_map").select(
        "affiliation_id",
        F.array_join(F.reverse(F.array_distinct(F.reverse(w))), " ").alias("last_kept"),
        F.array_join(F.array_distinct(w), " ").alias("first_kept"),
    )


@query("""WITH r AS (SELECT exact_study_type FROM study_type_df WHERE exact_study_type IS NOT NULL GROUP BY ALL HAVING count(*) * 20 < (SELECT count(*) FROM study_type_df)),
x AS (SELECT id, exact_study_type IN (SELECT exact_study_type FROM r) AS rare FROM study_type_df)
SELECT id, unnest(range(0, CASE WHEN rare THEN 3 ELSE 1 END))::INT AS copy FROM x""")
def set_oversample(spark, d):
    s = table(spark, d, "study_type_df").select("id", "exact_study_type")
    n = s.count()
    rare = s.where("exact_study_type is not null").groupBy("exact_study_type").count().where(F.col("count") * 20 < n)
    rare = rare.select("exact_study_type", F.lit(2).alias("last"))
    return s.join(rare, "exact_study_type", "left").select("id", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("copy"))


# ---- dashboards

_EDGES = [1990, 2000, 2005, 2010, 2015, 2020, 2025]
_CASE = "CASE " + " ".join(f"WHEN {{y}} >= {a} AND {{y}} < {b} THEN {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " ELSE -1 END"


@query(f"SELECT id, {_CASE.format(y='year')} AS bucket FROM articles_df")
def pv_bucket(spark, d):
    return table(spark, d, "articles_df").select("id", D.bucket(F.col("year"), _EDGES).alias("bucket"))


@query(f"""WITH r AS (SELECT topics, {_CASE.format(y='year')} AS bucket FROM big_dataset), k AS (SELECT * FROM r WHERE bucket >= 0), t AS (SELECT bucket, count(*) AS t FROM k GROUP BY bucket)
SELECT label, bucket, n, round(n * 100 / t, 6) AS pct FROM (SELECT label, bucket, count(*) AS n FROM (SELECT unnest(list_distinct(topics)) AS label, bucket FROM k) WHERE label IS NOT NULL GROUP BY ALL) JOIN t USING (bucket)""")
def pv_topic_year(spark, d):
    return D.label_by_bucket(table(spark, d, "big_dataset"), "topics", "year", _EDGES, share=True).where("label is not null")


_CLASSES = ["Technology intervention", "Socioeconomic intervention", "Ecosystem intervention"]


@query("SELECT dataset, " + ", ".join(f"count(*) FILTER (WHERE contains(intervention_labels, '{c}')) AS c{k}" for k, c in enumerate(_CLASSES)) + " FROM big_dataset GROUP BY dataset")
def pv_district(spark, d):
    return table(spark, d, "big_dataset").groupBy("dataset").agg(*(F.count_if(F.contains("intervention_labels", F.lit(c))).alias(f"c{k}") for k, c in enumerate(_CLASSES)))


@query("""WITH e AS (SELECT dataset, lower(trim(x)) AS label FROM (SELECT dataset, unnest(string_split(intervention_labels, ';')) AS x FROM big_dataset))
SELECT dataset, count(DISTINCT label) AS n_labels FROM e WHERE label <> '' GROUP BY dataset""")
def pv_district_unique(spark, d):
    e = table(spark, d, "big_dataset").select("dataset", F.explode(F.split("intervention_labels", ";")).alias("x")).select("dataset", F.lower(F.trim("x")).alias("label"))
    return e.where("label <> ''").groupBy("dataset").agg(F.count_distinct("label").alias("n_labels"))


@query("SELECT dataset, (coalesce(contains(intervention_labels, 'Technology'), false)::INT + 2 * coalesce(contains(intervention_labels, 'Socioeconomic'), false)::INT + 4 * coalesce(contains(intervention_labels, 'Ecosystem'), false)::INT) AS code, count(*) AS n FROM big_dataset GROUP BY ALL")
def pv_district_overlap(spark, d):
    code = D.membership([F.contains("intervention_labels", F.lit(x)) for x in ("Technology", "Socioeconomic", "Ecosystem")])
    return table(spark, d, "big_dataset").groupBy("dataset", code.alias("code")).agg(F.count("*").alias("n"))


@query(r"SELECT regexp_extract(title, '#([0-9]+)', 1) AS number, count(*) AS n FROM articles_df WHERE regexp_matches(title, '#[0-9]+') GROUP BY 1")
def pv_topic_total(spark, d):
    t = table(spark, d, "articles_df").where("title rlike '#[0-9]+'")
    return t.groupBy(F.regexp_extract("title", "#([0-9]+)", 1).alias("number")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(topics)) AS label FROM big_dataset WHERE list_contains(topics, 'maize')) WHERE label <> 'maize' GROUP BY label")
def pv_topic_cooc(spark, d):
    return D.co_labels(table(spark, d, "big_dataset"), "id", "topics", "maize")


_CO = "SELECT label, count(*) AS \"all\", " + ", ".join(f"count(*) FILTER (WHERE contains(intervention_labels, '{c}')) AS c{k}" for k, c in enumerate(_CLASSES)) + " FROM (SELECT unnest(list_distinct(topics)) AS label, intervention_labels FROM big_dataset WHERE list_contains(topics, 'maize')) WHERE label <> 'maize' GROUP BY label"


def _co_classes(spark, d):
    own = table(spark, d, "big_dataset").where(F.array_contains("topics", "maize"))
    e = own.select(F.explode(F.array_distinct("topics")).alias("label"), "intervention_labels").where("label <> 'maize'")
    return e.groupBy("label").agg(F.count("*").alias("all"), *(F.count_if(F.contains("intervention_labels", F.lit(c))).alias(f"c{k}") for k, c in enumerate(_CLASSES)))


@query(_CO)
def pv_cooc_interv(spark, d):
    return _co_classes(spark, d)


@query('SELECT label, ' + ", ".join(f'round(100 * c{k} / "all", 6) AS c{k}' for k in range(3)) + f" FROM ({_CO})")
def pv_cooc_interv_rel(spark, d):
    return _co_classes(spark, d).select("label", *(F.round(100 * F.col(f"c{k}") / F.col("all"), 6).alias(f"c{k}") for k in range(3)))


@query("""SELECT topic, label, count(*) AS n FROM (SELECT topic, lower(trim(l)) AS label FROM (SELECT unnest(topics) AS topic, intervention_labels FROM big_dataset) , LATERAL (SELECT unnest(string_split(intervention_labels, ';')) AS l)) WHERE label <> '' AND topic IS NOT NULL GROUP BY ALL""")
def pv_label_topic(spark, d):
    e = table(spark, d, "big_dataset").select(F.explode("topics").alias("topic"), "intervention_labels")
    e = e.select("topic", F.explode(F.split("intervention_labels", ";")).alias("l")).select("topic", F.lower(F.trim("l")).alias("label"))
    return e.where("label <> '' and topic is not null").groupBy("topic", "label").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT country, CASE WHEN contains(lower(a.abstract), 'smallholder') THEN 'small scale' WHEN contains(lower(a.abstract), 'farmer') THEN 'farmers' ELSE 'undefined' END AS kind
FROM (SELECT abstract, trim(list_last(string_split(raw_affiliation, ','))) AS country FROM articles_df WHERE raw_affiliation IS NOT NULL) a WHERE country IN (SELECT country FROM affiliation_map))
SELECT country, count(*) FILTER (WHERE kind = 'small scale') AS small_scale, count(*) FILTER (WHERE kind = 'farmers') AS farmers, count(*) FILTER (WHERE kind = 'undefined') AS undefined FROM k GROUP BY country""")
def pv_pop_region(spark, d):
    a = table(spark, d, "articles_df").where("raw_affiliation is not null").select("abstract", F.trim(F.element_at(F.split("raw_affiliation", ","), -1)).alias("country"))
    known = table(spark, d, "affiliation_map").select("country").distinct()
    kind = F.when(F.contains(F.lower("abstract"), F.lit("smallholder")), "small_scale").when(F.contains(F.lower("abstract"), F.lit("farmer")), "farmers").otherwise("undefined")
    k = a.join(known, "country", "left_semi").withColumn("kind", kind)
    return k.groupBy("country").agg(*(F.count_if(F.col("kind") == x).alias(x) for x in ("small_scale", "farmers", "undefined")))
