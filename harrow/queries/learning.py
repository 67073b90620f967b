"""Vectors, models, metrics, samples, sources, sinks, incremental runs and the pipeline."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, merging, models, wordvectors
from ..plans import pipeline
from ..session import cut, scratch, spread_scan, table
from ..sources import files
from ..streaming import incremental
from . import query, sql

A = "articles_df"

# ---- vectors and models


@query(f"""WITH w AS (SELECT {sql.tokens('abstract')} AS l FROM articles_df), u AS (SELECT w, count(*) AS n FROM (SELECT unnest(l) AS w FROM w) GROUP BY w),
p AS (SELECT p, count(*) AS n_ab FROM (SELECT unnest(list_transform(range(1, length(l)), lambda i: l[i] || ' ' || l[i + 1])) AS p FROM w) GROUP BY p HAVING count(*) >= 5)
SELECT a.w AS a, b.w AS b, n_ab, round((n_ab - 5) * (SELECT count(*) FROM u) / (a.n * b.n), 6) AS score FROM p JOIN u a ON a.w = split_part(p, ' ', 1) JOIN u b ON b.w = split_part(p, ' ', 2) WHERE (n_ab - 5) * (SELECT count(*) FROM u) / (a.n * b.n) > 10""")
def ml_phrases(spark, d):
    words = spread_scan(table(spark, d, A).select("id", "abstract")).select("id", T.token_list("abstract").alias("l"))
    return models.phrases(words, "id", "l").withColumn("score", F.round("score", 6))


@query()
def ml_w2v(spark, d):
    """The twenty terms nearest to the most frequent one, by vectors trained on titles and abstracts; training isn't SQL."""
    text = F.concat_ws(". ", "title", "abstract").alias("t")
    words = cut(T.token_lists(spread_scan(table(spark, d, A).select(text)), "t").where("size(l) > 1"))
    names, vectors = wordvectors.trained(words, "l", dim=300, least=7, window=6, rounds=10, seed=1)
    found = wordvectors.near(names, vectors, names[0], 20) if names else []
    return spark.createDataFrame(found, "word string, similarity double").withColumn("similarity", F.round("similarity", 4))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)
SELECT query_id, id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS r FROM q JOIN v ON q.vec_id <> v.vec_id) WHERE r <= 10""")
def ml_similar(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return models.nearest(e.where("vec_id % 20 = 0"), e, 10).withColumn("similarity", F.round("similarity", 6))


@query("""WITH e AS (SELECT label, unnest(range(0, length(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings), w AS (SELECT vec_id, 1.0 + vec_id % 3 AS w FROM embeddings)
SELECT label, dim, round(sum(x * w) / sum(w), 5) + 0.0 AS mean FROM e JOIN w USING (vec_id) GROUP BY label, dim""")
def ml_mean_vec(spark, d):
    """Weighted mean vectors of groups."""
    e = table(spark, d, "embeddings").select("label", (F.lit(1.0) + F.col("vec_id") % 3).alias("w"), F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", "dim").agg((F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 5) + F.lit(0.0)).alias("mean"))


@query(f"""WITH t AS (SELECT DISTINCT id, {sql.tokens('title')} AS l FROM articles_df), s AS (SELECT DISTINCT w, sup FROM (SELECT unnest(l) AS w, unnest(list_transform(range(1, length(l)), lambda i: l[i] || ' ' || l[i + 1])) AS sup FROM t WHERE false) UNION SELECT unnest([l[i], l[i + 1]]), l[i] || ' ' || l[i + 1] FROM (SELECT l, unnest(range(1, length(l))) AS i FROM t))
SELECT w, count(DISTINCT sup) AS n_super FROM s GROUP BY w""")
def ml_subphr_idx(spark, d):
    """Words with the number of distinct two-word expressions they stand in."""
    p = table(spark, d, A).select(T.token_list("title").alias("l")).select(F.explode(T.bigrams(F.col("l"))).alias("sup")).distinct()
    return p.select(F.explode(F.split("sup", " ")).alias("w"), "sup").groupBy("w").agg(F.count_distinct("sup").alias("n_super"))


@query(f"""WITH w AS (SELECT DISTINCT id, unnest({sql.tokens('title')}) AS term FROM articles_df), f AS (SELECT term, count(*) AS df FROM w GROUP BY term)
SELECT term, df, CASE WHEN {sql.abbreviation('term')} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM f WHERE df <= 0.3 * (SELECT count(*) FROM articles_df) AND df >= 0.0015 * (SELECT count(*) FROM articles_df)""")
def ml_tfidf_topic(spark, d):
    """The filtered vocabulary of the topic model with its term weights."""
    a = table(spark, d, A)
    n = a.count()
    f = a.select("id", F.explode(F.array_distinct(T.token_list("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return f.where((F.col("df") <= 0.3 * n) & (F.col("df") >= 0.0015 * n)).withColumn("weight", F.when(T.is_abbreviation("term"), 2.0).otherwise(1.0))


def _topics(spark, d):
    text = table(spark, d, A).select("id", F.concat_ws(". ", "title", "abstract").alias("text"))
    return models.text_topics(text, "text", k=8)


@query()
def ml_nmf(spark, d):
    """Topics of the titles: the ten words of each."""
    _, words = _topics(spark, d)
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return words.withColumn("r", r).where("r <= 10").select("topic", "term", F.round("weight", 4).alias("weight"))


@query()
def ml_topic_fill(spark, d):
    """Topics of each article by rank and by nearness to the topic's greatest weight."""
    own, _ = _topics(spark, d)
    return models.topics_of(own).groupBy("id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


@query("""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.label, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS coherence FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def ml_coherence(spark, d):
    """Mean cosine of all pairs of a group, from the sum of its unit vectors: no pair is made."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))
    sums = e.select("label", "vec_id", "norm", F.posexplode("v").alias("p", "x")).groupBy("label", "p").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.first("n").alias("n"))
    return whole.where("n > 1").select("label", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("coherence"))


@query("""WITH k AS (SELECT id, list_distinct(list_filter(list_transform(string_split(lower(coalesce(keywords, '')), ';'), lambda w: trim(w)), lambda w: w <> '')) AS k FROM articles_df),
t AS (SELECT article_id AS id, list_distinct(list(lower(trim(x)))) AS t FROM (SELECT article_id, unnest(topics) AS x FROM big_dataset WHERE article_id IS NOT NULL) WHERE trim(x) <> '' GROUP BY article_id),
j AS (SELECT id, k, t, length(list_filter(t, lambda a: length(list_filter(k, lambda b: a = b)) > 0)) AS hit FROM k JOIN t USING (id) WHERE length(k) > 0)
SELECT id, round(hit / length(t), 6) AS "precision", round(hit / length(k), 6) AS recall FROM j""")
def ml_kw_eval(spark, d):
    """Authors' keywords against assigned topics."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda w: F.trim(w)), lambda w: w != ""))
    k = table(spark, d, A).select("id", clean(F.split(F.lower(F.coalesce("keywords", F.lit(""))), ";")).alias("k")).where("size(k) > 0")
    t = table(spark, d, "big_dataset").where("article_id is not null").select(F.col("article_id").alias("id"), F.explode("topics").alias("x"))
    t = t.select("id", F.lower(F.trim("x")).alias("x")).where("x <> ''").groupBy("id").agg(F.collect_set("x").alias("t"))
    hit = F.size(F.array_intersect("t", "k"))
    return k.join(t, "id").select("id", F.round(hit / F.size("t"), 6).alias("precision"), F.round(hit / F.size("k"), 6).alias("recall"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(0, length(v))) AS p FROM e) GROUP BY label, p),
c AS (SELECT label, list(x ORDER BY p) AS mean FROM m GROUP BY label), d AS (SELECT vec_id, list(list_distance(v, mean) ORDER BY c.label) AS d FROM e, c GROUP BY vec_id),
x AS (SELECT vec_id, list_transform(d, lambda y: exp((y - list_avg(d)) / greatest(list_stddev_pop(d), 1e-12))) AS x FROM d)
SELECT vec_id, list_transform(x, lambda y: round(y / list_sum(x) - 0.5, 5)) AS scores FROM x""")
def ml_dist_softmax(spark, d):
    e = table(spark, d, "embeddings")
    return models.class_distances(e, "vec_id", "embedding", "label").select("vec_id", F.transform("scores", lambda x: F.round(x, 5)).alias("scores"))


def _labelled(spark, d):
    s = table(spark, d, "study_type_df").where("abstract is not null and exact_study_type is not null")
    return s.select("id", "split_name", F.concat_ws(". ", "title", "abstract").alias("text"), F.col("exact_study_type").alias("label"))


@query()
def ml_study_labelers(spark, d):
    """Study types of the test split by a classifier fitted on the training split."""
    rows = _labelled(spark, d)
    model = models.TextClassifier().fit(rows.where("split_name = 'train'"))
    test = rows.where("split_name = 'test'").select("id", "text")
    return model.predict(test).select("id", "predicted", F.round("probability", 4).alias("probability"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), e AS (SELECT label, unnest(range(0, length(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, list(v ORDER BY p) AS m FROM (SELECT label, p, avg(x) AS v FROM e GROUP BY ALL) GROUP BY label), s AS (SELECT label FROM c ORDER BY n, label LIMIT 3)
SELECT label, target FROM (SELECT a.label, b.label AS target, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.m, b.m) DESC, b.label) AS r FROM m a JOIN m b ON a.label <> b.label WHERE a.label IN (FROM s) AND b.label NOT IN (FROM s)) WHERE r = 1""")
def ml_reassign(spark, d):
    """The three smallest groups, each given to the large group of the most similar mean (a row per group)."""
    e = table(spark, d, "embeddings")
    small = e.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label").limit(3).select("label")
    m = e.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("v"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s.v).alias("embedding"))
    a, b = m.join(small, "label", "left_semi"), m.join(small, "label", "left_anti")
    found = models.nearest(a.withColumnRenamed("label", "vec_id"), b.withColumnRenamed("label", "vec_id"), 1)
    kind = e.schema["label"].dataType
    return found.select(F.col("query_id").cast(kind).alias("label"), F.col("id").cast(kind).alias("target"))


@query()
def ml_cluster(spark, d):
    """``node, group`` of every vector: classes of three or more, linked by mutual neighbours of one label and named after
    the member nearest to their mean; the others are their own class."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    c = merging.components(models.mutual_neighbours(e, 3, 0.5))
    c = c.join(c.groupBy("group").agg(F.count("*").alias("n")).where("n >= 3").select("group"), "group")
    x = c.join(e.select(F.col("vec_id").alias("node"), F.posexplode("embedding").alias("p", "x")), "node").withColumn("x", F.col("x").cast("double"))
    m = x.groupBy("group", "p").agg(F.avg("x").alias("m"))
    near = x.join(m, ["group", "p"]).groupBy("group", "node").agg((F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("s"))
    r = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("s"), "node"))
    named = near.withColumn("r", r).where("r = 1").select("group", F.col("node").alias("named"))
    found = c.join(named, "group").select("node", "named")
    return e.select(F.col("vec_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("named", "node").alias("group"))


@query(r"SELECT id, array_to_string(l[1:64], ' ') AS head, array_to_string(l[greatest(length(l) - 63, 1):], ' ') AS tail FROM (SELECT id, string_split(regexp_replace(abstract, '\s+', ' ', 'g'), ' ') AS l FROM articles_df WHERE abstract IS NOT NULL)")
def ml_bert(spark, d):
    """Head and tail of each text as a pair model takes them."""
    l = F.split(F.regexp_replace("abstract", r"\s+", " "), " ")
    a = table(spark, d, A).where("abstract is not null").select("id", l.alias("l"))
    start = F.greatest(F.size("l") - 63, F.lit(1))
    return a.select("id", F.array_join(F.slice("l", 1, 64), " ").alias("head"), F.array_join(F.slice("l", start, 64), " ").alias("tail"))


@query("SELECT label, round(avg(m), 5) + 0.0 AS mean_of_max FROM (SELECT label, list_max(embedding)::DOUBLE AS m FROM embeddings) GROUP BY label")
def ag_window_pool(spark, d):
    return table(spark, d, "embeddings").select("label", F.array_max("embedding").cast("double").alias("m")).groupBy("label").agg((F.round(F.avg("m"), 5) + F.lit(0.0)).alias("mean_of_max"))


# ---- metrics and samples

_C = "c AS (SELECT extended_study_type AS truth, exact_study_type AS predicted, count(*) AS n FROM study_type_df WHERE extended_study_type IS NOT NULL AND exact_study_type IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_C}, l AS (SELECT truth AS label FROM c UNION SELECT predicted FROM c), x AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = label AND predicted = label) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = label) AS s, (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = label) AS p FROM l)
SELECT label, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 6) AS "precision", round(CASE WHEN s > 0 THEN tp / s ELSE 0 END, 6) AS recall, round(CASE WHEN p + s > 0 AND tp > 0 THEN 2 * tp / (p + s) ELSE 0 END, 6) AS f1, s::BIGINT AS support FROM x""")
def ev_report(spark, d):
    r = evaluation.report(table(spark, d, "study_type_df"), "extended_study_type", "exact_study_type")
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_C} SELECT truth, predicted, n FROM c WHERE truth <> predicted")
def ev_confuse(spark, d):
    return evaluation.confusion(table(spark, d, "study_type_df"), "extended_study_type", "exact_study_type").where("truth <> predicted")


@query(f"WITH {_C} SELECT truth AS label, round(100.0 * sum(n) FILTER (WHERE truth <> predicted) / sum(n), 4) AS missed FROM c GROUP BY truth")
def ev_missed(spark, d):
    c = evaluation.confusion(table(spark, d, "study_type_df"), "extended_study_type", "exact_study_type")
    return c.groupBy(F.col("truth").alias("label")).agg(F.round(100.0 * F.sum(F.when(F.col("truth") != F.col("predicted"), F.col("n"))) / F.sum("n"), 4).alias("missed"))


_SETS = "s AS (SELECT id, list_distinct(list_filter(string_split(lower(coalesce(keywords, '')), ' '), lambda w: w <> '')) AS t, list_distinct(list_filter(string_split(lower(coalesce(title, '')), ' '), lambda w: w <> '')) AS p FROM articles_df), h AS (SELECT *, length(list_intersect(t, p)) AS h FROM s)"


def _set_scores(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))
    return table(spark, d, A).select("dataset", evaluation.set_scores(words("keywords"), words("title")).alias("s"))


@query(f"""WITH {_SETS}, x AS (SELECT CASE WHEN length(p) > 0 THEN h / length(p) ELSE (length(t) = 0)::INT END AS p, CASE WHEN length(t) > 0 THEN h / length(t) ELSE (length(p) = 0)::INT END AS r FROM h)
SELECT round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM x""")
def ev_f1_multi(spark, d):
    return _set_scores(spark, d).agg(F.round(F.avg("s.p"), 6).alias("precision"), F.round(F.avg("s.r"), 6).alias("recall"), F.round(F.avg("s.f1"), 6).alias("f1"))


@query(f"WITH {_SETS} SELECT round(avg((h > 0)::INT), 6) AS accuracy FROM h")
def ev_acc_multi(spark, d):
    return _set_scores(spark, d).agg(F.round(F.avg("s.any"), 6).alias("accuracy"))


_DRAW = "(('0x' || substr(md5({k}::VARCHAR || '{s}'), 1, 7))::BIGINT / 268435456.0)"


@query(f"SELECT id, exact_study_type, CASE WHEN {_DRAW.format(k='id', s='a')} < 0.05 THEN 'test' ELSE 'train' END AS part FROM study_type_df")
def sm_split(spark, d):
    return evaluation.split(table(spark, d, "study_type_df").select("id", "exact_study_type"), "id", 0.05, "a")


@query(f"SELECT dataset, id FROM (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY {_DRAW.format(k='id', s='b')}, id) AS r FROM articles_df) WHERE r <= 5")
def sm_choice(spark, d):
    return evaluation.choose(table(spark, d, A).select("dataset", "id"), "dataset", "id", 5, "b")


@query(f"SELECT exact_study_type, id FROM (SELECT exact_study_type, id, row_number() OVER (PARTITION BY exact_study_type ORDER BY {_DRAW.format(k='id', s='c')}, id) AS r FROM study_type_df WHERE exact_study_type IS NOT NULL) WHERE r <= 50")
def ac_pool(spark, d):
    """A labelling pool of up to fifty of each class."""
    return evaluation.choose(table(spark, d, "study_type_df").where("exact_study_type is not null").select("exact_study_type", "id"), "exact_study_type", "id", 50, "c")


# ---- sources, sinks, incremental runs


@query("SELECT id, coalesce(journal, '') AS journal, coalesce(dataset, '') AS dataset FROM articles_df")
def src_file(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, A).select("id", "journal", "dataset").write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    return files.read_csv(spark, path).select(F.col("id").cast("bigint").alias("id"), "journal", "dataset")


@query("SELECT affiliation_id, [city, country] AS cells FROM affiliation_map")
def src_list_cells(spark, d):
    a = table(spark, d, "affiliation_map").select("affiliation_id", F.concat(F.lit("['"), "city", F.lit("', \""), "country", F.lit("\"]")).alias("c"))
    return a.select("affiliation_id", files.list_cells("c").alias("cells"))


@query("SELECT id, dataset FROM articles_df UNION ALL SELECT id, dataset FROM study_type_df")
def src_dispatch(spark, d):
    return files.read_all(spark, [f"{d}/articles_df.parquet", f"{d}/study_type_df.parquet"]).select("id", "dataset")


@query("SELECT doc_id, source FROM documents")
def snk_excel_part(spark, d):
    path = scratch(spark, "parts")
    files.write_parts(table(spark, d, "documents").select("doc_id", "source"), path, rows=500)
    return spark.read.parquet(path)


@query("SELECT id, n FROM (SELECT doc_id AS id, n_chars AS n FROM documents) WHERE n IS NOT NULL")
def src_partitioned(spark, d):
    path = scratch(spark, "tabs")
    files.write_tabs({"0": table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))}, path)
    return files.read_any(spark, f"{path}/0").where("n is not null")


@query("SELECT journal_id::VARCHAR AS _id, journal_name FROM journal_list")
def snk_elastic_bulk(spark, d):
    docs = files.documents(table(spark, d, "journal_list"), ["journal_id", "journal_name", "short_name"], "journal_id")
    return docs.select("_id", F.get_json_object("doc", "$.journal_name").alias("journal_name"))


@query("SELECT id, dataset FROM study_type_df UNION ALL SELECT id, dataset FROM articles_df WHERE id NOT IN (SELECT id FROM study_type_df)")
def snk_elastic_upsert(spark, d):
    return files.upsert(table(spark, d, A).select("id", "dataset"), table(spark, d, "study_type_df").select("id", "dataset"), "id")


@query("SELECT affiliation_id, count_mentions, (count_mentions - (SELECT min(count_mentions) FROM affiliation_map)) / ((SELECT max(count_mentions) FROM affiliation_map) - (SELECT min(count_mentions) FROM affiliation_map)) AS bar FROM affiliation_map")
def fmt_databar(spark, d):
    return files.data_bars(table(spark, d, "affiliation_map").select("affiliation_id", "count_mentions"), "count_mentions")


@query("SELECT id, CASE WHEN exact_study_type = 'No category' THEN 'highlight' END AS style FROM study_type_df")
def fmt_highlight(spark, d):
    return table(spark, d, "study_type_df").select("id", files.highlight("exact_study_type", "No category").alias("style"))


@query("SELECT id, title FROM articles_df WHERE id NOT IN (SELECT article_id FROM big_dataset WHERE article_id IS NOT NULL)")
def in_skip_done(spark, d):
    done = table(spark, d, "big_dataset").where("article_id is not null").select(F.col("article_id").alias("id"))
    return incremental.pending(table(spark, d, A).select("id", "title"), done, "id")


@query("SELECT event_id, event_type, value * 2 AS doubled FROM events")
def in_resume(spark, d):
    """A file stream worked through in batches, then called again with nothing new to do."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    source, target, point = (scratch(spark, x) for x in ("source", "target", "point"))
    e.repartition(3).write.parquet(source)
    work = lambda s: s.select("event_id", "event_type", (F.col("value") * 2).alias("doubled"))
    incremental.run_available(spark, source, e.schema, work, target, point)
    return incremental.run_available(spark, source, e.schema, work, target, point)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def in_ckpt_stage(spark, d):
    """The latest event of each user, merged batch by batch."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    source, target, point = (scratch(spark, x) for x in ("source", "target", "point"))
    e.repartition(3).write.parquet(source)
    return incremental.upsert_batches(spark, source, e.schema, "user_id", "event_id", target, point)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_windows(spark, d):
    """Hourly counts by the streaming plan, over a table (an addition)."""
    return incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def st_sessions(spark, d):
    """Sessions of users (an addition)."""
    return incremental.sessions(table(spark, d, "events"), "ts", "user_id")


@query("SELECT id, length(string_split(journal, ' '))::INT AS n_words FROM articles_df")
def in_cache(spark, d):
    work = lambda v: v.select("journal", F.size(F.split("journal", " ")).alias("n_words"))
    return incremental.memoised(table(spark, d, A).select("id", "journal"), "journal", work).select("id", "n_words")


_SETTINGS = {
    "columns": [
        {"column_filler_class": "JournalNormalizer"},
        {"column_filler_class": "NoSuchFiller"},
        {"column_filler_class": "ColumnDataRenamer", "column_to_rename": "dataset", "values_dict": {"ruraldocs": "rural"}, "column_to_save": "source"},
        {"column_filler_class": "ColumnFiller", "column_dictionary": {"Cereals": ["maize", "sorghum"], "Methods": ["survey", "trial"]}, "column_name": "tags"},
        {"column_filler_class": "PopulationTagsFinder", "column": "missing_column"},
        {"column_filler_class": "PopulationTagsFinder", "column": "abstract"},
    ]
}


@query(f"""WITH w AS (SELECT id, dataset, list_concat(list_concat({sql.tokens('title')}, {sql.tokens('abstract')}), {sql.tokens('keywords')}) AS t FROM articles_df)
SELECT id, CASE WHEN dataset = 'ruraldocs' THEN 'rural' ELSE dataset END AS source, list_filter(['Cereals', 'Methods'], lambda x: (x = 'Cereals' AND list_has_any(t, ['maize', 'sorghum'])) OR (x = 'Methods' AND list_has_any(t, ['survey', 'trial']))) AS tags FROM w""")
def pipeline_run(spark, d):
    """Settings with two broken steps: the table goes on without them."""
    out, _ = pipeline.run(table(spark, d, A), _SETTINGS, isolate=False)
    return out.select("id", "source", "tags")


@query("SELECT * FROM (VALUES (0, 'JournalNormalizer', 'Finished'), (1, 'NoSuchFiller', 'Finished with errors'), (2, 'ColumnDataRenamer', 'Finished'), (3, 'ColumnFiller', 'Finished'), (5, 'PopulationTagsFinder', 'Finished')) t(position, step, state) WHERE position <> 5")
def in_status(spark, d):
    _, status = pipeline.run(table(spark, d, A), {"columns": _SETTINGS["columns"][:4]}, isolate=False)
    return status.frame(spark).select("position", "step", "state")
