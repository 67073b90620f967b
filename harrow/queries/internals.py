"""Smaller steps inside the operators: training rows, existence, word lists, codes, pairs of texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, labelling, models
from ..session import exists, scratch, table
from . import query, sql
from .knowledge import _REL, relations
from .learning import _DRAW
from .searching import A

_TEXT = "coalesce(title, '') || '. ' || coalesce(abstract, '')"
_SENT = rf"s AS (SELECT id, unnest(list_filter(string_split(regexp_replace({_TEXT}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '')) AS s FROM articles_df)"
_NAMES = ["maize", "sorghum", "kenya", "india"]
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


@query("SELECT * FROM (VALUES ('there', true), ('not there', false)) t(name, found)")
def snk_elastic_exists(spark, d):
    """Is a target there before rows are sent to it?"""
    path = scratch(spark, "there")
    table(spark, d, "region").write.parquet(path)
    return spark.createDataFrame([("there", exists(spark, path)), ("not there", exists(spark, path + "-not"))], "name string, found boolean")


@query(f"""WITH {_SENT}, t AS (SELECT id, row_number() OVER () AS n, string_split(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM s),
p AS (SELECT id, n, w, unnest(w) AS x, unnest(range(1, length(w) + 1)) AS i FROM t), v AS (SELECT * FROM p WHERE list_contains({_list(labelling.STORING)}, x)),
c AS (SELECT v.id, v.n, v.w, v.x AS verb, v.i, min(p.i) AS c FROM v JOIN p ON p.n = v.n AND p.i > v.i AND p.i - v.i <= 8 AND list_contains({_list(labelling.CONTAINERS)}, p.x) GROUP BY ALL)
SELECT id, verb, array_to_string(list_filter(w[i + 1:c], lambda y: NOT list_contains({sql.STOP}, y) AND NOT list_contains({_list(_NAMES)}, y) AND NOT regexp_matches(y, '[0-9]')), ' ') AS argument FROM c""")
def rx_srl_storage(spark, d):
    """Verbs of storing with the container behind them and what stands between, without places and crops."""
    return labelling.storage(table(spark, d, A), ["title", "abstract"], _NAMES)


_CROPS = ["maize", "sorghum", "rice", "cassava", "teff"]


@query(rf"""WITH f AS (SELECT id, ' ' || trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) || ' ' AS t FROM articles_df), e AS (SELECT id, t, unnest(list_filter({_list(_CROPS)}, lambda c: regexp_matches(t, '[^a-z]' || c || '[^a-z]'))) AS term FROM f),
m AS (SELECT id, term, regexp_replace(t, '([^a-z])(' || array_to_string(list_filter({_list(_CROPS)}, lambda c: c <> term), '|') || ')([^a-z])', '\1\3', 'g') AS t1 FROM e)
SELECT id, term, trim(regexp_replace(regexp_replace(t1, '([^a-z])(' || array_to_string(list_filter({_list(_CROPS)}, lambda c: c <> term), '|') || ')([^a-z])', '\1\3', 'g'), ' +', ' ', 'g')) AS context FROM m""")
def ecs_split(spark, d):
    """One context for each crop of a title, without the other crops."""
    return labelling.contexts(table(spark, d, A), "title", _CROPS)


_KEYS, _GENERIC, _ABSTRACT = ["soil water", "crop plants", "market prices", "animal keeping"], ["honey", "yield"], ["use", "adoption", "effect", "improved"]


@query(f"""WITH t AS (SELECT DISTINCT lower(trim(x)) AS concept FROM (SELECT unnest(topics) AS x FROM big_dataset) WHERE trim(x) <> ''),
n AS (SELECT concept, regexp_replace(concept, '^(?:(?:{"|".join(_ABSTRACT)}) (?:of )?)+', '') AS name FROM t), k AS (SELECT unnest({_list(_KEYS)}) AS k),
s AS (SELECT concept, name, k, 1 - levenshtein(name, k) / greatest(length(name), length(k)) AS s FROM n, k WHERE name <> '' AND NOT list_contains({_list(_GENERIC)}, name))
SELECT concept, name, CASE WHEN s >= 0.3 THEN k ELSE 'other' END AS middle FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY s DESC, k) AS r FROM s) WHERE r = 1""")
def id_dict(spark, d):
    """A taxonomy of the topics: generic ones out, leading abstract words off, each under a middle layer."""
    t = table(spark, d, "big_dataset").select(F.explode("topics").alias("x")).select(F.lower(F.trim("x")).alias("concept")).where("concept <> ''").distinct()
    return labelling.derived_taxonomy(t, _KEYS, _GENERIC, _ABSTRACT)


_FLAGS = {"yields": "yield", "incomes": "income", "waters": "water"}


@query(f"""WITH r AS (SELECT regexp_replace(lower(title), '^ +| +$', '', 'g') AS text, {", ".join(f"contains(lower(coalesce(abstract, '')), '{w}')::INT AS {c}" for c, w in _FLAGS.items())} FROM articles_df WHERE title IS NOT NULL),
m AS (SELECT text, {", ".join(f"max({c}) AS {c}" for c in _FLAGS)} FROM r GROUP BY text), x AS (SELECT *, {_DRAW.format(k='text', s='d')} AS u FROM m)
SELECT text, {", ".join(_FLAGS)} FROM x WHERE {" OR ".join(f"{c} = 1" for c in _FLAGS)} OR u < 0.5""")
def ml_outcome_prep(spark, d):
    """Training rows of outcomes: a row a text with 0/1 labels, any match counting; half of those without any, by a draw."""
    low = F.lower(F.coalesce("abstract", F.lit("")))
    rows = table(spark, d, A).select("title", *(F.contains(low, F.lit(w)).cast("int").alias(c) for c, w in _FLAGS.items()))
    m = labelling.any_match(rows, "title", list(_FLAGS))
    some = F.lit(False)
    for c in _FLAGS:
        some = some | (F.col(c) == 1)
    return m.where(some | (evaluation.draw(F.col("text"), "d") < 0.5))


@query()
def lb_priority_model(spark, d):
    """Priority of each article by a classifier's probability, fitted on whether a study has a type; rows only."""
    s = table(spark, d, "study_type_df").where("abstract is not null and split_name = 'train'")
    rows = s.select("id", F.concat_ws(". ", "title", "abstract").alias("text"), F.when(F.col("exact_study_type") == "No category", "no").otherwise("yes").alias("label"))
    a = table(spark, d, A).select("id", T.drop_html(F.concat_ws(".", "title", "abstract")).alias("text"))
    p = models.TextClassifier().fit(rows).predict(a)
    p = p.select("id", F.when(F.col("predicted") == "yes", F.col("probability")).otherwise(1 - F.col("probability")).alias("p"))
    return p.select("id", F.when(F.col("p") < 0.1, "Unlikely").when(F.col("p") < 0.4, "Less likely").otherwise("More likely").alias("priority"))


@query(f"""WITH x AS (SELECT unnest([journal_name, short_name]) AS w FROM journal_list), n AS (SELECT w, array_to_string({sql.tokens('w')}, ' ') AS k FROM x WHERE w IS NOT NULL)
SELECT lower(trim(w)) AS word FROM n WHERE trim(w) <> '' UNION SELECT k FROM n WHERE k <> ''""")
def hs_filter_dict(spark, d):
    """Filter words of a dictionary: those of every column, as they are and normalised."""
    j = table(spark, d, "journal_list").select(F.explode(F.array("journal_name", "short_name")).alias("w")).where("w is not null")
    both = j.select(F.lower(F.trim("w")).alias("word")).unionAll(j.select(T.normal_sentence("w")))
    return both.where("word <> ''").distinct()


@query(f"WITH {_REL} SELECT DISTINCT special FROM rel WHERE special = lower(special) OR {sql.upper('special')}")
def rx_coref_clean(spark, d):
    """Terms without capitalised ones that are no abbreviations."""
    return relations(spark, d).select("special").distinct().where((F.col("special") == F.lower("special")) | ((F.upper("special") == F.col("special")) & (F.lower("special") != F.col("special"))))


@query(f"SELECT doc, array_to_string({sql.tokens('s')}, ' ') AS norm, CASE WHEN {_DRAW.format(k='s', s='m')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM (WITH {_SENT} SELECT DISTINCT id AS doc, s FROM s WHERE regexp_matches(s, '[0-9]'))")
def ml_measure_prep(spark, d):
    """Training rows of measurements: sentences with numbers, normalised, in two parts by a draw."""
    s = labelling.joined(table(spark, d, A), ["title", "abstract"]).select(F.col("id").alias("doc"), F.explode(T.split_sentences("text")).alias("s"))
    s = s.where(F.col("s").rlike("[0-9]")).distinct().withColumn("norm", T.normal_sentence("s"))
    return evaluation.split(s, "s", 0.2, "m").select("doc", "norm", "part")


@query("""WITH s AS (SELECT id, exact_study_type AS l FROM study_type_df WHERE exact_study_type IS NOT NULL AND id IS NOT NULL), p AS (SELECT id, l, lead(id) OVER (PARTITION BY l ORDER BY id) AS same FROM s),
f AS (SELECT l, min(id) AS first FROM s GROUP BY l), n AS (SELECT l, lead(l) OVER (ORDER BY l) AS next FROM f)
SELECT p.id, same, f.first AS other FROM p LEFT JOIN n ON n.l = p.l LEFT JOIN f ON f.l = n.next""")
def ml_siamese_prep(spark, d):
    """Each row with the next of its class and the first of the following class: pairs for twin encoders."""
    s = table(spark, d, "study_type_df").where("exact_study_type is not null and id is not null").select("id", F.col("exact_study_type").alias("l"))
    p = s.withColumn("same", F.lead("id").over(Window.partitionBy("l").orderBy("id")))
    f = s.groupBy("l").agg(F.min("id").alias("first"))  # a row per class
    n = f.select("l", F.lead("first").over(Window.orderBy("l")).alias("other"))
    return p.join(F.broadcast(n), "l", "left").select("id", "same", "other")


@query(f"""WITH w AS (SELECT exact_study_type AS label, unnest({sql.tokens('title')}) AS term FROM study_type_df WHERE exact_study_type IS NOT NULL), c AS (SELECT label, term, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT label, sum(n) AS whole FROM c GROUP BY label), f AS (SELECT term, count(*) AS k FROM c GROUP BY term), m AS (SELECT count(*) AS classes FROM t)
SELECT label, term, round(n / whole * ln(1 + classes / k), 7) AS weight FROM c JOIN t USING (label) JOIN f USING (term), m""")
def ml_class_tf(spark, d):
    """Weights of terms in classes: frequency in the class by the logarithm of how few classes have them."""
    w = table(spark, d, "study_type_df").where("exact_study_type is not null").select(F.col("exact_study_type").alias("label"), F.explode(T.token_list("title")).alias("term"))
    c = w.groupBy("label", "term").agg(F.count("*").alias("n"))
    t = c.groupBy("label").agg(F.sum("n").alias("whole"))  # a row per class
    f = c.groupBy("term").agg(F.count("*").alias("k"))
    classes = t.count()
    j = c.join(F.broadcast(t), "label").join(f, "term")
    return j.select("label", "term", F.round(F.col("n") / F.col("whole") * F.log(1 + F.lit(classes) / F.col("k")), 7).alias("weight"))


@query("""WITH a AS (SELECT dataset, bool_or(list_contains(topics, 'maize')) AS m, bool_or(list_contains(topics, 'rice')) AS r FROM big_dataset GROUP BY dataset)
SELECT dataset, list_concat(CASE WHEN m THEN ['maize'] ELSE [] END, CASE WHEN r THEN ['rice'] ELSE [] END) AS names FROM a""")
def pv_code_names(spark, d):
    """The names that a bit code of memberships stands for."""
    has = lambda x: F.coalesce(F.max(F.array_contains("topics", x)), F.lit(False))
    a = table(spark, d, "big_dataset").groupBy("dataset").agg((has("maize").cast("int") + 2 * has("rice").cast("int")).alias("code"))
    names = F.array_compact(F.array(*(F.when(F.col("code").bitwiseAND(1 << k) > 0, n) for k, n in enumerate(("maize", "rice")))))
    return a.select("dataset", names.alias("names"))


@query("""WITH t(thr) AS (VALUES (0.2), (0.5), (0.8)), x AS (SELECT vec_id, label, abs(embedding[1]::DOUBLE) AS p, vec_id % 2 = 0 AS truth FROM embeddings)
SELECT thr::DOUBLE AS threshold, sum((p >= thr AND truth)::INT)::BIGINT AS tp, sum((p >= thr)::INT)::BIGINT AS found, sum(truth::INT)::BIGINT AS wanted FROM x, t GROUP BY thr""")
def swi_thresholds(spark, d):
    """Hits, findings and wanted rows of a score at several thresholds, in one pass."""
    x = table(spark, d, "embeddings").select(F.abs(F.col("embedding")[0].cast("double")).alias("p"), (F.col("vec_id") % 2 == 0).alias("truth"))
    return evaluation.at_thresholds(x, "p", "truth", [0.2, 0.5, 0.8])
