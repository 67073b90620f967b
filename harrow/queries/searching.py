"""Inverted index, search, dictionary labels, merging, abbreviations and near-duplicate articles."""

from pyspark.sql import functions as F

from ..operators import dedupe, merging, search
from ..session import cut, scratch, table, written
from . import query, sql

A = "articles_df"
INDEXED = ("title", "abstract", "keywords", "identificators")
_POST = "t AS (" + " UNION ALL ".join(f"SELECT id, {sql.tokens(c)} AS l FROM articles_df" for c in INDEXED) + """),
post AS (SELECT DISTINCT id AS doc_id, term FROM (SELECT id, unnest(l) AS term FROM t UNION ALL SELECT id, unnest(list_transform(range(1, length(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM t)),
vocab AS (SELECT term, count(*) AS df, substr(term, 1, 3) AS prefix, length(string_split(term, ' '))::INT AS n_words FROM post GROUP BY term)"""


_built: dict[tuple[str, str], str] = {}


def index(spark, d, path=None):
    """Of the whole text; built once for a session and data directory, as long as its tables are there."""
    if path is not None:
        return search.Index.build(table(spark, d, A), list(INDEXED), path=path)
    key = (spark.sparkContext.applicationId, d)
    if not written(_built.get(key, "")):
        _built[key] = scratch(spark, "index")
        return search.Index.build(table(spark, d, A), list(INDEXED), path=_built[key])
    return search.Index.load(spark, _built[key])


def frequent(ix):
    """A dictionary that occurs in the data: all longer single words of three texts or more, labelled by first letter."""
    v = ix.vocabulary.where("n_words = 1 and length(term) >= 6 and term rlike '^[a-z]+$' and df >= 3")
    return v.select(F.col("term").alias("keyword"), F.upper(F.substring("term", 1, 1)).alias("label"))


_SIM = "(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
_ZS = "(length({a}) = length({b}) AND length(list_filter(range(3, length({a}) + 1), lambda i: substr({a}, 1, i - 1) = substr({b}, 1, i - 1) AND substr({a}, i + 1) = substr({b}, i + 1) AND (({a}[i] = 's' AND {b}[i] = 'z') OR ({a}[i] = 'z' AND {b}[i] = 's')))) > 0)"


def _fuzzy_sql(words, least):
    """Variants (word, term) of the words of a table ``words`` (word, df)."""
    return f"""(SELECT DISTINCT word, v.term FROM {words} w JOIN vocab v ON substr(word, 1, 3) = v.prefix AND v.n_words = 1 AND abs(length(word) - length(v.term)) <= length(word) / 3
WHERE word = v.term OR (regexp_matches(v.term, '^[ -~]+$') AND {_SIM.format(a='word', b='v.term')} >= {least} AND v.df < 4 * w.df) OR {_ZS.format(a='word', b='v.term')})"""


_DICT = "dict AS (SELECT term AS keyword, upper(substr(term, 1, 1)) AS label, term AS word, df FROM vocab WHERE n_words = 1 AND length(term) >= 6 AND regexp_matches(term, '^[a-z]+$') AND df >= 3)"
_VARIANTS = f"{_DICT}, held AS (SELECT keyword, label, post.doc_id FROM {_fuzzy_sql('dict', 0.92)} x JOIN dict USING (word) JOIN post ON post.term = x.term)"


@query(f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def se_build(spark, d):
    return index(spark, d).vocabulary.select("term", "df")


@query(f"WITH {_POST} SELECT term, df FROM vocab WHERE df >= 2")
def snk_synapp(spark, d):
    return index(spark, d).vocabulary.where("df >= 2").select("term", "df")


@query(f"WITH {_POST} SELECT doc_id FROM post WHERE term = 'irrigation'")
def se_lookup(spark, d):
    return index(spark, d).lookup("irrigation")


@query(f"WITH {_POST} SELECT term FROM vocab WHERE n_words = 1 AND regexp_matches(term, '^agri[A-Za-z0-9_]*$') OR n_words = 1 AND regexp_matches(term, '^fert[A-Za-z0-9_]*r$')")
def se_wildcard(spark, d):
    ix = index(spark, d)
    return ix.wildcard("agri*").union(ix.wildcard("fert*r"))


@query(f"""WITH {_POST}, w AS (SELECT term AS word, df FROM vocab WHERE n_words = 1 AND length(term) >= 6 AND regexp_matches(term, '^[a-z]+$')) SELECT * FROM {_fuzzy_sql('w', 0.85)}""")
def se_fuzzy(spark, d):
    ix = index(spark, d)
    words = ix.vocabulary.where("n_words = 1 and length(term) >= 6 and term rlike '^[a-z]+$'")
    return ix.fuzzy(words.select(F.col("term").alias("word")))


_QUERIES = ["drip irrigation", "soil organic carbon", "maize", "warehouse receipts and grain yield", ""]
_KEYS = {"drip irrigation": ["drip irrigation"], "soil organic carbon": ["soil organic", "organic carbon"], "maize": ["maize"],
         "warehouse receipts and grain yield": ["warehouse receipt", "receipt grain", "grain yield"]}
_QSQL = "q(query, term, n) AS (VALUES " + ", ".join(f"('{q}', '{t}', {len(ts)})" for q, ts in _KEYS.items() for t in ts) + ")"


@query(f"WITH {_POST}, {_QSQL} SELECT query, doc_id FROM q JOIN post USING (term) GROUP BY query, doc_id, n HAVING count(DISTINCT term) = n")
def se_phrase(spark, d):
    return index(spark, d).search(spark.createDataFrame([(q,) for q in _QUERIES], "query string"))


@query(f"""WITH {_POST}, {_QSQL} SELECT query, doc_id FROM q JOIN post USING (term) GROUP BY query, doc_id, n HAVING count(DISTINCT term) = n AND query <> 'maize'
UNION SELECT 'maize', doc_id FROM post JOIN vocab v USING (term) WHERE v.n_words = 1 AND v.prefix = 'mai' AND (term = 'maize' OR
(regexp_matches(term, '^[ -~]+$') AND {_SIM.format(a="'maize'", b='term')} >= 0.85 AND v.df < 4 * (SELECT df FROM vocab WHERE term = 'maize')))""")
def se_query(spark, d):
    return index(spark, d).search(spark.createDataFrame([(q,) for q in _QUERIES], "query string"), 0.85)


@query(f"WITH {_POST} SELECT DISTINCT doc_id FROM post WHERE regexp_matches(term, '^(irrig|fert)[A-Za-z0-9_]*$')")
def se_query_wild(spark, d):
    ix = index(spark, d)
    terms = ix.wildcard("irrig*").union(ix.wildcard("fert*")).withColumnRenamed("term", "query")
    return ix.search(terms).select("doc_id").distinct()


@query(f"""WITH {_POST}, w AS (SELECT word, v.term FROM (VALUES ('fertiliser'), ('labour'), ('grain'), ('yield')) x(word) JOIN vocab v ON v.n_words = 1 AND substr(word, 1, 3) = v.prefix AND regexp_matches(v.term, '^[ -~]+$')
AND (word = v.term OR ({_SIM.format(a='word', b='v.term')} >= 0.8 AND v.df < 4 * (SELECT max(df) FROM vocab WHERE term = word)) OR (length(word) = length(v.term) AND length(list_filter(range(3, length(word)), lambda i: substr(word, 1, i - 1) = substr(v.term, 1, i - 1) AND substr(word, i + 1) = substr(v.term, i + 1) AND ((word[i] = 's' AND v.term[i] = 'z') OR (word[i] = 'z' AND v.term[i] = 's')))) > 0)))
SELECT a.term || ' ' || b.term AS expanded FROM w a, w b WHERE (a.word = 'fertiliser' AND b.word = 'labour') OR (a.word = 'grain' AND b.word = 'yield')""")
def se_expand_spell(spark, d):
    """All spellings of two-word queries: a join of each word's few variants."""
    v = index(spark, d).fuzzy(spark.createDataFrame([(w,) for w in ("fertiliser", "labour", "grain", "yield")], "word string"), 0.8)
    q = spark.createDataFrame([("fertiliser", "labour"), ("grain", "yield")], "a string, b string")
    x = q.join(v.toDF("a", "ta"), "a").join(v.toDF("b", "tb"), "b")
    return x.select(F.concat_ws(" ", "ta", "tb").alias("expanded"))


@query(f"WITH {_POST}, {_VARIANTS} SELECT doc_id, list_sort(list_distinct(list(label))) AS labels, list_sort(list_distinct(list(keyword))) AS details FROM held GROUP BY doc_id")
def lb_dict(spark, d):
    ix = index(spark, d)
    return search.dictionary_label(ix, frequent(ix), 0.92)


@query(f"WITH {_POST}, {_VARIANTS} SELECT doc_id, list_sort(list_distinct(flatten(list([label || '/', label || '/' || keyword])))) AS labels, list_sort(list_distinct(list(keyword))) AS details FROM held GROUP BY doc_id")
def lb_dict_hierarchy(spark, d):
    ix = index(spark, d)
    return search.dictionary_label(ix, frequent(ix), 0.92, hierarchy=True)


@query(f"WITH {_POST}, {_DICT} SELECT doc_id, keyword AS term FROM dict JOIN post ON term = keyword")
def jn_index_dict(spark, d):
    ix = index(spark, d)
    return ix.postings.join(frequent(ix).select(F.col("keyword").alias("term")), "term")


_TAX = [("maize", "cereals"), ("sorghum", "cereals"), ("rice", "cereals"), ("goat", "livestock"), ("sheep", "livestock"), ("finger millet", "cereals")]


@query(f"WITH {_POST}, x(narrow, broad) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TAX) + """),
k AS (SELECT narrow AS key, broad || '/' || narrow AS value, broad FROM x UNION SELECT CASE WHEN broad = 'cereals' THEN 'cereal' ELSE broad END, broad || '/', broad FROM x),
h AS (SELECT doc_id, CASE WHEN key = 'cereal' THEN 'cereals' ELSE key END AS key, value, broad FROM k JOIN post ON term = key)
SELECT doc_id, list_sort(list_distinct(list(value))) AS "values", list_sort(list_distinct(list(broad))) AS broad, list_sort(list_distinct(list(key))) AS details FROM h GROUP BY doc_id""")
def lb_taxonomy(spark, d):
    return search.taxonomy_label(index(spark, d), spark.createDataFrame(_TAX, "narrow string, broad string"))


_NEAR = f"""w AS (SELECT id, {sql.words('abstract')} AS l FROM articles_df), p AS (SELECT id, unnest(l) AS w, unnest(range(0, length(l))) AS p FROM w),
near AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND abs(a.p - b.p) <= 5 WHERE a.w IN ('small', 'subsistence', 'marginal') AND b.w IN ('farm', 'farms', 'farmer', 'farmers', 'plot', 'plots'))"""


@query(f"""WITH {_NEAR}, x AS (SELECT w.id, array_to_string(l, ' ') AS t, near.id IS NOT NULL AS n FROM w LEFT JOIN near ON w.id = near.id),
y AS (SELECT id, CASE WHEN n OR regexp_matches(t, '(^| )small ?holders?( |$)') THEN 'Small scale farmers' WHEN regexp_matches(t, '(^| )farmers?( |$)') THEN 'Farmers' END AS tag FROM x) SELECT * FROM y WHERE tag IS NOT NULL""")
def lb_population(spark, d):
    return search.population_tags(table(spark, d, A), "abstract")


_RULES = [("evidence - household", "Evidence"), ("survey", "Survey"), ("study", "Study"), ("trial", "Trial"), ("appraisal", "")]


@query(f"""WITH {_POST} SELECT doc_id, 'Evidence' AS label, 0 AS priority FROM post WHERE term = 'evidence' AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'household')
UNION SELECT doc_id, 'Survey', 1 FROM post WHERE term = 'survey' UNION SELECT doc_id, 'Study', 2 FROM post WHERE term = 'study' UNION SELECT doc_id, 'Trial', 3 FROM post WHERE term = 'trial'""")
def lb_study_kw(spark, d):
    return search.keyword_labels(index(spark, d), _RULES)


@query(f"""WITH {_POST}, l AS (SELECT doc_id, 'Evidence' AS label, 0 AS priority FROM post WHERE term = 'evidence' AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'household')
UNION SELECT doc_id, 'Survey', 1 FROM post WHERE term = 'survey' UNION SELECT doc_id, 'Study', 2 FROM post WHERE term = 'study' UNION SELECT doc_id, 'Trial', 3 FROM post WHERE term = 'trial')
SELECT id, coalesce(arg_min(label, priority), 'No category') AS label FROM articles_df LEFT JOIN l ON id = doc_id GROUP BY id""")
def lb_study_single(spark, d):
    """One label an article: the first rule that holds."""
    l = search.keyword_labels(index(spark, d), _RULES).groupBy("doc_id").agg(F.min_by("label", "priority").alias("label"))
    a = table(spark, d, A).select("id")
    return a.join(l, F.col("id") == F.col("doc_id"), "left").select("id", F.coalesce("label", F.lit("No category")).alias("label"))


@query(f"""WITH {_POST}, f AS (SELECT doc_id FROM post WHERE term = 'maize' INTERSECT SELECT doc_id FROM post WHERE term = 'evidence')
SELECT doc_id, list_sort(list_distinct(list(topic))) AS topics FROM f JOIN (SELECT article_id, unnest(topics) AS topic FROM big_dataset) ON article_id = doc_id WHERE topic IN ('maize', 'rice', 'pulses') GROUP BY doc_id""")
def lb_strategy(spark, d):
    """All keywords of a rule in the text, and one of its labels on the record."""
    found = index(spark, d).search(spark.createDataFrame([("maize",), ("evidence",)], "query string"))
    both = found.groupBy("doc_id").agg(F.count_distinct("query").alias("n")).where("n = 2")
    labels = table(spark, d, "big_dataset").select(F.col("article_id").alias("doc_id"), F.explode("topics").alias("topic")).where("topic in ('maize', 'rice', 'pulses')")
    return both.join(labels, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


# ---- merging and abbreviations


def _merge_sql(block, threshold, pick):
    """Items (item, g, w) of ``v`` joined to parents, and these to the ends of their chains."""
    return f"""pr AS (SELECT a.g, a.item, b.item AS other, b.w AS w2 FROM v a JOIN v b ON a.g = b.g AND substr(a.item, 1, {block}) = substr(b.item, 1, {block}) AND a.item <> b.item AND (b.w > a.w OR (b.w = a.w AND b.item < a.item))
  WHERE {_SIM.format(a='a.item', b='b.item')} >= {threshold} OR {_ZS.format(a='a.item', b='b.item')}),
up AS (SELECT g, item, {pick} AS parent FROM pr GROUP BY g, item),
walk AS (SELECT g, item, item AS root FROM v UNION ALL SELECT walk.g, walk.item, up.parent FROM walk JOIN up ON up.g = walk.g AND up.item = walk.root),
merged AS (SELECT g, item, root FROM walk WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.g = walk.g AND up.item = walk.root))"""


@query(f"WITH RECURSIVE {_POST}, v AS (SELECT term AS item, '' AS g, df AS w FROM vocab WHERE n_words = 1 AND length(term) > 5), {_merge_sql(5, 0.85, 'arg_max(other, (-w2, other))')} SELECT item, root FROM merged")
def cm_merge(spark, d):
    """Words of one five-letter prefix merged into the lightest heavier spelling, to the ends of the chains."""
    v = index(spark, d).vocabulary.where("n_words = 1 and length(term) > 5").select(F.col("term").alias("item"), F.col("df").alias("weight"))
    return merging.merge_similar(v, 0.85)


@query(f"""WITH RECURSIVE v AS (SELECT lower(normalized_name) AS item, coalesce(city, '') AS g, max(count_mentions) AS w FROM affiliation_map WHERE normalized_name <> '' GROUP BY ALL), {_merge_sql(2, 0.88, 'arg_min(other, (-w2, other))')},
n AS (SELECT root, g, country, sum(count_mentions) AS n FROM merged JOIN affiliation_map ON lower(normalized_name) = item AND coalesce(city, '') = g WHERE country IS NOT NULL GROUP BY ALL),
c AS (SELECT root, g, arg_min(country, (-n, country)) AS country FROM n GROUP BY ALL)
SELECT g AS city, item, root, country FROM merged LEFT JOIN c USING (root, g)""")
def af_remap_city(spark, d):
    """Organisation names of one city merged into the most mentioned spelling, with the country most mentioned of it."""
    a = table(spark, d, "affiliation_map").select(F.lower("normalized_name").alias("item"), F.coalesce("city", F.lit("")).alias("city"), "country", "count_mentions")
    merged = cut(merging.merge_similar(a.withColumnRenamed("count_mentions", "weight"), 0.88, block=2, keep="first", group="city"))
    n = merged.join(a.where("country is not null"), ["item", "city"]).groupBy("root", "city", "country").agg(F.sum("count_mentions").alias("n"))
    c = n.groupBy("root", "city").agg(F.min(F.struct(-F.col("n"), "country")).alias("b")).select("root", "city", F.col("b.country").alias("country"))
    return merged.join(c, ["root", "city"], "left").select("city", "item", "root", "country")


@query(f"WITH {_POST}, x AS (SELECT a.term AS spaced, replace(a.term, ' ', '') AS glued, a.df AS df_spaced FROM vocab a WHERE a.n_words = 2) SELECT spaced, glued, df_spaced, v.df AS df_glued FROM x JOIN vocab v ON v.term = glued AND v.n_words = 1 WHERE v.df > 2 * df_spaced")
def cm_space(spark, d):
    v = index(spark, d).vocabulary
    x = v.where("n_words = 2").select(F.col("term").alias("spaced"), F.replace("term", F.lit(" "), F.lit("")).alias("glued"), F.col("df").alias("df_spaced"))
    y = v.where("n_words = 1").select(F.col("term").alias("glued"), F.col("df").alias("df_glued"))
    return x.join(y, "glued").where("df_glued > 2 * df_spaced")


_SKIPPED = "[" + ", ".join(f"'{w}'" for w in merging.SKIPPED) + "]"
_ONE = "upper(w[1]) || '(?:' || upper(w[2]) || ')?'"
_ABBR = (
    "m AS (SELECT {id}, unnest(regexp_extract_all({t}, '" + merging.BRACKETED.replace("{", "{{").replace("}", "}}") + "')) AS m FROM {s}),\n"
    "p AS (SELECT {id}, regexp_extract(m, '\\(([A-Z]+)s?\\)', 1) AS abbr, string_split(trim(regexp_extract(m, '^(.*?) ?\\(', 1)), ' ') AS l FROM m),\n"
    "k AS (SELECT *, list_filter(list_concat([length(abbr), length(abbr) + 1, length(abbr) + 2], list_reverse(range(2, length(abbr)))), lambda n: n <= length(l)) AS ns FROM p),\n"
    "f AS (SELECT {id}, abbr, list_filter(list_transform(ns, lambda n: l[length(l) - n + 1:]), lambda t: NOT list_contains(" + _SKIPPED + ", lower(t[1])) AND regexp_full_match(abbr, "
    "array_to_string(list_transform(t, lambda w: CASE WHEN list_contains(" + _SKIPPED + ", lower(w)) THEN '(?:' || " + _ONE + " || ')?' ELSE " + _ONE + " END), '')))[1] AS t FROM k),\n"
    "r AS (SELECT {id}, abbr, lower(array_to_string(t, ' ')) AS meaning FROM f WHERE t IS NOT NULL)"
)
_SPELLED = "(SELECT id, coalesce(title, '') || '. ' || coalesce(abstract, '') AS t FROM articles_df UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT id, raw_affiliation FROM articles_df WHERE raw_affiliation IS NOT NULL)"


def _abbreviations(spark, d):
    """``id, abbr, meaning`` of the texts, documents and affiliations."""
    a = table(spark, d, A)
    t = a.select("id", F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("t"))
    t = t.unionAll(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).unionAll(a.where("raw_affiliation is not null").select("id", "raw_affiliation"))
    return merging.abbreviation_pairs(t, "t", "id")


@query("WITH " + _ABBR.format(id="id", t="t", s=_SPELLED) + " SELECT id, abbr, meaning FROM r")
def ab_extract(spark, d):
    return _abbreviations(spark, d)


@query("WITH " + _ABBR.format(id="id", t="t", s=_SPELLED) + " SELECT abbr, meaning, n FROM (SELECT abbr, meaning, count(*) AS n, row_number() OVER (PARTITION BY abbr ORDER BY count(*) DESC, meaning) AS r FROM r GROUP BY abbr, meaning) WHERE r = 1")
def ab_match(spark, d):
    return merging.ranked_meanings(_abbreviations(spark, d)).where("rank = 1").select("abbr", "meaning", "n")


@query("SELECT id, list_sort(list_distinct([lower(title), replace(lower(title), 'programme', 'program'), regexp_replace(lower(title), 'program([^m]|$)', 'programme\\1', 'g')])) AS variants FROM articles_df")
def ab_program(spark, d):
    t = F.lower("title")
    v = F.array(t, F.replace(t, F.lit("programme"), F.lit("program")), F.regexp_replace(t, "program([^m]|$)", "programme$1"))
    return table(spark, d, A).select("id", F.array_sort(F.array_distinct(v)).alias("variants"))


# ---- near-duplicate articles

_KEY = f"""k AS (SELECT id, year, ({sql.tokens('title')}) AS l, title, abstract FROM articles_df),
b AS (SELECT id, year::VARCHAR || '|' || l[1] || '|' || coalesce(l[2], '') AS block FROM k WHERE length(l) > 0 AND year IS NOT NULL)"""


@query(f"WITH {_KEY} SELECT id, block FROM b")
def dd_key(spark, d):
    return dedupe.block_keys(table(spark, d, A))


_TFIDF = """{p}w AS (SELECT id, unnest({t}) AS term FROM articles_df), {p}tf AS (SELECT id, term, count(*) AS tf FROM {p}w WHERE term <> '' GROUP BY ALL),
{p}x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM articles_df)) / (1 + df)) + 1) AS x FROM {p}tf JOIN (SELECT term, count(*) AS df FROM {p}tf GROUP BY term) USING (term)),
{p}n AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM {p}x)"""
_TW = _TFIDF.replace("{p}", "t").replace("{t}", sql.tokens("title"))
_AW = _TFIDF.replace("{p}", "a").replace("{t}", sql.tokens("abstract"))


@query(f"WITH {_TW} SELECT id, term, round(w, 6) AS w FROM tn")
def dd_tfidf(spark, d):
    return dedupe.tfidf(table(spark, d, A), "title").select("id", "term", F.round("w", 6).alias("w"))


# the other engine's edit distance counts bytes
_TITLE_SIM = "1 - levenshtein(x.t, y.t) / greatest(strlen(x.t), strlen(y.t))"


def _cosine_sql(name, weights, least):
    return f"{name} AS (SELECT id_a, id_b, sum(a.w * b.w) AS c FROM {least} JOIN {weights} a ON a.id = id_a JOIN {weights} b ON b.id = id_b AND a.term = b.term GROUP BY id_a, id_b)"


_RULE = f"""{_KEY}, {_TW}, {_AW},
c AS (SELECT block, id, lower(title) AS t, lower(coalesce(abstract, '')) AS a, trim(coalesce(abstract, '')) = '' AS none FROM articles_df JOIN b USING (id)),
rep AS (SELECT block, t, a, min(id) AS id FROM c GROUP BY ALL),
cand AS (SELECT x.id AS id_a, y.id AS id_b FROM rep x JOIN rep y ON x.block = y.block AND x.id < y.id UNION ALL SELECT r.id, c.id FROM rep r JOIN c USING (block, t, a) WHERE r.id < c.id),
{_cosine_sql('tc', 'tn', 'cand')}, {_cosine_sql('ac', 'an', 'cand')},
scored AS (SELECT cand.id_a, cand.id_b, {{sim}} AS lev, coalesce(tc.c, 0) AS tc, coalesce(ac.c, 0) AS ac, x.none OR y.none AS none FROM cand JOIN c x ON x.id = cand.id_a JOIN c y ON y.id = cand.id_b
  LEFT JOIN tc ON tc.id_a = cand.id_a AND tc.id_b = cand.id_b LEFT JOIN ac ON ac.id_a = cand.id_a AND ac.id_b = cand.id_b),
dup AS (SELECT id_a, id_b FROM scored WHERE ((lev >= 0.9 OR tc >= 0.95) AND (ac >= 0.85 OR none)) OR (tc > 0.8 AND ac >= 0.94))""".replace("{sim}", _TITLE_SIM)


@query(f"WITH {_RULE} SELECT id_a, id_b FROM dup")
def dd_rule(spark, d):
    return dedupe.duplicates(table(spark, d, A)).select("id_a", "id_b")


_PRIORITY = {"ruraldocs": 1, "openplots": 2, "seedlib": 3}


def _decided(spark, d):
    a = table(spark, d, A)
    return cut(dedupe.decide(dedupe.duplicates(a), a, _PRIORITY))


_DEC = f"""{_RULE}, r AS (SELECT id, CASE dataset WHEN 'ruraldocs' THEN 1 WHEN 'openplots' THEN 2 WHEN 'seedlib' THEN 3 ELSE 4 END AS p FROM articles_df),
dec AS (SELECT CASE WHEN x.p <= y.p THEN id_a ELSE id_b END AS kept, CASE WHEN x.p <= y.p THEN id_b ELSE id_a END AS deleted FROM dup JOIN r x ON x.id = id_a JOIN r y ON y.id = id_b)"""


@query(f"WITH {_DEC} SELECT kept, deleted FROM dec")
def dd_priority(spark, d):
    return _decided(spark, d)


@query(f"WITH {_DEC} SELECT DISTINCT kept AS id, kept AS \"group\", 'left' AS is_deleted FROM dec UNION SELECT deleted, kept, 'deleted' FROM dec")
def dd_report(spark, d):
    return dedupe.report(_decided(spark, d))


@query(f"WITH {_DEC} SELECT id, title FROM articles_df WHERE id NOT IN (SELECT deleted FROM dec)")
def dd_survivors(spark, d):
    return dedupe.survivors(table(spark, d, A).select("id", "title"), _decided(spark, d))


@query(f"""WITH {_DEC}, e AS (SELECT id, trim(unnest(string_split(keywords, ';'))) AS v FROM articles_df),
m AS (SELECT id, v FROM e WHERE id NOT IN (SELECT deleted FROM dec) UNION SELECT kept, v FROM e JOIN dec ON e.id = deleted) SELECT id, list_sort(list_distinct(list(v))) AS keywords FROM m WHERE v <> '' GROUP BY id""")
def dd_merge2(spark, d):
    a = table(spark, d, A).select("id", F.transform(F.split("keywords", ";"), lambda w: F.trim(w)).alias("keywords"))
    return dedupe.merged_lists(a, _decided(spark, d), "keywords")
