"""Dictionary and pattern labels, the tagger, stacked models, topic tables, and a run of every step."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labelling, models, tagging
from ..plans import pipeline
from ..session import cut, scratch, table
from ..sources import files, workbook
from . import query, sql
from .searching import _POST, A, index

_TAX = [
    ("drip irrigation", "Technology intervention", ["water"]),
    ("voucher scheme", "Socioeconomic intervention", ["finance"]),
    ("crop rotation", "Ecosystem intervention", ["soils", "other"]),
    ("crop insurance", "Socioeconomic intervention", []),
    ("extension service", "Socioeconomic intervention", ["advice"]),
    ("extension approach", "Socioeconomic intervention", ["advice"]),
]


def _names():
    """What each concept is called, by the rule of families, for the SQL."""
    out = []
    for concept, kind, middle in _TAX:
        first, _, last = concept.rpartition(" ")
        lasts = [c.rpartition(" ")[2] for c, _, _ in _TAX if c.rpartition(" ")[0] == first]
        family = all(x in labelling.EXTENSIONS for x in lasts)
        name, raw = (f"{first} intervention", first) if family else (concept, concept)
        for m in middle or [""]:
            out.append((concept, kind, name, raw, f"{kind}/{m}/{name}" if m else f"{kind}/{name}", f"{kind}/{m}/" if m not in ("", "other") else None))
    return out


_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _names())


@query(f"""WITH {_POST}, k(term, class, name, raw, path, layer) AS (VALUES {_VALUES}), h AS (SELECT doc_id, k.* FROM k JOIN post USING (term))
SELECT doc_id, list_sort(list_distinct(list(class))) AS classes, list_sort(list_distinct(list(raw))) AS raw, list_sort(list_distinct(list_concat(list(path), coalesce(list(layer) FILTER (layer IS NOT NULL), [])))) AS found FROM h GROUP BY doc_id""")
def lb_interv(spark, d):
    """Interventions of a taxonomy: concepts that differ in an extension word are one, with class and middle layer."""
    taxonomy = spark.createDataFrame(_TAX, "concept string, class string, middle array<string>")
    return labelling.interventions(index(spark, d), taxonomy)


_END = "|".join(labelling.PROGRAMME)
_TEXT = "coalesce(title, '') || '. ' || coalesce(abstract, '')"


@query(rf"""SELECT DISTINCT id, p AS programme FROM (SELECT id, regexp_replace(unnest(regexp_extract_all({_TEXT}, '((?:[A-Z][A-Za-z&-]+ (?:(?:of|for|and|the) )*)+(?:{_END}))\b', 1)), '^(?:The|A|An|In|Under) ', '') AS p FROM articles_df) WHERE contains(p, ' ')""")
def lb_programs_model(spark, d):
    """Programmes that the texts of the articles name, told by patterns."""
    return labelling.programmes(table(spark, d, A), ["title", "abstract"])


@query(r"""WITH m AS (SELECT lower(journal_name) AS meaning, min(short_name) AS abbr FROM journal_list WHERE short_name IS NOT NULL AND NOT regexp_matches(journal_name, '[^A-Za-z ]') GROUP BY 1),
d AS (SELECT id, ' ' || array_to_string(list_transform(string_split(trim(regexp_replace(coalesce(journal, ''), '\s+', ' ', 'g')), ' '), lambda w: regexp_replace(lower(w), '^\W+|\W+$', '', 'g')), ' ') || ' ' AS t FROM articles_df WHERE id IS NOT NULL),
h AS (SELECT id, abbr, meaning FROM d JOIN m ON contains(t, ' ' || meaning || ' '))
SELECT id, abbr, meaning FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.id = a.id AND b.meaning <> a.meaning AND contains(b.meaning, a.meaning))""")
def ab_find(spark, d):
    """Listed titles inside the typed journals, the longer before the shorter."""
    found = labelling.meanings_in(table(spark, d, A).where("id is not null"), "journal", _titles(spark, d))
    return found.select("id", F.explode("hits").alias("h")).select("id", "h.abbr", "h.meaning").distinct()


def _titles(spark, d):
    """``abbr, meaning``: short names of the listed journals."""
    j = table(spark, d, "journal_list").where("short_name is not null and not journal_name rlike '[^A-Za-z ]'")
    return j.select(F.col("short_name").alias("abbr"), F.lower("journal_name").alias("meaning"))


@query()
def ab_replace(spark, d):
    """Typed journals with the short name behind each listed title inside them; greedy, so no SQL."""
    found = labelling.meanings_in(table(spark, d, A).where("journal is not null"), "journal", _titles(spark, d))
    return labelling.replaced_meanings(found)


_FIND = [("maize", "irrigation"), ("survey", "household"), ("soil", "yield")]


@query(f"WITH {_POST}, q(a, b) AS (VALUES {', '.join(map(str, _FIND))}) SELECT a, b, count(*) AS n FROM q JOIN post x ON x.term = a JOIN post y ON y.term = b AND y.doc_id = x.doc_id GROUP BY a, b")
def jn_intersect(spark, d):
    """In how many texts both terms of a pair stand."""
    post = index(spark, d).postings
    q = spark.createDataFrame(_FIND, "a string, b string")
    x = q.join(post.select(F.col("term").alias("a"), "doc_id"), "a")
    return x.join(post.select(F.col("term").alias("b"), "doc_id"), ["b", "doc_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))


_KEEP = f"list_filter(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')) AND NOT list_contains({sql.STOP}, w))"


@query(f"SELECT id, length({_KEEP})::INT AS n FROM articles_df")
def str_norm_num(spark, d):
    """Numbers of the words kept when titles become stems with their numbers."""
    return table(spark, d, A).select("id", F.size(T.stems_with_numbers("title")).alias("n"))


@query()
def str_norm_num_stems(spark, d):
    """The stems themselves; a stemmer has no SQL."""
    return table(spark, d, A).select("id", F.array_join(T.stems_with_numbers("title"), " ").alias("stems"))


@query()
def str_phrase(spark, d):
    """Words of the titles with those joined that the collection uses as one expression."""
    words = table(spark, d, A).select("id", T.token_list("title").alias("l"))
    return models.phrased(words, "id", "l", models.phrases(words, "id", "l")).select("id", F.array_join("l", ";").alias("words"))


_TAGGED = ["maize", "sorghum", "cassava", "rice", "finger millet"]


def _entity_rows(spark, d):
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", " "), F.lit(" "))
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(f" {c} ")), c) for c in _TAGGED)))
    return table(spark, d, A).where("title is not null").select("id", F.col("title").alias("text"), F.array_sort(held).alias("entities"))


@query("SELECT id, c AS entity, (length(title) - position(reverse(c) IN reverse(lower(title))) - length(c) + 2)::INT AS start FROM articles_df, (SELECT unnest(['maize', 'sorghum', 'cassava', 'rice', 'finger millet']) AS c) WHERE contains(' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || c || ' ') AND position(reverse(c) IN reverse(lower(title))) > 0")
def ml_ner_prep(spark, d):
    """Span of the last mention of each entity of a title (positions from 1): the rows a tagger is trained on."""
    rows = _entity_rows(spark, d).select("id", "text", F.explode("entities").alias("entity"))
    return rows.select("id", "entity", tagging.last_span("text", "entity").cast("int").alias("start")).where("start > 0")


def _tagger(spark, d):
    rows = _entity_rows(spark, d)
    held_out = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    return tagging.Tagger().fit(rows.where(~held_out)), rows.where(held_out)


@query()
def ml_ner_train(spark, d):
    """Entities that a tagger, trained on nine tenths of the titles, finds in the others."""
    model, rest = _tagger(spark, d)
    return model.predict(rest)


@query()
def ml_ner_eval(spark, d):
    """Precision and recall of the tagger on the held-out tenth; titles rightly left empty count."""
    model, rest = _tagger(spark, d)
    return tagging.scores(model.predict(rest), rest)


@query()
def lb_interv_ner(spark, d):
    """Entities of held-out titles with the class of each by a classifier: ``class/entity``."""
    model, rest = _tagger(spark, d)
    found = model.predict(rest).select("id", F.explode("found").alias("text"))
    known = spark.createDataFrame([(c, "Cereal" if c != "cassava" else "Root crop") for c in _TAGGED], "text string, label string")
    kind = models.TextClassifier(features=256).fit(known).predict(found)
    return kind.groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "predicted", "text"))).alias("labels"))


def _study(spark, d):
    s = table(spark, d, "study_type_df").where("abstract is not null and exact_study_type is not null")
    words = F.split(F.trim(F.regexp_replace("abstract", r"\s+", " ")), " ")
    return s.select(
        "id", "split_name", F.col("exact_study_type").alias("label"), F.concat_ws(". ", "title", "abstract").alias("text"), "title",
        F.array_join(F.slice(words, 1, 60), " ").alias("head"), F.array_join(F.slice(F.reverse(words), 1, 60), " ").alias("tail"),
    )


@query()
def ml_stack(spark, d):
    """Macro-F1 on the test split of base classifiers and of boosted stumps over their probabilities."""
    rows = _study(spark, d)
    stack = models.Stacked([("text", "logistic"), ("text", "bayes"), ("title", "logistic")]).fit(rows.where("split_name = 'train'"))
    return stack.scored(rows.where("split_name = 'test'"))


@query()
def ml_bert_variants(spark, d):
    """The same over the first and the last words of the texts, as encoders of bounded length see them."""
    rows = _study(spark, d)
    stack = models.Stacked([("head", "logistic"), ("tail", "logistic")]).fit(rows.where("split_name = 'train'"))
    return stack.scored(rows.where("split_name = 'test'"))


def _topic_parts(spark, d):
    from .learning import _topics

    own, words = _topics(spark, d)
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return own, words.withColumn("r", r)


@query()
def ml_topic_stats(spark, d):
    """Of each topic its first ten words and how many articles have it."""
    own, words = _topic_parts(spark, d)
    top = words.where("r <= 10").groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term), ", ").alias("words"))
    return top.join(models.topics_of(own).groupBy("topic").agg(F.count("*").alias("n_articles")), "topic", "left").select("topic", "words", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))


@query()
def ml_topic_words(spark, d):
    """Head words of each topic: of its first fifty, ranked by PageRank on their similarities, the first and two like it."""
    _, words = _topic_parts(spark, d)
    pool = cut(words.where("r <= 50").join(models.term_vectors(words), "term").select("topic", "term", "v"))  # 50 a topic
    pairs = pool.join(pool.select("topic", F.col("term").alias("other"), F.col("v").alias("u")), "topic").where("term <> other")
    pairs = cut(pairs.select("topic", "term", "other", models.cosine("v", "u").alias("s")))
    node = lambda c: F.concat_ws("|", F.col("topic").cast("string"), c)
    rank = models.pagerank(pairs.where("s > 0").select(node("term").alias("a"), node("other").alias("b"), F.col("s").alias("w")), rounds=20)
    ranked = pool.select("topic", "term", node("term").alias("node")).join(rank, "node").select("topic", "term", F.round("rank", 9).alias("rank"))
    order = Window.partitionBy("topic").orderBy(F.desc("rank"), "term")
    first = ranked.withColumn("p", F.row_number().over(order)).where("p = 1").select("topic", F.col("term").alias("other"))
    near = first.join(pairs, ["topic", "other"]).where("s >= 0.35").join(ranked, ["topic", "term"])
    near = near.withColumn("p", F.row_number().over(order) + 1).where("p <= 3").select("topic", "p", "term")
    return first.select("topic", F.lit(1).alias("p"), F.col("other").alias("term")).unionAll(near)


@query()
def ml_topic_kw(spark, d):
    """Keywords of each topic: its hundred words, ranked by mean similarity to its first three; 20, and all from 0.5 on."""
    _, words = _topic_parts(spark, d)
    vectors = models.term_vectors(words)
    pool = words.where("r <= 100").join(vectors, "term")
    first = words.where("r <= 3").join(vectors, "term").select("topic", F.col("v").alias("u"))
    sim = pool.join(first, "topic").groupBy("topic", "term").agg(F.avg(models.cosine("v", "u")).alias("s"))
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("s"), "term"))
    return sim.withColumn("r", r).where("r <= 20 or s >= 0.5").select("topic", "term", F.round("s", 4).alias("similarity"))


_OUT = {"Income": ["income", "returns", "costs"], "Yield": ["yield", "yields", "germination"], "Water": ["water", "runoff", "irrigation"]}
_SENT = rf"s AS (SELECT id, unnest(list_filter(string_split(regexp_replace({_TEXT}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: trim(w) <> '')) AS s FROM articles_df)"


@query(f"""WITH {_SENT}, l AS ({' UNION ALL '.join(f"SELECT id, s, '{k}' AS label FROM s WHERE list_has_any(string_split(regexp_replace(lower(s), '[^a-z]+', ' ', 'g'), ' '), {ws})" for k, ws in _OUT.items())})
SELECT id, list_sort(list_distinct(list(label))) AS labels, list_sort(list_distinct(list('[' || label || ']' || s))) AS details FROM l GROUP BY id""")
def lb_outcomes(spark, d):
    """Labels of sentences of title and abstract, united per article with the sentences that gave them."""
    return labelling.united(labelling.sentence_labels(table(spark, d, A), ["title", "abstract"], _OUT))


@query("""WITH v AS (SELECT lower(trim(title)) AS k, exact_study_type AS l FROM study_type_df WHERE exact_study_type IS NOT NULL AND title IS NOT NULL), c AS (SELECT k, l, count(*) AS n FROM v GROUP BY ALL)
SELECT k, arg_min(l, (-n, l)) AS majority, list_sort(list_distinct(list(l))) AS all_labels, max(n) > sum(n) * 0.5 AS agreed FROM c GROUP BY k""")
def swi_label(spark, d):
    """Titles labelled more than once: the majority, all labels, and whether the majority is one."""
    v = table(spark, d, "study_type_df").where("title is not null").select(F.lower(F.trim("title")).alias("k"), "exact_study_type")
    return labelling.by_majority(v, ["k"], "exact_study_type")


_TERMS = ["yield", "costs", "rainfall", "losses", "net returns"]
_NUM = labelling.NUMBER


@query(rf"""WITH {_SENT}, t AS (SELECT id, row_number() OVER () AS n, string_split(trim(regexp_replace(lower(s), '[^\w.,%-]+', ' ', 'g')), ' ') AS w FROM s),
u AS (SELECT id, n, w, unnest(w) AS x, unnest(range(0, length(w))) AS i FROM t), num AS (SELECT id, n, i, regexp_extract(x, '{_NUM}') AS number FROM u WHERE regexp_matches(x, '{_NUM}')),
term AS (SELECT n, i, k AS term FROM u, (SELECT unnest({_TERMS}) AS k) WHERE array_to_string(list_transform(w[i + 1:i + length(string_split(k, ' '))], lambda y: regexp_replace(y, '[.,]+$', '')), ' ') = k)
SELECT id, number, term FROM (SELECT num.id, number, term, row_number() OVER (PARTITION BY num.n, num.i ORDER BY abs(num.i - term.i), term.i, term) AS r FROM num JOIN term USING (n)) WHERE r = 1""")
def lb_measure(spark, d):
    """Terms of a list nearest to each number of a sentence."""
    terms = F.array(*map(F.lit, _TERMS))
    return labelling.measurements(table(spark, d, A).withColumn("terms", terms), ["title", "abstract"], "terms")


@query("SELECT affiliation_id::VARCHAR AS affiliation_id, normalized_name, city, count_mentions::VARCHAR AS count_mentions FROM affiliation_map")
def snk_excel(spark, d):
    """A table written as styled workbooks of at most a hundred rows, and read back."""
    path = scratch(spark, "books")
    workbook.write(table(spark, d, "affiliation_map").select("affiliation_id", "normalized_name", "city", "count_mentions"), path, rows=100, widths={"normalized_name": 60})
    return workbook.read(spark, path)


@query("""SELECT 'articles' AS title, column_name AS field, CASE WHEN column_name = 'url' THEN 'url' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'number' END AS kind
FROM (DESCRIBE SELECT * FROM articles_df)""")
def snk_kibana(spark, d):
    """Fields of an index pattern for a search server's front end, read back from its saved object."""
    payload = files.index_pattern(table(spark, d, A).limit(0), "articles", url_columns={"url": "{{rawValue}}"})
    made = spark.createDataFrame([(payload,)], "doc string")
    fields = F.from_json(F.get_json_object("doc", "$.attributes.fields"), "array<struct<name:string,type:string,format:string>>")
    each = made.select(F.get_json_object("doc", "$.attributes.title").alias("title"), F.explode(fields).alias("f"))
    return each.select("title", F.col("f.name").alias("field"), F.coalesce(F.col("f.format"), F.col("f.type")).alias("kind"))


SETTINGS = {
    "columns": [
        {"column_filler_class": "AdvancedTextNormalizer", "full_normalization": True},
        {"column_filler_class": "Deduplicator", "priority": {"ruraldocs": 1}},
        {"column_filler_class": "KeywordNormalizer"},
        {"column_filler_class": "JournalNormalizer"},
        {"column_filler_class": "AuthorAndAuthorAffiliationExtractor"},
        {"column_filler_class": "GeoNameFinder", "columns_to_process": ["title", "abstract"], "names": ["kenya", "india", "torda"]},
        {"column_filler_class": "TopicModeler", "columns_to_process": ["title"], "n_components": 6, "rounds": 3},
        {"column_filler_class": "CropsSearch", "column_name": "crops", "taxonomy": [["maize", "cereals"], ["goat", "livestock"]]},
        {"column_filler_class": "PopulationTagsFinder"},
        {"column_filler_class": "ProgramExtractor", "model_type": "list", "programs": ["voucher scheme # inputs", "drip irrigation # water"]},
        {"column_filler_class": "ColumnFiller", "column_name": "tags", "column_dictionary": {"Cereals": ["maize", "sorghum"], "Methods": ["survey", "trial"]}},
        {"column_filler_class": "InterventionsSearchForLabeling", "taxonomy": [{"concept": c, "class": k, "middle": m} for c, k, m in _TAX]},
        {"column_filler_class": "MeasurementsLabeler"},
        {"column_filler_class": "StudyTypeLabeller", "rules": [["survey", "Survey"], ["trial", "Trial"]]},
        {"column_filler_class": "ComparedTermsLabeller"},
        {"column_filler_class": "ColumnDataRenamer", "column_to_rename": "dataset", "values_dict": {"ruraldocs": "rural"}, "column_to_save": "source"},
        {"column_filler_class": "InterventionLabeller", "narrow_concept_column": "title", "label_column": "intervention_labels"},
        {"column_filler_class": "OutcomesFinder", "labels": _OUT},
        {"column_filler_class": "StrategyFocusLabeller", "column_name": "strategy", "column_dictionary": {"Water": "irrigation;yield", "Maize": "maize"}},
        {"column_filler_class": "FullTextPriorityLabeller"},
    ]
}
_ALL = [s["column_filler_class"] for s in SETTINGS["columns"]]


@query()
def nz_full(spark, d):
    """Titles and abstracts after all cleaners, with capitals and words run together mended by what the collection shows."""
    step = {"column_filler_class": "AdvancedTextNormalizer", "full_normalization": True}
    out, _ = pipeline.run(table(spark, d, A), {"columns": [step]})
    return out.select("id", "title", "abstract")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', 'Finished')" for k, n in enumerate(_ALL)) + ") t(position, step, state)")
def pipeline_all(spark, d):
    """Every step in one run, each isolated."""
    rows = table(spark, d, A).withColumn("probability", F.pmod(F.col("id"), F.lit(100)) / 100)
    _, status = pipeline.run(rows, SETTINGS)
    return status.frame(spark).select("position", "step", "state")


@query()
def pipeline_labels(spark, d):
    """What the steps of one isolated run found for each article that is left."""
    rows = table(spark, d, A).withColumn("probability", F.pmod(F.col("id"), F.lit(100)) / 100)
    out, _ = pipeline.run(rows, SETTINGS)
    return out.select("id", "topics", "crops", "population", "programs_found", "tags", "interventions_found", "measurements", "study_type", "compared_terms", "source", "strategy", "priority", "outcomes_found")
