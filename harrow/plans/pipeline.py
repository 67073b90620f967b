"""Settings-driven enrichment: a list of named steps, each a function of a table to a table.

Settings are JSON: ``{"columns": [{"column_filler_class": "<name>", ..., "step_name": "..."}]}``.  Every step is
validated against the table's columns before anything runs; a step that can't be planned is skipped and the table goes
on unchanged.  With ``isolate`` each step's table is written to the shared folder: a step that fails while running is
skipped too, with its error in the status, and later steps read the table instead of planning all earlier ones again.
What a step wrote besides its table and the index is removed after it, and so is the table before, so that the folder
never holds more than two tables of the run.  Short lists of cheap steps may do without.  The search index of the table is built when a step first wants it and used
by all later ones, until a step changes the texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe, entities, labelling, models, relations, search
from ..session import cut, parallelism, recorded, released, removed, scratch

Step = Callable[[DataFrame, dict], DataFrame]
FILLERS: dict[str, Step] = {}


def filler(name: str) -> Callable[[Step], Step]:
    def register(f: Step) -> Step:
        FILLERS[name] = f
        return f

    return register


@dataclass
class Status:
    """States of the steps of a run."""

    steps: list[dict] = field(default_factory=list)

    def set(self, name: str, state: str, error: str = "") -> None:
        for s in self.steps:
            if s["step"] == name:
                s |= {"state": state, "error": error}
                return
        self.steps.append({"step": name, "state": state, "error": error})

    def frame(self, spark) -> DataFrame:
        rows = [(k, s["step"], s["state"], s["error"]) for k, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, "position int, step string, state string, error string")


CHANGE_TEXTS = {"AdvancedTextNormalizer", "Deduplicator", "KeywordNormalizer"}


def run(df: DataFrame, settings: str | dict, isolate: bool = True) -> tuple[DataFrame, Status]:
    """The enriched table and the states: Finished, or Finished with errors for skipped steps."""
    spec = json.loads(settings) if isinstance(settings, str) else settings
    spark, status = df.sparkSession, Status()
    steps = [(s.get("step_name") or s.get("column_filler_class", ""), s) for s in spec.get("columns", [])]
    indexes: dict[tuple[str, ...], search.Index] = {}
    left: set[str] = set()  # paths of the run that are still read
    for name, _ in steps:
        status.set(name, "Pending")
    for name, s in steps:
        status.set(name, "In Progress")
        with recorded() as made:
            try:
                new = FILLERS[s["column_filler_class"]](df, s | {"indexes": indexes})
                _ = new.schema  # analysed here, so that wrong columns are found
                df = _written(new) if isolate else new
                status.set(name, "Finished")
            except Exception as e:  # a failing step is skipped, whatever failed; its error stays in the status
                status.set(name, "Finished with errors", f"{type(e).__name__}: {e}"[:300])
        if s.get("column_filler_class") in CHANGE_TEXTS:
            indexes.clear()
        new = None
        if isolate:
            left |= set(made)
            read = [f for t in (df, *(x.postings for x in indexes.values())) for f in t.inputFiles()[:1]]
            for path in [x for x in left if not any(os.path.basename(x) in f for f in read)]:
                removed(spark, path)
                left.remove(path)
            released(spark)
    return df, status


def _written(df: DataFrame) -> DataFrame:
    """The table written, by hash of its ids where the session's catalog can state that: joins on the id then move what
    a step found and not the table.  The catalog's entry goes at once, as the DataFrame doesn't need it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "step")
    write = df.write.option("compression", "zstd")
    if "id" not in df.columns or spark.conf.get("spark.sql.catalogImplementation") != "in-memory":
        write.parquet(path)
        return spark.read.parquet(path)
    name = os.path.basename(path).replace("-", "_")
    write.bucketBy(parallelism(spark), "id").format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # with a path of its own, so the files stay
    return out.select(*df.columns)


def _default(df: DataFrame, labels: DataFrame, key: str, column: str) -> DataFrame:
    joined = df.join(labels.withColumnRenamed(key, "id"), "id", "left")
    return joined.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))


def _index(df: DataFrame, s: dict) -> search.Index:
    columns = tuple(s.get("columns_to_search", ["title", "abstract", "keywords"]))
    known = s.setdefault("indexes", {})
    if columns not in known:
        known[columns] = search.Index.build(df, list(columns))
    return known[columns]


@filler("AdvancedTextNormalizer")
def normalise(df: DataFrame, s: dict) -> DataFrame:
    """Escapes, braces, tags, copyright remarks and loose marks go; with ``full_normalization`` words are mended too."""
    columns = s.get("columns_to_process", ["title", "abstract"])
    for c in columns:
        for clean in (T.drop_html, T.drop_braces, T.drop_escapes, T.drop_copyright, T.trim_punctuation):
            df = df.withColumn(c, clean(c))  # a projection each: nested, each would do all before it several times
    if s.get("full_normalization"):
        df = _written(df)  # mending counts the cleaned words first
        for c in columns:
            df = relations.mended(df, "id", c)
    return df


@filler("Deduplicator")
def deduplicate(df: DataFrame, s: dict) -> DataFrame:
    decided = cut(dedupe.decide(dedupe.duplicates(df), df, s.get("priority", {})))
    return dedupe.survivors(df, decided)


@filler("KeywordNormalizer")
def keywords(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumn("keywords", T.keyword_columns("keywords"))


@filler("JournalNormalizer")
def journal(df: DataFrame, s: dict) -> DataFrame:
    return df.withColumn("journal", T.journal_part("journal"))


@filler("AuthorAndAuthorAffiliationExtractor")
def authors(df: DataFrame, s: dict) -> DataFrame:
    df = df.withColumn("author_names", entities.author_names(s.get("column", "raw_authors")))
    parts = F.transform(F.split(F.coalesce(s.get("affiliations", "raw_affiliation"), F.lit("")), ";"), lambda x: entities.institution(entities.affiliation_parts(x)))
    return df.withColumn("affiliations", F.filter(parts, lambda x: x != ""))


@filler("GeoNameFinder")
def geography(df: DataFrame, s: dict) -> DataFrame:
    gazetteer = df.sparkSession.createDataFrame([(x,) for x in s["names"]], "name string")
    text = df.select("id", F.concat_ws(" ", *s["columns_to_process"]).alias("t"))
    found = entities.place_mentions(text, "id", "t", gazetteer).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("_l"))
    return _default(df, found.withColumnRenamed("_l", s.get("column_name", "countries")), "id", s.get("column_name", "countries"))


@filler("ColumnFiller")
def column(df: DataFrame, s: dict) -> DataFrame:
    rows = [(k, label) for label, ks in s["column_dictionary"].items() for k in ks]
    dictionary = df.sparkSession.createDataFrame(rows, "keyword string, label string")
    out = search.dictionary_label(_index(df, s), dictionary, s.get("threshold"), s.get("keep_hierarchy", False))
    name, details = s["column_name"], s.get("column_details", s["column_name"] + "_details")
    return _default(_default(df, out.select("doc_id", F.col("labels").alias(name)), "doc_id", name), out.select("doc_id", F.col("details").alias(details)), "doc_id", details)


@filler("CropsSearch")
def crops(df: DataFrame, s: dict) -> DataFrame:
    taxonomy = df.sparkSession.createDataFrame([tuple(x) for x in s["taxonomy"]], "narrow string, broad string")
    name = s["column_name"]
    return _default(df, search.taxonomy_label(_index(df, s), taxonomy).select("doc_id", F.col("values").alias(name)), "doc_id", name)


@filler("PopulationTagsFinder")
def population(df: DataFrame, s: dict) -> DataFrame:
    return df.join(search.population_tags(df, s.get("column", "abstract")).withColumnRenamed("tag", s.get("column_name", "population")), "id", "left")


@filler("StudyTypeLabeller")
def study_type(df: DataFrame, s: dict) -> DataFrame:
    labels = search.keyword_labels(_index(df, s), [tuple(r) for r in s["rules"]]).groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("study_type"))
    out = _default(df, labels, "doc_id", "study_type")
    return out.withColumn("study_type", F.when(F.size("study_type") == 0, F.array(F.lit("No category"))).otherwise(F.col("study_type")))


@filler("ColumnDataRenamer")
def rename(df: DataFrame, s: dict) -> DataFrame:
    c = F.col(s["column_to_rename"])
    for old, new in s["values_dict"].items():
        c = F.when(F.col(s["column_to_rename"]) == old, new).otherwise(c)
    return df.withColumn(s.get("column_to_save", s["column_to_rename"]), c)


@filler("StrategyFocusLabeller")
def strategy(df: DataFrame, s: dict) -> DataFrame:
    """Labels of rules whose keywords (joined by ``;``) are all in the text."""
    index, out = _index(df, s), df
    rules = [(label, [k.strip() for k in rule.split(";")]) for label, rule in s["column_dictionary"].items()]
    table = df.sparkSession.createDataFrame([(label, k, len(set(ks))) for label, ks in rules for k in set(ks)], "label string, query string, n int")
    hits = index.search(table.select("query")).join(table, "query").groupBy("doc_id", "label", "n").agg(F.count_distinct("query").alias("m"))
    labels = hits.where("m = n").groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias(s["column_name"]))
    return _default(out, labels, "doc_id", s["column_name"])


@filler("FullTextPriorityLabeller")
def priority(df: DataFrame, s: dict) -> DataFrame:
    p = F.col(s.get("probability_column", "probability"))
    return df.withColumn("priority", F.when(p < 0.1, "Unlikely").when(p < 0.4, "Less likely").otherwise("More likely"))


@filler("OutcomesFinder")
def outcomes(df: DataFrame, s: dict) -> DataFrame:
    """Sentence labels by a predictor (words of each label unless a model is set), united per article, with details."""
    columns = s.get("columns_to_take", [s["column_to_take"]] if "column_to_take" in s else ["title", "abstract"])
    out = labelling.united(labelling.sentence_labels(df, columns, s["labels"]))
    name = s.get("column", "outcomes_found")
    df = _default(df, out.select("id", F.col("labels").alias(name)), "id", name)
    details = s.get("column_details", "outcomes_details")
    return _default(df, out.select("id", F.col("details").alias(details)), "id", details)


@filler("ComparedTermsLabeller")
def compared(df: DataFrame, s: dict) -> DataFrame:
    name = s.get("column_name", "compared_terms")
    return _default(df, labelling.compared_terms(df, s.get("columns_to_process", ["title", "abstract"]), out=name), "id", name)


@filler("ProgramExtractor")
def programs(df: DataFrame, s: dict) -> DataFrame:
    """Programmes of a list ("name # meaning"), or, with the type "model", those that patterns tell."""
    name = s.get("column_name", "programs_found")
    if s.get("model_type", "model") == "model":
        found = labelling.programmes(df, s.get("columns_to_process", ["title", "abstract"]))
        found = found.groupBy("id").agg(F.array_sort(F.collect_set("programme")).alias(name))
        return _default(df, found, "id", name)
    rows = [(p.partition("#")[0].strip(), p) for p in s["programs"]]
    listed = df.sparkSession.createDataFrame(rows, "query string, program string")
    hits = _index(df, s).search(listed.select("query")).join(listed, "query")
    return _default(df, hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("program")).alias(name)), "doc_id", name)


@filler("InterventionsSearchForLabeling")
def interventions(df: DataFrame, s: dict) -> DataFrame:
    """``interventions_found, intervention_labels, interventions_found_raw`` from a taxonomy."""
    rows = [(t["concept"], t["class"], t.get("middle", [])) for t in s["taxonomy"]]
    taxonomy = df.sparkSession.createDataFrame(rows, "concept string, class string, middle array<string>")
    out = labelling.interventions(_index(df, s), taxonomy, s.get("threshold"))
    for column, name in (("found", "interventions_found"), ("classes", "intervention_labels"), ("raw", "interventions_found_raw")):
        df = _default(df.drop(name), out.select("doc_id", F.col(column).alias(name)), "doc_id", name)
    return df


@filler("MeasurementsLabeler")
def measured(df: DataFrame, s: dict) -> DataFrame:
    """Of each list column the terms that stand nearest to a number; ``measurements`` tells which columns have any."""
    mapping = s.get("mappings_for_measurements", {"interventions_found_raw": "measurements_for_interventions"})
    columns = s.get("columns_to_process", ["title", "abstract"])
    has = []
    for source, name in mapping.items():
        found = labelling.measurements(df, columns, source).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("_m"))
        df = df.join(found, "id", "left")
        new = F.coalesce("_m", F.array().cast("array<string>"))
        df = df.withColumn(name, F.array_sort(F.array_union(name, new)) if name in df.columns else new).drop("_m")
        has.append(F.when(F.size(name) > 0, F.lit(name)))
    return df.withColumn("measurements", F.array_distinct(F.array_compact(F.array(*has))))


@filler("InterventionLabeller")
def classified(df: DataFrame, s: dict) -> DataFrame:
    """A class for the text of ``narrow_concept_column``, by a classifier fitted on the rows that have one."""
    concept, known, out = s["narrow_concept_column"], s["label_column"], s.get("predicted_label_column", "Predicted Label")
    parts = [concept, *([s["broad_concepts_name"]] if "broad_concepts_name" in s else [])]
    text = F.concat_ws(" ", *(F.array_join(c, " ") if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in parts))
    label = F.element_at(known, 1) if dict(df.dtypes)[known].startswith("array") else F.col(known)
    label = label if not dict(df.dtypes)[known].startswith("array") else F.when(F.size(known) == 1, label)
    rows = df.select("id", text.alias("text"), label.alias("label"))
    model = models.TextClassifier(features=s.get("features", 4096)).fit(rows.where("label is not null and text <> ''"))
    return df.join(model.predict(rows.select("id", "text").where("text <> ''")).select("id", F.col("predicted").alias(out)), "id", "left")


@filler("TopicModeler")
def topics(df: DataFrame, s: dict) -> DataFrame:
    """``topics`` (three words joined), ``topics_keywords`` and ``topics_hierarchy`` of each row, by factors of its texts."""
    text = labelling.joined(df, s.get("columns_to_process", ["title", "abstract"]))
    own, words = models.text_topics(text, "text", k=s.get("n_components", 8), rounds=s.get("rounds", 6))
    r = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    top = words.withColumn("r", r).where("r <= 3").groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x.term).alias("w"))
    chosen = models.topics_of(own).join(F.broadcast(top), "topic")  # a row per topic
    got = chosen.groupBy("id").agg(
        F.array_sort(F.collect_set(F.array_join("w", ","))).alias("topics"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w")))).alias("topics_keywords"),
        F.array_sort(F.collect_set(F.concat(F.element_at("w", 1), F.lit("/")))).alias("topics_hierarchy"),
    )
    for name in ("topics", "topics_keywords", "topics_hierarchy"):
        df = _default(df.drop(name), got.select("id", name), "id", name)
    return df
