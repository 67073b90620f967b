"""Pipeline, incremental runs, sources, models and the contract."""

import json
import subprocess
import sys

import numpy as np
import pytest

from harrow import session
from harrow.operators import evaluation, models, relations
from harrow.plans import pipeline
from harrow.sources import files
from harrow.streaming import incremental

COLUMNS = "id bigint, title string, abstract string, year int, dataset string, journal string, keywords string, raw_authors string, raw_affiliation string"
ROWS = [
    (1, "Maize trial on <i>small</i> farms", "Small farms grew maize. Yields rose © 2010 Press", 2000, "a", "x; Plough Letters, 3", "maize; full text", "A. Smith; Jones, B.", "Dept of Hay, University of Lund, Sweden; P.O. Box 3"),
    (2, "Sorghum", None, 2001, "b", None, None, None, None),
    (3, None, "", None, None, "", "", "", ""),
]


def test_steps_are_isolated(spark):
    settings = {
        "columns": [
            {"column_filler_class": "AdvancedTextNormalizer"},
            {"column_filler_class": "GeoNameFinder", "names": ["Lund", "Sweden"], "columns_to_process": ["raw_affiliation"]},
            {"column_filler_class": "Nope", "step_name": "broken"},
            {"column_filler_class": "ColumnDataRenamer", "column_to_rename": "missing", "values_dict": {"a": "b"}},
            {"column_filler_class": "AuthorAndAuthorAffiliationExtractor"},
            {"column_filler_class": "CropsSearch", "taxonomy": [["maize", "cereals"]], "column_name": "crops"},
            {"column_filler_class": "StudyTypeLabeller", "rules": [["trial", "Trial"]]},
            {"column_filler_class": "StrategyFocusLabeller", "column_dictionary": {"Both": "maize;trial"}, "column_name": "focus", "columns_to_search": ["title"]},
            {"column_filler_class": "OutcomesFinder", "labels": {"Yield": ["yields"]}},
            {"column_filler_class": "PopulationTagsFinder"},
            {"column_filler_class": "KeywordNormalizer"},
            {"column_filler_class": "JournalNormalizer"},
            {"column_filler_class": "Deduplicator"},
        ]
    }
    df = spark.createDataFrame(ROWS, COLUMNS)
    out, status = pipeline.run(df, json.dumps(settings))
    states = {r["step"]: r["state"] for r in status.frame(spark).collect()}
    assert states.pop("broken") == states.pop("ColumnDataRenamer") == "Finished with errors"
    assert set(states.values()) == {"Finished"}, status.steps
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["title"] == "Maize trial on small farms" and one["abstract"] == "Small farms grew maize. Yields rose"
    assert one["countries"] == ["Lund", "Sweden"] and one["crops"] == ["cereals/maize"]
    assert one["study_type"] == ["Trial"] and got[2]["study_type"] == ["No category"]
    assert one["focus"] == ["Both"] and one["outcomes_found"] == ["Yield"] and got[3]["outcomes_found"] == []
    assert one["population"] == "Small scale farmers"
    assert one["author_names"] == ["Smith A", "Jones B"] and one["affiliations"] == ["university lund"]
    assert one["journal"] == "Plough Letters" and one["keywords"] == "maize"


def test_a_run_leaves_one_table_and_fails_nothing_by_it(spark):
    steps = ["AdvancedTextNormalizer", "Deduplicator", "Nope", "PopulationTagsFinder", "KeywordNormalizer", "JournalNormalizer"]
    settings = [{"column_filler_class": x, "full_normalization": True} for x in steps]
    settings[2:2] = [{"column_filler_class": "CropsSearch", "taxonomy": [["maize", "cereals"]], "column_name": "crops"}]
    before = set(session._scratch)
    out, status = pipeline.run(spark.createDataFrame(ROWS, COLUMNS), {"columns": settings})
    left = [x for x in session._scratch if x not in before]
    assert [s["state"] for s in status.steps] == [*["Finished"] * 3, "Finished with errors", *["Finished"] * 3], status.steps
    assert len(left) == 1 and all(left[0] in f for f in out.inputFiles())
    assert {r["id"]: r["crops"] for r in out.collect()} == {1: ["cereals/maize"], 2: [], 3: []}


def test_a_step_moves_what_it_found_and_not_the_table(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = pipeline._written(spark.createDataFrame([(k, f"t{k}") for k in range(40)], "id bigint, title string"))
        labels = spark.range(0, 40, 2).selectExpr("id as doc_id", "array('x') as l")
        out = pipeline._default(df, labels, "doc_id", "l")
        assert {r["id"]: (r["title"], r["l"]) for r in out.collect()} == {k: (f"t{k}", ["x"] if k % 2 == 0 else []) for k in range(40)}
        assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1
        assert pipeline._written(df.limit(0)).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("step_")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_words_are_mended_alike_with_and_without_a_join(spark, monkeypatch):
    rows = [(k, "the soil of maize-plots, café soil2") for k in range(80)] + [(90, "SOIL"), (91, "  ofsoil x. MAIZE"), (92, None), (93, ""), (94, "9")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    found = {r["id"]: r["t"] for r in relations.mended(df, "id", "t").collect()}
    assert found[90] == "soil" and found[91] == "  of soil x. maize"
    monkeypatch.setattr(relations, "FIXES", 0)
    assert found == {r["id"]: r["t"] for r in relations.mended(df, "id", "t").collect()}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, target, point = (str(tmp_path / x) for x in "stp")
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema
    work = lambda s: s.selectExpr("id", "id * 2 as twice")
    assert incremental.run_available(spark, source, schema, work, target, point).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert incremental.run_available(spark, source, schema, work, target, point).count() == 15
    assert incremental.pending(spark.range(5), spark.range(3), "id").count() == 2


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "wb") as f:
        f.write("a,b\n1,caf\xe9\n2,\n".encode("iso-8859-1"))
    assert [tuple(r) for r in files.read_csv(spark, path).collect()] == [("1", "café"), ("2", "")]
    cells = spark.createDataFrame([("['a', \"b, c\"]",), ("x",), ("",), (None,), ("[]",)], "c string")
    assert [r[0] for r in cells.select(files.list_cells("c")).collect()][:3] == [["a", "b, c"], ["x"], []]
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(tuple(r) for r in files.upsert(base, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    files.write_parts(spark.range(25), str(tmp_path / "parts"), rows=10)
    assert files.read_any(spark, str(tmp_path / "parts")).count() == 25


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in models.nearest(df.where("vec_id % 20 = 0"), df, 4).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -2
        assert got[q] == set(np.argsort(-s)[:4].tolist())


def test_topics_lower_the_error(spark):
    rows = [(k, t, 1.0) for k in range(20) for t in (("a", "b", "c") if k % 2 else ("x", "y", "z"))]
    own, words = models.nmf(spark.createDataFrame(rows, "id bigint, term string, w double"), k=2, rounds=8, max_df=1.0)
    w = {(r["id"], r["topic"]): r["weight"] for r in own.collect()}
    h = {(r["term"], r["topic"]): r["weight"] for r in words.collect()}
    error = sum((v - sum(w[i, c] * h[t, c] for c in range(2))) ** 2 for i, t, v in rows)
    assert error < 0.5


def test_classifier_learns(spark):
    rows = [(k, "maize yields rose in plots" if k % 2 else "goats and sheep were kept", "crop" if k % 2 else "animal") for k in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    got = models.TextClassifier(features=256).fit(df).predict(df).collect()
    assert all(r["predicted"] == ("crop" if r["id"] % 2 else "animal") for r in got)


def test_class_distances_are_centred(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 2.0], "a")], "i int, v array<double>, l string")
    for r in models.class_distances(df, "i", "v", "l").collect():
        assert abs(sum(r["scores"])) < 1e-9


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "t string, p string")
    got = {r["label"]: r for r in evaluation.report(df, "t", "p").collect()}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == 0.5 and got["b"]["support"] == 1


def test_entry_and_contract(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    queries, statements = e.queries(), e.oracle_sql()
    assert len(queries) > 150 and set(statements) <= set(queries)


def test_library_stands_without_the_training_data_subpackage():
    code = "import sys; sys.modules['harrow.llm'] = None\nimport importlib.util as u; u.find_spec = lambda n: None\nimport __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert int(out.stdout) > 150, out.stderr


@pytest.mark.parametrize("name", ["str_norm", "se_query", "lb_dict", "pv_topic_year", "gx_country", "set_minus_docs"])
def test_queries_have_stable_schemas(spark, sf, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    assert df.columns and df.count() >= 0
