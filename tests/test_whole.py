"""Queries do their whole job: results that a smaller share of the input would miss."""

from harrow import registry
from harrow.operators import models


def articles(spark, path, rows):
    columns = "id bigint, title string, abstract string, keywords string, identificators string, dataset string, journal string"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/articles_df.parquet")
    return str(path)


def test_the_index_holds_the_whole_text(spark, tmp_path):
    rows = [(1, "Goats", "A survey of maize plots", "sheep", "rice", "ruraldocs", "j"), (2, None, "evidence", None, None, "d", None)]
    d = articles(spark, tmp_path, rows)
    q = registry.queries()
    words = {"goat", "survey", "maize", "plot", "sheep", "rice", "evidence"}
    for name in ("se_build", "snk_model"):
        assert words <= {r["term"] for r in q[name](spark, d).collect()}
    assert {r["doc_id"]: r["label"] for r in q["lb_study_kw"](spark, d).collect()} == {1: "Survey", 2: "Evidence"}
    assert {r["id"]: r["tags"] for r in q["pipeline_run"](spark, d).collect()} == {1: ["Cereals", "Methods"], 2: []}


def test_every_vector_is_clustered_within_its_label(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 2)
    close = lambda k: [1.0, 0.01 * k, 0.0]
    rows = [(k, close(k), 1) for k in (1, 2, 3)] + [(k, close(k), 2) for k in (4, 5, 6)]
    rows += [(7, [0.0, 0.0, 1.0], 1), (8, [0.0, 1.0, 0.0], 2), (20, [-1.0, 0.0, 0.0], 1), (9, None, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["node"]: r["group"] for r in registry.queries()["ml_cluster"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5, 6: 5, 7: 7, 8: 8, 20: 20, 9: 9}
