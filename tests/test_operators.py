"""Operators against brute force on small fixtures."""

import math
from collections import Counter

from harrow.operators import dedupe, merging, reshape, search


def articles(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title string, abstract string, year int, dataset string, keywords string")


def test_row_ids_are_consecutive(spark):
    got = reshape.row_ids(spark.range(0, 1000, 3).selectExpr("id"), "id", 5, ranges=7).collect()
    assert sorted((r["id"], r["row_id"]) for r in got) == [(3 * k, k + 5) for k in range(334)]


def test_rename_and_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b", None]), (2, []), (3, None)], "id int, l array<string>")
    mapping = spark.createDataFrame([("a", "x"), ("a", "y")], "value string, new string")
    assert {r["id"]: r["renamed"] for r in reshape.rename_values(df, "id", "l", mapping).collect()} == {1: ["b", "x", "y"], 2: [], 3: []}
    assert reshape.explode_or(df, "l", "v").where("v = 'Unspecified'").count() == 2


def test_a_search_moves_no_posting_unless_it_has_many_terms(spark, monkeypatch):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "Maize yields rose", None), (2, "Maize", "yields"), (3, None, "maize yields rose; goats")]
        ix = search.Index.build(spark.createDataFrame(rows, "id bigint, title string, keywords string"), ["title", "keywords"])
        q = spark.createDataFrame([("maize",), ("maize yields rose",), ("",)], "query string")
        few = ix.search(q)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(search, "KEYS", 0)
        got = [sorted(tuple(r) for r in x.collect()) for x in (few, ix.search(q))]
        assert got[0] == got[1] == [("maize", 1), ("maize", 2), ("maize", 3), ("maize yields rose", 1), ("maize yields rose", 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_index_and_search(spark):
    rows = [(1, "Organising small farms", None, 2000, "d", None), (2, "Organizing farm labour markets", "", 2001, "d", "greenhouse"), (3, "Greenhouse gas", "x", 2002, "d", None), (4, None, None, None, None, None)]
    ix = search.Index.build(articles(spark, rows), ["title", "keywords"])
    q = spark.createDataFrame([("organising",), ("farm labour markets",), ("",), ("farm",)], "query string")
    exact = {(r["query"], r["doc_id"]) for r in ix.search(q).collect()}
    assert exact == {("organising", 1), ("farm labour markets", 2), ("farm", 1), ("farm", 2)}
    loose = {(r["query"], r["doc_id"]) for r in ix.search(q, 0.85).collect()}
    assert loose == exact | {("organising", 2)}
    assert {r["term"] for r in ix.wildcard("organi*ing").collect()} == {"organising", "organizing"}
    both = ix.search(spark.createDataFrame([("greenhouse",), ("greenhouse gas",)], "query string"))
    assert [r["doc_id"] for r in search.exclusion(both, "greenhouse", "greenhouse gas").collect()] == [2]


def greedy(items, similar, keep):
    """Each item goes to the last or first heavier similar one; roots by following."""
    order = sorted(items, key=lambda x: (-items[x], x))
    parent = {}
    for j, x in enumerate(order):
        near = [y for y in order[:j] if similar(x, y)]
        if near:
            parent[x] = near[-1] if keep == "last" else near[0]
    out = {}
    for x in order:
        y = x
        while y in parent:
            y = parent[y]
        out[x] = y
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_greedy_merge_matches_the_loop(spark):
    import random

    rng = random.Random(3)
    words = {"plant" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 6))): rng.randint(1, 5) for _ in range(40)}
    df = spark.createDataFrame(list(words.items()), "item string, weight int")
    for keep in ("last", "first"):
        got = {r["item"]: r["root"] for r in merging.merge_similar(df, 0.85, keep=keep).collect()}
        assert got == greedy(words, lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) >= 0.85, keep)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30) if k % 10 != 9] + [(50, 40), (5, 5)]
    got = {r["node"]: r["group"] for r in merging.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got[9] == 0 and got[15] == 10 and got[50] == 40 and got[29] == 20


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "We use the Net Present Value (NPV) and big words (ZZ)."), (2, None)], "id int, t string")
    assert [tuple(r) for r in merging.abbreviation_pairs(df, "t").collect()] == [(1, "NPV", "net present value")]


def test_tfidf_and_rule(spark):
    long = "soil carbon under maize plots rose quickly after three seasons of green manure"
    rows = [(1, "Soil carbon under maize", long, 2000, "b", "x;y"), (2, "Soils carbon under maize", long + " indeed", 2000, "a", "y;z"), (3, "Soil carbon elsewhere", "other words entirely", 2000, "a", None), (4, "Soil carbon under maize", long, 2001, "a", None), (5, None, None, None, None, None)]
    df = articles(spark, rows)
    w = {(r["id"], r["term"]): r["w"] for r in dedupe.tfidf(df, "title").collect()}
    n, docs = 5, {1: ["soil", "carbon", "maize"], 2: ["soil", "carbon", "maize"], 3: ["soil", "carbon", "elsewhere"], 4: ["soil", "carbon", "maize"]}
    dfreq = Counter(t for ts in docs.values() for t in ts)
    for i, ts in docs.items():
        x = {t: math.log((1 + n) / (1 + dfreq[t])) + 1 for t in ts}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for t in ts:
            assert abs(w[i, t] - x[t] / norm) < 1e-9
    pairs = dedupe.duplicates(df)
    assert [(r["id_a"], r["id_b"]) for r in pairs.collect()] == [(1, 2)]
    decided = dedupe.decide(pairs, df, {"a": 1, "b": 2})
    assert [tuple(r) for r in decided.collect()] == [(2, 1)]
    assert dedupe.survivors(df, decided).count() == 4


def test_population_tags(spark):
    df = spark.createDataFrame([(1, "small plots near a farm"), (2, "Small a b c d e f farm"), (3, "Farmers came"), (4, None), (5, "smallholder")], "id int, t string")
    got = {r["id"]: r["tag"] for r in search.population_tags(df, "t").collect()}
    assert got == {1: "Small scale farmers", 3: "Farmers", 5: "Small scale farmers"}
