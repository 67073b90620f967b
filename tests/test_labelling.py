import random

from pyspark.sql import functions as F

from harrow.functions.stem import stem
from harrow.functions import text as T
from harrow.operators import labelling as L
from harrow.operators import merging, models, relations, search, tagging
from harrow.session import spread_join
from harrow.streaming import incremental


def test_relations_between_noun_phrases(spark):
    rows = [
        (1, "Legumes such as cowpea, velvet beans and soya were sown."),
        (2, "They grew such cereals as maize or teff."),
        (3, "Goats, sheep and other livestock were sold. Cowpea is a kind of legume."),
        (4, "Crops, especially maize, fell by 5 % of sales."),
        (5, None), (6, ""), (7, "Nothing of it."),
    ]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("*", "1 as t", "2 as general")
    got = {tuple(r) for r in relations.hearst(df, "id", "text").collect()}
    assert {(1, "legumes", "cowpea"), (1, "legumes", "velvet beans"), (1, "legumes", "soya")} <= got
    assert {(2, "cereals", "maize"), (2, "cereals", "teff"), (3, "livestock", "goats"), (3, "livestock", "sheep"), (3, "legume", "cowpea")} <= got
    assert {r for r in got if r[0] == 4} == {(4, "crops", "maize")} and not [r for r in got if r[0] > 4]
    basic = {tuple(r) for r in relations.hearst(df, "id", "text", extended=False).collect()}
    assert not [r for r in basic if r[0] == 3]


def test_compared_terms(spark):
    rows = [(1, "A comparison of drip lines and furrows in Torda", None), (2, None, "We compared mulching and manure for their effect on yield."), (3, "Nothing", "")]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string")
    assert {r["id"]: r["compared"] for r in L.compared_terms(df, ["title", "abstract"]).collect()} == {1: ["drip lines", "furrows"], 2: ["manure", "mulching"]}


def test_interventions_of_families(spark):
    docs = spark.createDataFrame([(1, "seed scheme here"), (2, "a seed project"), (3, "credit rules"), (4, None)], "id bigint, title string")
    taxonomy = spark.createDataFrame(
        [("seed scheme", "Inputs", ["access"]), ("seed project", "Inputs", ["other"]), ("credit rules", "Finance", []), ("credit scheme", "Finance", [])],
        "concept string, class string, middle array<string>",
    )
    got = {r["doc_id"]: (r["classes"], r["raw"], r["found"]) for r in L.interventions(search.Index.build(docs, ["title"]), taxonomy).collect()}
    assert got == {
        1: (["Inputs"], ["seed"], ["Inputs/access/", "Inputs/access/seed intervention"]),
        2: (["Inputs"], ["seed"], ["Inputs/other/seed intervention"]),
        3: (["Finance"], ["credit rules"], ["Finance/credit rules"]),
    }


def test_measurements_take_the_nearest_term(spark):
    rows = [(1, "Yield rose by 4.5 t while net returns fell 12%.", ["yield", "net returns"]), (2, "It fell by 3. Yield rose.", ["yield"]), (3, "Yield rose by 7.", []), (4, None, ["yield"]), (5, "Yield rose by 7.", None)]
    df = spark.createDataFrame(rows, "id bigint, t string, terms array<string>").selectExpr("*", "1 as n", "2 as c")
    got = sorted(tuple(r) for r in L.measurements(df, ["t"], "terms").collect())
    assert got == [(1, "12", "net returns"), (1, "4.5", "yield")]


def test_programmes_and_votes(spark):
    df = spark.createDataFrame([(1, "The Green Lake Project began", "by the Fund for Hay Initiative."), (2, "a project", None)], "id bigint, title string, abstract string")
    assert sorted(tuple(r) for r in L.programmes(df, ["title", "abstract"]).collect()) == [(1, "Fund for Hay Initiative"), (1, "Green Lake Project")]
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, None)], "k int, l string")
    got = {r["k"]: (r["majority"], r["all_labels"], r["agreed"]) for r in L.by_majority(votes, ["k"], "l").collect()}
    assert got == {1: ("a", ["a", "b"], True), 2: ("a", ["a", "b"], False)}


def test_meanings_are_found_longest_first(spark):
    dictionary = spark.createDataFrame([("SOM", "soil organic matter"), ("OM", "organic matter"), ("NR", "net returns")], "abbr string, meaning string")
    docs = spark.createDataFrame([(1, "Soil Organic Matter, and organic matter; net  returns"), (2, None), (3, "none")], "id bigint, t string").selectExpr("*", "1 as w", "2 as hits")
    found = L.meanings_in(docs, "t", dictionary)
    got = {r["id"]: r["text"] for r in L.replaced_meanings(found).collect()}
    assert got == {1: "Soil Organic Matter, (SOM) and organic matter; (OM) net returns (NR)", 2: "", 3: "none"}
    assert L.meanings_in(docs, "t", dictionary.where("abbr = 'x'")).count() == 3


def test_tagger_learns_and_scores(spark):
    rng = random.Random(2)
    names, verbs = ["maize", "teff", "finger millet"], ["grew", "sold", "stored"]
    rows = []
    for k in range(300):
        held = rng.sample(names, rng.randint(0, 2))
        rows.append((k, f"Farmers {rng.choice(verbs)} " + (" and ".join(held) if held else "little") + " in the plots", sorted(held)))
    df = spark.createDataFrame(rows, "id bigint, text string, entities array<string>")
    model = tagging.Tagger(features=512).fit(df.where("id < 200"))
    score = tagging.scores(model.predict(df.where("id >= 200")), df.where("id >= 200")).first()
    assert score["f1"] > 0.95
    spans = spark.createDataFrame([("maize and Maize", "maize"), ("none", "maize")], "t string, e string").select(tagging.last_span("t", "e").alias("s"))
    assert [r["s"] for r in spans.collect()] == [11, 0]


def test_stems():
    told = {"generously": "generous", "irrigation": "irrig", "hoping": "hope", "hopping": "hop", "skies": "sky", "agreed": "agre", "knightly": "knight", "gas": "gas", "a": "a", "yields": "yield"}
    assert {w: stem(w) for w in told} == told


def test_stems_keep_numbers(spark):
    df = spark.createDataFrame([("The 12 Yields of 3 hoping farmers",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.stems_with_numbers("t")).collect()] == [["12", "yield", "3", "hope", "farmer"], [], []]


def test_phrases_join_from_left_to_right(spark):
    words = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["b", "c"]), (3, ["x"]), (4, [])], "id bigint, l array<string>")
    found = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r["id"]: r["l"] for r in models.phrased(words, "id", "l", found).collect()} == {1: ["a b", "c d"], 2: ["b c"], 3: ["x"], 4: []}


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(6)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(250)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "item string")
    for t in (0.7, 0.85):
        wanted = {(a, b) for a in words for b in words if a != b and 1 - lev(a, b) / max(len(a), len(b)) >= t}
        assert {tuple(r) for r in merging.similar_pairs(df, t).collect()} == wanted


def test_hot_keys_are_joined_in_parts(spark):
    big = spark.range(30_000).selectExpr("id", "if(id % 2 = 0, 'hot', cast(id as string)) as k", "id as v").unionAll(spark.createDataFrame([(-1, None, 0)], "id bigint, k string, v bigint"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3)], "k string, w int")
    plan = spread_join(big, small, ["k"], least=2000)
    assert "_salt" in plan._jdf.queryExecution().toString()
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = spread_join(big, small, ["k"], how, least=2000), big.join(small, "k", how)
        assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    schema = "k int, at int, v string"
    source, target, point = (str(tmp_path / x) for x in ("source", "target", "point"))
    call = lambda: {tuple(r) for r in incremental.upsert_batches(spark, source, spark.createDataFrame([], schema).schema, "k", "at", target, point).collect()}
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([], schema).write.parquet(source)
    assert call() == set()
    add([(1, 1, "a"), (2, 1, "b")])
    assert call() == {(1, 1, "a"), (2, 1, "b")}
    assert call() == {(1, 1, "a"), (2, 1, "b")}  # nothing new
    add([(1, 2, "c"), (3, 1, "d"), (2, 0, "old")])
    assert call() == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}


def test_nothing_collects_what_grows(spark):
    """Topics of rows without a known term are zeros, not missing rows."""
    rows = [(k, t, 1.0) for k in range(40) for t in (("a", "b") if k % 2 else ("c", "d"))] + [(99, "rare", 1.0)]
    own, _ = models.nmf(spark.createDataFrame(rows, "id bigint, term string, w double"), k=2, rounds=3, min_df=0.1, max_df=0.9)
    assert own.select("id").distinct().count() == 41 and own.where("id = 99").agg(F.sum("weight")).first()[0] == 0


def test_storage_contexts_and_taxonomies(spark):
    df = spark.createDataFrame([(1, "They stored the dry 2 maize grain in a jar or bag. Seal it.", None), (2, "Stored.", "x"), (3, None, "")], "id bigint, t string, u string")
    assert [tuple(r) for r in L.storage(df, ["t", "u"], ["maize"]).collect()] == [(1, "stored", "dry grain jar")]
    c = spark.createDataFrame([(1, "Maize and  sorghum on maizefield"), (2, "none"), (3, None)], "id bigint, t string")
    assert {(r["id"], r["term"]): r["context"] for r in L.contexts(c, "t", ["maize", "sorghum"]).collect()} == {(1, "maize"): "maize and on maizefield", (1, "sorghum"): "and sorghum on maizefield"}
    t = spark.createDataFrame([("use of drip lines",), ("honey",), ("improved use of drip line",), ("zzz",)], "concept string")
    got = {r["concept"]: (r["name"], r["middle"]) for r in L.derived_taxonomy(t, ["drip lines", "soils"], ["honey"], ["use", "improved"]).collect()}
    assert got == {"use of drip lines": ("drip lines", "drip lines"), "improved use of drip line": ("drip line", "drip lines"), "zzz": ("zzz", "other")}
    m = spark.createDataFrame([("A ", 1, None), ("a", 0, 0), (None, 1, 1)], "t string, x int, y int")
    assert [tuple(r) for r in L.any_match(m, "t", ["x", "y"]).collect()] == [("a", 1, 0)]


def test_workbooks_come_back(spark, tmp_path):
    from harrow.sources import workbook

    rows = [(k, f"=1+{k} <&> é\n x", float(k) / 2, ["a", "b"]) for k in range(25)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, `a b` string, x double, l array<string>").coalesce(1)
    done = workbook.write(df, str(tmp_path / "books"), rows=10, widths={"id": 8})
    assert sorted(r["n"] for r in done.collect()) == [6, 10, 10]
    got = {r["id"]: r["a b"] for r in workbook.read(spark, str(tmp_path / "books")).collect()}
    assert len(got) == 26 and got["7"] == rows[7][1] and got["99"] is None
    assert workbook.letters(0) == "A" and workbook.letters(27) == "AB"
    assert workbook.write(df.where("id < 0"), str(tmp_path / "none")).count() == 0


def test_stacked_models_learn(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        label = rng.choice(["crop", "herd"])
        rows.append((k, label, " ".join(rng.choices(["maize", "teff", "plot"] if label == "crop" else ["goat", "sheep", "milk"], k=4)), "x y"))
    df = spark.createDataFrame(rows, "id bigint, label string, text string, other string")
    stack = models.Stacked([("text", "logistic"), ("other", "bayes")], features=256, trees=5).fit(df.where("id < 300"))
    f1 = {r["model"]: r["macro_f1"] for r in stack.scored(df.where("id >= 300")).collect()}
    assert f1["stacked"] > 0.95 and f1["text logistic"] > 0.95 and f1["other bayes"] < 0.8


def test_words_are_mended_by_the_collection(spark):
    rows = [(k, "maize rose here, of yield") for k in range(80)] + [(100, "MAIZE rose"), (101, "ofmaize, and Maize; x"), (102, None), (103, "")]
    df = spark.createDataFrame(rows, "id bigint, t string").selectExpr("*", "1 as w", "2 as fixed")
    got = {r["id"]: r["t"] for r in relations.mended(df, "id", "t").collect()}
    assert got[100] == "maize rose" and got[101] == "of maize, and Maize; x" and got[102] is None and got[103] == ""
    assert len(got) == 84 and got[5] == rows[5][1]
