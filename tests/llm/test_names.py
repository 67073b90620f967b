import random

from harrow.llm import canonical
from harrow.llm import name_variants as V
from harrow.llm.bktree import BKTree


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_tree_finds_all_within_radius():
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    tree = BKTree([(w, k) for k, w in enumerate(words)])
    queries = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(40)]
    for q, found in zip(queries, tree.search(queries, lambda q: 2)):
        assert sorted(found) == sorted((d, k) for k, w in enumerate(words) if (d := plain_levenshtein(q, w)) <= 2)


def test_values_are_mapped_or_reported(spark):
    journals = spark.createDataFrame(
        [(1, "Annals of Plough Design", "Ann. Plough Des."), (2, "Hedge Letters", None), (3, None, None)],
        "journal_id int, journal_name string, short_name string",
    )
    typed = ["Annals of Plough Design", "ANNALS OF PLOUGH DESIGN", "Ann Plough Des", "Plough Design, Annals of", "Annlas of Plough Desing, vol. 3, no. 9",
             "Annals & Plough Design", "hedge letters 9(3)", "Journal of Boats", "Thesis, Torda", None, "  "]
    values = spark.createDataFrame([(t,) for t in typed if t and t.strip()], "value string")
    for shard in (50_000, 1):
        got = {r["value"]: r["ref_id"] for r in canonical.journals(values, journals, shard).collect()}
        assert [got[t] for t in typed if t and t.strip()] == [1, 1, 1, 1, 1, 1, 2, 0, 0]
    empty = canonical.journals(values, journals.where("journal_id > 9"))
    assert {r["ref_id"] for r in empty.collect()} == {0}


def test_articles_with_nulls_and_repeats(spark):
    articles = spark.createDataFrame(
        [(1, "Hedge Letters", "University of Torda, Lund; retired;; Dept. of Hay, University of Torda"), (2, None, " "), (3, " ", None)],
        "id bigint, journal string, raw_affiliation string",
    ).selectExpr("*", "1 as ref_id", "'x' as value")
    journals = spark.createDataFrame([(2, "Hedge Letters", None)], "journal_id int, journal_name string, short_name string")
    places = spark.createDataFrame(
        [(7, "University of Torda, Lund", "University of Torda", "Torda", "Lund", 3)],
        "affiliation_id int, raw_university_name string, normalized_name string, city string, country string, count_mentions int",
    )
    got = sorted(tuple(r) for r in canonical.articles(articles, journals, places).collect())
    assert got == [(1, "journal", 2), (1, "raw_affiliation", 0), (1, "raw_affiliation", 7)]


def test_person_forms():
    same = ["Marta K. Olsen", "Olsen, Marta", "OLSEN, Marta", "Dr. Marta Olsen", "marta olsen", "Marta Olsen (corresponding author)"]
    assert {V.person(s)[::2] for s in same} == {("marta", "olsen")}
    for s in ("M.K. Olsen", "Olsen MK", "Olsen, M.K."):
        assert V.person(s) == ("", "mk", "olsen")
    for s in ("et al.", "Anonymous", "", "  ", "n/a"):
        assert V.person(s) is None


def test_edits():
    assert V.edits("abcd", "abdc", 2) == 1
    assert V.edits("abcd", "xyz", 2) == 3
    assert V.edits("", "a", 1) == 1


def test_persons_are_linked(spark):
    forms = ["Martalina Olsentorp", "Olsentorp, Martalina", "OLSENTORP, Martalina", "Dr. Martalina Olsentorp", "martalina olsentorp", "Martalina K. Olsentorp"]
    other = ["Gustavo Bernsteg", "Bernsteg, Gustavo", "gustavo bernsteg", "Dr. Gustavo Bernsteg"]
    variants = ["Martalina Olsetnorp", "M.K. Olsentorp", "Olsentorp M.", "Olsentorp, Lina"]
    rows = [(";".join(forms + other + variants + ["et al.", ""]),), (None,), (" ; ",)]
    df = spark.createDataFrame(rows, "raw_authors string").selectExpr("*", "1 as id", "2 as value", "3 as entity")
    short = spark.createDataFrame([("Martalina", "Lina")], "given_name string, short_form string")
    linked = {r["value"]: r["entity"] for r in V.persons(df, short).collect()}
    assert {linked[x] for x in forms + variants} == {"martalina olsentorp"}
    assert {linked[x] for x in other} == {"gustavo bernsteg"}
    assert "et al." not in linked
    assert V.persons(df.where("id > 5"), short).count() == 0


def test_organisations_are_linked(spark):
    torda = ["University of Tordavik", "UNIVERSITY OF TORDAVIK", "Tordavik, University of", "Univ. of Tordavik", "University of Tordavik, Lundia", "Dept. of Hay, University of Tordavik, Tordavik, Lundia"]
    other = ["Bernsteg Seed Cooperative", "Bernsteg Seed Coop.", "BERNSTEG SEED COOPERATIVE"]
    rest = [f"University of {x}" for x in ("Aalborgia", "Mekkelin", "Zurrabad")]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(torda + other + rest + ["retired", "P.O. Box 3, Torda", ""])], "id bigint, raw_affiliation string")
    linked = {r["value"]: r["entity"] for r in V.organisations(df).collect()}
    assert len({linked[x] for x in torda}) == 1
    assert len({linked[x] for x in other}) == 1
    assert len(set(linked.values())) == 5
    pairs = V.pairs(V.organisations(df)).collect()
    assert len(pairs) == 15 + 3
    assert all(r["name_a"] < r["name_b"] for r in pairs)


def test_words_below_the_frequent_list_keep_their_counts(spark, monkeypatch):
    places = ["Tordavik"] * 60 + ["Tordavek"] * 40
    rng = random.Random(7)
    names = [f"{x} {''.join(rng.choices('bcdfglmnprst', k=9))} office" for x in places]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, raw_affiliation string")
    monkeypatch.setattr(V, "COMMON", 0.5)  # 50 of 100 spellings, as for 100,000
    got = {r["value"]: r["entity"] for r in V.organisations(df).collect()}
    assert len(got) == 100 and all("tordavek" in e for v, e in got.items() if "Tordavek" in v)


def test_short_names_by_slips_and_frequency(spark):
    journals = spark.createDataFrame([(1, "Nature", None), (2, "Science", None)], "journal_id int, journal_name string, short_name string")
    typed = ["Nature"] * 60 + ["Science"] * 60 + ["Natrue", "Scienec", "Natur"] + ["Mature"] * 30 + ["Future"]
    values = spark.createDataFrame([(t,) for t in typed], "value string")
    for shard in (50_000, 1):
        got = {r["value"]: r["ref_id"] for r in canonical.journals(values, journals, shard).collect()}
        assert got == {"Nature": 1, "Science": 2, "Natrue": 1, "Scienec": 2, "Natur": 1, "Mature": 0, "Future": 0}


def test_abbreviations_have_no_bound():
    names = [f"Annals of Soil {k}ology" for k in ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l")]
    from harrow.llm.name_forms import Vocabulary

    v = Vocabulary([*names, "Acta Semantica Kinetica"])
    assert "annals soil kology" in v.expanded(["ann", "soil", "kol"])
    assert v.expanded(["a", "s", "kin"]) == ["acta semantica kinetica"]


def test_short_forms_need_strong_odds():
    assert V._score("bo li", "bo lo", [1, 1], [1, 30], (9, 1)) > 0
    assert V._score("bo li", "bo lo", [1, 1], [1, 5], (9, 1)) < 0
    assert V._score("abc", "abd", [1], [90], (9, 1)) < 0
