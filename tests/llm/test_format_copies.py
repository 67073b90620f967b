import unicodedata
from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from harrow.llm import foldhash
from harrow.llm import format_copies as C


def canonical(text):
    keep = lambda c: not (unicodedata.category(c)[0] in "PZ" or c.isspace() or unicodedata.category(c) in ("Cc", "Cf"))
    return "".join(c for c in text if keep(c)).casefold()


def brute(rows):
    groups = defaultdict(set)
    for i, t, a in rows:
        if i is not None and t and a and t.strip() and a.strip():
            groups[tuple(sorted((canonical(t), canonical(a))))].add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


texts = st.text(alphabet=st.sampled_from(list("aAß ẞé.,-—\n ﬁ中İ1")), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_hash_and_comparison_agree_with_canonical_strings(a, b):
    h = foldhash.text_hashes(pa.array([a, b, None]))
    assert (h[0] == h[1]) == (canonical(a) == canonical(b))
    assert foldhash.same(a, b, block=3) == (canonical(a) == canonical(b))


def test_long_texts_are_hashed_in_blocks():
    text = "Ab, c—ß " * 100_000
    other = text.upper().replace(",", " ")
    h = foldhash.text_hashes(pa.array([text, other, text + "x"]))
    assert h[0] == h[1] != h[2]
    assert foldhash.same(text, other)


def test_copies_against_brute_force(spark):
    rows = [
        (5, "A title", "Some text."), (3, "a TITLE!", "some  text"), (9, "Some text", "A-title"), (7, "A title", "other"),
        (1, None, "Some text."), (2, " ", "Some text."), (4, "!!", "Some text"), (6, "...", "some text"), (3, "a TITLE!", "some  text"),
        (None, "A title", "Some text."), (11, "x" * 70_000, "y"), (12, "Y", "X" * 70_000),
    ]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string").selectExpr("*", "1 as first_id", "'k' as left")
    assert {tuple(r) for r in C.copies(df).collect()} == brute(rows)
    collapsed = {r["first_id"]: r["n_copies"] for r in C.collapse(df).collect()}
    assert collapsed == {3: 3, 7: 1, 4: 2, 11: 2}
    assert C.copies(df.where("id < 0")).count() == 0


def test_hot_group_is_salted(spark):
    df = spark.range(500).selectExpr("id", "'Same title' as title", "concat('Text', repeat('.', cast(id as int))) as abstract")
    assert C.copies(df, hot=7).count() == 499


def test_colliding_rows_form_their_own_classes(spark, monkeypatch):
    import harrow.llm.format_copies as module

    real = module.keys
    monkeypatch.setattr(module, "keys", lambda *a: real(*a).selectExpr("id", "0L as k1", "0L as k2"))
    rows = [(k, f"t{k % 3}", "a") for k in range(12)]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string")
    assert {tuple(r) for r in module.copies(df).collect()} == brute(rows)
