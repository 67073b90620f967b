"""Small fixed cases of the string functions."""

import pytest
from pyspark.sql import functions as F

from harrow.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression("x").alias("o")).first()["o"]


@pytest.mark.parametrize(
    "f,value,wanted",
    [
        (T.unaccent, "Ção naïve Østre 中", "Cao naive stre "),
        (T.normal_text, "The GMOs grew 3x_fast, IN 2nd naïve-plots!", "the GMO grew fast IN naive plots"),
        (T.normal_sentence, "The studies of boxes and women's glasses", "study box woman glass"),
        (T.key_sorted, "zebra apples", "apple zebra"),
        (T.drop_escapes, "a.<U+00E9> b <U+00E9>c", "a.  b ; c"),
        (T.drop_escapes, "plain", "plain"),
        (T.drop_copyright, "Good text © 2010 Press", "Good text"),
        (T.drop_copyright, "[No abstract available]", ""),
        (T.drop_html, "<i>a</i> () &amp; &copy; b", "a & b"),
        (T.drop_braces, "{A}b{%}{long}", "Ab%"),
        (T.trim_punctuation, " ,.abc.", "abc"),
        (T.trim_punctuation, "abc. ", "abc."),
        (T.keyword_search, "Full text; Big Farms, small-farms;", "Big Farms ; small farms"),
        (T.country_name, "Côte (x), West", "Cote"),
        (T.journal_part, "Soil {J}ournal; vol. 3", "Soil Journal"),
        (T.journal_part, "x; Plough Letters, 3", "Plough Letters"),
        (T.keep_content, "The Farm of Farms", "Farm Farms"),
        (T.semicolon_head, "a; b c d", "b c d"),
        (T.access_to, "access water accessed", "access to water accessed"),
    ],
)
def test_values(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_similarity(spark):
    row = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "a")], "a string, b string").select(T.similarity("a", "b").alias("s")).collect()
    assert [r["s"] and round(r["s"], 4) for r in row] == [0.5714, None, None]


def test_zs_variants(spark):
    rows = [("organise", "organize", True), ("sizes", "zizes", False), ("realise", "realice", False), ("analysis", "analysiz", False)]
    got = spark.createDataFrame(rows, "a string, b string, w boolean").select(T.zs_variant("a", "b").alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_abbreviations(spark):
    rows = [("GMO", True), ("GMOs", True), ("Gmo", False), ("s", False), ("", False)]
    got = spark.createDataFrame(rows, "w string, t boolean").select(T.is_abbreviation("w").alias("g"), "t").collect()
    assert all(r["g"] == r["t"] for r in got)


def test_arrays(spark):
    assert one(spark, "a and b (3); c [de] or", T.split_parts) == ["a", "b", "c"]
    assert one(spark, "a b c", lambda x: T.bigrams(F.split(x, " "))) == ["a b", "b c"]
    assert one(spark, "a", lambda x: T.bigrams(F.split(x, " "))) == []
    assert one(spark, "a b c", lambda x: T.windows(F.split(x, " "), 2, 1)) == ["a b", "b c", "c"]
    assert sorted(one(spark, "a b c", lambda x: T.sub_phrases(x, 2))) == ["a", "a b", "b", "b c", "c"]
    assert one(spark, None, T.normal_words) == []


@pytest.mark.parametrize(
    "value,wanted",
    [("Soil carbon of farms [In German]", "Soil carbon of farms"), ("[Soil carbon]", "Soil carbon"), ("Soil [a] carbon under maize and rice plots", "Soil [a] carbon under maize and rice plots"), (None, None), ("", "")],
)
def test_last_brackets(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(T.drop_last_brackets("x").alias("o")).first()["o"] == wanted


def test_partitions(spark):
    assert one(spark, "a b c", T.partitions) == [["a", "b", "c"], ["a", "b c"], ["a b", "c"], ["a b c"]]
    assert one(spark, "", T.partitions) == [[]]
    assert one(spark, "w " * 21, T.partitions) is None
    assert one(spark, "soil; the water of x; sol", T.english_parts) == " the water of x"
    assert one(spark, "the NA ABC of XY", T.abbreviation_runs) == ["NA ABC"]
