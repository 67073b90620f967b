"""Topics of texts: the same factors as from a row for each term of each document, without such rows."""

import random

from harrow.operators import dedupe, models


def test_topics_of_texts_equal_those_of_their_weights(spark, monkeypatch):
    pick = random.Random(3)
    words = [f"w{chr(97 + k // 20)}{chr(97 + k % 20)}o" for k in range(80)]
    rows = [(k, " ".join(pick.choices(words[(k % 4) * 20 :][:20], k=9) + [f"only{'q' * (k % 7)}{chr(97 + k % 26)}x"])) for k in range(300)] + [(300, None), (301, "the of")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    want, want_words = models.nmf(dedupe.tfidf(df, "text"), k=4)
    monkeypatch.setattr(dedupe, "tfidf", None)
    monkeypatch.setattr(models, "BUCKET", 50)
    own, found = models.text_topics(df, "text", k=4)
    one = lambda df, key: {(r[key], r["topic"]): r["weight"] for r in df.collect()}
    for a, b in ((one(want, "id"), one(own, "id")), (one(want_words, "term"), one(found, "term"))):
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
