"""Near-duplicates of large blocks: all pairs of the rule, without the others being stored."""

import math
import os
import random
from collections import Counter

from harrow.operators import dedupe
from harrow.session import shared_dir

WORDS = "soil carbon maize yield water goat sheep millet rice plot farm labour credit market drip ridge mulch clay sand loam".split()


def articles(spark, rows):
    return spark.createDataFrame(rows, "id bigint, title string, abstract string, year int, dataset string, keywords string")


def many(n, seed):
    """Titles of one block, in groups of near copies whose abstracts differ more or less, some without one."""
    pick, rows = random.Random(seed), []
    while len(rows) < n:
        title, abstract = [pick.choices(WORDS, k=k) for k in (6, 30)]
        for _ in range(pick.randint(1, 4)):
            t, a = title[:], abstract[:]
            if pick.random() < 0.5:
                t[pick.randrange(6)] = pick.choice(WORDS)
            for _ in range(pick.choice([0, 0, 1, 6])):
                a[pick.randrange(30)] = pick.choice(WORDS)
            text = "common block " + " ".join(t)
            text = text[:-1] + "q" if pick.random() < 0.2 else text
            rows.append((len(rows), text, pick.choice([" ".join(a)] * 6 + [None, " "]), 2020, "d", "k"))
    return rows


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(rows):
    def vectors(c):
        tf = [Counter((r[c] or "").split()) for r in rows]
        df = Counter(t for x in tf for t in x)
        out = []
        for x in tf:
            w = {t: k * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, k in x.items()}
            norm = math.sqrt(sum(v * v for v in w.values()))
            out.append({t: v / norm for t, v in w.items()})
        return lambda i, j: sum(v * out[j].get(t, 0) for t, v in out[i].items())

    title, abstract = vectors(1), vectors(2)
    first = {}
    for k, r in enumerate(rows):
        first.setdefault((r[1], r[2] or ""), k)
    found = set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            ki, kj = ((rows[k][1], rows[k][2] or "") for k in (i, j))
            if first[ki] != i or (ki != kj and first[kj] != j):
                continue
            a, b = rows[i][1], rows[j][1]
            tc, ac, none = title(i, j), abstract(i, j), any(not (rows[k][2] or "").strip() for k in (i, j))
            alike = tc >= 0.95 or 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.9
            if alike and (ac >= 0.85 or none) or tc > 0.8 and ac >= 0.94:
                found.add((rows[i][0], rows[j][0]))
    return found


def test_all_pairs_of_the_rule_are_found_in_tiles_too(spark, monkeypatch):
    rows = many(150, 1)
    want = expected(rows)
    assert len(want) > 50
    for tile in (dedupe.TILE, 40):
        monkeypatch.setattr(dedupe, "TILE", tile)
        got = [tuple(r) for r in dedupe.duplicates(articles(spark, rows)).select("id_a", "id_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_block_are_not_stored(spark):
    """Of a block of 1,500 rows there are a million pairs; what is written grows with the rows."""
    pick = random.Random(2)
    rows = [(k, f"common block {' '.join(pick.choices(WORDS, k=6))} x{k}", " ".join(pick.choices(WORDS, k=20)), 2020, "d", "k") for k in range(1500)]
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(shared_dir(spark).removeprefix("file:")) for f in fs)
    before = size()
    dedupe.duplicates(articles(spark, rows)).collect()
    assert size() - before < 3_000_000
