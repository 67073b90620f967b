import random

import regex

from harrow.llm import overlap as O
from harrow.llm import tokens as T
from harrow.llm import wordcodes as W


def article(rng, n=90):
    return " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))


def test_exact_and_near_pairs(spark):
    rng = random.Random(3)
    rows, wanted = [], set()
    for k in range(60):
        text = article(rng)
        rows.append((k, f"Title {k} of plots", text, "train"))
        if k % 3 == 0:
            words = text.split()
            for _ in range(6):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            changed = " ".join(words)
            if k % 2:
                changed = changed.upper().replace(" ", "\n ")
            rows.append((1000 + k, f"<i>Title</i> {k} of plots", changed, "test"))
            wanted.add((1000 + k, k))
        if k % 10 == 0:
            rows.append((2000 + k, f"TITLE {k}, of plots", f"**{text}**", "dev"))
            wanted.add((2000 + k, k))
        rows.append((3000 + k, f"Title {k} of plots", article(rng), "test"))  # the title alone
        half = text.split()[:45] + article(rng, 45).split()
        rows.append((4000 + k, "Another title", " ".join(half), "dev"))  # half of the text
    rows += [(9000, "t", None, "test"), (9001, "t", "  ", "dev"), (None, "t", "text of it", "test"), (9002, None, "...", "train"), (9003, "q", "q", None)]
    rows.append((9004, "short", "two words", "train"))
    rows.append((9005, "SHORT", "Two words!", "test"))
    wanted.add((9005, 9004))
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string, split_name string").selectExpr("*", "'d' as dataset", "1 as h", "2 as runs")
    found = O.overlaps(df)
    assert {(r["eval_id"], r["train_id"]) for r in found.collect()} == wanted
    by = {r["split_name"]: r for r in O.report(df, found).collect() if r["split_name"]}
    assert by["dev"]["n_pairs"] == 6 and by["dev"]["n_exact"] == 6
    assert O.overlaps(df.where("id < 0")).count() == 0


def test_many_copies_are_all_paired(spark):
    df = spark.range(40).selectExpr(
        "id", "'Same' as title", "'one two three four five six seven' as abstract", "case when id < 30 then 'train' else 'test' end as split_name"
    )
    assert O.overlaps(df).count() == 300


def words(*texts):
    own = W.canonical(*texts)
    return regex.findall(rf"[\p{{Han}}{T.KANA_THAI}]|[[\p{{L}}\p{{M}}\p{{N}}]--[\p{{Han}}{T.KANA_THAI}]]+", own, regex.V1)


def shingles(*texts):
    """Runs by the plain rule, as tuples of words."""
    found = words(*texts)
    lone = [len(w) == 1 and regex.match(rf"[\p{{Han}}{T.KANA_THAI}]", w) is not None for w in found]
    out = {tuple(found[k : k + (10 if lone[k] else 5)]) for k in range(len(found))}
    out = {r for r in out if len(r) == (10 if regex.match(rf"[\p{{Han}}{T.KANA_THAI}]", r[0]) else 5)}
    return out or {tuple(found)}


def test_words_and_runs_are_those_of_the_plain_rule():
    rng = random.Random(1)
    texts = ["A-b", "中文，字 and 漢字仮名ひらがな", "", "ß Straße ÉCOLE e\u0301t", "ภาษาไทย now", "x" * 300_000 + " y z", article(rng, 20_000), "a\0b c", "two words"]
    done = [W.canonical("", t) for t in texts]
    seen = []
    for first, bounds, codes, single in W.coded(done):
        t, r = W.runs(bounds, codes, single)
        for k in range(len(bounds) - 1):
            want = words("", texts[first + k])
            assert bounds[k + 1] - bounds[k] == len(want)
            assert len(r[t == k]) == (len(shingles("", texts[first + k])) if want else 0)
            seen.append(first + k)
    assert seen == list(range(len(texts)))
    pairs = [("The  cat, sat", "<i>THE</i> cat sat"), ("Straße", "STRASSE")]
    for a, b in pairs:
        one, other = (next(W.coded([W.canonical(x, None)])) for x in (a, b))
        assert W.wholes(*one[1:3])[0] == W.wholes(*other[1:3])[0]


def test_every_pair_of_brute_force_at_three_levels(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        base = article(rng, rng.choice([12, 40, 90, 250])).split() + "the stock phrase that all of them have in common".split()
        for j in range(4):
            own = list(base)
            for _ in range(int(len(own) * rng.random() * 0.1)):
                own[rng.randrange(len(own))] = f"q{rng.randint(0, 10**6)}"
            rows.append((len(rows), f"Title {k}", " ".join(own), "train" if j < 2 else "test"))
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string, split_name string")
    sets = {r[0]: shingles(r[1], r[2]) for r in rows}
    alike = {
        (e[0], t[0]): len(sets[e[0]] & sets[t[0]]) / max(len(sets[e[0]]), len(sets[t[0]]))
        for e in rows if e[3] == "test" for t in rows if t[3] == "train"
    }
    for level in (0.5, 0.63, 0.9):
        wanted = {p for p, v in alike.items() if v >= level}
        found = {(r["eval_id"], r["train_id"]) for r in O.overlaps(df, similar=level).collect()}
        assert wanted and found == wanted


def test_hot_run_and_hot_copy(spark):
    """Half of the rows are copies of one text, and all texts share a phrase."""
    rng = random.Random(4)
    rows = [(k, "Hot", "this text was delivered very often indeed", "train" if k % 40 else "dev") for k in range(800)]
    rows += [(1000 + k, "", f"the phrase that all of them share {article(rng, 8)}", "train" if k % 2 else "test") for k in range(800)]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string, split_name string")
    assert O.overlaps(df).count() == 20 * 780


def test_variants_of_one_text_hide_no_pair(spark):
    rng = random.Random(5)
    y = [f"w{k}" for k in range(150)]
    z = [f"z{k}" if k % 19 == 9 else w for k, w in enumerate(y)]
    x = [*z[:75], "extra", *z[76:]]
    rows = [(1, "", " ".join(y), "train"), (2, "", " ".join(z), "train"), (3, "", " ".join(x), "test")]
    rows += [(10 + k, "", article(rng, 150), "train" if k % 2 else "test") for k in range(200)]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string, split_name string")
    assert {(r["eval_id"], r["train_id"]) for r in O.overlaps(df).collect()} == {(3, 1), (3, 2)}


def test_counts_of_many_tasks_are_summed_in_rounds(spark):
    rng = random.Random(7)
    rows = [(k, "t", article(rng, 30), "train" if k % 3 else "test") for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, title string, abstract string, split_name string")
    hashed = O._rows(df, ("train",), ("test",)).repartition(12).mapInArrow(O._hash, O._HASHED)
    hashed = O.cut(hashed)
    whole = O.sketch(hashed)
    assert (O.sketch(hashed, most=4) == whole).all()
