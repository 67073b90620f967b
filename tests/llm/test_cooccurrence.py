from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from harrow.llm import cooccurrence as C

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, topics array<string>, intervention_labels string, loaded_at timestamp_ntz"


def brute(rows):
    latest = {}
    for i, topics, labels, at in rows:
        if i is None:
            continue
        items = tuple(sorted({" ".join(x.lower().split()) for x in [*(topics or []), *(labels or "").split(";")] if x and x.strip()}))
        key = (at is not None, at or T0, items)
        if i not in latest or key > latest[i]:
            latest[i] = key
    one, two = Counter(), Counter()
    for _, _, items in latest.values():
        one.update(items)
        two.update(combinations(items, 2))
    return {(a, b, n, one[a], one[b], len(latest)) for (a, b), n in two.items()}


ROWS = [
    (1, ["Maize", " maize ", None, ""], "Rice; soil  carbon;;", T0), (2, None, "rice;maize", T0), (3, [], None, T0), (4, ["rice"], " ", None),
    (4, ["soil carbon", "rice"], "", T0), (2, ["rice", "maize", "goat"], None, T0 + timedelta(1)), (None, ["maize", "rice"], None, T0), (5, ["maize", "rice"], None, T0), (5, ["maize", "rice"], None, T0),
]


def as_set(df):
    return {tuple(r) for r in df.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n").collect()}


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' as a", "'y' as b", "1 as items")
    assert as_set(C.pair_counts(df)) == brute(ROWS)
    assert as_set(C.pair_counts(df.where("id < 0"))) == set()


def test_batches_in_any_order_give_the_same_table(spark, tmp_path):
    state = C.PairTable(spark, str(tmp_path / "pairs"), buckets=4)
    done = []
    for part in (ROWS[5:], ROWS[:3], ROWS[3:5]):
        before = brute(done)
        done += part
        affected = as_set(state.apply(spark.createDataFrame(part, SCHEMA)))
        assert as_set(state.scored()) == brute(done)
        # what changed besides the number of records was scored again, with the new number
        assert {r for r in brute(done) if r[:5] not in {x[:5] for x in before}} <= affected <= brute(done)
    again = state.apply(spark.createDataFrame(ROWS[:3], SCHEMA))  # delivered again: nothing changes
    assert again.count() == 0
    assert as_set(state.scored()) == brute(ROWS)


def test_scores_follow_the_number_of_records_and_replaced_baskets(spark, tmp_path):
    state = C.PairTable(spark, str(tmp_path / "pairs"), buckets=3)
    state.apply(spark.createDataFrame([(k, ["a", "b"], None, T0) for k in range(4)], SCHEMA))
    assert {(r["lift"], r["pmi"]) for r in state.scored().collect()} == {(1.0, 0.0)}
    affected = state.apply(spark.createDataFrame([(10 + k, ["c"], None, T0) for k in range(4)], SCHEMA))
    assert affected.count() == 0  # no count of a, b or their pair changed
    assert {(r["n"], r["lift"], r["pmi"]) for r in state.scored().collect()} == {(8, 2.0, 1.0)}
    gone = state.apply(spark.createDataFrame([(k, ["a", "c"], None, T0 + timedelta(1)) for k in range(4)], SCHEMA))
    assert as_set(gone) == {("a", "c", 4, 4, 8, 8)} == as_set(state.scored())


def test_long_basket_and_hot_item(spark, tmp_path):
    rows = [(k, ["hot", f"i{k}"], None, T0) for k in range(3000)] + [(9000, [f"w{k:04}" for k in range(600)], None, T0)]
    state = C.PairTable(spark, str(tmp_path / "pairs"))
    state.apply(spark.createDataFrame(rows, SCHEMA))
    assert state.scored().count() == 3000 + 600 * 599 // 2 and as_set(state.scored()) == brute(rows)


def test_frequent_pairs_use_exact_bounds(spark):
    rows = [(k, ["a", "b"] if k < 4 else ["c"], None, T0) for k in range(1000)]
    found = C.frequent_pairs(C.pair_counts(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["item_a"], r["item_b"]) for r in found] == [("a", "b")]
    rows.append((1000, ["c"], None, T0))  # 4 of 1001 is below 1 in 250
    assert C.frequent_pairs(C.pair_counts(spark.createDataFrame(rows, SCHEMA))).count() == 0
