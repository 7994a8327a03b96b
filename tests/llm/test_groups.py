import random

import numpy as np
import pytest

from weftline.llm.components import connected_components, mention_groups, spanning_forest
from weftline.llm.group_splits import SplitPlan, anneal, claim_groups, split_claims


def brute(pairs):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in parent}


def graphs():
    rng = random.Random(2)
    yield [(i, i + 1) for i in range(300)]  # a chain
    yield [(0, i) for i in range(1, 400)] + [(i, i - 1) for i in range(500, 560)]  # a hub, a chain backwards
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] * 2 + [(7, 7), (None, 3), (4, None)]
    yield []


@pytest.mark.parametrize("limit", [10, 40, 1_000_000])
def test_components_against_brute_force(spark, limit):
    for g in graphs():
        df = spark.createDataFrame(g, "a long, b long").repartition(3)
        got = {r.node: r.group for r in connected_components(df, "a", "b", limit).collect()}
        assert got == brute(g)


def test_long_chain_takes_few_levels(spark):
    """An ordered chain whose pairs lie scattered over partitions of a hundredth of it."""
    n = 30_000
    df = spark.range(n).selectExpr("id as a", "id + 1 as b").repartition(4)
    levels = []
    found = connected_components(df, "a", "b", n // 100, levels).toPandas()
    assert len(levels) <= 20 and all(b < 0.8 * a for a, b in zip(levels, levels[1:]))
    assert len(found) == n + 1 and (found["group"] == 0).all() and found["node"].is_unique


def test_forest():
    n, r = spanning_forest(np.array([5, 9, 2]), np.array([9, 7, 2]))
    assert dict(zip(n.tolist(), r.tolist())) == {2: 2, 5: 5, 7: 5, 9: 5}


def test_mention_groups(spark):
    m = spark.createDataFrame([(i, "node") for i in range(1, 12)] + [(1, "node"), (None, "x")], "mention_id long, node string")
    x = spark.createDataFrame(
        [(2, 1, None, "match"), (1, 2, None, "match"), (2, 3, None, "no_match"), (3, 4, None, None), (5, None, "E", "match"), (None, 6, "E", "match"), (7, None, "E", "no_match"), (6, 2, None, "match"), (8, 99, None, "match"), (99, 9, None, "match"), (10, 10, None, "match"), (11, None, "F", "match"), (None, None, None, "match")],
        "left_mention_id long, right_mention_id long, matched_entity_id string, decision string",
    )
    assert sorted(tuple(r) for r in mention_groups(x, m).collect()) == [(1, 1), (2, 1), (5, 1), (6, 1)]
    assert mention_groups(x.limit(0), m).count() == 0


def claims(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "id string, book_name string, char string, label string, group string")


def test_claim_groups(spark):
    rows = [("5", "The  Book", "Ann", "consistent"), ("3", " the book ", "Bob", None), ("7", None, "BOB ", "contradict"), ("9", None, None, "consistent"), ("8", "", None, ""), ("11", "Other", "Cy", "consistent"), ("11", "Other", "Cy", "consistent"), ("x", "Other", "Dee", "consistent"), (None, "Other", "Eve", "c")]
    assert sorted(tuple(r) for r in claim_groups(claims(spark, rows)).collect()) == [(3, 3), (5, 3), (7, 3), (8, 8), (9, 9), (11, 11)]
    assert claim_groups(claims(spark, rows).limit(0)).count() == 0
    rng = random.Random(6)
    rows = [(str(i), rng.choice([None, f"b{rng.randrange(40)}"]), rng.choice([None, f"c{rng.randrange(40)}"]), "consistent") for i in range(150)]
    want = brute([(int(r[0]), int(s[0])) for r in rows for s in rows if r is s or (r[1] and r[1] == s[1]) or (r[2] and r[2] == s[2])])
    assert {r.id: r.group_id for r in claim_groups(claims(spark, rows)).collect()} == want


def test_splits(spark):
    rng = random.Random(7)
    rows = [(str(i), f"b{int(rng.random() ** 3 * 200)}", None, rng.choice(["consistent", "Contradict ", None])) for i in range(1500)]
    t = claims(spark, rows)
    got = split_claims(t, SplitPlan(bucket=60)).collect()
    assert len(got) == 1500
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.new_split)
    assert all(len(v) == 1 for v in by.values())
    n = {s: sum(r.new_split == s for r in got) / 1500 for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.05 and abs(n["test"] - 0.1) < 0.05 and abs(n["validation"] - 0.1) < 0.05
    assert split_claims(t, SplitPlan(bucket=60)).exceptAll(split_claims(t, SplitPlan(bucket=60))).count() == 0
    assert split_claims(t.limit(0)).count() == 0
    assert len(split_claims(t.limit(1)).collect()) == 1
    with pytest.raises(ValueError):
        SplitPlan(proportions=(0.5, 0.5, 0.5))


def test_annealing_improves():
    rng = np.random.default_rng(0)
    u = rng.integers(1, 50, (200, 2)).astype(float)
    start = np.zeros(200, dtype=int)
    t = np.outer([0.8, 0.1, 0.1], u.sum(axis=0))
    at, cost = anneal(u, start, t, 20, 1)
    assert cost < 0.02 and anneal(u[:0], start[:0], t * 0, 5, 1)[1] == 0
