import math
import random

import pytest

from weftline.llm.score_fusion import FusionScale, distinct_evidence, first_chunk, fuse_scores, rank_evidence, rank_evidence_and_fused

SCHEMA = "evidence_id string, chunk_id string, source string, raw_score double, rank int, atomic_claim_id string, query_id string, recorded_at long, ingested_at long, _list string, _s string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, i, "clash", "clash") if len(r) == 7 else r for i, r in enumerate(rows)], SCHEMA)


def brute(rows, floor=0.02):
    def squash(v, values):
        values = sorted(values)
        n = len(values)
        med = values[(n + 1) // 2 - 1]
        off = sorted(abs(x - med) for x in values)
        mad, mean = off[(n + 1) // 2 - 1], sum(off) / n
        s = 1.4826 * mad if mad > 0 else 1.2533 * mean
        return 1 / (1 + math.exp(-(max(min((v - med) / s, 30), -30) if s > 0 else 0)))

    lists = {}
    for c, lst, item, score, rank in rows:
        lists.setdefault((c, lst), []).append((item, score, rank))
    out = {}
    for (c, lst), xs in lists.items():
        ms, mr = sum(x[1] for x in xs) / len(xs), sum(x[2] for x in xs) / len(xs)
        sign = -1 if sum((x[1] - ms) * (x[2] - mr) for x in xs) > 0 else 1
        for item, s, r in xs:
            out.setdefault(c, {}).setdefault(item, []).append((math.log(squash(sign * s, [sign * x[1] for x in xs])) + math.log(squash(-r, [-x[2] for x in xs]))) / 2)
    n = {c: sum(1 for k in lists if k[0] == c) for c in out}
    return {(c, i): math.exp((sum(v) + (n[c] - len(v)) * math.log(floor)) / n[c]) for c, items in out.items() for i, v in items.items()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(3):
        for lst in range(3):
            items = rng.sample(range(20), 9)  # odd: the lower and upper median agree
            scores = sorted((rng.random() * 10 ** lst for _ in items), reverse=lst != 1)
            rows += [(f"c{c}", f"l{lst}", f"k{i:02d}", s, r + 1) for r, (i, s) in enumerate(zip(items, scores))]
    df = spark.createDataFrame(rows, "g string, lst string, item string, raw_score double, rank int")
    got = {(r.g, r.item): r.fused_score for r in fuse_scores(df, "g", "item", ["lst"]).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=0.02) for k in want)


def test_no_list_wins_by_its_numbers(spark):
    rows = [(f"s{i}", f"k{i}", "SEMANTIC", 0.9 - i / 20, i + 1, "c", "q") for i in range(6)]
    rows += [(f"l{i}", f"k{(i + 5) % 6}", "LEXICAL", 1e6 if i == 0 else 9.0 - i, i + 1, "c", "q") for i in range(6)]
    rows += [(f"g{i}", f"k{i}", "GRAPH", float(i), i + 1, "c", "q") for i in range(6)]  # distances: lower is better
    r = rank_evidence(table(spark, rows))
    assert first_chunk(r).collect()[0].chunk_id == "k0"


def test_untidy_rows(spark):
    rows = [
        ("a", "k1", "SEMANTIC", 0.9, 1, "c", "q"), ("a", "k1", "SEMANTIC", 0.9, 1, "c", "q"), ("b", "k2", "SEMANTIC", float("nan"), 2, "c", "q"), ("d", "k3", "SEMANTIC", 0.5, None, "c", "q"),
        ("e", "k4", "SEMANTIC", None, None, "c", "q"), ("f", "k5", "GRAPH", 1.0, 1, None, "q"), ("g", "k5", "GRAPH", 1.0, 1, "c", None), (None, "k6", "GRAPH", 2.0, 1, "c", "q"), ("h", None, "GRAPH", 2.0, 1, "c", "q"),
        ("i", "t2", "LEXICAL", 1.0, 1, "d", "q"), ("j", "t1", "LEXICAL", 1.0, 1, "d", "q"), ("k", "k9", "LEXICAL", float("inf"), None, "d", "q"),
    ]
    t = table(spark, rows)
    assert distinct_evidence(t).where("atomic_claim_id = 'c' and chunk_id = 'k1'").count() == 1
    got = {(r.atomic_claim_id, r.chunk_id): r for r in rank_evidence(t).collect()}
    assert set(got) == {("c", "k1"), ("c", "k2"), ("c", "k3"), ("c", "k6"), ("d", "t1"), ("d", "t2")}
    assert got[("d", "t1")].fused_rank == 1 and got[("d", "t1")].fused_score == got[("d", "t2")].fused_score
    assert rank_evidence(t.limit(0)).count() == 0
    fused = spark.createDataFrame([("c", "k2", 9.0), ("c", "k1", None), (None, "k1", 1.0)], "atomic_claim_id string, chunk_id string, rrf_score double")
    assert rank_evidence_and_fused(t, fused).where("chunk_id = 'k2'").first().lists == 2


def test_resent_rows_keep_the_first(spark):
    rows = [("a", "late", "S", 0.1, 2, "c", "q", 0, 9, "", ""), ("a", "first", "S", 0.2, 1, "c", "q", 0, 1, "", "")]
    assert [r.chunk_id for r in distinct_evidence(spark.createDataFrame(rows, SCHEMA)).collect()] == ["first"]
    assert FusionScale().floor < 0.5
