import math
import random

import pytest

from weftline.config import Chunking, Graph, Retrieval, Rules
from weftline.operators import chunking, construction, fusion, graph, ledger, lexical, metrics, parsing, provenance, resolution, retrieval, segmentation, vector
from weftline.operators import verification as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_settings_are_checked():
    for bad in (lambda: Chunking(10, 10), lambda: Retrieval(top_k=0), lambda: Graph(max_hops=3)):
        with pytest.raises(ValueError):
            bad()
    assert Chunking().fingerprint == Chunking().fingerprint != Chunking(600).fingerprint


def test_chunks(spark):
    d = spark.createDataFrame([("a", "x" * 1300), ("b", ""), ("c", None)], "source_id string, cleaned_text string")
    assert [(r.char_start, r.char_end, len(r.text)) for r in chunking.chunk_documents(d).orderBy("char_start").collect()] == [(0, 700, 700), (580, 1280, 700), (1160, 1300, 140)]


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(f"s{i % 3}", i, a := rng.randrange(3000), a + rng.randrange(0, 900)) for i in range(60)]
    chunks = [(f"s{i % 3}", f"c{i}", a := rng.randrange(3000), a + rng.randrange(0, 1500)) for i in range(60)]
    got = chunking.overlapping(spark.createDataFrame(spans, "source_id string, id int, span_start int, span_end int"), spark.createDataFrame(chunks, "source_id string, chunk_id string, char_start int, char_end int"))
    want = sorted((s[1], c[1]) for s in spans for c in chunks if s[0] == c[0] and c[2] < s[3] and s[2] < c[3] and s[3] > s[2] and c[3] > c[2])
    assert rows(got.select("id", "chunk_id")) == want


def test_bm25(spark):
    c = spark.createDataFrame([("arm", "john lost his left arm"), ("london", "john moved to london"), ("z", "piano piano")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "london arm arm"), (2, "nothing here")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.raw_score) for r in lexical.bm25_search(q, c, Retrieval(top_k=2)).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1 + 0.5)
    avg = (5 + 4 + 2) / 3
    score = 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 5 / avg))
    assert got[(1, 1)] == ("arm", pytest.approx(score, abs=1e-5)) and got[(1, 2)][0] == "london"
    assert got[(2, 1)] == ("arm", 0.0) and got[(2, 2)] == ("london", 0.0)


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector.nearest(df, df.where("vec_id % 10 = 0"), 3, block=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(0, 50, 10):
        s = u @ u[q]
        s[[q, 7]] = -9
        assert [i for _, i in sorted(got[q])] == list(np.argsort(-s)[:3])


def test_hashed_embedding_and_cache(spark):
    t = spark.createDataFrame([(1, "a a b"), (2, "")], "k int, text string")
    w = [r.weight for r in vector.hashed_embedding(t, "k", "text").collect()]
    assert sum(x * x for x in w) == pytest.approx(1, abs=1e-6)
    assert vector.cache_misses(t, spark.createDataFrame([("",)], "text string")).count() == 1


def evidence(spark, rows_):
    return spark.createDataFrame([(f"e{i}", *r, i) for i, r in enumerate(rows_)], "evidence_id string, atomic_claim_id string, query_id string, source string, chunk_id string, rank int, recorded_at int")


def test_fusion(spark):
    e = evidence(spark, [("c", "q1", "SEMANTIC", "a", 1), ("c", "q1", "LEXICAL", "a", 2), ("c", "q1", "SEMANTIC", "b", 2), ("c", "q2", "LEXICAL", "b", 1), ("c", "q1", "GRAPH", "d", 9), (None, "q1", "GRAPH", "d", 1), ("c", "q1", "GRAPH", "d", None)])
    r = {x.chunk_id: x for x in fusion.rrf(fusion.stamped(e)).collect()}
    assert r["a"].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and r["a"].pos == 1 and r["b"].pos == 2
    assert r["a"].contributing_sources == "SEMANTIC,LEXICAL" and r["b"].n_queries == 2
    assert {x.chunk_id: x.score for x in fusion.round_robin(fusion.stamped(e)).collect()}["d"] == pytest.approx(0.1)


def test_queries_and_stamps(spark):
    c = spark.createDataFrame([("c1", "John left.")], "claim_id string, text string")
    q = retrieval.build_queries(c.unionByName(c), retrieval.probe_questions(c))
    assert [r.origin for r in q.orderBy("origin").collect()] == ["CLAIM", "QUESTION"]
    hits = q.selectExpr("query_id", "'k' as chunk_id", "1.0d as raw_score", "1 as rank")
    assert retrieval.stamp(hits, q, "LEXICAL").where("evidence_id is not null and atomic_claim_id = 'c1'").count() == 2


def test_classification_and_verdicts(spark):
    claims = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "r"), ("d", "s")], "claim_id string, parent_claim_id string")
    res = spark.createDataFrame([("a", "x", "CONTRADICTION", 0.9), ("a", "y", "ENTAILMENT", 0.99), ("c", "x", "ENTAILMENT", 0.5), ("d", "z", "NEUTRAL", 0.9)], "atomic_claim_id string, evidence_chunk_id string, label string, score double")
    k = V.classify(claims, res)
    assert {r.claim_id: r.status for r in k.collect()} == {"a": "CONTRADICTED", "b": "UNRESOLVED", "c": "SUPPORTED", "d": "UNRESOLVED"}
    v = {r.parent_claim_id: (r.verdict, r.fired_rule) for r in V.verdicts(k).collect()}
    assert v == {"p": ("CONTRADICTORY", "rule_1_contradiction"), "r": ("CONSISTENT", "rule_3_all_supported"), "s": ("INSUFFICIENT_EVIDENCE", "rule_2_unresolved")}
    assert {r.parent_claim_id: r.fired_rule for r in V.verdicts(k, Rules(strict=False)).collect()}["s"] == "rule_3_no_contradiction"
    cited = {(r.atomic_claim_id, r.kind) for r in V.cited_evidence(k, res).collect()}
    assert cited == {("a", "contradiction"), ("c", "support")}
    n = {(r.t_contradiction, r.verdict): r.n for r in V.sweep(claims, res, [0.9, 0.95], [0.5]).collect()}
    assert n[(0.9, "CONTRADICTORY")] == 1 and (0.95, "CONTRADICTORY") not in n


def test_metrics(spark):
    pairs = spark.createDataFrame([("CONSISTENT", "CONSISTENT"), ("CONSISTENT", "CONTRADICTORY"), ("CONTRADICTORY", "CONTRADICTORY"), ("INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"), (None, "CONSISTENT")], "gold string, predicted string")
    m = {r.verdict: r for r in metrics.verdict_metrics(pairs).collect()}
    assert m["CONSISTENT"].accuracy == 0.75 and m["CONSISTENT"].f1 == pytest.approx(2 * 0.5 / 1.5, abs=1e-6)
    ranked = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "atomic_claim_id string, chunk_id string, pos int")
    gold = spark.createDataFrame([("c", "b"), ("e", "b")], "atomic_claim_id string, chunk_id string")
    r = {x.atomic_claim_id: x for x in metrics.retrieval_metrics(ranked, gold, (1, 2)).collect()}
    assert (r["c"].mrr, r["c"].recall_1, r["c"].recall_2, r["c"].precision_2, r["e"].mrr) == (0.5, 0.0, 1.0, 0.5, 0.0)
    v = spark.createDataFrame([(i,) for i in [5, 1, 4, 2, 3]], "x long")
    o = metrics.order_statistics(v, "x").first()
    assert (o.n, o.least, o.median, o.p95, o.most, o["mean"]) == (5, 1, 3, 5, 5, 3.0)


def test_traversal(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "subject_entity_id string, object_entity_id string, weight long")
    places = spark.createDataFrame([("a", "arm"), ("b", "arm"), ("b", "london"), ("c", "far")], "entity_id string, chunk_id string")
    entry = spark.createDataFrame([(1, "a")], "query_id int, entity_id string")
    one = {r.chunk_id: r.raw_score for r in graph.traverse(entry, edges, places, 1, 5).collect()}
    assert one == {"arm": 1.5, "london": 0.5}
    two = {r.chunk_id: r.raw_score for r in graph.traverse(entry, edges, places, 2, 5).collect()}
    assert two["far"] == pytest.approx(2 / 3, abs=1e-5)
    assert rows(graph.collapse_relations(spark.createDataFrame([("x", "y", "B", 1), ("y", "x", "A", 2), ("x", "x", "A", 1)], "subject string, object string, relation_type string, weight long"))) == [("y", "x", "A", 3)]


def test_component_labels(spark):
    rng = random.Random(3)
    e = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] + [(200, 200)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {k: find(k) for k in parent}
    edges = spark.createDataFrame([*e, (None, 1)], "a long, b long")
    for bound in (10, graph.TASK_EDGES):
        assert dict(rows(graph.component_labels(edges, "a", "b", bound))) == want
        assert graph.component_labels(edges.limit(0), "a", "b", bound).count() == 0
    text = edges.selectExpr("lpad(cast(a as string), 4, '0') as a", "lpad(cast(b as string), 4, '0') as b")
    assert {int(k): int(v) for k, v in rows(graph.component_labels(text, "a", "b"))} == want


def test_resolution_of_families(spark):
    def m(names):
        return spark.createDataFrame([("s", i, f"e{i}", n, al, "PERSON", i * 10) for i, (n, al) in enumerate(names)], "source_id string, mention_id long, local_id string, name string, aliases array<string>, type string, char_start int")

    family = m([("Baron Danglars", []), ("M. Danglars", []), ("Danglars", None), ("Monsieur Danglars", []), ("Mademoiselle Danglars", [])])
    got = {}
    for r in resolution.resolve(family).collect():
        got.setdefault(r.component, set()).add(r.mention_id)
    assert sorted(map(len, got.values())) == [1, 4]
    plain = m([("Edmond Dantès", ["Dantès"]), ("Dantès", []), ("Mercédès", ["he"]), ("he", [])])
    r = dict(rows(resolution.resolve(plain)))
    assert r[0] == r[1] and r[2] != r[3]
    c = resolution.canonical_entities(plain, resolution.resolve(plain)).where("n_mentions = 2").first()
    assert c.canonical_name == "Dantès" or c.canonical_name == "Edmond Dantès"


def test_quotes():
    assert provenance.place_quote("he  said “no”", 'Then he said "no" twice') == ("EXACT", 5, 17, False)
    assert provenance.place_quote("a", "a b a")[3] is True
    assert provenance.place_quote("x", "")[0] == "FAILED"
    words = [f"w{i}" for i in range(40)]
    changed = words[5:30]
    changed[3] = "other"
    tier, s, e, _ = provenance.place_quote(" ".join(changed), " ".join(words))
    assert tier == "FUZZY" and " ".join(words)[s:e].startswith("w5") and " ".join(words)[s:e].endswith("w29")


def test_segmentation(spark):
    t = "before\nChapter I\naa\nChapter II.\nbb\nchapter iii\ncc"
    d = spark.createDataFrame([("a", t), ("b", "no chapters")], "source_id string, cleaned_text string")
    spans = [(r.chapter_index, r.char_start, r.char_end) for r in segmentation.chapter_spans(d).orderBy("char_start").collect()]
    assert spans == [(0, 0, 7), (1, 7, t.index("Chapter II.")), (2, t.index("Chapter II."), t.index("chapter iii")), (3, t.index("chapter iii"), len(t))]
    w = segmentation.extraction_windows(d).where("source_id = 'b'").collect()
    assert [(x.chapter_index, x.window_index, x.char_start, x.char_end) for x in w] == [(0, None, 0, 11)]
    from weftline.config import Windows

    text = "\n\n".join("word " * 50 for _ in range(40))
    b = segmentation.window_bounds(text, 300, Windows(overlap=30, snap=20))
    assert b[0][0] == 0 and b[-1][1] == len(text) and all(p[1] > n[0] > p[0] for p, n in zip(b, b[1:]))
    assert all(len(segmentation.approximate_tokens(text[s:e])) <= 301 for s, e in b)


def test_construction(spark):
    ents = spark.createDataFrame([("s", "e1", "A"), ("s", "e2", "B"), ("s", "e3", "A")], "source_id string, local_id string, entity_id string")
    f = spark.createDataFrame([("s", "e1", "e2", "ALLY_OF", "k1"), ("s", "e3", "e2", "ALLY_OF", "k2"), ("s", "e1", "e3", "ALLY_OF", "k1"), ("s", "e1", "e9", "ALLY_OF", "k1")], "source_id string, subject_local_id string, object_local_id string, relation_type string, chunk_id string")
    good, bad = construction.build_relations(f, ents)
    assert rows(good) == [("A", "B", "ALLY_OF", 2)] and rows(bad) == [("dangling reference", 1), ("self-relation", 1)]
    facts = spark.createDataFrame([(1, "s", "fell", "k", 0, 2, None, "v1"), (2, "s", "fell", "k", 0, 1, 3, "v2"), (3, "s", "fell", "k", 0, 1, 3, "v3")], "fact_id int, source_id string, predicate string, chunk_id string, char_start int, chapter_index int, window_index int, local_id string")
    parts = spark.createDataFrame([(1, "s", "e1"), (2, "s", "e3"), (3, "s", "e9")], "fact_id int, source_id string, local_id string")
    ev = construction.build_events(facts, parts, ents).collect()
    assert [(e.fact_id, e.n_facts) for e in ev] == [(2, 2)]


def test_ledger(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",), ("x",)], "p string")
    assert rows(ledger.report([ledger.missing(a, b, ["k"], ["p"], "c1"), ledger.repeated(b, ["p"], "c2")])) == [("c1", 2), ("c2", 1)]
    p = spark.createDataFrame([("r", 0, "b"), ("r", 0, "a"), ("r", 1, "z")], "run string, part int, item string")
    import hashlib

    assert ledger.fingerprint(p, "run").first().fingerprint == hashlib.sha256(b"a,b|z").hexdigest()[:16]


def test_parsing(spark):
    a = spark.createDataFrame([("ok", '```json\n["A b.", " a B. ", "", "C"]\n```'), ("bad", "nonsense"), ("none", "[]"), ("many", '["1","2","3"]')], "k string, answer string")
    good, bad = parsing.parse_list(a, "k", "answer", most=2)
    assert [(r["index"], r.text) for r in good.orderBy("index").collect()] == [(0, "A b."), (1, "C")]
    assert dict(rows(bad)) == {"bad": "not a JSON array", "none": "no items", "many": "too many items"}
    q, bad = parsing.parse_list(spark.createDataFrame([("q", '["Is it?", "No."]'), ("e", "[]")], "k string, answer string"), "k", "answer", fenced=False, questions=True)
    assert [r.text for r in q.collect()] == ["Is it?"] and bad.count() == 0


def test_verify_fuses_dense_hits_and_questions(spark, monkeypatch):
    from weftline.operators import fusion
    from weftline.plans import pipeline

    seen = []
    fuse = fusion.rrf
    monkeypatch.setattr(pipeline.fusion, "rrf", lambda e, *a: seen.append(e) or fuse(e, *a))
    docs = spark.createDataFrame([("s", "Anna met the miller at the gate. The lantern was cracked."), ("t", "A gardener sold nine teapots.")], "source_id string, cleaned_text string")
    claims = spark.createDataFrame([("c", "Anna met the miller."), ("d", "Teapots were sold by the gardener.")], "claim_id string, text string")
    assert {r.claim_id for r in pipeline.verify(docs, claims).collect()} == {"c", "d"}
    rows = seen[0].where("source = 'SEMANTIC'").collect()
    assert {(r.atomic_claim_id, r["rank"]) for r in rows} == {(c, k) for c in "cd" for k in (1, 2)} and len(rows) == 8  # two queries a claim, two chunks
    best = {r.atomic_claim_id: r.chunk_id for r in rows if r["rank"] == 1}
    assert best["c"] != best["d"]
    assert seen[0].where("source = 'LEXICAL'").select("query_id").distinct().count() == 4


def test_searches_with_bounds_are_exact(spark, monkeypatch):
    import numpy as np

    rng = random.Random(5)
    monkeypatch.setattr(vector, "LEAST_SAMPLE", 20)
    monkeypatch.setattr(lexical, "CHUNK_BLOCK", 40)
    monkeypatch.setattr(lexical, "QUERY_PASS", 15)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: [words[min(int(rng.expovariate(0.12)), 59)] for _ in range(n)]
    texts = {f"c{i:03}": pick(rng.randrange(1, 25)) for i in range(300)}
    asked = {i: pick(6) for i in range(30)} | {30: ["unknown"], 31: ["w59"]}
    c = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "chunk_id string, text string").repartition(4)
    q = spark.createDataFrame([(k, " ".join(v)) for k, v in asked.items()], "query_id int, text string")
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in set(t) for t in texts.values()) for w in words}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items() if d}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    score = lambda a, t: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in a), 6)
    want = {(k, i + 1): x[1] for k, a in asked.items() for i, x in enumerate(sorted((-score(a, t), c) for c, t in texts.items())[:5])}
    assert {(r.query_id, r["rank"]): r.chunk_id for r in lexical.bm25_search(q, c, Retrieval(top_k=5)).collect()} == want

    x = np.random.default_rng(1).integers(0, 3, size=(300, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.nearest(v, v.where("vec_id % 7 = 0"), 5, block=20).collect()}
    real = [j for j in range(300) if x[j].any()]
    assert got == {(i, k + 1): j for i in range(0, 300, 7) for k, (_, j) in enumerate(sorted((-round(float(u[i] @ u[j]), 6), j) for j in real if j != i)[:5])}


def test_ties_of_a_batch_are_bounded():
    import numpy as np
    import pyarrow as pa

    class Sent:
        value = ({}, np.ones((2, 4)) / 2, np.full(2, -np.inf))

    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i:03}" for i in range(200)]), pa.array([[1.0] * 4] * 200)], ["chunk_id", "embedding"])
    assert [r["key"] for b in vector._cosines(Sent, 3)(iter([batch])) for r in b.to_pylist()] == ["k000", "k001", "k002"] * 2
    words = pa.RecordBatch.from_arrays([batch.column(0), pa.array([["a", "b"]] * 200)], ["chunk_id", "words"])
    Sent.value = (pa.array(["a"]), np.array([0, 1]), np.array([0], dtype=np.int32), np.array([1.0]), np.full(1, -np.inf), 2.0)
    assert [r["key"] for b in lexical._scores(Sent, Retrieval(top_k=3))(iter([words])) for r in b.to_pylist()] == ["k000", "k001", "k002"]


def test_walks_in_passes_are_those_of_a_plain_sum(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(graph, "WALK_ROWS", 20)
    monkeypatch.setattr(graph, "WALK_SUMS", 7)
    seen = {(f"q{i}", f"e{j}"): rng.randrange(0, 9) / 2 for i in range(12) for j in range(15) if rng.random() < (0.9 if i < 4 else 0.1)}
    places = {(f"e{rng.randrange(15)}", f"c{rng.randrange(40):02}") for _ in range(150)}
    got = graph._ranked(spark.createDataFrame([(q, e, g) for (q, e), g in seen.items()], "query_id string, entity_id string, gain double"), spark.createDataFrame(sorted(places), "entity_id string, chunk_id string"), 4)
    sums: dict[tuple, float] = {}
    for (q, e), g in seen.items():
        for c in (c for x, c in places if x == e):
            sums[q, c] = sums.get((q, c), 0.0) + g
    want = [(q, c, s, k + 1) for q in sorted({q for q, _ in sums}) for k, (s, c) in enumerate(sorted(((-s, c) for (x, c), s in sums.items() if x == q))[:4]) for s in [-s]]
    assert rows(got) == sorted(want)
    none = spark.createDataFrame([], "query_id string, entity_id string, gain double")
    assert graph._ranked(none, spark.createDataFrame(sorted(places), "entity_id string, chunk_id string"), 4).count() == 0


def test_alike_queries_walk_the_graph_once(spark, monkeypatch):
    from weftline.operators.indexes import GraphIndex

    walked = []
    walk = graph.traverse
    monkeypatch.setattr(graph, "traverse", lambda entry, *a: walked.append(entry.select("query_id").distinct().count()) or walk(entry, *a))
    chunks = spark.createDataFrame([("k1", "Tom Fen left", "s", 0), ("k2", "Ann Lee met Tom Fen", "s", 30)], "chunk_id string, text string, source_id string, char_start int")
    q = spark.createDataFrame([("a", "Where is Ann Lee?"), ("b", "Ann Lee left"), ("c", "Tom Fen?"), ("d", "nobody")], "query_id string, text string")
    index = GraphIndex()
    index.index(chunks)
    assert rows(index.query(q, 1).select("query_id", "chunk_id", "raw_score")) == [("a", "k2", 1.5), ("b", "k2", 1.5), ("c", "k2", 1.5)] and walked == [2]
