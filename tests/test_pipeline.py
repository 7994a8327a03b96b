import json

import pytest
from pyspark.sql import functions as F

from weftline.config import Chunking, Graph, Resources, Retrieval, Rules, Variant
from weftline.models import NoCall, ScriptedCompleter, ScriptedScorer
from weftline.operators import audits, caching, metrics, provenance, reasoning
from weftline.plans import pipeline
from weftline.plans.novel import build_graph, narrative_windows
from weftline.sources import sinks

STORY = "John lost his left arm in an accident in 2010.\n\nJohn moved to London in 2012."
CLAIM = "John played a two-handed piano piece in London."


@pytest.fixture(scope="module")
def ledger(spark):
    narratives = spark.createDataFrame([("john", STORY), ("empty", ""), ("none", None)], "source_id string, cleaned_text string")
    claims = spark.createDataFrame([("c", CLAIM), ("blank", " "), ("odd", "Nobody knows.")], "claim_id string, text string")
    said = {
        reasoning.DECOMPOSITION.replace("{most}", "10").replace("{text}", CLAIM): '["John played piano", "John used both hands", "the event occurred in London"]',
        reasoning.DECOMPOSITION.replace("{most}", "10").replace("{text}", "Nobody knows."): "no list",
        **{reasoning.QUESTIONS.replace("{most}", "5").replace("{text}", t): q for t, q in (("John played piano", "[]"), ("John used both hands", '["Did John lose an arm?"]'), ("the event occurred in London", "[]"))},
    }
    cache = spark.createDataFrame([], "key string, answer string")
    none = spark.createDataFrame([], "key string, label string, score double")
    scorer = ScriptedScorer(parts=[("arm", "both hands", "CONTRADICTION", 0.95), ("London", "event in London", "ENTAILMENT", 0.9), ("London", "occurred in London", "ENTAILMENT", 0.9)])
    steps = pipeline.model_steps(lambda p: caching.completions(p, ScriptedCompleter(said), cache, "m"), verify=lambda pairs: caching.pair_labels(pairs, scorer, none, "s")[0].select("atomic_claim_id", "evidence_chunk_id", "label", "score"))
    res = Resources(Chunking(48, 0), Retrieval(top_k=2), graph=Graph(), rules=Rules(0.7, 0.7))
    return pipeline.run(narratives, claims, Variant(), res, steps)


def test_claims_are_judged_from_end_to_end(ledger):
    assert ledger.claims.count() == 3 and ledger.questions.count() == 1 and ledger.queries.count() == 4
    assert {r.source for r in ledger.evidence.select("source").distinct().collect()} == {"LEXICAL", "SEMANTIC", "GRAPH"}
    status = {r.text: r.status for r in ledger.classified.join(ledger.claims.select("claim_id", "text"), "claim_id").collect()}
    assert status == {"John played piano": "UNRESOLVED", "John used both hands": "CONTRADICTED", "the event occurred in London": "SUPPORTED"}
    assert [(r.parent_claim_id, r.verdict, r.fired_rule) for r in ledger.verdicts.collect()] == [("c", "CONTRADICTORY", "rule_1_contradiction")]
    assert {(r.stage, r.key) for r in ledger.errors.collect()} == {("input", "blank"), ("decomposition", "odd"), ("judgement", "odd"), ("judgement", "blank")}


def test_a_run_is_sound_and_tells_itself_by_its_fingerprint(ledger, spark, tmp_path):
    assert {r.violations for r in ledger.integrity().collect()} == {0}
    prints = ledger.fingerprints()
    assert metrics.same_runs(prints, ledger.fingerprints().repartition(2), "parent_claim_id").first() == (1, 1, True)
    path = sinks.save_report(prints, str(tmp_path), "r1")
    assert spark.read.json(path).count() == 1
    sinks.save_ledgers(ledger.verdicts.withColumnRenamed("parent_claim_id", "name"), str(tmp_path / "ledgers"))
    assert json.loads(spark.read.json(str(tmp_path / "ledgers")).first().ledger)["verdict"] == "CONTRADICTORY"
    text = sinks.render_report("Run", {"claims": 3}, {"Verdicts": ledger.verdicts.select("parent_claim_id", "verdict")})
    assert "| c | CONTRADICTORY |" in text and "- claims: 3" in text
    assert sinks.print_summary("t", {"a": 1}) == "t\na  1"


def test_novel_graph_keeps_faults_to_their_windows(spark):
    text = "Tom Fen met Ann Lee. " * 3 + "Tom Fen sailed."
    narratives = spark.createDataFrame([("s", text), ("t", "Ann Lee left. " * 2)], "source_id string, cleaned_text string")
    windows = narrative_windows(narratives)
    entity = lambda i, name: {"local_id": f"e{i}", "name": name, "type": "PERSON", "aliases": [], "evidence_quotes": [name]}
    good = {
        "entities": [entity(1, "Tom Fen"), entity(2, "Ann Lee"), entity(3, "Nobody Here")],
        "relations": [{"subject_local_id": "e1", "object_local_id": "e2", "relation_type": "ALLY_OF", "evidence_quotes": ["Tom Fen met Ann Lee."]}, {"subject_local_id": "e1", "object_local_id": "OTHER", "relation_type": "ALLY_OF", "evidence_quotes": ["met"]}],
        "events": [{"local_id": "v1", "predicate": "sails", "participants": [{"entity_local_id": "e1", "role": "AGENT"}], "temporal": {"kind": "NONE"}, "evidence_quotes": ["Tom Fen sailed."]}],
    }
    prompt = lambda t: reasoning.EXTRACTION.replace("{chapter}", "0").replace("{window}", "-").replace("{text}", t)
    said = {prompt(text): json.dumps(good), prompt("Ann Lee left. " * 2): '{"entities": [{"local_id": "x"}]}'}
    chunks = spark.createDataFrame([("k1", "s", 0, 40), ("k2", "s", 40, len(text)), ("k3", "t", 0, 28)], "chunk_id string, source_id string, char_start int, char_end int")
    g = build_graph(windows, chunks, lambda p: caching.completions(p, ScriptedCompleter(said), spark.createDataFrame([], "key string, answer string"), "m"))
    assert {r.canonical_name for r in g.entities.collect()} == {"Tom Fen", "Ann Lee"}
    assert [(r.relation_type, r.weight) for r in g.relations.collect()] == [("ALLY_OF", 1)]
    assert [(r.predicate, r.temporal_kind) for r in g.events.collect()] == [("sails", "NONE")] and g.participations.first().role == "AGENT"
    assert {(r.kind, r.reason) for r in g.left_out.collect()} == {("window", "unfit entity"), ("entity", "no quote resolves"), ("relation", "dangling reference")}
    empty = build_graph(windows.limit(0), chunks, lambda p: caching.completions(p, NoCall(), spark.createDataFrame([], "key string, answer string"), "m"))
    assert empty.entities.count() == 0 and empty.left_out.count() == 0


def test_places_are_those_of_a_plain_search(spark):
    words = [f"w{i}" for i in range(40)]
    changed = [*words[:30], "other", *words[31:]]
    rows = [(1, "he  said “no”", 'x\n Then he   said "no" \t twice … he said "no"'), (2, "…", "a…b ... c"), (3, " ".join(words), "start " + "  ".join(changed)), (4, "absent", "text"), (5, None, "x"), (6, "x", None), (7, "", "x"), (8, "plain", "a plain text"), (9, "b ...", "a…b ... c")]
    got = {r.id: (r.tier, r.char_start, r.char_end, r.ambiguous) for r in provenance.resolve_quotes(spark.createDataFrame(rows, "id int, quote string, text string"), ["id"]).collect()}
    assert got[1][0] == "EXACT" and rows[0][2][got[1][1] : got[1][2]] == 'he   said "no"' and got[1][3]
    assert rows[1][2][got[2][1] : got[2][2]] == "…" and got[2][3] and rows[8][2][got[9][1] : got[9][2]] == "b ..."
    assert got[3][0] == "FUZZY" and rows[2][2][got[3][1] : got[3][2]] == "  ".join(changed)
    assert {got[k][0] for k in (4, 5, 6, 7)} == {"FAILED"} and got[8] == ("EXACT", 2, 7, False)
    none = spark.createDataFrame([], "id int, quote string, text string")
    assert provenance.resolve_quotes(none, ["id"]).count() == 0


def test_audits(spark):
    keys = spark.createDataFrame([("s", 1, "tom fen", 0), ("s", 2, "tom fen", 0), ("s", 2, "fen", 1), ("s", 3, "fen", 0), ("s", 4, "ann fen", 0), ("s", 4, "fen", 1)], "source_id string, mention_id long, key string, pos int")
    m = spark.createDataFrame([(i, "s", "PERSON") for i in (1, 2, 3, 4)], "mention_id long, source_id string, type string")
    assert {r.component for r in audits.key_components(keys).collect()} == {1}
    strong = audits.key_components(keys, ~F.col("key").isin("fen"))
    assert {(r.mention_id, r.component) for r in strong.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert audits.component_sizes(strong, m).first() == ("s", 4, 3, 2)
    assert {r.key: r.kind for r in audits.key_kinds(keys, m, ("tom",)).collect()} == {"tom fen": "full name", "fen": "surname", "ann fen": "full name"}
    names = spark.createDataFrame([("Tom", 1), ("Ann", 4)], "name string, mention_id long")
    assert audits.kept_apart(strong, names).count() == 0 and audits.kept_apart(audits.key_components(keys), names).count() == 1
    assert audits.kept_together(strong, spark.createDataFrame([("g", 1), ("g", 3)], "group string, mention_id long")).first().n_components == 2
    assert audits.corroborated_components(keys).count() == 4


def test_evaluation_and_ablation(spark, tmp_path):
    from weftline.config import Evaluation
    from weftline.plans import evaluation

    narratives = spark.createDataFrame([("john", STORY)], "source_id string, cleaned_text string")
    examples = spark.createDataFrame([("a", "John moved to London in 2012.", "CONSISTENT"), ("b", "Quite other words altogether!", "CONTRADICTORY"), ("c", " ", "CONSISTENT")], "example_id string, claim string, gold string")
    spans = spark.createDataFrame([("a", "john", 48, 77), ("a", "other", 0, 5)], "example_id string, source_id string, span_start int, span_end int")
    res = Resources(Chunking(48, 0), Retrieval(top_k=2))
    cfg = Evaluation((1, 2), keep=True, folder=str(tmp_path))
    reports, deltas = evaluation.ablation(examples, narratives, spans, (Variant(), Variant("no_graph", backends=("SEMANTIC", "LEXICAL"))), res, cfg=cfg)
    rows = {r.example_id: r for r in reports[0].examples.collect()}
    assert rows["a"].predicted == "CONSISTENT" and rows["a"].correct and rows["c"].predicted is None and rows["a"].mrr > 0 and rows["b"].mrr is None
    assert {r.variant for r in deltas.collect()} == {"full", "no_graph"} and deltas.where("variant = 'full'").first().delta == 0
    assert reports[0].run != reports[1].run and "| CONSISTENT |" in evaluation.markdown(reports[0])
    assert spark.read.json(f"{tmp_path}/reports").count() == 6
    with pytest.raises(ValueError):
        evaluation.ablation(examples, narratives, spans, (Variant("no_graph"),), res)


def test_jobs(spark, capsys):
    import os

    from weftline.__main__ import main

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    main(["histogram", "/root/testdata/sf0.001"])
    assert "bucket" in capsys.readouterr().out


def test_indexes(spark):
    from weftline.operators.indexes import DenseIndex, GraphIndex, LexicalIndex

    chunks = spark.createDataFrame([("k1", "Tom Fen left the arm", "s", 0), ("k2", "Ann Lee met Tom Fen", "s", 30), ("k3", "", "s", 60)], "chunk_id string, text string, source_id string, char_start int")
    q = spark.createDataFrame([(1, "Where is Ann Lee?"), (2, "zzz")], "query_id int, text string").selectExpr("cast(query_id as string) as query_id", "text")
    for index, want in ((LexicalIndex(), {("1", "k2"), ("2", "k1")}), (DenseIndex(), {("1", "k2")}), (GraphIndex(), {("1", "k2")})):
        with pytest.raises(ValueError):
            index.query(q, 1)
        index.index(chunks)
        assert want <= {(r.query_id, r.chunk_id) for r in index.query(q, 1).collect()}, index
        with pytest.raises(ValueError):
            index.query(q, 0)
