import json

import numpy as np
import pytest

from weftline.config import ABLATION, Evaluation, Model, Resources, Variant, run_id
from weftline.models import ChatCompleter, LogitScorer, ModelError, NoCall, Retry, ScriptedCompleter, ScriptedScorer, TransientError, label_map, nullable_dialect, with_retry
from weftline.operators import caching, reasoning
from weftline.operators.vector import HashedEmbedder


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def call(fails):
        calls.append(1)
        if len(calls) <= fails:
            raise TransientError("busy")
        return "ok"

    assert with_retry(lambda: call(3), Retry(), waits.append) == "ok" and waits == [5, 10, 20]
    calls.clear()
    with pytest.raises(TransientError):
        with_retry(lambda: call(99), Retry(most=2), lambda s: None)
    assert len(calls) == 3


def test_schema_dialect():
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": ["string", "null"]}, "b": {"type": "array", "items": {"type": ["null"], "additionalProperties": True}}}}
    assert nullable_dialect(schema) == {"type": "object", "properties": {"a": {"type": "string", "nullable": True}, "b": {"type": "array", "items": {"type": "string", "nullable": True}}}}
    assert schema["additionalProperties"] is False


def test_chat_completer():
    sent = []

    def post(answer):
        def run(url, body, headers, codes):
            sent.append((url, body, headers, codes))
            return {"choices": [answer]}

        return run

    good = ChatCompleter("http://x", Model("m"), "be brief", "k", post=post({"finish_reason": "stop", "message": {"content": '{"a": 1}'}}))
    assert good.complete("hi") == '{"a": 1}' and sent[0][1]["messages"][1] == {"role": "user", "content": "hi"} and sent[0][2] == {"Authorization": "Bearer k"}
    assert json.loads(good.complete_structured("hi", {"type": "object"})) == {"a": 1} and sent[1][1]["response_format"]["json_schema"]["strict"]
    for answer in ({"finish_reason": "length", "message": {"content": "x"}}, {"finish_reason": "stop", "message": {"content": None}}):
        with pytest.raises(ModelError):
            ChatCompleter("http://x", Model("m"), post=post(answer)).complete("hi")


def test_labels_and_scorers():
    assert label_map({0: "contradiction", 1: "entailment", 2: "neutral"}) == {0: "CONTRADICTION", 1: "ENTAILMENT", 2: "NEUTRAL"}
    with pytest.raises(ModelError):
        label_map({0: "yes", 1: "entailment", 2: "neutral"})
    got = LogitScorer(lambda p, h: np.array([[0.0, 2.0, 0.0]] * len(p)), {0: "contradiction", 1: "entailment", 2: "neutral"}).score(["a"], ["b"])
    assert got[0][0] == "ENTAILMENT" and abs(got[0][1] - np.exp(2) / (np.exp(2) + 2)) < 1e-9
    s = ScriptedScorer({("p", "h"): ("CONTRADICTION", 0.95)}, [("arm", "hands", "CONTRADICTION", 0.9)])
    assert s.score(["p", "lost an arm", "x"], ["h", "both hands", "y"]) == [("CONTRADICTION", 0.95), ("CONTRADICTION", 0.9), ("NEUTRAL", 0.5)]


def test_settings():
    assert len({v.fingerprint for v in ABLATION}) == len(ABLATION) and ABLATION[0].name == "full"
    assert run_id("d", Variant(), Evaluation()) != run_id("e", Variant(), Evaluation()) and len(Resources().fingerprint) == 16
    for bad in (lambda: Variant(backends=()), lambda: Variant(fusion="x"), lambda: Model(max_tokens=0)):
        with pytest.raises(ValueError):
            bad()


def _cache(spark):
    return spark.createDataFrame([], "key string, answer string")


def test_completions_are_cached_once_and_failures_never(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "lost"), (5, None)], "id long, prompt string")
    out, fresh = caching.completions(prompts, ScriptedCompleter({"a": "A", "b": "B"}), _cache(spark), "m")
    assert {(r.id, r.answer) for r in out.collect()} == {(1, "A"), (2, "A"), (3, "B"), (4, None), (5, None)}
    assert [r.error for r in out.where("id = 4").collect()] == ["ModelError: no recorded answer"] and fresh.count() == 2
    again, none = caching.completions(prompts.where("id <= 3"), NoCall(), fresh, "m")
    assert {r.answer for r in again.collect()} == {"A", "B"} and none.count() == 0
    held, lost = caching.replay(prompts, fresh, "m")
    assert held.count() == 3 and lost.count() == 2
    assert caching.replay(prompts, fresh, "other model")[0].count() == 0
    assert caching.completions(prompts.limit(0), NoCall(), _cache(spark), "m")[0].count() == 0


def test_embeddings_through_a_cache(spark):
    t = spark.createDataFrame([(1, "one two two"), (2, "one two two"), (3, ""), (4, None)], "id long, text string")
    out, fresh = caching.embeddings(t, HashedEmbedder(), spark.createDataFrame([], "key string, embedding array<double>"), "e")
    rows = {r.id: r.embedding for r in out.collect()}
    assert rows[1] == rows[2] and rows[3] is None and rows[4] is None and abs(sum(x * x for x in rows[1]) - 1) < 1e-9 and fresh.count() == 1
    with pytest.raises(ValueError):
        HashedEmbedder().embed([])


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, caching.upsert(t, spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id long, v string"), "id").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def _answering(spark, answers):
    return lambda prompts: caching.completions(prompts, ScriptedCompleter(answers), _cache(spark), "m")


def test_decomposition_and_questions(spark):
    claims = spark.createDataFrame([("c1", "John played piano with both hands in London."), ("c2", "  "), ("c3", "odd"), ("c4", "lost")], "claim_id string, text string")
    prompt = lambda t: reasoning.DECOMPOSITION.replace("{most}", "10").replace("{text}", t)
    said = {prompt(claims.first().text): '```json\n["John played piano", "John used both hands", " john PLAYED piano ", "the event occurred in London"]\n```', prompt("odd"): "[]"}
    good, bad, fresh = reasoning.decompose(claims, _answering(spark, said))
    assert [(r.claim_index, r.text) for r in good.orderBy("claim_index").collect()] == [(0, "John played piano"), (1, "John used both hands"), (2, "the event occurred in London")]
    assert {(r.claim_id, r.reason) for r in bad.collect()} == {("c2", "blank claim"), ("c3", "no items"), ("c4", "ModelError: no recorded answer")} and fresh.count() == 2
    ask = {reasoning.QUESTIONS.replace("{most}", "5").replace("{text}", "odd"): '["Did John lose an arm?", "no question"]', **{reasoning.QUESTIONS.replace("{most}", "5").replace("{text}", t): "[]" for t in ("lost", claims.first().text)}}
    q, bad, _ = reasoning.ask_questions(claims, _answering(spark, ask))
    assert [(r.atomic_claim_id, r.text) for r in q.collect()] == [("c3", "Did John lose an arm?")] and {r.claim_id for r in bad.collect()} == {"c2"}


def test_fact_verdicts_are_strict(spark):
    rows = [
        ("ok", '{"verdict": "SUPPORTED", "confidence": 0.9, "quotes": ["in 2010"], "explanation": "x"}', None),
        ("free", '{"verdict": "NOT_MENTIONED", "confidence": 1, "explanation": "x"}', None),
        ("quote", '{"verdict": "CONTRADICTED", "confidence": 0.9, "quotes": [], "explanation": "x"}', "no quote"),
        ("kind", '{"verdict": "MAYBE", "confidence": 0.9, "quotes": ["a"], "explanation": "x"}', "unknown verdict"),
        ("sure", '{"verdict": "SUPPORTED", "confidence": 1.5, "quotes": ["a"], "explanation": "x"}', "confidence outside 0 to 1"),
        ("mute", '{"verdict": "SUPPORTED", "confidence": 0.5, "quotes": ["a"], "explanation": ""}', "no explanation"),
        ("text", "no json", "not a verdict"),
        ("null", None, "not a verdict"),
    ]
    good, bad = reasoning.parse_fact_verdict(spark.createDataFrame([r[:2] for r in rows], "claim_id string, answer string"))
    assert {r.claim_id for r in good.collect()} == {"ok", "free"} and {r.claim_id: r.reason for r in bad.collect()} == {r[0]: r[2] for r in rows if r[2]}


def test_facts_need_their_quotes_in_the_evidence(spark):
    claims = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "no evidence")], "claim_id string, text string")
    evidence = spark.createDataFrame([("a", 1, "k1", "He said “yes”  in 2010."), ("a", 2, "k2", "in 2010 he left"), ("b", 1, "k3", "nothing"), ("c", 1, "k4", "here"), ("c", 2, "k5", "there")], "claim_id string, pos int, chunk_id string, text string")
    block = {"a": "[1] He said “yes”  in 2010.\n[2] in 2010 he left", "b": "[1] nothing", "c": "[1] here\n[2] there"}
    said = {reasoning.FACT_CHECK.replace("{text}", t).replace("{passages}", block[k]): json.dumps({"verdict": v, "confidence": 0.8, "quotes": q, "explanation": "e"}) for k, t, v, q in (("a", "x", "SUPPORTED", ['"yes" in 2010', "he left"]), ("b", "y", "SUPPORTED", ["made up"]), ("c", "z", "NOT_MENTIONED", []))}
    facts, bad, _ = reasoning.verify_facts(claims, evidence, _answering(spark, said))
    assert {(r.claim_id, r.chunk_id, r.label) for r in facts.collect()} == {("a", "k1", "SUPPORTED"), ("c", "k4", "NOT_MENTIONED")}
    assert {(r.claim_id, r.reason) for r in bad.collect()} == {("b", "a quote is in no evidence text")}
    pairs = {r.atomic_claim_id: (r.label, r.premise) for r in reasoning.pairs_of_facts(facts, claims).collect()}
    assert pairs == {"a": ("ENTAILMENT", '"yes" in 2010 he left'), "c": ("NEUTRAL", reasoning.NO_QUOTE)}


def test_extraction_is_strict_by_window(spark):
    entity = {"local_id": "e1", "name": "Tom", "type": "PERSON", "aliases": [], "evidence_quotes": ["Tom"]}
    event = {"local_id": "v1", "predicate": "sails", "participants": [{"entity_local_id": "e1", "role": "AGENT"}], "temporal": {"kind": "NONE"}, "evidence_quotes": ["sails"]}
    tie = {"subject_local_id": "e1", "object_local_id": "OTHER", "relation_type": "ALLY_OF", "evidence_quotes": ["and"]}
    rows = [
        ("ok", {"entities": [entity], "relations": [tie], "events": [event]}, None), ("few", {"entities": [entity]}, None), ("id", {"entities": [{**entity, "local_id": "x"}]}, "unfit entity"), ("type", {"entities": [{**entity, "type": "SHIP"}]}, "unfit entity"),
        ("mute", {"entities": [{**entity, "evidence_quotes": []}]}, "unfit entity"), ("tie", {"entities": [entity], "relations": [{**tie, "relation_type": "CO_OCCURS"}]}, "unfit relation"), ("role", {"entities": [entity], "events": [{**event, "participants": []}]}, "unfit event"), ("none", {}, "not an extraction"),
    ]
    e, r, v, bad = reasoning.parse_extraction(spark.createDataFrame([(k, json.dumps(x)) for k, x, _ in rows], "window_id string, answer string"))
    assert {x.window_id for x in e.collect()} == {"ok", "few"} and r.count() == 1 and v.count() == 1
    assert {x.window_id: x.reason for x in bad.collect()} == {k: why for k, _, why in rows if why}
