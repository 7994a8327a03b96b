"""Model-backed steps as frames of prompts and answers: decomposition, questions, fact verification, extraction.

Every step has the same form: rows give prompts, prompts are answered through a cache, answers are parsed strictly, and
what can't be used goes to a frame of errors, so one bad answer costs its own row only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Parsing
from weftline.functions.text import content_id
from weftline.operators.parsing import parse_list, strip_fence
from weftline.operators.provenance import verified_quotes

#: Prompts; the names in braces are filled in.
DECOMPOSITION = "Take the claim apart into at most {most} statements that can each be true or false by itself.\nAnswer with a JSON array of strings.\n\nClaim: {text}"
QUESTIONS = "Ask at most {most} short questions whose answers would bear out or refute the claim.\nAnswer with a JSON array of strings, each ending in a question mark.\n\nClaim: {text}"
FACT_CHECK = "Say whether the passages support the claim, contradict it, or don't mention it, and quote the words that tell.\n\nClaim: {text}\n\nPassages:\n{passages}"
EXTRACTION = "List the entities, relations and events of this part of a narrative with the words that tell of them.\n\nChapter {chapter}, window {window}:\n{text}"

#: Prompts' answers: (key, prompt) rows to (rows with answer and error, fresh cache entries).
Answering = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

# Labels of a fact and of a pair, and what stands for a missing quote.
FACT_TO_PAIR = {"SUPPORTED": "ENTAILMENT", "CONTRADICTED": "CONTRADICTION", "NOT_MENTIONED": "NEUTRAL"}
NO_QUOTE = "(no supporting quote)"
# The kinds an extraction may give.
ENTITY_TYPES = ("PERSON", "LOCATION", "ORGANIZATION", "OBJECT", "OTHER")
RELATION_TYPES = ("FAMILY_OF", "ALLY_OF", "ENEMY_OF", "MEMBER_OF", "LOCATED_AT", "POSSESSES", "SAME_AS")
TEMPORAL_KINDS = ("ABSOLUTE", "RELATIVE", "NONE")
ROLES = ("AGENT", "PATIENT", "EXPERIENCER", "LOCATION", "INSTRUMENT")


def filled(template: str, **values: Column | str | int) -> Column:
    """A template as a column; null where a value is."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        v = values[name]
        out += [F.lit(before), v.cast("string") if isinstance(v, Column) else F.lit(str(v))]
    return F.concat(*out, F.lit(rest))


def passages_block(texts: Column) -> Column:
    """Texts one per line, each with its number from 1."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


def _blank(text: str) -> Column:
    return F.coalesce(~F.col(text).rlike(r"(?U)\S"), F.lit(True))


def _listed(claims: DataFrame, template: str, most: int, answers: Answering, questions: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = claims.select("claim_id", "text").distinct()
    blank = asked.where(_blank("text")).select("claim_id", F.lit("blank claim").alias("reason"))
    said, fresh = answers(asked.where(~_blank("text")).select("claim_id", filled(template, most=most, text=F.col("text")).alias("prompt")))
    lost = said.where("answer is null").select("claim_id", F.coalesce("error", F.lit("no answer")).alias("reason"))
    good, bad = parse_list(said.where("answer is not null").select("claim_id", "answer"), "claim_id", "answer", fenced=not questions, questions=questions, most=most)
    return good, blank.unionByName(lost).unionByName(bad), fresh


def decompose(claims: DataFrame, answers: Answering, cfg: Parsing = Parsing()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atomic claims (claim_id, parent_claim_id, claim_index, text), errors (claim_id, reason), fresh entries) of claims (claim_id, text)."""
    good, bad, fresh = _listed(claims, DECOMPOSITION, cfg.claims, answers, False)
    return good.select(F.col("item_id").alias("claim_id"), F.col("claim_id").alias("parent_claim_id"), F.col("index").alias("claim_index"), "text"), bad, fresh


def whole_claims(claims: DataFrame) -> DataFrame:
    """Claims as their own only parts, for runs without decomposition."""
    return claims.select(content_id(F.col("claim_id"), F.lit(0), F.col("text")).alias("claim_id"), F.col("claim_id").alias("parent_claim_id"), F.lit(0).alias("claim_index"), "text")


def ask_questions(claims: DataFrame, answers: Answering, cfg: Parsing = Parsing()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions (question_id, atomic_claim_id, index, text), errors, fresh entries); a claim may have no question."""
    good, bad, fresh = _listed(claims, QUESTIONS, cfg.questions, answers, True)
    return good.select(F.col("item_id").alias("question_id"), F.col("claim_id").alias("atomic_claim_id"), "index", "text"), bad, fresh


_VERDICT = "verdict string, confidence double, quotes array<string>, explanation string"


def parse_fact_verdict(answers: DataFrame, key: str = "claim_id", answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(verdicts (key, label, confidence, quotes, explanation), errors (key, reason)) of JSON answers; a missing list of quotes is an empty one."""
    v = answers.select(key, F.from_json(F.col(answer), _VERDICT).alias("v")).select(key, "v.*")
    quotes = F.coalesce("quotes", F.array().cast("array<string>"))
    reason = (
        F.when(F.col("verdict").isNull() & F.col("confidence").isNull(), "not a verdict")
        .when(~F.coalesce(F.col("verdict").isin(list(FACT_TO_PAIR)), F.lit(False)), "unknown verdict")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0 to 1")
        .when(F.coalesce(F.length("explanation"), F.lit(0)) == 0, "no explanation")
        .when((F.col("verdict") != "NOT_MENTIONED") & (F.size(quotes) == 0), "no quote")
        .when(F.exists(quotes, lambda q: q.isNull()), "null quote")
    )
    v = v.withColumn("reason", reason)
    return v.where("reason is null").select(key, F.col("verdict").alias("label"), "confidence", quotes.alias("quotes"), "explanation"), v.where("reason is not null").select(key, "reason")


def verify_facts(claims: DataFrame, evidence: DataFrame, answers: Answering) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts (claim_id, chunk_id, label, confidence, quotes, explanation), errors (claim_id, reason), fresh entries): one verdict per claim over all its evidence.

    claims (claim_id, text), evidence (claim_id, pos, chunk_id, text) of a bounded number per claim, as fusion gives it. A claim without evidence has no row. Every quote must stand exactly in some
    evidence text; else the whole answer is an error.
    """
    shown = evidence.where("text is not null").groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text"))), lambda r: r["text"]).alias("texts"))
    asked = claims.select("claim_id", "text").distinct().join(shown, "claim_id")
    said, fresh = answers(asked.select("claim_id", filled(FACT_CHECK, text=F.col("text"), passages=passages_block(F.col("texts"))).alias("prompt")))
    lost = said.where("answer is null").select("claim_id", F.coalesce("error", F.lit("no answer")).alias("reason"))
    good, bad = parse_fact_verdict(said.where("answer is not null"))
    anchors, unproved = verified_quotes(good.select("claim_id", F.posexplode("quotes").alias("pos", "quote")), evidence.join(good.select("claim_id"), "claim_id", "left_semi"))
    facts = good.join(anchors, "claim_id").select("claim_id", "chunk_id", "label", "confidence", "quotes", "explanation")
    return facts, lost.unionByName(bad).unionByName(unproved), fresh


def facts_of_pairs(labels: DataFrame) -> DataFrame:
    """Facts (claim_id, chunk_id, label, confidence, quotes, explanation) of scored pairs (claim_id, chunk_id, label, score, premise): the premise is the quote."""
    back = F.create_map(*[F.lit(x) for fact, pair in FACT_TO_PAIR.items() for x in (pair, fact)])
    text = F.format_string("The pair was labelled %s with a score of %.3f.", "label", "score")
    return labels.select("claim_id", "chunk_id", back[F.col("label")].alias("label"), F.col("score").alias("confidence"), F.array("premise").alias("quotes"), text.alias("explanation"))


def pairs_of_facts(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Pair results (atomic_claim_id, evidence_chunk_id, label, score, premise, hypothesis) of facts; facts of unknown claims have none."""
    label = F.create_map(*[F.lit(x) for pair in FACT_TO_PAIR.items() for x in pair])[F.col("label")]
    premise = F.coalesce(F.nullif(F.array_join("quotes", " "), F.lit("")), F.lit(NO_QUOTE))
    said = claims.select("claim_id", F.col("text").alias("hypothesis"))
    return facts.join(said, "claim_id").select(F.col("claim_id").alias("atomic_claim_id"), F.col("chunk_id").alias("evidence_chunk_id"), label.alias("label"), F.col("confidence").alias("score"), premise.alias("premise"), "hypothesis")


_ENTITY = "struct<local_id:string,name:string,type:string,aliases:array<string>,evidence_quotes:array<string>>"
_RELATION = "struct<subject_local_id:string,object_local_id:string,relation_type:string,evidence_quotes:array<string>>"
_EVENT = "struct<local_id:string,predicate:string,participants:array<struct<entity_local_id:string,role:string>>,temporal:struct<time_expression:string,kind:string>,evidence_quotes:array<string>>"


def parse_extraction(answers: DataFrame, key: str = "window_id", answer: str = "answer") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, events, errors (key, reason)) of JSON answers, each frame with the key; a window with one unfit part gives nothing.

    Entities and events are numbered e1, v1 .. within their window; every fact has a quote; types, roles and kinds are known ones.
    """
    got = answers.select(key, F.from_json(strip_fence(F.col(answer)), f"entities array<{_ENTITY}>, relations array<{_RELATION}>, events array<{_EVENT}>").alias("x"))
    got = got.select(key, F.col("x").isNull().alias("none"), F.col("x.entities").alias("e"), F.coalesce("x.relations", F.array().cast(f"array<{_RELATION}>")).alias("r"), F.coalesce("x.events", F.array().cast(f"array<{_EVENT}>")).alias("v"))
    full = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    quoted = lambda x: F.coalesce(F.size(x["evidence_quotes"]) > 0, F.lit(False)) & F.coalesce(F.forall(x["evidence_quotes"], lambda q: q.isNotNull()), F.lit(False))
    among = lambda c, known: F.coalesce(c.isin(list(known)), F.lit(False))
    entity = lambda x: F.coalesce(x["local_id"].rlike("^e[0-9]+$"), F.lit(False)) & full(x["name"]) & among(x["type"], ENTITY_TYPES) & quoted(x)
    relation = lambda x: full(x["subject_local_id"]) & full(x["object_local_id"]) & among(x["relation_type"], RELATION_TYPES) & quoted(x)
    part = lambda p: full(p["entity_local_id"]) & among(p["role"], ROLES)
    event = lambda x: (
        F.coalesce(x["local_id"].rlike("^v[0-9]+$"), F.lit(False)) & full(x["predicate"]) & F.coalesce(F.size(x["participants"]) > 0, F.lit(False)) & F.coalesce(F.forall(x["participants"], part), F.lit(False))
        & (x["temporal"].isNull() | among(x["temporal"]["kind"], TEMPORAL_KINDS)) & quoted(x)
    )
    reason = (
        F.when(F.col("none") | F.col("e").isNull(), "not an extraction").when(~F.forall("e", entity), "unfit entity").when(~F.forall("r", relation), "unfit relation").when(~F.forall("v", event), "unfit event")
    )
    got = got.withColumn("reason", reason)
    good = got.where("reason is null")
    entities = good.select(key, F.explode("e").alias("x")).select(key, "x.*")
    relations = good.select(key, F.explode("r").alias("x")).select(key, "x.*")
    events = good.select(key, F.explode("v").alias("x")).select(key, "x.*")
    return entities, relations, events, got.where("reason is not null").select(key, "reason")


def extract_windows(windows: DataFrame, answers: Answering) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, events, errors, fresh entries) of windows (window_id, text, chapter_index, window_index); blank windows are errors."""
    w = windows.select("window_id", "text", filled(EXTRACTION, chapter=F.col("chapter_index"), window=F.coalesce(F.col("window_index").cast("string"), F.lit("-")), text=F.col("text")).alias("prompt"))
    blank = w.where(_blank("text")).select("window_id", F.lit("blank window").alias("reason"))
    said, fresh = answers(w.where(~_blank("text")).select("window_id", "prompt"))
    lost = said.where("answer is null").select("window_id", F.coalesce("error", F.lit("no answer")).alias("reason"))
    entities, relations, events, bad = parse_extraction(said.where("answer is not null"))
    return entities, relations, events, blank.unionByName(lost).unionByName(bad), fresh
