"""Named queries of ledgers, reports, audits and typed graphs, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Rules
from weftline.functions import text as T
from weftline.operators import audits, construction, fusion, graph, ledger, metrics, resolution
from weftline.operators import verification as V
from weftline.plans import queries as Q
from weftline.session import cut, table
from weftline.sources.sinks import confusion_table as pivoted


def _big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id) of every kind of content hash, made from the tables' own rows."""
    c, e, m = Q.chunks_of(spark, d), fusion.stamped(table(spark, d, "retrieved_evidence")), Q._mentions(spark, d)
    cl, r = Q.claims_of(spark, d), table(spark, d, "entity_records")
    made = [
        ("chunk", c, T.content_id(F.col("source_id"), F.col("char_start"), F.col("char_end"), F.col("text"))),
        ("source_claim", cl, T.content_id("source", F.col("text"))),
        ("atomic_claim", cl, T.content_id(F.coalesce("parent_claim_id", F.lit("")), F.col("claim_index"), F.col("text"))),
        ("question", cl, T.content_id(F.col("claim_id"), F.lit(0), F.col("text"))),
        ("query", cl, T.content_id(F.col("claim_id"), "CLAIM", "", F.col("text"))),
        ("evidence", e, T.content_id(F.col("query_id"), F.col("source"), F.col("chunk_id"), F.col("rank"))),
        ("raw_evidence", e, T.content_id(F.col("query_id"), F.col("chunk_id"), F.col("rank"))),
        ("entity", r, T.content_id(F.col("canonical_name"), F.col("entity_type"))),
        ("event", r, T.content_id("appears", F.col("entity_id"), F.element_at("provenance", 1)["chunk_id"], F.element_at("provenance", 1)["char_start"])),
        ("mention_order", m, F.sha2(F.concat_ws(":", F.lit("1"), F.lit("None"), "local_id", "name"), 256)),
    ]
    out = None
    for kind, rows, made_id in made:
        part = rows.select(F.lit(kind).alias("kind"), made_id.alias("id")).where("id is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens and cost of one call per document and source, at prices given as parameters (per million tokens)."""
    from weftline.operators.metrics import call_cost

    return call_cost(table(spark, d, "documents").where("text is not null"), "source", "text", answer_tokens=200, price_in=0.3, price_out=2.5)


def query_validation(spark: SparkSession, d: str) -> DataFrame:
    """Queries by whether origin and question id fit together, a question's id taken away from every query whose id begins with 0."""
    q = Q.query_builder(spark, d).withColumn("question_id", F.when((F.col("origin") == "QUESTION") & ~F.col("query_id").startswith("0"), F.col("query_id")))
    fits = (F.col("origin") == "QUESTION") == F.col("question_id").isNotNull()
    return q.groupBy(F.when(fits, "valid").otherwise("origin and question differ").alias("state")).agg(F.count("*").alias("n"))


def fused_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "retrieved_evidence").where("atomic_claim_id is not null and query_id is not null and rank is not null")
    kept = ["evidence_id", "atomic_claim_id", "query_id", "source", "chunk_id", "rank", "recorded_at", "text"]
    f = fusion.rrf(e.select(*kept).distinct())
    return f.select("atomic_claim_id", "chunk_id", F.round("score", 6).alias("rrf_score"), "contributing_sources", F.array_join("contributing_query_ids", ",").alias("query_ids"), F.sha2("text", 256).alias("text_digest"))


def evidence_by_claim(spark: SparkSession, d: str) -> DataFrame:
    return _big(fusion.by_claim(Q.stamped(spark, d)), "pos", "rank")


def unstamped_evidence(spark: SparkSession, d: str) -> DataFrame:
    return fusion.unstamped(table(spark, d, "retrieved_evidence")).groupBy("reason").agg(F.count("*").alias("n"))


def confusion_table(spark: SparkSession, d: str) -> DataFrame:
    return pivoted(metrics.confusion(Q._pairs(spark, d)))


def claim_scores(spark: SparkSession, d: str) -> DataFrame:
    return V.claim_scores(Q.claims_of(spark, d), Q._labelled(spark, d))


def gold_sanity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gold_sanity(Q._pairs(spark, d), "id").groupBy("sane", "note").agg(F.count("*").alias("n"))


def contradiction_recall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contradiction_recall(Q._pairs(spark, d))


#: Which fused rows a variant keeps, by the backends that found them.
VARIANTS = {"full": None, "no_lexical": "LEXICAL", "no_graph": "GRAPH", "no_semantic": "SEMANTIC"}


def _variant_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(variant, parent_claim_id, verdict): verdicts without the evidence only one backend found, for each of them."""
    by = Q.claims_of(spark, d).where("parent_claim_id is not null").select("claim_id", "parent_claim_id")
    found = table(spark, d, "fused_evidence").where("text is not null").groupBy("atomic_claim_id", F.col("chunk_id").alias("evidence_chunk_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("contributing_sources")))).alias("sources"))
    labels = cut(Q._labelled(spark, d).join(found, ["atomic_claim_id", "evidence_chunk_id"]))
    out = None
    for name, left_out in VARIANTS.items():
        kept = labels if left_out is None else labels.where(~F.col("sources").eqNullSafe(F.array(F.lit(left_out))))
        v = V.verdicts(V.classify(by, kept, Q.LOOSE), Q.LOOSE).select(F.lit(name).alias("variant"), "parent_claim_id", "verdict")
        out = v if out is None else out.unionByName(v)
    return out


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """(parent_claim_id, gold): verdicts of the lenient rules with lower thresholds, to hold others against."""
    c = V.classify(Q.claims_of(spark, d).where("parent_claim_id is not null").select("claim_id", "parent_claim_id"), Q._labelled(spark, d), Rules(contradiction=0.92, entailment=0.6, strict=False))
    return V.verdicts(c, Rules(strict=False)).select("parent_claim_id", F.col("verdict").alias("gold"))


def variant_accuracy(spark: SparkSession, d: str) -> DataFrame:
    pairs = _variant_verdicts(spark, d).withColumnRenamed("verdict", "predicted").join(_expected(spark, d), "parent_claim_id")
    per = metrics.variant_metrics(pairs)
    return per.join(metrics.contribution(per).select("variant", "delta"), "variant")


def verdict_changes(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_variant_verdicts(spark, d))
    return metrics.verdict_changes(v.where("variant = 'no_graph'"), v.where("variant = 'full'"), "parent_claim_id")


def verifier_comparison(spark: SparkSession, d: str) -> DataFrame:
    a, b = Q.verdict_strict(spark, d).select("parent_claim_id", F.col("verdict").alias("a")), Q.verdict_lenient(spark, d).select("parent_claim_id", F.col("verdict").alias("b"))
    return metrics.compare_verifiers(a.join(b, "parent_claim_id").join(_expected(spark, d), "parent_claim_id"))


def missed_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Gold contradictions judged otherwise, where the strictest rules find none, and why."""
    c = Q.claims_of(spark, d).where("parent_claim_id is not null").select("claim_id", "parent_claim_id")
    judged = V.verdicts(V.classify(c, Q._labelled(spark, d), Rules(contradiction=0.99, entailment=0.5)), Rules()).select("parent_claim_id", F.col("verdict").alias("predicted"))
    fused = table(spark, d, "fused_evidence").select("atomic_claim_id", "chunk_id").distinct()
    return metrics.missed_contradictions(_expected(spark, d).join(judged, "parent_claim_id"), fused, c)


def contradiction_grounding(spark: SparkSession, d: str) -> DataFrame:
    by = Q.claims_of(spark, d).where("parent_claim_id is not null").select(F.col("claim_id").alias("atomic_claim_id"), F.col("parent_claim_id").alias("example_id"))
    cited = Q.classified_evidence(spark, d).join(by, "atomic_claim_id").select("example_id", F.col("evidence_chunk_id").alias("chunk_id"), "kind")
    gold = Q._gold(spark, d).join(by, "atomic_claim_id").select("example_id", "chunk_id")
    g = metrics.grounded_contradictions(_expected(spark, d).select(F.col("parent_claim_id").alias("example_id"), "gold"), cited, gold)
    return g.select("example_id", F.coalesce(F.col("grounded").cast("string"), F.lit("not asked")).alias("grounded"))


def run_determinism(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of two runs of the ledger, the second over reordered tables."""
    one = Q.ledger_fingerprint(spark, d)
    return metrics.same_runs(one, Q.ledger_fingerprint(spark, d).repartition(3), "parent_claim_id")


def ledger_integrity(spark: SparkSession, d: str) -> DataFrame:
    """All references a ledger's records make, and the records that may be there once."""
    from weftline.operators import retrieval

    c, fused = Q.claims_of(spark, d), table(spark, d, "fused_evidence")
    questions, labels, cited = retrieval.probe_questions(c), cut(Q._labelled(spark, d)), Q.classified_evidence(spark, d)
    evidence = table(spark, d, "retrieved_evidence")
    lost = Q._classified(spark, d).where("status = 'UNRESOLVED'").select("claim_id")
    return ledger.report([
        ledger.questions_known(questions, c),
        ledger.evidence_known(evidence, c, Q.query_builder(spark, d).unionByName(evidence.where("source = 'SEMANTIC'").select("query_id", "atomic_claim_id", F.lit("SEEN").alias("origin"), "text").distinct())),
        ledger.results_known(labels, fused.where("rrf_score is not null")),
        ledger.classification_known(cited, lost, c),
        ledger.repeated(Q.verdict_strict(spark, d), ["parent_claim_id"], "verdict"),
    ])


def ledger_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Claims recorded once: those whose id begins with a digit are there already, all are offered again."""
    c = Q.claims_of(spark, d).select("claim_id", "text")
    whole, refused = ledger.record(c.where(F.col("claim_id").rlike("^[0-9]")), c, ["claim_id"])
    return whole.agg(F.count("*").alias("n_recorded"), F.countDistinct("claim_id").alias("n_claims")).crossJoin(refused.agg(F.count("*").alias("n_refused")))


def ledger_fingerprint_full(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each claim's ledger over all its parts."""
    from weftline.operators import retrieval

    c = cut(Q.claims_of(spark, d).where("parent_claim_id is not null"))
    by = c.select(F.col("claim_id").alias("atomic_claim_id"), "parent_claim_id")
    of = lambda df, item: df.join(by, "atomic_claim_id").select("parent_claim_id", item.alias("item"))
    classified, labels = cut(Q._classified(spark, d)), cut(Q._labelled(spark, d))
    cited = V.cited_evidence(classified, labels, Q.LOOSE)
    verdicts = V.verdicts(classified, Q.LOOSE)
    fused = table(spark, d, "fused_evidence").where("rrf_score is not null").select("atomic_claim_id", "chunk_id", "rrf_score").distinct()
    parent = F.col("parent_claim_id")
    parts = ledger.parts_of(
        "parent_claim_id",
        claim=c.select("parent_claim_id", F.concat(F.lit("claim "), parent).alias("item")).distinct(),
        claim_id=c.select("parent_claim_id", parent.alias("item")).distinct(),
        atomic_claims=c.select("parent_claim_id", F.col("claim_id").alias("item")),
        questions=of(retrieval.probe_questions(c), F.col("question_id")),
        evidence=of(Q.stamped(spark, d), F.col("evidence_id")),
        fused=of(fused, F.format_string("%s:%s:%.6f", "atomic_claim_id", "chunk_id", "rrf_score")),
        results=of(labels, F.format_string("%s:%s:%s:%.6f", "atomic_claim_id", "evidence_chunk_id", "label", "score")),
        contradictions=of(cited.where("kind = 'contradiction'"), F.col("evidence_chunk_id")),
        support=of(cited.where("kind = 'support'"), F.col("evidence_chunk_id")),
        unsupported=classified.where("status = 'UNRESOLVED'").select("parent_claim_id", F.col("claim_id").alias("item")),
        verdict=verdicts.select("parent_claim_id", F.col("verdict").alias("item")),
        fired_rule=verdicts.select("parent_claim_id", F.col("fired_rule").alias("item")),
    )
    return ledger.fingerprint(parts, "parent_claim_id")


def entity_provenance(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "entity_records").select("entity_id", F.explode("provenance").alias("p")).select("entity_id", "p.*")
    p = graph.entity_provenance(r)
    line = F.transform("provenance", lambda x: F.concat_ws(":", x["chunk_id"], x["char_start"].cast("string"), x["char_end"].cast("string")))
    return p.select("entity_id", F.sha2(F.array_join(line, ","), 256).alias("digest"), "n_places")


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's number of neighbours and their weight together."""
    n = graph.neighbours(Q._graph(spark, d)[2])
    return n.groupBy("entity_id").agg(F.countDistinct("neighbour_id").alias("degree"), F.sum("weight").alias("weight"))


def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The record that a mention's name is, whatever the case, over all narratives."""
    names = table(spark, d, "raw_entity_mentions").where("name is not null").select("mention_id", "name").distinct()
    return graph.entity_by_name(names, table(spark, d, "entity_records")).where("entity_id is not null").select("mention_id", "entity_id").distinct()


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, participants, entities) of successive mentions: each mention with the next of its narrative; local ids that end with 7 are known to nobody."""
    m = cut(Q._mentions(spark, d).where("local_id is not null and char_start is not null and chunk_id is not null"))
    after = Window.partitionBy("source_id").orderBy("char_start", "mention_id")
    m = m.withColumn("next_local_id", F.lead("local_id").over(after))
    fact = F.col("mention_id").alias("fact_id")
    facts = m.select(fact, "source_id", F.concat(F.lit("near "), F.col("type")).alias("predicate"), "chunk_id", "char_start", F.lit(1).alias("chapter_index"), F.lit(None).cast("int").alias("window_index"), "local_id")
    parts = m.select(fact, "source_id", "local_id", F.lit("AGENT").alias("role")).unionByName(m.where("next_local_id is not null").select(fact, "source_id", F.col("next_local_id").alias("local_id"), F.lit("PATIENT").alias("role")))
    known = m.where("local_id not like '%7'").select("source_id", "local_id").distinct().withColumn("entity_id", T.content_id(F.col("source_id"), F.col("local_id")))
    return facts, parts, known


def events_resolved(spark: SparkSession, d: str) -> DataFrame:
    return construction.build_events(*_facts(spark, d))


def event_participations(spark: SparkSession, d: str) -> DataFrame:
    return construction.build_participations(*_facts(spark, d))


def event_rejects(spark: SparkSession, d: str) -> DataFrame:
    return construction.rejected_events(*_facts(spark, d))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Relations between the local ids of successive mentions, typed by the first one's type, with their places."""
    facts, parts, _ = _facts(spark, d)
    other = parts.where("role = 'PATIENT'").select("fact_id", F.col("local_id").alias("other"))
    who = lambda c: F.concat_ws("|", "source_id", c)
    place = F.struct("chunk_id", "char_start")
    r = facts.join(other, "fact_id").select(who("local_id").alias("subject"), who("other").alias("object"), F.col("predicate").alias("relation_type"), place.alias("place"))
    return r.groupBy("subject", "object", "relation_type").agg(F.count("*").alias("weight"), F.collect_set("place").alias("places"))


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph.collapse_relations(_typed(spark, d), "places")
    return e.select("subject", "object", "relation_type", "weight", F.size("provenance").cast("bigint").alias("n_places"))


def graph_records_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Entities, relations, events and participations of each narrative as one fingerprint."""
    facts, parts, known = _facts(spark, d)
    src = facts.select("fact_id", "source_id")
    entities = known.select("source_id", "entity_id", F.col("local_id").alias("canonical_name"), F.lit("OTHER").alias("entity_type"))
    events = construction.build_events(facts, parts, known).join(src, "fact_id").withColumns({"temporal_kind": F.lit(None).cast("string"), "temporal_expression": F.lit(None).cast("string")})
    takes = construction.build_participations(facts, parts, known).join(events.select("event_id", "source_id"), "event_id")
    ends = facts.select("source_id", F.col("local_id").alias("subject_local_id"), "fact_id", F.col("predicate").alias("relation_type"), "chunk_id").join(parts.where("role = 'PATIENT'").select("fact_id", F.col("local_id").alias("object_local_id")), "fact_id")
    good, _ = construction.build_relations(ends, known)
    relations = good.join(known.select("source_id", F.col("entity_id").alias("subject_entity_id")), "subject_entity_id")
    lines = construction.entity_lines(entities, ["source_id"])
    for part in (construction.relation_lines(relations, ["source_id"]), construction.event_lines(events, ["source_id"]), construction.participation_lines(takes, ["source_id"])):
        lines = lines.unionByName(part)
    return construction.graph_fingerprint(lines, ["source_id"], ["section", "order"])


def records_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """All entity records of all narratives as one fingerprint."""
    e = table(spark, d, "entity_records").select("source_id", "entity_id", "canonical_name", "entity_type").distinct()
    return construction.bucketed_fingerprint(construction.entity_lines(e, ["source_id"]), "order")


def key_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = cut(Q._mentions(spark, d))
    return audits.key_kinds(resolution.merge_keys(m), m)


def key_components(spark: SparkSession, d: str) -> DataFrame:
    """Components per narrative when every key ties its mentions."""
    m = cut(Q._mentions(spark, d))
    return audits.component_sizes(audits.key_components(cut(resolution.merge_keys(m))), m)


def strong_key_components(spark: SparkSession, d: str) -> DataFrame:
    """Components per narrative when only strong keys tie their mentions."""
    m = cut(Q._mentions(spark, d))
    return audits.component_sizes(audits.key_components(cut(resolution.merge_keys(m)), ~T.is_weak_key(F.col("key"))), m)


def _families(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of people by family name alone, with one of several forms of address or another word before it, so that families are in doubt."""
    r = table(spark, d, "entity_records").where("entity_type = 'PERSON'").select("source_id", "entity_id", "canonical_name").distinct()
    kind = F.pmod(F.length("canonical_name"), F.lit(5))
    word = F.element_at(F.split("canonical_name", " "), -1)
    surface = F.when(kind == 0, F.concat(F.lit("Lord "), word)).when(kind == 1, F.concat(F.lit("Lady "), word)).when(kind == 2, F.concat(F.lit("Blind "), word)).when(kind == 3, word).otherwise(F.col("canonical_name"))
    ids = F.conv(F.substring(F.sha2(F.concat_ws(":", "source_id", "entity_id"), 256), 1, 15), 16, 10).cast("bigint")
    return r.select(ids.alias("mention_id"), "source_id", surface.alias("name"), F.array("canonical_name").alias("aliases"), F.lit("PERSON").alias("type"), F.lit(0).alias("char_start"))


def ambiguous_families(spark: SparkSession, d: str) -> DataFrame:
    return resolution.ambiguous_keys(resolution.key_tags(resolution.merge_keys(_families(spark, d))))


def family_components(spark: SparkSession, d: str) -> DataFrame:
    """Mentions merged where family names are in doubt: the branch that anchors, joins and keeps apart."""
    return resolution.resolve(cut(_families(spark, d)))


def local_entities(spark: SparkSession, d: str) -> DataFrame:
    m = cut(Q._mentions(spark, d))
    comp = cut(resolution.resolve(m))
    return resolution.local_entities(m, comp, resolution.canonical_entities(m, comp))


QUERIES = {f.__name__: f for f in (
    record_ids, token_cost, query_validation, fused_records, evidence_by_claim, unstamped_evidence, confusion_table, claim_scores, gold_sanity, contradiction_recall, variant_accuracy, verdict_changes, verifier_comparison,
    missed_contradictions, contradiction_grounding, run_determinism, ledger_integrity, ledger_recorded, ledger_fingerprint_full, entity_provenance, graph_neighbours, entity_lookup, events_resolved, event_participations,
    event_rejects, typed_edges, graph_records_fingerprint, records_fingerprint, key_kinds, key_components, strong_key_components, ambiguous_families, family_components, local_entities,
)}
