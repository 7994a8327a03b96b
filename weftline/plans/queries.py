"""Named queries: each operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Chunking, Graph, Rules
from weftline.functions import text as T
from weftline.operators import chunking, construction, fusion, graph, ledger, lexical, metrics, parsing, provenance, resolution, retrieval, segmentation, vector
from weftline.operators import verification as V
from weftline.session import cut, table

SWEEP = [round(0.5 + 0.05 * i, 2) for i in range(7)]


def narratives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_documents").select("source_id", "cleaned_text").distinct()


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each id once."""
    return table(spark, d, "document_chunks").groupBy("chunk_id").agg(F.min(F.struct("text", "source_id", "char_start", "char_end")).alias("_r")).select("chunk_id", "_r.*")


def claims_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "atomic_claims").distinct()


def stamped(spark: SparkSession, d: str) -> DataFrame:
    return fusion.stamped(table(spark, d, "retrieved_evidence"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_documents").select("source_id", "raw_text").distinct().where("raw_text is not null")
    return raw.select("source_id", T.clean_text(F.col("raw_text")).alias("cleaned")).select("source_id", F.length("cleaned").cast("bigint").alias("n"), F.sha2("cleaned", 256).alias("digest"))


def clean_rejects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length(T.clean_text(F.col("text"))), F.lit(0)).alias("n"))
    return docs.groupBy((F.col("n") == 0).alias("rejected")).agg(F.count("*").alias("n_docs"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_documents(narratives(spark, d), Chunking())
    return c.select("chunk_id", "source_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"))


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of(spark, d)
    return c.select("claim_id", T.content_id(F.coalesce("parent_claim_id", F.lit("")), F.col("claim_index"), F.col("text")).alias("made_id"), T.content_id(F.lit("source"), F.col("text")).alias("source_claim_id"), T.content_id(F.col("claim_id"), F.lit("CLAIM"), F.lit(""), F.col("text")).alias("query_id"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("text is not null").select("source", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("t"))
    return n.groupBy("source").agg(F.sum("t").cast("bigint").alias("tokens"))


def row_validation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunks").select("chunk_id", "text", "char_start", "char_end").distinct()
    reason = F.when(F.col("char_end") <= F.col("char_start"), "empty span").when(F.length("text") != F.col("char_end") - F.col("char_start"), "length differs").otherwise("valid")
    return c.groupBy(reason.alias("state")).agg(F.count("*").alias("n"))


def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claim_rows").distinct().where("char is not null")
    text = F.concat(F.lit("Regarding "), F.col("char"), F.lit(": "), F.col("content"))
    label = F.lower(F.trim("label"))
    return c.select("id", text.alias("claim_text"), F.when(label == "consistent", "CONSISTENT").when(label == "contradict", "CONTRADICTORY").alias("expected_verdict"))


def passages_prompt(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "fused_evidence").where("text is not null").select("atomic_claim_id", "chunk_id", "text").distinct()
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    block = F.array_join(F.transform(rows, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["text"])), "\n")
    return e.groupBy("atomic_claim_id").agg(block.alias("b")).select("atomic_claim_id", F.sha2("b", 256).alias("digest"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of(spark, d).where("parent_claim_id is not null")
    made = c.groupBy("parent_claim_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", "text"))).alias("r"))
    words = F.transform("r", lambda x: x["text"])
    return made.select("parent_claim_id", F.concat(F.lit("```json\n"), F.to_json(F.concat(words, F.transform(words, lambda w: F.concat(F.lit(" "), F.upper(w), F.lit(" "))), F.array(F.lit("  ")))), F.lit("\n```")).alias("answer"))


def parse_json_array(spark: SparkSession, d: str) -> DataFrame:
    good, _ = parsing.parse_list(_answers(spark, d), "parent_claim_id", "answer")
    return good.select("parent_claim_id", F.col("index").cast("bigint").alias("position"), "text")


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    stats, _, _ = lexical.term_statistics(lexical.tokenised(chunks_of(spark, d)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").distinct()


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_search(_items(spark, d), chunks_of(spark, d)).select("query_id", "chunk_id", F.round("raw_score", 3).alias("raw_score"))


def query_builder(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of(spark, d)
    return retrieval.build_queries(c.select("claim_id", "text"), retrieval.probe_questions(c)).select("query_id", "atomic_claim_id", "origin", "text")


def evidence_grouped(spark: SparkSession, d: str) -> DataFrame:
    e = stamped(spark, d)
    return e.groupBy("atomic_claim_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("query_id").alias("n_queries"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(stamped(spark, d)).select("atomic_claim_id", "chunk_id", F.round("score", 6).alias("rrf_score"), "contributing_sources", F.col("n_queries").cast("bigint").alias("n_queries"))


def round_robin_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.round_robin(stamped(spark, d)).select("atomic_claim_id", "chunk_id", F.round("score", 6).alias("rrf_score"))


def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "entity_records").select("entity_id", "source_id", F.explode("provenance").alias("p")).select("entity_id", "source_id", F.col("p.char_start").alias("span_start"), F.col("p.char_end").alias("span_end")).distinct()
    return chunking.overlapping(s, chunks_of(spark, d).drop("text")).select("entity_id", "chunk_id").distinct()


def fact_provenance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "entity_records").select("entity_id", "source_id", F.explode("provenance").alias("p")).select("entity_id", "source_id", F.col("p.char_start").alias("span_start"), F.col("p.char_end").alias("span_end")).distinct()
    o = chunking.overlapping(s, chunks_of(spark, d).drop("text"))
    return provenance.clip_to_chunks(o, ["entity_id"]).select("entity_id", "chunk_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"))


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vector.nearest(v, v.where("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vector.hashed_embedding(table(spark, d, "benchmark").distinct(), "item_id", "text").select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round("weight", 6).alias("weight"))


def hashed_embedding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return vector.hashed_embedding(chunks_of(spark, d), "chunk_id", "text").select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("weight", 6).alias("weight"))


def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return vector.cache_misses(table(spark, d, "retrieved_evidence"), table(spark, d, "fused_evidence")).agg(F.count("*").alias("misses"), F.sum(F.length("text")).cast("bigint").alias("characters"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "fused_evidence").where("text is not null").select("atomic_claim_id", F.col("chunk_id").alias("evidence_chunk_id"), F.col("text").alias("premise")).distinct()
    return V.lexical_labels(e.join(claims_of(spark, d).select(F.col("claim_id").alias("atomic_claim_id"), F.col("text").alias("hypothesis")), "atomic_claim_id")).select("atomic_claim_id", "evidence_chunk_id", "label", "score")


#: The lexical stand-in's scores lie lower than a model's.
LOOSE = Rules(contradiction=0.95, entailment=0.5, strict=True)


def nli_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return V.classify(claims_of(spark, d).where("parent_claim_id is not null").select("claim_id", "parent_claim_id"), _labelled(spark, d), LOOSE)


def classify_claims(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


def classified_evidence(spark: SparkSession, d: str) -> DataFrame:
    return V.cited_evidence(_classified(spark, d), _labelled(spark, d), LOOSE)


def verdict_strict(spark: SparkSession, d: str) -> DataFrame:
    return V.verdicts(_classified(spark, d), LOOSE)


def verdict_lenient(spark: SparkSession, d: str) -> DataFrame:
    return V.verdicts(_classified(spark, d), Rules(LOOSE.contradiction, LOOSE.entailment, False))


def verdict_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = verdict_strict(spark, d), verdict_lenient(spark, d)
    return a.select("parent_claim_id", F.col("verdict").alias("strict")).join(b.select("parent_claim_id", F.col("verdict").alias("lenient")), "parent_claim_id").groupBy("strict", "lenient").agg(F.count("*").alias("n"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of(spark, d).where("parent_claim_id is not null").select("claim_id", "parent_claim_id")
    return V.sweep(c, _labelled(spark, d), [0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97], SWEEP)


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return V.score_histogram(_labelled(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Gold verdicts of claims against the usual label of their book."""
    label = F.lower(F.trim("label"))
    c = table(spark, d, "claim_rows").select("id", F.lower(F.trim("book_name")).alias("book"), F.when(label == "consistent", "CONSISTENT").when(label == "contradict", "CONTRADICTORY").alias("gold")).distinct().where("gold is not null")
    book = c.where("book is not null").groupBy("book").agg(F.when(F.count_if(F.col("gold") == "CONSISTENT") * 2 > F.count("*"), "CONSISTENT").when(F.count_if(F.col("gold") == "CONSISTENT") * 2 < F.count("*"), "CONTRADICTORY").otherwise("INSUFFICIENT_EVIDENCE").alias("predicted"))
    return c.join(book, "book", "left").select("id", "gold", F.coalesce("predicted", F.lit("INSUFFICIENT_EVIDENCE")).alias("predicted"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_pairs(spark, d))


def verdict_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.verdict_metrics(_pairs(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that an earlier run took from two backends or more."""
    return table(spark, d, "fused_evidence").where("size(contributing_sources) >= 2").select("atomic_claim_id", "chunk_id").distinct()


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(fusion.rrf(stamped(spark, d)), _gold(spark, d))


def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.citation_metrics(classified_evidence(spark, d), _gold(spark, d))


def stage_latency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_latency(table(spark, d, "events"), "event_type", "ts")


def ablation_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = cut(stamped(spark, d))
    variants = {"full": fusion.rrf(e), "no_lexical": fusion.rrf(e.where("source <> 'LEXICAL'")), "no_graph": fusion.rrf(e.where("source <> 'GRAPH'")), "round_robin": fusion.round_robin(e)}
    gold = _gold(spark, d)
    rows = None
    for name, ranked in variants.items():
        r = metrics.retrieval_metrics(ranked, gold).agg(F.avg("recall_10").alias("recall_10")).select(F.lit(name).alias("variant"), "recall_10")
        rows = r if rows is None else rows.unionByName(r)
    full = rows.where("variant = 'full'").select(F.col("recall_10").alias("full"))
    return rows.crossJoin(F.broadcast(full)).select("variant", F.round("recall_10", 5).alias("recall_10"), F.round(F.col("full") - F.col("recall_10"), 5).alias("delta"))


def retrieval_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = fusion.rrf(stamped(spark, d))
    return f.groupBy("atomic_claim_id").agg(F.count_if(F.col("contributing_sources").contains("GRAPH")).alias("g"), F.count_if(F.col("contributing_sources") == "GRAPH").alias("o")).agg(F.count("*").alias("claims"), F.count_if(F.col("g") > 0).alias("with_graph"), F.count_if(F.col("o") > 0).alias("graph_only"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claim_rows").select(F.col("id").cast("bigint").alias("id"), "split", "label").distinct()
    return metrics.stratified_sample(c, 100, ["split", "label"], "id").select("id")


def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.order_statistics(chunks_of(spark, d).select(F.length("text").cast("bigint").alias("n_chars")), "n_chars")


def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d).join(_labelled(spark, d).groupBy(F.col("atomic_claim_id").alias("claim_id")).agg(F.count("*").alias("n"), F.bool_or(F.col("label") != "NEUTRAL").alias("any")), "claim_id", "left")
    mode = F.when(F.col("status") != "UNRESOLVED", "resolved").when(F.col("n").isNull(), "retrieval").when(~F.col("any"), "nli").otherwise("threshold")
    return c.groupBy(mode.alias("mode")).agg(F.count("*").alias("n_claims"))


def ledger_fk_violations(spark: SparkSession, d: str) -> DataFrame:
    c, e, f = claims_of(spark, d), table(spark, d, "retrieved_evidence"), table(spark, d, "fused_evidence")
    q = query_builder(spark, d)
    return ledger.report([
        ledger.missing(e, c, ["atomic_claim_id"], ["claim_id"], "evidence has a claim"),
        ledger.missing(f, c, ["atomic_claim_id"], ["claim_id"], "fused evidence has a claim"),
        ledger.missing(f, e, ["atomic_claim_id", "chunk_id"], ["atomic_claim_id", "chunk_id"], "fused evidence was retrieved"),
        ledger.missing(e, chunks_of(spark, d), ["chunk_id"], ["chunk_id"], "evidence has a chunk"),
        ledger.missing(q, c, ["atomic_claim_id"], ["claim_id"], "query has a claim"),
    ])


def ledger_write_once(spark: SparkSession, d: str) -> DataFrame:
    return ledger.report([ledger.repeated(table(spark, d, "atomic_claims"), ["claim_id"], "claim"), ledger.repeated(table(spark, d, "retrieved_evidence"), ["evidence_id"], "evidence"), ledger.repeated(table(spark, d, "fused_evidence"), ["atomic_claim_id", "chunk_id"], "fused evidence")])


def ledger_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    c = claims_of(spark, d).where("parent_claim_id is not null")
    by = c.select("claim_id", "parent_claim_id")
    parts = c.select("parent_claim_id", F.lit(0).alias("part"), F.col("claim_id").alias("item"))
    parts = parts.unionByName(stamped(spark, d).join(by, F.col("atomic_claim_id") == F.col("claim_id")).select("parent_claim_id", F.lit(1).alias("part"), F.col("evidence_id").alias("item")))
    v = verdict_strict(spark, d)
    parts = parts.unionByName(v.select("parent_claim_id", F.lit(2).alias("part"), F.col("verdict").alias("item")))
    return ledger.fingerprint(parts, "parent_claim_id")


def checkpoint_resume(spark: SparkSession, d: str) -> DataFrame:
    from weftline.sources.readers import remaining

    c = claims_of(spark, d).select("claim_id")
    return remaining(c, table(spark, d, "fused_evidence").select(F.col("atomic_claim_id").alias("claim_id")), "claim_id")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").distinct().select("item_id", F.posexplode(T.mentions(F.col("text"))).alias("pos", "mention")).select("item_id", F.col("pos").cast("bigint").alias("pos"), "mention")


def mentions_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.mentions(F.col("text"))).alias("pos", "mention")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "mention")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = chunks_of(spark, d).select("chunk_id", "text", F.struct("source_id", "char_start", "chunk_id").alias("pos"))
    found = cut(graph.chunk_mentions(c, Graph().least_mention))
    ents = cut(graph.entities_of(found))
    return found, ents, cut(graph.cooccurrence(found, ents))


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[2]


def graph_topology(spark: SparkSession, d: str) -> DataFrame:
    _, ents, edges = _graph(spark, d)
    return graph.topology(ents, edges)


def _bfs(spark: SparkSession, d: str, hops: int) -> DataFrame:
    found, ents, edges = _graph(spark, d)
    q = _items(spark, d)
    places = found.join(ents, "name").select("entity_id", "chunk_id").distinct()
    return graph.traverse(graph.entry_entities(q, ents), edges, places, hops, 10).select("query_id", "chunk_id", "raw_score")


def graph_bfs_1hop(spark: SparkSession, d: str) -> DataFrame:
    return _bfs(spark, d, 1)


def graph_bfs_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _bfs(spark, d, 2)


def relation_collapse(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("subject"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("object"), F.col("l_returnflag").alias("relation_type")).agg(F.count("*").alias("weight"))
    back = li.where("relation_type = 'R'").select(F.col("object").alias("subject"), F.col("subject").alias("object"), "relation_type", "weight")
    return graph.collapse_relations(li.where("relation_type <> 'R'").unionByName(back))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_entity_mentions").where("mention_id is not null and source_id is not null")
    one = F.struct("source_id", "local_id", "name", "type", "char_start", "chunk_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return m.groupBy("mention_id").agg(F.min(one).alias("_r")).select("mention_id", "_r.*")


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "raw_entity_mentions").select("name").where("name is not null").distinct()
    n = n.withColumn("normalised", T.norm_name(F.col("name")))
    return n.select("name", "normalised", T.is_generic(F.col("normalised")).alias("generic"), T.is_weak_key(F.col("normalised")).alias("weak"))


def merge_keys(spark: SparkSession, d: str) -> DataFrame:
    return resolution.merge_keys(_mentions(spark, d)).select("mention_id", "key").distinct()


def qualifier_tags(spark: SparkSession, d: str) -> DataFrame:
    return resolution.key_tags(resolution.merge_keys(_mentions(spark, d)))


def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    return resolution.ambiguous_keys(qualifier_tags(spark, d))


def er_components(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve(_mentions(spark, d))


def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_mentions(spark, d))
    return resolution.canonical_entities(m, cut(resolution.resolve(m)))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "raw_entity_mentions").where("mention_id is not null").select("mention_id", "chunk_id", F.explode("evidence_quotes").alias("quote")).distinct()
    return q.join(chunks_of(spark, d).select("chunk_id", "text"), "chunk_id")


def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    q = provenance.exact_quotes(_quotes(spark, d))
    return q.select("mention_id", F.sha2("quote", 256).alias("quote_digest"), F.col("canon_start").cast("bigint").alias("canon_start"), "occurrences")


def quote_places(spark: SparkSession, d: str) -> DataFrame:
    return provenance.resolve_quotes(_quotes(spark, d), ["mention_id", "chunk_id"])


def quote_trust_boundary(spark: SparkSession, d: str) -> DataFrame:
    q = provenance.exact_quotes(_quotes(spark, d))
    return q.groupBy("mention_id").agg(F.bool_and(F.coalesce(F.col("canon_start") >= 0, F.lit(False))).alias("verified")).groupBy("verified").agg(F.count("*").alias("n_mentions"))


def chapter_spans(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.chapter_spans(narratives(spark, d)).select("source_id", F.col("chapter_index").cast("bigint").alias("chapter_index"), F.col("char_start").cast("bigint").alias("char_start"), "char_end")


def extraction_windows(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.extraction_windows(narratives(spark, d))


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Relations between successive mentions of a narrative, and the entity each local id was resolved to."""
    from pyspark.sql import Window

    m = cut(_mentions(spark, d))
    comp = cut(resolution.resolve(m))
    of = resolution.local_entities(m, comp, resolution.canonical_entities(m, comp))
    after = Window.partitionBy("source_id").orderBy("char_start", "mention_id")
    facts = m.withColumn("object_local_id", F.lead("local_id").over(after)).select("source_id", F.col("local_id").alias("subject_local_id"), "object_local_id", F.col("type").alias("relation_type"), "chunk_id")
    return facts, of


def relations_resolved(spark: SparkSession, d: str) -> DataFrame:
    return construction.build_relations(*_facts(spark, d))[0]


def graph_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_records").select("source_id", "entity_id", "canonical_name", "entity_type").distinct()
    line = F.concat_ws(":", F.lit("E"), "entity_id", "canonical_name", "entity_type")
    return construction.graph_fingerprint(e.withColumn("line", line), ["source_id"], ["entity_id"])


def nli_premises(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "raw_entity_mentions").where("mention_id is not null").groupBy("mention_id").agg(F.min(F.to_json("evidence_quotes")).alias("q")).select("mention_id", F.from_json("q", "array<string>").alias("quotes"))
    premise = F.coalesce(F.nullif(F.array_join("quotes", " "), F.lit("")), F.lit("(no supporting quote)"))
    return q.select("mention_id", F.sha2(premise, 256).alias("premise_digest"))


def graph_entry(spark: SparkSession, d: str) -> DataFrame:
    _, ents, _ = _graph(spark, d)
    return graph.entry_entities(_items(spark, d), ents)


def label_map(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in V.FACT_LABELS.items() for x in pair])[F.col("label")]
    return _labelled(spark, d).groupBy("label", kind.alias("fact_label")).agg(F.count("*").alias("n"))


def macro_averages(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.retrieval_metrics(fusion.rrf(stamped(spark, d)), _gold(spark, d))
    return r.agg(F.count("*").alias("n_claims"), *[F.round(F.avg(c), 5).alias(c) for c in ("mrr", "recall_5", "precision_5", "recall_10", "precision_10")])


def retrieve_stamped(spark: SparkSession, d: str) -> DataFrame:
    q = _items(spark, d).select(F.col("query_id").cast("string").alias("query_id"), F.col("query_id").cast("string").alias("atomic_claim_id"), "text")
    hits = lexical.bm25_search(q.select("query_id", "text"), chunks_of(spark, d))
    return retrieval.stamp(hits, q, "LEXICAL").select("evidence_id", "atomic_claim_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


def parse_questions(spark: SparkSession, d: str) -> DataFrame:
    q = retrieval.probe_questions(claims_of(spark, d))
    made = q.groupBy("atomic_claim_id").agg(F.to_json(F.array(F.min("text"), F.upper(F.min("text")), F.lit("Not a question."))).alias("answer"))
    good, _ = parsing.parse_list(made, "atomic_claim_id", "answer", fenced=False, questions=True, most=5)
    return good.select("atomic_claim_id", F.col("index").cast("bigint").alias("position"), "text", F.col("item_id").alias("question_id"))


def fact_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims' statuses as facts with the best evidence's score."""
    c = V.cited_evidence(_classified(spark, d), _labelled(spark, d), LOOSE)
    return c.groupBy("atomic_claim_id", "kind").agg(F.count("*").alias("n"), F.max("nli_score").alias("best"), F.min_by("evidence_chunk_id", F.struct(-F.col("nli_score"), F.col("evidence_chunk_id"))).alias("chunk_id"))


def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.pipeline import verify

    return verify(narratives(spark, d), claims_of(spark, d).where("text is not null").select("claim_id", "text").distinct())


QUERIES = {f.__name__: f for f in (
    clean_text, clean_rejects, tokenize_counts, chunk_spans, content_ids, token_estimates, row_validation, claim_texts, passages_prompt, parse_json_array, bm25_stats, bm25_topk, query_builder,
    evidence_grouped, rrf_fusion, round_robin_fusion, span_overlap, fact_provenance, knn_cosine, hashed_embedding, hashed_embedding_chunks, embedding_cache_misses, nli_labels, classify_claims, classified_evidence, verdict_strict,
    verdict_lenient, verdict_diff, threshold_sweep, score_histogram, confusion, verdict_metrics, retrieval_metrics, citation_metrics, stage_latency, ablation_deltas, retrieval_coverage, stratified_sample,
    order_statistics, failure_modes, ledger_fk_violations, ledger_write_once, ledger_fingerprint, checkpoint_resume, mentions, mentions_documents, cooccurrence_edges, graph_topology, graph_bfs_1hop, graph_bfs_2hop, relation_collapse,
    normalize_names, merge_keys, qualifier_tags, ambiguous_keys, er_components, canonical_entities, quote_exact, quote_places, quote_trust_boundary, chapter_spans, extraction_windows, relations_resolved,
    graph_fingerprint, nli_premises, graph_entry, label_map, macro_averages, retrieve_stamped, parse_questions, fact_verdicts, verify_claims,
)}
