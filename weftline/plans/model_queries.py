"""Named queries of the model-backed steps, answered from recorded completions that are made from the tables' own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import Embedding, Model, PairScoring, Parsing
from weftline.models import NoCall
from weftline.operators import caching, provenance, reasoning, vector
from weftline.operators import verification as V
from weftline.plans import queries as Q
from weftline.session import cut, table

NAMESPACE = Model().fingerprint


def _first(c: str) -> Column:
    """First hex digit of an id, by which recorded answers differ."""
    return F.substring(c, 1, 1)


def _recorded(prompts: DataFrame, answer: Column, kept: Column) -> DataFrame:
    """A cache that holds the answers of the rows that ``kept`` holds for."""
    return prompts.where(kept).select(caching.cache_key(NAMESPACE, F.col("prompt")).alias("key"), answer.alias("answer")).distinct()


def _parents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(claims, cache) of the claims that were taken apart; those whose id begins with 0 or 1 aren't in the cache, those with 2 have a broken answer."""
    c = Q.claims_of(spark, d).where("parent_claim_id is not null")
    made = c.groupBy("parent_claim_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", "text"))).alias("r")).select(F.col("parent_claim_id").alias("claim_id"), F.concat(F.lit("Claim "), "parent_claim_id").alias("text"), F.transform("r", lambda x: x["text"]).alias("parts"))
    prompts = made.withColumn("prompt", reasoning.filled(reasoning.DECOMPOSITION, most=Parsing().claims, text=F.col("text")))
    answer = F.when(_first("claim_id") == "2", F.lit("no list")).otherwise(F.concat(F.lit("```json\n"), F.to_json("parts"), F.lit("\n```")))
    return made.select("claim_id", "text"), _recorded(prompts, answer, ~_first("claim_id").isin("0", "1"))


def _answers(cache: DataFrame) -> reasoning.Answering:
    return lambda prompts: caching.completions(prompts, NoCall(), cache, NAMESPACE)


def decompose_replay(spark: SparkSession, d: str) -> DataFrame:
    claims, cache = _parents(spark, d)
    good, _, _ = reasoning.decompose(claims, _answers(cache))
    return good.select("claim_id", "parent_claim_id", F.col("claim_index").cast("bigint").alias("claim_index"), "text")


def decompose_errors(spark: SparkSession, d: str) -> DataFrame:
    claims, cache = _parents(spark, d)
    return reasoning.decompose(claims, _answers(cache))[1].groupBy("reason").agg(F.count("*").alias("n"))


def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Prompts a replay finds answers for, and those it must set aside."""
    claims, cache = _parents(spark, d)
    prompts = claims.select("claim_id", reasoning.filled(reasoning.DECOMPOSITION, most=Parsing().claims, text=F.col("text")).alias("prompt"))
    held, lost = caching.replay(prompts, cache, NAMESPACE)
    return held.agg(F.count("*").alias("n_hits")).crossJoin(lost.agg(F.count("*").alias("n_misses")))


def question_replay(spark: SparkSession, d: str) -> DataFrame:
    c = Q.claims_of(spark, d).select("claim_id", "text")
    prompts = c.withColumn("prompt", reasoning.filled(reasoning.QUESTIONS, most=Parsing().questions, text=F.col("text")))
    said = F.to_json(F.array(F.concat(F.lit("Is it so that "), "claim_id", F.lit("?")), F.lit("This asks nothing."), F.lit("Why?"), F.lit(" why? ")))
    good, _, _ = reasoning.ask_questions(c, _answers(_recorded(prompts, said, ~_first("claim_id").isin("0", "1"))))
    return good.select("question_id", "atomic_claim_id", F.col("index").cast("bigint").alias("position"), "text")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Fused evidence as shown to a verifier, numbered by chunk."""
    e = table(spark, d, "fused_evidence").where("text is not null and atomic_claim_id is not null").groupBy("atomic_claim_id", "chunk_id").agg(F.min("text").alias("text"))
    return e.select(F.col("atomic_claim_id").alias("claim_id"), F.row_number().over(Window.partitionBy("atomic_claim_id").orderBy("chunk_id")).alias("pos"), "chunk_id", "text")


def _fact_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, evidence, cache): answers that quote the last passage, quote nothing, quote what isn't there, are no verdict, or are missing, by the claim's first digit."""
    c, e = Q.claims_of(spark, d).select("claim_id", "text"), cut(_shown(spark, d))
    texts = e.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text"))), lambda r: r["text"]).alias("texts"))
    p = c.join(texts, "claim_id").withColumn("prompt", reasoning.filled(reasoning.FACT_CHECK, text=F.col("text"), passages=reasoning.passages_block(F.col("texts"))))
    quote = F.substring(F.element_at("texts", -1), 3, 40)
    kind = F.when(_first("claim_id").between("0", "7"), "SUPPORTED").when(_first("claim_id").between("8", "9"), "CONTRADICTED").when(_first("claim_id") == "e", "MAYBE").otherwise("NOT_MENTIONED")
    quotes = F.when(_first("claim_id").between("0", "7"), F.array(quote)).when(_first("claim_id") == "d", F.array(F.lit("words of no passage at all"))).otherwise(F.array().cast("array<string>"))
    said = F.to_json(F.struct(kind.alias("verdict"), F.lit(0.75).alias("confidence"), quotes.alias("quotes"), F.lit("as told").alias("explanation")))
    return c, e, _recorded(p, said, _first("claim_id") != "f")


def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence, cache = _fact_answers(spark, d)
    return reasoning.verify_facts(claims, evidence, _answers(cache))[0].select("claim_id", "chunk_id", "label", "confidence", F.size("quotes").cast("bigint").alias("n_quotes"))


def fact_check_errors(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence, cache = _fact_answers(spark, d)
    return reasoning.verify_facts(claims, evidence, _answers(cache))[1].groupBy("reason").agg(F.count("*").alias("n"))


def fact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Facts of scored pairs, and those facts as pairs again."""
    e = _shown(spark, d).select("claim_id", "chunk_id", F.col("text").alias("premise"))
    c = Q.claims_of(spark, d).select("claim_id", "text").distinct()
    labels = V.lexical_labels(e.join(c, "claim_id"), "premise", "text").select("claim_id", "chunk_id", "label", "score", "premise")
    back = reasoning.pairs_of_facts(reasoning.facts_of_pairs(labels), c)
    return back.select("atomic_claim_id", "evidence_chunk_id", "label", F.round("score", 6).alias("score"), F.sha2("premise", 256).alias("premise_digest"), F.length("hypothesis").cast("bigint").alias("n_hypothesis"))


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(windows, cache): every chunk that has mentions as a window, whose recorded answer lists them; some mentions of type OTHER are written as a type there isn't, and relations of windows whose id begins with 2 quote what isn't there."""
    m = table(spark, d, "raw_entity_mentions").where("mention_id is not null and chunk_id is not null").groupBy("mention_id").agg(F.min(F.struct("chunk_id", "local_id", "name", "type", "evidence_quotes")).alias("m")).select("m.*")
    entity = F.struct("local_id", "name", F.when((F.col("type") == "OTHER") & (F.pmod(F.length("name"), F.lit(3)) == 0), "THING").otherwise(F.col("type")).alias("type"), "evidence_quotes")
    each = m.groupBy("chunk_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    first, last = F.element_at("entities", 1), F.element_at("entities", -1)
    tie = F.struct(first["local_id"].alias("subject_local_id"), last["local_id"].alias("object_local_id"), F.lit("ALLY_OF").alias("relation_type"), F.when(_first("chunk_id") == "2", F.array(F.lit("words that stand nowhere"))).otherwise(first["evidence_quotes"]).alias("evidence_quotes"))
    event = F.struct(F.lit("v1").alias("local_id"), F.lit("appears").alias("predicate"), F.array(F.struct(first["local_id"].alias("entity_local_id"), F.lit("AGENT").alias("role"))).alias("participants"), first["evidence_quotes"].alias("evidence_quotes"))
    said = F.to_json(F.struct("entities", F.array(tie).alias("relations"), F.array(event).alias("events")))
    w = Q.chunks_of(spark, d).join(each, "chunk_id").select(F.col("chunk_id").alias("window_id"), "text", F.lit(1).alias("chapter_index"), F.lit(None).cast("int").alias("window_index"), "source_id", "char_start", said.alias("said"))
    w = cut(w)
    p = w.withColumn("prompt", reasoning.filled(reasoning.EXTRACTION, chapter=F.col("chapter_index"), window="-", text=F.col("text")))
    return w.drop("said"), _recorded(p, F.col("said"), ~_first("window_id").isin("0", "1")).dropDuplicates(["key"])


def window_entities(spark: SparkSession, d: str) -> DataFrame:
    w, cache = _windows(spark, d)
    return reasoning.extract_windows(w, _answers(cache))[0].select("window_id", "local_id", "name", "type")


def window_facts(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n_facts, n_windows) of what the windows' answers give; a window with an unfit part gives nothing."""
    w, cache = _windows(spark, d)
    entities, relations, events, _, _ = reasoning.extract_windows(w, _answers(cache))
    out = None
    for kind, frame in (("entity", entities), ("relation", relations), ("event", events)):
        part = frame.agg(F.count("*").alias("n_facts"), F.countDistinct("window_id").alias("n_windows")).select(F.lit(kind).alias("kind"), "n_facts", "n_windows")
        out = part if out is None else out.unionByName(part)
    return out


def window_errors(spark: SparkSession, d: str) -> DataFrame:
    w, cache = _windows(spark, d)
    return reasoning.extract_windows(w, _answers(cache))[3].groupBy("reason").agg(F.count("*").alias("n"))


def _window_quotes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w, cache = _windows(spark, d)
    entities, relations, _, _, _ = reasoning.extract_windows(w, _answers(cache))
    quotes = lambda kind, df, local: df.select(F.lit(kind).alias("kind"), F.concat_ws(":", "window_id", local).alias("fact_id"), "window_id", F.explode("evidence_quotes").alias("quote"))
    return quotes("entity", entities, F.col("local_id")).unionByName(quotes("relation", relations, F.col("subject_local_id"))).distinct(), w


def novel_provenance(spark: SparkSession, d: str) -> DataFrame:
    """(kind, fact_id, chunk_id): the chunks that facts out of the windows' answers are traced to by their quotes."""
    quotes, w = _window_quotes(spark, d)
    found, _ = provenance.resolve_facts(cut(quotes), w, Q.chunks_of(spark, d))
    return found.select("kind", "fact_id", "chunk_id").distinct()


def novel_rejects(spark: SparkSession, d: str) -> DataFrame:
    quotes, w = _window_quotes(spark, d)
    return provenance.resolve_facts(cut(quotes), w, Q.chunks_of(spark, d))[1].groupBy("kind", "reason").agg(F.count("*").alias("n"))


def _novel(spark: SparkSession, d: str):
    from weftline.plans.novel import build_graph

    w, cache = _windows(spark, d)
    return build_graph(w, Q.chunks_of(spark, d), _answers(cache))


def novel_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the narratives, out of the windows' answers."""
    return _novel(spark, d).entities.select("entity_id", "canonical_name", "entity_type", "n_mentions")


def novel_relations(spark: SparkSession, d: str) -> DataFrame:
    return _novel(spark, d).relations


def novel_events(spark: SparkSession, d: str) -> DataFrame:
    return _novel(spark, d).events.select("event_id", "predicate", "n_facts")


def quote_anchors(spark: SparkSession, d: str) -> DataFrame:
    """(mention_id, chunk_id): where mentions' quotes are verified; mentions whose id ends with 3 have one more quote, which stands nowhere."""
    m = table(spark, d, "raw_entity_mentions").where("mention_id is not null").groupBy("mention_id").agg(F.min(F.struct("chunk_id", "evidence_quotes")).alias("m")).select("mention_id", "m.*")
    chunks = Q.chunks_of(spark, d).select("chunk_id", "text")
    near = m.select("mention_id", F.posexplode(F.array(F.reverse("chunk_id"), "chunk_id")).alias("pos", "chunk_id")).join(chunks, "chunk_id")
    quotes = F.when(F.col("mention_id") % 10 == 3, F.array_append("evidence_quotes", F.lit("words that stand nowhere"))).otherwise(F.col("evidence_quotes"))
    return provenance.verified_quotes(m.select("mention_id", F.posexplode(quotes).alias("pos", "quote")), near, "mention_id")[0]


def embedding_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of all chunks through a cache that holds those whose id begins with a digit."""
    c = cut(Q.chunks_of(spark, d).select("chunk_id", "text"))
    space = Embedding().fingerprint
    seen = c.where(F.col("chunk_id").rlike("^[0-9]"))
    held = vector.hashed_vectors(seen, "chunk_id", "text").join(seen, "chunk_id").select(caching.cache_key(space, F.col("text")).alias("key"), "embedding").dropDuplicates(["key"])
    out, _ = caching.embeddings(c, vector.HashedEmbedder(), held, space)
    rows = out.select("chunk_id", F.posexplode("embedding").alias("dim", "weight")).where("weight <> 0")
    return rows.select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("weight", 6).alias("weight"))


def pair_cache_fill(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all claim-evidence pairs through a cache that holds those of claims whose id begins with a digit."""
    e = table(spark, d, "fused_evidence").where("text is not null").select("atomic_claim_id", F.col("chunk_id").alias("evidence_chunk_id"), F.col("text").alias("premise")).distinct()
    pairs = cut(e.join(Q.claims_of(spark, d).select(F.col("claim_id").alias("atomic_claim_id"), F.col("text").alias("hypothesis")), "atomic_claim_id"))
    space = PairScoring().fingerprint
    seen = V.lexical_labels(pairs.where(F.col("atomic_claim_id").rlike("^[0-9]")))
    held = seen.select(caching.cache_key(space, F.length("premise"), F.col("premise"), F.col("hypothesis")).alias("key"), "label", "score").dropDuplicates(["key"])
    out, _ = caching.pair_labels(pairs, V.LexicalScorer(), held, space)
    return out.select("atomic_claim_id", "evidence_chunk_id", "label", "score")


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The vectors with every tenth one given again under another label, and ten new ones."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    again = v.where("vec_id % 10 = 0").select("vec_id", (F.col("label") + 100).alias("label"))
    new = spark.range(10).select((-F.col("id") - 1).alias("vec_id"), F.lit(7).cast(v.schema["label"].dataType).alias("label"))
    return caching.upsert(v, again.unionByName(new.select("vec_id", "label")), "vec_id").select("vec_id", F.col("label").cast("bigint").alias("label"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of all prompts over the claims and the chunks."""
    c, w = Q.claims_of(spark, d), Q.chunks_of(spark, d)
    made = [
        ("decomposition", c.select(F.col("claim_id").alias("id"), reasoning.filled(reasoning.DECOMPOSITION, most=10, text=F.col("text")).alias("p"))),
        ("questions", c.select(F.col("claim_id").alias("id"), reasoning.filled(reasoning.QUESTIONS, most=5, text=F.col("text")).alias("p"))),
        ("facts", c.select(F.col("claim_id").alias("id"), reasoning.filled(reasoning.FACT_CHECK, text=F.col("text"), passages=reasoning.passages_block(F.array("text", "claim_id"))).alias("p"))),
        ("extraction", w.select(F.col("chunk_id").alias("id"), reasoning.filled(reasoning.EXTRACTION, chapter=1, window="-", text=F.col("text")).alias("p"))),
    ]
    out = None
    for kind, rows in made:
        part = rows.select(F.lit(kind).alias("kind"), "id", F.sha2("p", 256).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__: f for f in (
    decompose_replay, decompose_errors, cache_replay, question_replay, fact_checks, fact_check_errors, fact_pairs, window_entities, window_facts, window_errors, novel_provenance, novel_rejects, novel_entities, novel_relations, novel_events, quote_anchors,
    embedding_cache_fill, pair_cache_fill, vector_upsert, prompts,
)}
