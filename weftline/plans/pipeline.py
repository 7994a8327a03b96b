"""Claims against narratives, end to end: each step takes frames and gives frames, and what fails goes to a frame of errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Chunking, Fusion, Graph, Resources, Retrieval, Rules, Variant
from weftline.operators import chunking, fusion, ledger, reasoning, retrieval, vector
from weftline.operators import verification as V
from weftline.operators.indexes import DenseIndex, GraphIndex, Index, LexicalIndex
from weftline.session import cut

class Decomposer(Protocol):
    """Claims (claim_id, text) to atomic claims (claim_id, parent_claim_id, claim_index, text) and errors (claim_id, reason)."""

    def __call__(self, claims: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Questioner(Protocol):
    """Atomic claims (claim_id, text) to questions (question_id, atomic_claim_id, index, text) and errors (claim_id, reason)."""

    def __call__(self, claims: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Verifier(Protocol):
    """Pairs (atomic_claim_id, evidence_chunk_id, premise, hypothesis) to results (atomic_claim_id, evidence_chunk_id, label, score)."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


class Vectoriser(Protocol):
    """Texts (key, text) to vectors (key, embedding)."""

    def __call__(self, texts: DataFrame, key: str, text: str) -> DataFrame: ...


class WindowExtractor(Protocol):
    """Windows (window_id, text ..) to entities, relations, events and errors (window_id, reason)."""

    def __call__(self, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]: ...


def _no_errors(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.lit(None).cast("string").alias("reason")).limit(0)


def as_given(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims that are atomic already."""
    return claims.select("claim_id", F.col("claim_id").alias("parent_claim_id"), F.lit(0).alias("claim_index"), "text"), _no_errors(claims)


def scripted_questions(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    return retrieval.probe_questions(claims).select("question_id", "atomic_claim_id", "index", "text"), _no_errors(claims)


def lexical_results(pairs: DataFrame) -> DataFrame:
    return V.lexical_labels(pairs).select("atomic_claim_id", "evidence_chunk_id", "label", "score")


@dataclass(frozen=True)
class Steps:
    """The steps a model stands behind; by default what needs none."""

    decompose: Decomposer = as_given
    question: Questioner = scripted_questions
    verify: Verifier = lexical_results
    vectorise: Vectoriser = vector.hashed_vectors


def model_steps(answers: reasoning.Answering, **others: Callable) -> Steps:
    """Steps whose claims are taken apart and asked about by a model's answers."""
    return Steps(decompose=lambda claims: reasoning.decompose(claims, answers)[:2], question=lambda claims: reasoning.ask_questions(claims, answers)[:2], **others)


@dataclass(frozen=True)
class Ledger:
    """All records of a run, by kind; ``errors`` (stage, key, reason) are what was left out and why."""

    chunks: DataFrame
    claims: DataFrame
    questions: DataFrame
    queries: DataFrame
    evidence: DataFrame
    fused: DataFrame
    results: DataFrame
    classified: DataFrame
    cited: DataFrame
    verdicts: DataFrame
    errors: DataFrame
    resources: Resources = field(default_factory=Resources)

    def integrity(self) -> DataFrame:
        """(constraint, violations) of the records' references; all are 0 in a sound run."""
        lost = self.classified.where("status = 'UNRESOLVED'").select("claim_id")
        fused = self.fused.select("atomic_claim_id", "chunk_id")
        return ledger.report([
            ledger.questions_known(self.questions, self.claims), ledger.missing(self.queries, self.claims, ["atomic_claim_id"], ["claim_id"], "query has a claim"), ledger.evidence_known(self.evidence, self.claims, self.queries),
            ledger.missing(fused, self.evidence, ["atomic_claim_id", "chunk_id"], ["atomic_claim_id", "chunk_id"], "fused evidence was retrieved"), ledger.results_known(self.results, fused),
            ledger.classification_known(self.cited, lost, self.claims), ledger.repeated(self.verdicts, ["parent_claim_id"], "verdict"),
        ])

    def fingerprints(self) -> DataFrame:
        """(parent_claim_id, fingerprint) of each claim's records; equal for equal inputs and settings."""
        by = self.claims.select(F.col("claim_id").alias("atomic_claim_id"), "parent_claim_id")
        of = lambda df, item: df.join(by, "atomic_claim_id").select("parent_claim_id", item.alias("item"))
        chunk = F.col("evidence_chunk_id")
        parts = ledger.parts_of(
            "parent_claim_id",
            claim_id=self.claims.select("parent_claim_id", F.col("parent_claim_id").alias("item")).distinct(),
            atomic_claims=self.claims.select("parent_claim_id", F.col("claim_id").alias("item")),
            questions=of(self.questions, F.col("question_id")),
            evidence=of(self.evidence, F.col("evidence_id")),
            fused=of(self.fused, F.format_string("%s:%s:%.6f", "atomic_claim_id", "chunk_id", "score")),
            results=of(self.results, F.format_string("%s:%s:%s:%.6f", "atomic_claim_id", "evidence_chunk_id", "label", "score")),
            contradictions=of(self.cited.where("kind = 'contradiction'"), chunk),
            support=of(self.cited.where("kind = 'support'"), chunk),
            unsupported=self.classified.where("status = 'UNRESOLVED'").select("parent_claim_id", F.col("claim_id").alias("item")),
            verdict=self.verdicts.select("parent_claim_id", F.col("verdict").alias("item")),
            fired_rule=self.verdicts.select("parent_claim_id", F.col("fired_rule").alias("item")),
        )
        return ledger.fingerprint(parts, "parent_claim_id")


def index_of(backend: str, res: Resources, steps: Steps) -> Index:
    """The index behind a backend's name."""
    made = {"LEXICAL": lambda: LexicalIndex(res.retrieval), "SEMANTIC": lambda: DenseIndex(steps.vectorise), "GRAPH": lambda: GraphIndex(res.graph)}
    if backend not in made:
        raise ValueError(f"unknown backend {backend!r}")
    return made[backend]()


def search(backend: str, queries: DataFrame, chunks: DataFrame, res: Resources, steps: Steps) -> DataFrame:
    """(query_id, chunk_id, raw_score, rank) of one backend for all queries (query_id, text) at once."""
    index = index_of(backend, res, steps)
    index.index(chunks)
    return index.query(queries, res.retrieval.top_k)


def run(narratives: DataFrame, claims: DataFrame, variant: Variant = Variant(), res: Resources = Resources(), steps: Steps = Steps()) -> Ledger:
    """The ledger of all claims (claim_id, text) against all narratives (source_id, cleaned_text), indexed once.

    Ingest, decompose, ask, retrieve, fuse, verify, classify, judge. Blank claims, answers that can't be used and claims without parts are errors; everything else goes on.
    """
    chunks = cut(chunking.chunk_documents(narratives, res.chunking)).select("chunk_id", "text", "source_id", "char_start")
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    asked = claims.select("claim_id", "text").distinct()
    atomic, bad_claims = steps.decompose(asked.where(~blank)) if variant.decompose else as_given(asked.where(~blank))
    atomic = cut(atomic.select("claim_id", "parent_claim_id", "claim_index", "text").distinct())
    said = atomic.select("claim_id", "text").distinct()
    questions, bad_questions = steps.question(said)
    questions = cut(questions if variant.questions else questions.limit(0))
    queries = cut(retrieval.build_queries(said, questions))
    hits = [retrieval.stamp(search(b, queries.select("query_id", "text"), chunks, res, steps), queries, b) for b in variant.backends]
    evidence = cut(reduce(DataFrame.unionByName, hits))
    at = evidence.withColumn("recorded_at", F.lit(0))
    fused = cut(fusion.rrf(at, res.fusion) if variant.fusion == "rrf" else fusion.round_robin(at, res.fusion.top_k))
    pairs = fused.select("atomic_claim_id", F.col("chunk_id").alias("evidence_chunk_id")).join(chunks.select(F.col("chunk_id").alias("evidence_chunk_id"), F.col("text").alias("premise")), "evidence_chunk_id").join(said.select(F.col("claim_id").alias("atomic_claim_id"), F.col("text").alias("hypothesis")), "atomic_claim_id")
    results = cut(steps.verify(pairs))
    classified = cut(V.classify(atomic.select("claim_id", "parent_claim_id"), results, res.rules))
    errors = [("input", asked.where(blank).select("claim_id", F.lit("blank claim").alias("reason"))), ("decomposition", bad_claims), ("questions", bad_questions), ("judgement", V.without_claims(asked.withColumnRenamed("claim_id", "parent_claim_id"), classified).withColumnRenamed("parent_claim_id", "claim_id"))]
    told = reduce(DataFrame.unionByName, [e.select(F.lit(stage).alias("stage"), F.col("claim_id").alias("key"), "reason") for stage, e in errors])
    return Ledger(chunks, atomic, questions, queries, evidence, fused, results, classified, V.cited_evidence(classified, results, res.rules), V.verdicts(classified, res.rules), told, res)


def verify(narratives: DataFrame, claims: DataFrame, use_graph: bool = True, rules: Rules = Rules(contradiction=0.95), chunks_cfg: Chunking = Chunking(), search: Retrieval = Retrieval(), fuse: Fusion = Fusion(), walk: Graph = Graph()) -> DataFrame:
    """(claim_id, verdict, fired_rule, n_evidence) of claims that are atomic already; a claim without evidence is unresolved."""
    backends = ("LEXICAL", "SEMANTIC", "GRAPH") if use_graph else ("LEXICAL", "SEMANTIC")
    out = run(narratives, claims, Variant(backends=backends), Resources(chunks_cfg, search, fuse, walk, rules))
    n = out.results.groupBy(F.col("atomic_claim_id").alias("parent_claim_id")).agg(F.count("*").alias("n_evidence"))
    return out.verdicts.join(n, "parent_claim_id", "left").select(F.col("parent_claim_id").alias("claim_id"), "verdict", "fired_rule", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def run_remaining(narratives: DataFrame, claims: DataFrame, done: DataFrame, variant: Variant = Variant(), res: Resources = Resources(), steps: Steps = Steps()) -> Ledger:
    """``run`` for the claims an earlier run didn't finish; ``done`` (claim_id) is its checkpoint."""
    from weftline.sources.readers import remaining

    return run(narratives, remaining(claims, done, "claim_id"), variant, res, steps)
