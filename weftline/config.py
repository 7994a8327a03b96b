"""Frozen settings of the engine, each with a fingerprint of its values."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class _Settings:
    @property
    def fingerprint(self) -> str:
        text = ":".join(str(getattr(self, f.name)) for f in fields(self))
        return hashlib.sha256(text.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Chunking(_Settings):
    """size and overlap of chunks, in code points."""

    size: int = 700
    overlap: int = 120

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and less than size")


@dataclass(frozen=True)
class Retrieval(_Settings):
    """Hits per query and list; BM25's parameters, epsilon being the floor of a negative idf as a share of the mean."""

    top_k: int = 10
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")


@dataclass(frozen=True)
class Fusion(_Settings):
    rrf_k: int = 60
    top_k: int = 10


@dataclass(frozen=True)
class Graph(_Settings):
    max_hops: int = 1
    least_mention: int = 2

    def __post_init__(self) -> None:
        if self.max_hops not in (1, 2):
            raise ValueError("max_hops must be 1 or 2")


@dataclass(frozen=True)
class Rules(_Settings):
    """Inclusive thresholds; strict: a claim set is consistent only if every claim is supported."""

    contradiction: float = 0.9
    entailment: float = 0.5
    strict: bool = True


@dataclass(frozen=True)
class Quotes(_Settings):
    """least share of equal words of a fuzzy match, and its lead over the next best place."""

    overlap: float = 0.95
    margin: float = 0.03


@dataclass(frozen=True)
class Windows(_Settings):
    """Sizes in tokens of extraction windows; snap in tokens of about four characters."""

    least_chapters: int = 3
    most: int = 6000
    fallback: int = 4000
    overlap: int = 600
    snap: int = 200


@dataclass(frozen=True)
class Model(_Settings):
    """Of a completion service."""

    name: str = "none"
    temperature: float = 0.0
    max_tokens: int = 1024

    def __post_init__(self) -> None:
        if self.max_tokens < 1 or not 0 <= self.temperature <= 2:
            raise ValueError("max_tokens must be at least 1 and temperature from 0 to 2")


@dataclass(frozen=True)
class Embedding(_Settings):
    """model: of a sentence encoder; hashed bags of words where it is that name."""

    model: str = "hashed-bow"
    dims: int = 64
    batch: int = 64
    normalised: bool = True


@dataclass(frozen=True)
class PairScoring(_Settings):
    model: str = "lexical"
    max_tokens: int = 256
    batch: int = 64


@dataclass(frozen=True)
class Parsing(_Settings):
    """Most items of a decomposition and of a list of questions."""

    claims: int = 10
    questions: int = 5


@dataclass(frozen=True)
class Extraction(_Settings):
    """Versions of prompt and schema, part of every key of the extraction's cache."""

    prompt: str = "1"
    schema: str = "1"


@dataclass(frozen=True)
class FactCheck(_Settings):
    prompt: str = "1"
    schema: str = "1"


@dataclass(frozen=True)
class Evaluation(_Settings):
    """cutoffs: of recall and precision. keep: whether reports and ledgers are written to ``folder``."""

    cutoffs: tuple[int, ...] = (5, 10)
    seed: int = 0
    keep: bool = False
    folder: str = ""


@dataclass(frozen=True)
class Variant(_Settings):
    """One way to run the pipeline. backends: that search. fusion: 'rrf' or 'round_robin'. decompose: whether claims are taken apart."""

    name: str = "full"
    backends: tuple[str, ...] = ("SEMANTIC", "LEXICAL", "GRAPH")
    fusion: str = "rrf"
    questions: bool = True
    decompose: bool = True

    def __post_init__(self) -> None:
        if not self.backends or self.fusion not in ("rrf", "round_robin"):
            raise ValueError("a variant needs a backend, and fusion 'rrf' or 'round_robin'")


#: The full pipeline, and one variant for each component left out.
ABLATION = (
    Variant(),
    Variant("no_questions", questions=False),
    Variant("no_lexical", backends=("SEMANTIC", "GRAPH")),
    Variant("no_graph", backends=("SEMANTIC", "LEXICAL")),
    Variant("no_fusion", fusion="round_robin"),
    Variant("no_decomposition", decompose=False),
)


@dataclass(frozen=True)
class Resources:
    """All settings of a run in one, and its fingerprint."""

    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    fusion: Fusion = Fusion()
    graph: Graph = Graph()
    rules: Rules = Rules(contradiction=0.95)
    parsing: Parsing = Parsing()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(":".join(getattr(self, f.name).fingerprint for f in fields(self)).encode()).hexdigest()[:16]


def run_id(dataset: str, variant: Variant, evaluation: Evaluation) -> str:
    """Of an evaluation run: dataset's, variant's and settings' fingerprints together."""
    return hashlib.sha256(f"{dataset}:{variant.fingerprint}:{evaluation.fingerprint}".encode()).hexdigest()[:16]
