"""Model connectors: protocols, retry, clients over HTTP, and scripted ones where no model is at hand.

A connector answers one prompt; ``operators.reasoning`` runs it over frames of prompts, behind a cache.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np

from weftline.config import Model


@runtime_checkable
class Completer(Protocol):
    """Answers a prompt with a text."""

    def complete(self, prompt: str) -> str: ...


@runtime_checkable
class StructuredCompleter(Protocol):
    """Answers a prompt with the text of a JSON value of a given schema."""

    def complete_structured(self, prompt: str, schema: Mapping[str, Any]) -> str: ...


@runtime_checkable
class Embedder(Protocol):
    """Turns texts into unit vectors, one row each."""

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


@runtime_checkable
class PairScorer(Protocol):
    """Labels (premise, hypothesis) pairs ENTAILMENT, CONTRADICTION or NEUTRAL, with a score each."""

    def score(self, premises: Sequence[str], hypotheses: Sequence[str]) -> list[tuple[str, float]]: ...


class TransientError(RuntimeError):
    """A failure worth another try, such as a full quota or an overloaded service."""


class ModelError(ValueError):
    """An answer that can't be used, or a call that must not be made."""


@dataclass(frozen=True)
class Retry:
    """The k-th wait is first * factor ** k seconds; after ``most`` more tries the failure stands."""

    first: float = 5.0
    factor: float = 2.0
    most: int = 5
    codes: tuple[int, ...] = (429, 503)

    def waits(self) -> list[float]:
        return [self.first * self.factor**k for k in range(self.most)]


def with_retry(call: Callable[[], Any], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> Any:
    """The value of ``call``, tried again after each TransientError."""
    for wait in retry.waits():
        try:
            return call()
        except TransientError:
            sleep(wait)
    return call()


def nullable_dialect(node: Any) -> Any:
    """A JSON schema for services that know no lists of types: the first type other than null with nullable beside it, and no additionalProperties."""
    if isinstance(node, list):
        return [nullable_dialect(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: nullable_dialect(v) for k, v in node.items() if k != "additionalProperties"}
    kinds = node.get("type")
    if isinstance(kinds, list):
        out["type"] = next((t for t in kinds if t != "null"), "string")
        out |= {"nullable": True} if "null" in kinds else {}
    return out


def post_json(url: str, body: Mapping[str, Any], headers: Mapping[str, str], codes: Sequence[int], timeout: float = 120.0) -> dict[str, Any]:
    """The JSON answer to a POST; a status among ``codes`` is a TransientError."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise (TransientError if e.code in codes else ModelError)(f"status {e.code}") from e


@dataclass(frozen=True)
class ChatCompleter:
    """Completions of a chat service, as text or of a strict JSON schema. ``post`` sends a request; tests give their own.

    An answer without content, or one that didn't end by itself, is an error, so it is never cached. ``nullable``: the service takes the nullable dialect.
    """

    url: str
    model: Model
    system: str = ""
    key: str = ""
    schema_name: str = "answer"
    nullable: bool = False
    retry: Retry = Retry()
    post: Callable[..., dict[str, Any]] = post_json
    sleep: Callable[[float], None] = time.sleep

    def _ask(self, prompt: str, extra: Mapping[str, Any]) -> str:
        said = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": prompt}]
        body = {"model": self.model.name, "temperature": self.model.temperature, "max_tokens": self.model.max_tokens, "messages": said, **extra}
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        choice = with_retry(lambda: self.post(self.url, body, headers, self.retry.codes), self.retry, self.sleep)["choices"][0]
        text = choice.get("message", {}).get("content")
        if choice.get("finish_reason") != "stop":
            raise ModelError(f"the completion ended by {choice.get('finish_reason')!r}")
        if not text:
            raise ModelError("the completion has no content")
        return text

    def complete(self, prompt: str) -> str:
        return self._ask(prompt, {})

    def complete_structured(self, prompt: str, schema: Mapping[str, Any]) -> str:
        wanted = nullable_dialect(dict(schema)) if self.nullable else dict(schema)
        text = self._ask(prompt, {"response_format": {"type": "json_schema", "json_schema": {"name": self.schema_name, "strict": True, "schema": wanted}}})
        json.loads(text)
        return text


@dataclass(frozen=True)
class ScriptedCompleter:
    """Recorded answers by prompt; any other prompt has the default, or is an error."""

    answers: Mapping[str, str] = field(default_factory=dict)
    default: str | None = None

    def complete(self, prompt: str) -> str:
        text = self.answers.get(prompt, self.default)
        if text is None:
            raise ModelError("no recorded answer")
        return text

    def complete_structured(self, prompt: str, schema: Mapping[str, Any]) -> str:
        return self.complete(prompt)


class NoCall:
    """For replays: every prompt must be in the cache."""

    def complete(self, prompt: str) -> str:
        raise ModelError("a call in a replay")

    def complete_structured(self, prompt: str, schema: Mapping[str, Any]) -> str:
        raise ModelError("a call in a replay")


def label_map(names: Mapping[int, str]) -> dict[int, str]:
    """A classifier's class numbers by the three labels; a name that is none of them, in any case, is an error."""
    known = ("ENTAILMENT", "CONTRADICTION", "NEUTRAL")
    unknown = sorted(n for n in names.values() if n.upper() not in known)
    if unknown or {n.upper() for n in names.values()} != set(known):
        raise ModelError(f"unknown or missing labels: {unknown or sorted(names.values())}")
    return {k: n.upper() for k, n in names.items()}


@dataclass(frozen=True)
class LogitScorer:
    """A PairScorer over a classifier's logits: the label of the largest softmax, and that value."""

    logits: Callable[[Sequence[str], Sequence[str]], np.ndarray]
    names: Mapping[int, str]

    def score(self, premises: Sequence[str], hypotheses: Sequence[str]) -> list[tuple[str, float]]:
        known = label_map(self.names)
        x = np.asarray(self.logits(premises, hypotheses), dtype=np.float64)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [(known[int(k)], float(p[i, k])) for i, k in enumerate(best)]


@dataclass(frozen=True)
class ScriptedScorer:
    """Recorded labels by pair, then by parts of both texts; any other pair has the default."""

    pairs: Mapping[tuple[str, str], tuple[str, float]] = field(default_factory=dict)
    parts: Sequence[tuple[str, str, str, float]] = ()
    default: tuple[str, float] = ("NEUTRAL", 0.5)

    def score(self, premises: Sequence[str], hypotheses: Sequence[str]) -> list[tuple[str, float]]:
        def one(p: str, h: str) -> tuple[str, float]:
            near = ((label, s) for a, b, label, s in self.parts if a in p and b in h)
            return self.pairs.get((p, h)) or next(near, self.default)

        return [one(p, h) for p, h in zip(premises, hypotheses)]
