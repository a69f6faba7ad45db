"""Deterministic text embeddings: features hashed to pseudorandom directions, in numpy per batch.

A text's features are weighted strings (synonym concepts, stems, words, four-letter grams, pairs); a feature's hash
seeds the direction it adds. Features of a whole batch are made distinct first, so each direction is drawn once.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence
from typing import Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.config import query_tokens

# Hash and generator constants, suffixes in order, feature weights, built-in synonym clusters.
FNV_OFFSET, FNV_PRIME, ZERO_SEED, MULTIPLIER = 0xCBF29CE484222325, 0x100000001B3, 0x517CC1B727220A95, 0x2545F4914F6CDD1D
SUFFIXES = ("ations", "ation", "tions", "tion", "ings", "ing", "ments", "ment", "ness", "sses", "ies", "ed", "es", "s")
CONCEPT_WEIGHT, STEM_WEIGHT, WORD_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT, RAW_WEIGHT = 8.0, 1.2, 0.7, 0.25, 0.5, 1.0
SYNONYMS = {
    "concept:consensus_coordination": ("cluster coordination", "cluster coordinate", "coordination", "consensus heartbeat", "heartbeat timeout", "consensus timeout", "raft consensus", "cluster heartbeat", "leader election", "heartbeat interval", "election timeout", "coordination interval"),
    "concept:time_interval": ("interval", "timeout", "period", "duration", "heartbeat period"),
    "concept:episodic_memory": ("episodic trace", "episodic memory", "memory trace", "memory traces", "deliberation trace", "cognitive recollection", "retrieval trace"),
    "concept:network_proxy": ("reverse proxy", "nginx", "worker_connections", "ingress gateway", "socket buffer", "listen port", "proxy buffer"),
    "concept:telemetry_sensor": ("thermal sensor", "temperature alarm", "cryogenic refrigerator", "sensor telemetry", "optical sensor", "thermal threshold"),
}


class Embedder(Protocol):
    """Anything that turns a batch of texts into vectors; the one place for code of the user's own."""

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray: ...


def stem(word: str) -> str:
    out = word
    if len(out) > 3:
        hit = next((s for s in SUFFIXES if out.endswith(s) and len(out) - len(s) >= 3), "")
        if hit:
            out = out[: -len(hit)] + ("y" if hit == "ies" else "")
        if len(out) > 3 and out.endswith("e"):
            out = out[:-1]
    return out


def fnv1a(text: str) -> int:
    h = FNV_OFFSET
    for byte in text.encode("utf-8"):
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def directions(features: Sequence[str], dim: int) -> np.ndarray:
    """(features, dim) float32 in [-1, 1): all generators step together."""
    state = np.array([fnv1a(f) or ZERO_SEED for f in features], np.uint64)
    out = np.empty((len(features), dim), np.float32)
    for i in range(dim):
        state ^= state >> np.uint64(12)
        state ^= state << np.uint64(25)
        state ^= state >> np.uint64(27)
        out[:, i] = ((state * np.uint64(MULTIPLIER)) >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.float32) / np.float32(2147483648.0)
    return out


class HashEmbedder:
    """The built-in embedder. ``lower``: texts are trimmed and lower-cased first, so that synonyms match any case."""

    def __init__(self, dim: int = 384, lower: bool = True, synonyms: dict[str, Sequence[str]] | None = None, fixed: dict[str, Sequence[float]] | None = None) -> None:
        self.dim, self.lower = dim, lower
        self.phrases = {p.strip().lower(): c for c, ps in {**SYNONYMS, **(synonyms or {})}.items() for p in ps if p.strip()}
        self.fixed = {k.strip().lower(): np.array(v, np.float32) for k, v in (fixed or {}).items()}

    def features(self, text: str) -> dict[str, float]:
        if text == "":
            return {}
        out: dict[str, float] = {f"concept:{c}": CONCEPT_WEIGHT for c in sorted({c for p, c in self.phrases.items() if p in text})}
        words = query_tokens(text)

        def add(name: str, weight: float) -> None:
            out[name] = out.get(name, 0.0) + weight

        for i, w in enumerate(words):
            weight = 1.0 + 0.15 * min(5, len(w))
            add("s:" + stem(w), weight * STEM_WEIGHT)
            add("w:" + w, weight * WORD_WEIGHT)
            if len(w) >= 5:
                for j in range(len(w) - 3):
                    add("ng4:" + w[j : j + 4], GRAM_WEIGHT)
            if i + 1 < len(words):
                add(f"bi:{w}_{words[i + 1]}", PAIR_WEIGHT)
        if not out:
            add("raw:" + text, RAW_WEIGHT)
        return out

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        clean = [(t or "").strip().lower() if self.lower else (t or "") for t in texts]
        per = [self.features(t) for t in clean]
        names = list(dict.fromkeys(f for p in per for f in p))
        at = {f: i for i, f in enumerate(names)}
        out = np.zeros((len(texts), self.dim))
        if names:
            d = directions(names, self.dim).astype(np.float64)
            for i, p in enumerate(per):
                if p:
                    out[i] = np.fromiter(p.values(), np.float64, len(p)) @ d[[at[f] for f in p]]
            n = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(n > 0, n, 1)
        out = out.astype(np.float32)
        for i, t in enumerate(clean):
            if t in self.fixed:
                out[i] = self.fixed[t]
        return out


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.status, answer.read()


class HttpEmbedder:
    """A service with the public embeddings protocol: one POST for each ``batch`` texts, answers put in order by index.

    ``post`` sends a request (url, body, headers, timeout) and gives (status, body); tests and other transports set it.
    Any answer that isn't one vector for each text is an error; wrap in :class:`WithFallback` to go on without.
    """

    def __init__(self, endpoint: str, model: str = "", api_key: str = "", timeout: float = 10.0, batch: int = 64, post: Callable[[str, bytes, dict[str, str], float], tuple[int, bytes]] = _post) -> None:
        self.endpoint, self.model, self.api_key, self.timeout, self.batch, self.post = endpoint, model, api_key, timeout, batch, post

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})}
        out: list[list[float]] = []
        for lo in range(0, len(texts), self.batch):
            part = [t or "" for t in texts[lo : lo + self.batch]]
            status, body = self.post(self.endpoint, json.dumps({"input": part, **({"model": self.model} if self.model else {})}).encode(), headers, self.timeout)
            answer = json.loads(body)
            if status != 200 or answer.get("error"):
                raise RuntimeError(f"embedding service: {status} {answer.get('error')}")
            by_index = {int(x["index"]): x["embedding"] for x in answer.get("data", [])}
            if sorted(by_index) != list(range(len(part))):
                raise RuntimeError("embedding service: not one vector for each text")
            out += [by_index[i] for i in range(len(part))]
        return np.array(out, np.float32)


class WithFallback:
    """A remote embedder with a local one for when it fails; failures never fail the job."""

    def __init__(self, remote: Embedder, local: Embedder) -> None:
        self.remote, self.local, self.status = remote, local, "reachable"

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        try:
            out = np.asarray(self.remote.embed_batch(texts), np.float32)
            self.status = "reachable"
            return out
        except Exception:
            self.status = "degraded"
            return self.local.embed_batch(texts)


def with_embeddings(df: DataFrame, text: str, out: str, make: Callable[[], Embedder]) -> DataFrame:
    """``df`` with vectors of ``text`` where ``out`` is null or missing; ``make`` builds the embedder once per task."""
    base = df if out in df.columns else df.withColumn(out, F.lit(None).cast("array<float>"))

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for s in series:
            yield pd.Series(list(embedder.embed_batch(s.fillna("").tolist())))

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    vector = F.pandas_udf(run, "array<float>")
    return base.withColumn(out, F.coalesce(F.col(out), vector(F.col(text))))
