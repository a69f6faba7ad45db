"""Requests and settings of the engine as plain records."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

from loomgraph.functions.text import INDEX_STOP_WORDS, INDEX_TOKEN, INDEX_TRIM

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(value: str | int | float | None) -> timedelta | None:
    """``1h30m``, ``500ms``, ``0`` or a number of nanoseconds; anything else is an error."""
    if value is None:
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return timedelta(seconds=value / 1e9)
    text = str(value).strip()
    sign = -1 if text.startswith("-") else 1
    body = text.lstrip("+-")
    if body == "0":
        return timedelta(0)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise ValueError(f"not a duration: {value!r}")
    return timedelta(seconds=sign * sum(float(a) * _UNITS[b] for a, b in parts))


def query_tokens(text: str) -> list[str]:
    """The index tokens of a query, in order, without repetitions."""
    out: dict[str, None] = {}
    for found in re.findall(INDEX_TOKEN, text):
        clean = found.strip(INDEX_TRIM).lower()
        if len(clean) >= 2 and clean not in INDEX_STOP_WORDS:
            out.setdefault(clean)
    return list(out)


def string_list(value: Any) -> list[str]:
    """A list or a comma-separated string; blanks are left out."""
    items = value.split(",") if isinstance(value, str) else (value or [])
    return [x.strip() for x in items if str(x).strip()]


@dataclass(frozen=True)
class RecallConfig:
    """Default weights and limits of recall."""

    w_sim: float = 0.50
    w_freq: float = 0.15
    w_rec: float = 0.15
    w_imp: float = 0.20
    w_anchor: float = 1.0
    alpha: float = 0.65
    tau: timedelta = timedelta(hours=24)
    max_frequency: int = 100
    pool: int = 20
    top_k: int = 5
    hop_boost: float = 0.35
    min_edge_weight: float = 0.60

    @classmethod
    def server(cls) -> RecallConfig:
        """The weights that the service's flags give: similarity .6, frequency .2, recency .2."""
        return cls(w_sim=0.6, w_freq=0.2, w_rec=0.2)


@dataclass(frozen=True)
class RecallRequest:
    """One recall query. ``None`` means not given, which differs from zero."""

    query: str = ""
    embedding: tuple[float, ...] | None = None
    entity_id: str = ""
    anchors: tuple[str, ...] = ()
    anchor_mode: str = "boost"
    mode: str = "hybrid"
    hybrid_alpha: float | None = None
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # sim, freq, rec, imp
    w_anchor: float | None = None
    top_k: int = 0
    expand_neighbours: bool | None = None
    expand_hops: int = 0
    min_edge_weight: float | None = None
    attenuation: float | None = None
    relations: tuple[str, ...] = ()
    include_embeddings: bool = False
    include_secrets: bool = False
    fields: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> RecallRequest:
        """From JSON-like input; unknown names are ignored, lists may be comma-separated strings."""
        names = {"query": str, "entity_id": str, "anchor_mode": str, "mode": str, "hybrid_alpha": float, "top_k": int, "expand_neighbours": bool, "expand_hops": int, "min_edge_weight": float, "include_embeddings": bool, "include_secrets": bool}
        known = {k: kind(raw[k]) for k, kind in names.items() if raw.get(k) is not None}
        lists = {"anchors": "anchors", "traverse_relations": "relations", "fields": "fields"}
        known |= {to: tuple(string_list(raw[k])) for k, to in lists.items() if raw.get(k)}
        if raw.get("embedding"):
            known["embedding"] = tuple(map(float, raw["embedding"]))
        if raw.get("attenuation_factor") is not None:
            known["attenuation"] = float(raw["attenuation_factor"])
        known["weights"] = tuple(float(raw.get(k) or 0) for k in ("alpha", "beta", "gamma", "w_imp"))
        return cls(**known)

    def resolved(self, cfg: RecallConfig = RecallConfig()) -> ResolvedRequest:
        sim, freq, rec, imp = self.weights
        if not any(self.weights):
            sim, freq, rec, imp = cfg.w_sim, cfg.w_freq, cfg.w_rec, cfg.w_imp
        elif imp > 0 and not (sim or freq or rec):
            sim, freq, rec = cfg.w_sim, cfg.w_freq, cfg.w_rec
        total = sim + freq + rec + imp
        if total <= 0:
            sim, freq, rec, imp, total = 0.5, 0.15, 0.15, 0.2, 1.0
        words = self.query.split()
        tags = [w for w in words if w.startswith("#")]
        rest = " ".join(w for w in words if not w.startswith("#"))
        text = rest if tags and rest else self.query.strip()
        anchors: dict[str, None] = {}
        for tag in [*self.anchors, *tags]:
            clean = tag.strip().lower()
            if clean not in ("", "#"):
                anchors.setdefault(clean if clean.startswith("#") else "#" + clean)
        alpha = cfg.alpha if self.hybrid_alpha is None else self.hybrid_alpha
        alpha = {"dense": 1.0, "bm25": 0.0}.get(self.mode, alpha)
        expand = self.expand_neighbours if self.expand_neighbours is not None else self.expand_hops > 0
        return ResolvedRequest(
            text=text, tokens=query_tokens(text.lower()), embedding=self.embedding, entity_id=self.entity_id, anchors=list(anchors), filter_anchors=bool(anchors) and self.anchor_mode == "filter",
            alpha=min(1.0, max(0.0, alpha)), w_sim=sim / total, w_freq=freq / total, w_rec=rec / total, w_imp=imp / total, w_anchor=cfg.w_anchor if self.w_anchor is None else self.w_anchor,
            top_k=self.top_k if self.top_k > 0 else cfg.top_k, expand=expand, min_edge_weight=cfg.min_edge_weight if self.min_edge_weight is None else self.min_edge_weight,
            boost=cfg.hop_boost if self.attenuation is None else self.attenuation, relations=list(self.relations), include_embeddings=self.include_embeddings or "embedding" in self.fields,
            include_secrets=self.include_secrets, fields=list(self.fields),
        )


@dataclass(frozen=True)
class ResolvedRequest:
    text: str
    tokens: list[str]
    embedding: tuple[float, ...] | None
    entity_id: str
    anchors: list[str]
    filter_anchors: bool
    alpha: float
    w_sim: float
    w_freq: float
    w_rec: float
    w_imp: float
    w_anchor: float
    top_k: int
    expand: bool
    min_edge_weight: float
    boost: float
    relations: list[str]
    include_embeddings: bool
    include_secrets: bool
    fields: list[str] = field(default_factory=list)

    def with_vector(self, vector: tuple[float, ...]) -> ResolvedRequest:
        return replace(self, embedding=vector)


@dataclass(frozen=True)
class DecayConfig:
    """Periodic decay; ``half_life`` is a true half-life."""

    half_life: timedelta = timedelta(hours=72)
    archive_below: float = 0.10
    grace: timedelta = timedelta(hours=168)
    edge_below: float = 0.05


@dataclass(frozen=True)
class ScopedDecay:
    """Decay of a scope: all, unanchored, session or transient. Defaults archive every unprotected node in scope."""

    scope: str = "all"
    session_id: str = ""
    half_life: timedelta = timedelta(hours=72)
    grace: timedelta = timedelta(0)
    threshold: float | None = None
    min_importance: float = 0.80


@dataclass(frozen=True)
class FusionConfig:
    rate: float = 0.15
    max_weight: float = 5.0


@dataclass(frozen=True)
class Env:
    """Settings from the environment or a KEY=VALUE file; what the environment has wins."""

    values: dict[str, str]

    @classmethod
    def load(cls, path: str | None = None) -> Env:
        found: dict[str, str] = {}
        if path and os.path.exists(path):
            for line in open(path, encoding="utf-8"):
                line = line.strip()
                if line and not line.startswith("#") and "=" in line:
                    k, _, v = line.removeprefix("export ").partition("=")
                    found[k.strip()] = v.strip().strip("\"'")
        return cls({**found, **os.environ})

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.values.get(name, default)


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text)
