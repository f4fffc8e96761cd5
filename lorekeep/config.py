"""Defaults, and what differs for each kind of dataset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from enum import Enum
from typing import TypeVar

Settings = TypeVar("Settings")


class Mode(str, Enum):
    BM25 = "bm25"
    DENSE = "dense"
    HYBRID = "hybrid"


class Granularity(str, Enum):
    TURN = "turn"
    ROUND = "round"
    ALL = "all"


@dataclass(frozen=True)
class Search:
    """How questions are answered. What is zero, or not above zero where it must be, means the default."""

    mode: Mode | str = Mode.HYBRID
    top_k: int = 0
    candidates: int = 0
    rrf_k: int = 0
    trade_off: float = 0.0
    max_per_session: int = 0
    window_days: float = 0.0
    boost: float = 0.0
    hard_filter: bool = False
    k1: float = 1.2
    b: float = 0.75

    def resolved(self) -> Search:
        return replace(
            self,
            mode=Mode(self.mode or Mode.HYBRID),
            top_k=self.top_k if self.top_k > 0 else 10,
            candidates=self.candidates if self.candidates > 0 else 100,
            rrf_k=self.rrf_k if self.rrf_k > 0 else 60,
            trade_off=self.trade_off if self.trade_off > 0 else 0.7,
            window_days=self.window_days if self.window_days > 0 else 14.0,
            boost=self.boost if self.boost > 0 else 1.3,
        )


@dataclass(frozen=True)
class Tuning:
    search: Search
    granularity: Granularity


def tuning(dataset: str) -> Tuning:
    base = Search(rrf_k=60, candidates=100, top_k=10, max_per_session=4)
    if dataset == "locomo":
        return Tuning(replace(base, rrf_k=10, max_per_session=0), Granularity.ALL)
    if dataset == "longmemeval_s":
        return Tuning(replace(base, rrf_k=30), Granularity.TURN)
    return Tuning(base, Granularity.ALL)


@dataclass(frozen=True)
class Enrichment:
    """Of the ledger and its sweeps."""

    version: int = 1
    max_attempts: int = 5
    backoff_seconds: float = 60.0
    batch_size: int = 128
    batches: int = 8
    dims: int = 768
    model: str = "mock"
    document_prefix: str = "search_document: "
    query_prefix: str = "search_query: "


def from_environment(kind: type[Settings], env: Mapping[str, str] = os.environ) -> Settings:
    """Settings whose fields are named in the environment, as LOREKEEP_BATCH_SIZE for batch_size; others are as they are by
    default, and one that isn't of its field's kind is an error."""
    named = {f.name: env[f"LOREKEEP_{f.name.upper()}"] for f in fields(kind) if env.get(f"LOREKEEP_{f.name.upper()}")}
    default = kind()
    return replace(default, **{name: type(getattr(default, name))(value) for name, value in named.items()})
