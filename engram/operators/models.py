"""Plug-in points for models; everything around them is deterministic."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a model is given at once.
ASKED = 256


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def score(self, queries: list[str], documents: list[str]) -> list[float]: ...


class Judge(Protocol):
    def complete_json(self, prompts: list[str]) -> list[str | None]: ...


def _lazily(make: Callable[[], object]):
    """One model a Python worker, made at its first batch."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def _by_slices(texts: pa.Array, answer: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """``answer`` of ``ASKED`` texts at a time, so that of a batch only those are Python objects at once."""
    return pa.concat_arrays([pa.array(answer(texts.slice(lo, ASKED).to_pylist()), kind) for lo in range(0, len(texts), ASKED)] or [pa.nulls(0, kind)])


def embed(text: Column, make: Callable[[], Embedder]) -> Column:
    """Embedding column; the model is made once a worker and called with ``ASKED`` texts at a time."""
    model = _lazily(make)

    def run(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda some: [None if v is None else [float(x) for x in v] for v in model().embed(["" if t is None else t for t in some])], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>").asNondeterministic()(text)


def score(query: Column, document: Column, make: Callable[[], Scorer]) -> Column:
    model = _lazily(make)

    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(model().score(q.tolist(), d.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")(query, document)


def judge(prompt: Column, make: Callable[[], Judge]) -> Column:
    """Model answers as JSON text; null where the model fails, which skips the item."""
    model = _lazily(make)

    def run(prompts: pa.Array) -> pa.Array:
        return _by_slices(prompts, model().complete_json, pa.string())

    # A filter on the answer would otherwise ask a second time.
    return F.arrow_udf(run, "string").asNondeterministic()(prompt)


class HashEmbedder:
    """A small deterministic embedder for tests: hashed words on a unit sphere."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8"))
                v[h % self.dim] += 1.0 if h & 0x10000 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class CannedJudge:
    """Answers by the first key that a prompt contains; None without one."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def complete_json(self, prompts: list[str]) -> list[str | None]:
        return [next((a for k, a in self.answers.items() if k in p), None) for p in prompts]

