"""Pluggable models. Each has a deterministic default, so that every plan runs and can be checked without one."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Reranker(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


@dataclass
class ScriptedGenerator:
    """Answers by the first key that a prompt contains: a model for tests and demonstrations."""

    answers: dict[str, str]
    default: str = ""

    def generate(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), self.default)


@dataclass
class HashingEmbedder:
    """Counts of hashed words: the default in place of an embedding model."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            at = [zlib.crc32(word.encode()) % self.dim for word in (text or "").lower().split()]
            out.append(np.bincount(np.array(at, np.int64), minlength=self.dim).astype(float).tolist())
        return out


@dataclass
class Config:
    """Settings of an engine; None stands for the rule-based default."""

    collection: str = "default"
    dim: int = 64
    temperature: float = 0.1
    max_tokens: int = 2048
    max_graph_chunks: int = 20
    embedder: Embedder = field(default_factory=HashingEmbedder)
    generator: Generator | None = None
    reranker: Reranker | None = None
    top: int = 5
    diversity: float | None = 0.7


def embed(texts: DataFrame, embedder: Embedder, column: str = "text", to: str = "dense") -> DataFrame:
    """texts with an embedding column. Each distinct text is embedded once, in Arrow batches, and joined back by its hash."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder.embed(s.fillna("").tolist()))

    hashed = texts.withColumn("_h", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))
    distinct = hashed.groupBy("_h").agg(F.first(column).alias(column)).select("_h", run(F.col(column)).alias(to))
    return hashed.join(distinct, "_h").drop("_h")


def generate(prompts: DataFrame, generator: Generator | Callable[[str], str], column: str = "prompt", to: str = "response") -> DataFrame:
    """prompts with a model's response; a prompt that fails gives null and not an error."""
    ask = generator.generate if hasattr(generator, "generate") else generator

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for prompt in s:
                try:
                    out.append(ask(prompt))
                except Exception:  # noqa: BLE001  what a remote model raises isn't known here
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return prompts.withColumn(to, run(F.col(column)))


def rerank_scores(pairs: DataFrame, reranker: Reranker) -> DataFrame:
    """question_id, point_id, ce of pairs (question_id, point_id, question, text), in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            out = pd.Series(0.0, index=questions.index)
            for question, at in questions.groupby(questions).groups.items():
                out.loc[at] = reranker.score(question, texts.loc[at].fillna("").tolist())
            yield out

    return pairs.select("question_id", "point_id", run(F.col("question"), F.col("text")).alias("ce"))
