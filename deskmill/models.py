"""Model steps as protocols with deterministic defaults; real models plug in as Arrow batches of text.

The defaults exist so that every pipeline runs without weights. They keep the data flow, not a model's quality.
"""

from __future__ import annotations

import json
import time
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    query_prompt: str
    document_prompt: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Signed feature hashing of words to ``dim`` numbers, at length 1."""

    query_prompt, document_prompt = "", ""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            if words:
                h = pd.util.hash_array(np.array(words, dtype=object))
                np.add.at(out[i], (h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class EchoGenerator:
    """The first line of the prompt; a stand-in where no model is at hand."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [(p or "").split("\n", 1)[0] for p in prompts]


class ExtractiveGenerator:
    """Answers with the first line of the prompt's documentation, as the structured output that a model is asked for."""

    def generate(self, prompts: list[str]) -> list[str]:
        def one(prompt: str) -> str:
            said = prompt.partition("DOCUMENTATION:\n")[2].split("\n", 1)[0]
            return json.dumps({"intent": "question", "docs_answer": said, "answer": said or "-", "confidence": "high" if said else "low", "doc_sources": ["made up"]}, ensure_ascii=False)

        return [one(p or "") for p in prompts]


class Retrying:
    """A generator that is asked again after an error, ``attempts`` times in all, waiting twice as long each time; then the rows fail by themselves (null)."""

    def __init__(self, generator: Generator, attempts: int = 3, wait: float = 1.0):
        self.generator, self.attempts, self.wait = generator, attempts, wait

    def generate(self, prompts: list[str]) -> list[str | None]:
        for k in range(self.attempts):
            try:
                return self.generator.generate(prompts)
            except Exception:  # noqa: BLE001  providers raise what they like
                if k + 1 < self.attempts:
                    time.sleep(self.wait * 2**k)
        return self.generate(prompts[: len(prompts) // 2]) + self.generate(prompts[len(prompts) // 2 :]) if len(prompts) > 1 else [None] * len(prompts)


class RoundRobin:
    """A generator over several, starting one further with each call and going on after an error."""

    def __init__(self, generators: list[Generator]):
        self.generators, self.calls = generators, 0

    def generate(self, prompts: list[str]) -> list[str]:
        start, self.calls = self.calls, self.calls + 1
        error: Exception | None = None
        for k in range(len(self.generators)):
            try:
                return self.generators[(start + k) % len(self.generators)].generate(prompts)
            except Exception as e:  # noqa: BLE001
                error = e
        raise error or ValueError("no generator")


def embed(c: Column, embedder: Embedder, query: bool = False) -> Column:
    prompt = embedder.query_prompt if query else embedder.document_prompt

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([prompt + (t or "") for t in texts])))

    return run(c)


def rerank(query: Column, text: Column, reranker: Reranker) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(list(q), list(t)), dtype="float64")

    return run(query, text)


def generate(prompt: Column, generator: Generator) -> Column:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generator.generate(list(prompts)))

    return run(prompt)


def lexical_coverage(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query's distinct terms that the text has: the default reranker, an expression."""
    n = F.size(F.array_distinct(query_terms))
    return F.when(n > 0, F.size(F.array_intersect(query_terms, text_terms)) / n).otherwise(0.0)


def hypothetical(query: Column, generated: Column, least: int = 50) -> tuple[Column, Column]:
    """(search text, used): a generated passage replaces the query unless it is null or too short."""
    used = F.coalesce(F.length(generated) >= least, F.lit(False))
    return F.when(used, generated).otherwise(query), used
