"""Markdown-aware child chunks: headings, fences, rules, paragraphs, lines, words, characters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.config import CHUNK_OVERLAP, CHUNK_SIZE

_LEVELS = [re.compile(p) for p in (r"\n(?=#{1,6} )", r"```\n|\n(?=```)", r"\n(?:\*\*\*+|---+|___+)\n", r"\n\n+", r"\n", r" ")]


def _cuts(text: str, size: int, level: int = 0) -> list[str]:
    """Parts of at most ``size`` characters that together are the text; separators stay at the end of their part."""
    if len(text) <= size:
        return [text] if text else []
    for n in range(level, len(_LEVELS)):
        ends = [m.end() for m in _LEVELS[n].finditer(text) if 0 < m.end() < len(text)]
        if ends:
            return [p for a, b in zip([0, *ends], [*ends, len(text)]) for p in _cuts(text[a:b], size, n + 1)]
    return [text[a : a + size] for a in range(0, len(text), size)]


def split(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size``; each further one begins with whole parts of the one before, at most ``overlap`` long."""
    chunks: list[str] = []
    held: list[str] = []
    fresh = False
    for part in _cuts(text, size):
        if held and sum(map(len, held)) + len(part) > size:
            if fresh:
                chunks.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
        fresh = True
    if fresh:
        chunks.append("".join(held))
    return [c.strip() for c in chunks if c.strip()]


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, ord, text) of every document; null and blank texts have none."""

    def run(batches):
        for batch in batches:
            out = [(i, k, c) for i, t in zip(batch["doc_id"], batch["text"]) for k, c in enumerate(split(t, size, overlap))]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "ord", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return rows.mapInPandas(run, "doc_id BIGINT, ord BIGINT, text STRING")
