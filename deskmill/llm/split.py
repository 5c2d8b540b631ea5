"""Splitting oversized texts at natural boundaries.

A hierarchy of separators is applied recursively: a text over the limit is cut into sections, a section that is still
too long into paragraphs, then sentences, words and at last characters. The parts are packed greedily into pieces of
at most ``limit`` code points, and each further piece begins with a tail of about ``overlap`` code points of the one
before, begun at a word where there is one. Pieces are slices of the stored text, so that together they give all of it.

Work is per row and needs no shuffle; the limits are joined by the size Spark sees (a few rows are broadcast).

Defined cases: null text gives no piece, an empty text neither; a text within its limit is one piece; a text without
limit (unknown type, null or non-positive limit) is one piece; an overlap is cut to less than half of the limit; white
space counts as boundary wherever Unicode says so; an unbroken stretch over the limit is cut at characters, an
unbroken stretch within the limit never; further columns of the input are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "id BIGINT, piece_no INT, start_pos INT, end_pos INT, cut STRING, text STRING"

_SEPARATORS = (
    ("section", re.compile(r"\n(?=#{1,6}[ \t])|\n[ \t]*(?:[-=*_]{3,})[ \t]*\n|\n\s*\n\s*\n+")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("sentence", re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+[”’」』）】]*\s*|\n+")),
)
_BREAK = re.compile(r"[\s。！？]")


def _atoms(text: str, start: int, end: int, level: int, room: int, limit: int, out: list) -> None:
    if end - start <= room:
        out.append((start, end, ""))
        return
    while level < len(_SEPARATORS):
        name, separator = _SEPARATORS[level]
        level += 1
        a, cut = start, False
        for m in separator.finditer(text, start, end):
            b = m.end()
            if start < b < end:
                _atoms(text, a, b, level, room, limit, out)
                out[-1] = (*out[-1][:2], name)
                a, cut = b, True
        if cut:
            _atoms(text, a, end, level, room, limit, out)
            return
    # words: as many as fit together; a longer unbroken stretch stays whole up to the limit
    a = last = start
    marks = [p for m in _BREAK.finditer(text, start, end) for p in (m.start(), m.end())]
    for p in [*marks, end]:
        if p - a > room:
            if last > a:
                out.append((a, last, "word"))
                a = last
            if p - a > limit:
                for k in range(a, p, room):
                    out.append((k, min(k + room, p), "char"))
                a = p
                out[-1] = (*out[-1][:2], "word")
        last = p
    if end > a:
        out.append((a, end, "word"))


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of each piece; kind ``end`` for the last one."""
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, "end")]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    atoms: list[tuple[int, int, str]] = []
    _atoms(text, 0, n, 0, limit - overlap, limit, atoms)
    pieces, start, end, kind = [], 0, 0, ""
    for a, b, k in atoms:
        if b - start > limit:
            pieces.append((start, end, kind))
            low = max(end - overlap, b - limit, start + 1)
            m = _BREAK.search(text, low - 1, end - 1) if low < end else None
            start = m.end() if m else min(low, end)
        end, kind = b, k
    pieces.append((start, end, "end"))
    return pieces


def split(docs: DataFrame, limits: DataFrame, id_col: str, text_col: str, type_col: str, with_text: bool = True, oversized_only: bool = False) -> DataFrame:
    """Pieces of every text. ``limits``: ``type_col``, max_chars, overlap_chars; a repeated type takes its smallest limit.

    A row delivered more than once gives its pieces more than once; see :func:`distinct_pieces`.
    """
    bound = limits.groupBy(F.col(type_col).alias("_type")).agg(F.min("max_chars").alias("_max"), F.min_by("overlap_chars", "max_chars").alias("_over"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(type_col).alias("_type")).filter(F.col("_text") != "")
    rows = rows.join(bound, "_type", "inner" if oversized_only else "left")
    if oversized_only:
        rows = rows.filter((F.col("_max") > 0) & (F.length("_text") > F.col("_max")))

    def run(batches):
        for batch in batches:
            out = []
            for i, text, most, over in zip(batch["_id"], batch["_text"], batch["_max"], batch["_over"]):
                spans = split_spans(text, int(most), int(over) if over == over and over is not None else 0) if most == most and most is not None and most > 0 else [(0, len(text), "end")]
                out += [(i, k, a, b, kind, text[a:b] if with_text else None) for k, (a, b, kind) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "start_pos", "end_pos", "cut", "text"])

    return rows.select("_id", "_text", "_max", "_over").mapInPandas(run, PIECES)


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    """Each piece once, however often its row was delivered (redelivered rows hold the same content)."""
    return pieces.dropDuplicates(["id", "piece_no"])


def oversized(docs: DataFrame, limits: DataFrame, id_col: str, text_col: str, type_col: str) -> DataFrame:
    """Texts over their limit: ``hard`` where a piece had to end inside an unbroken stretch, else ``soft``."""
    pieces = split(docs, limits, id_col, text_col, type_col, with_text=False, oversized_only=True)
    hard = F.bool_or(F.col("cut") == "char")
    return pieces.groupBy("id").agg(F.when(hard, "hard").otherwise("soft").alias("kind"))
