import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmill.llm import split


def checked(text, limit, overlap):
    spans = split.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, kind), (c, d, _) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
        if kind != "char":
            assert re.match(r"[\s。！？]", text[b - 1]) or re.match(r"[\s。！？]", text[b])
    assert all(0 < b - a <= limit for a, b, _ in spans)
    longest = max(map(len, re.split(r"[\s。！？]", text)))
    assert any(k == "char" for *_, k in spans) == (len(text) > limit and longest > limit)
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n。#! «é", min_size=1, max_size=300), st.integers(3, 60), st.integers(0, 40))
def test_any_text(text, limit, overlap):
    checked(text, limit, overlap)


def test_prefers_the_stronger_boundary():
    text = "## A\n" + "w " * 40 + "\n\n" + "v " * 10 + "\n## B\n" + "u " * 30
    spans = checked(text, 120, 10)
    assert spans[0][2] == "section" and text[spans[0][1] :].startswith("## B")


def test_overlap_is_near_what_was_asked():
    random.seed(1)
    text = " ".join("x" * random.randint(1, 9) for _ in range(4000))
    spans = checked(text, 400, 50)
    assert all(38 <= b - c <= 50 for (_, b, _), (c, _, _) in zip(spans, spans[1:]))


def test_very_long_unbroken_text():
    spans = checked("x" * 1_000_000, 400, 50)
    assert all(b - c == 50 for (_, b, _), (c, _, _) in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([("a", 10, 3), ("a", 10, 3), ("n", None, None)], "source_type STRING, max_chars BIGINT, overlap_chars BIGINT")


def test_table_cases(spark, limits):
    rows = [(1, "ab " * 8, "a"), (1, "ab " * 8, "a"), (2, None, "a"), (3, "", "a"), (4, "short", "a"), (5, "y" * 30, "a"), (6, "y" * 30, "zz"), (7, "y" * 30, None), (8, "y" * 30, "n"), (None, "c" * 11, "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "i BIGINT, t STRING, source_type STRING, max_chars STRING")
    found = {(r.id, r.kind) for r in split.oversized(docs, limits, "i", "t", "source_type").collect()}
    assert found == {(1, "soft"), (5, "hard"), (None, "hard")}
    pieces = split.distinct_pieces(split.split(docs, limits, "i", "t", "source_type")).collect()
    assert sorted({r.id for r in pieces if r.id}) == [1, 4, 5, 6, 7, 8]
    assert [r.text for r in sorted(pieces, key=lambda r: r.piece_no) if r.id == 6] == ["y" * 30]
    assert split.split(docs.limit(0), limits, "i", "t", "source_type").count() == 0
