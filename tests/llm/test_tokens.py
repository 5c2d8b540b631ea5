import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deskmill.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    encoder = tokens.Encoder(tokens.load_vocabulary(tokens.DEFAULT_VOCABULARY))
    return lambda texts: encoder.encode(texts).to_pylist()


TEXTS = ["", None, "Hello  world's\n\n end <|endoftext|>", "Датчик давления 167,64 В", "操作员会看到", "เซ็นเซอร์ 👩‍🔧", "\x1c \x85 a", " " * 1000, "a" * 3000 + "б" * 700, "=-" * 900, "x" * 255 + "yz", "\t\t if x:\r\n"]


def test_cases(own, public):
    assert own(TEXTS) == [public(t) if t else [] for t in TEXTS]
    for t in TEXTS:
        assert tokens.decode(own([t])[0]) == (t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aбв 1'\n-t", max_size=400)), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    encoder = tokens.Encoder(tokens.load_vocabulary(tokens.DEFAULT_VOCABULARY)) if not tokens._ENCODERS else next(iter(tokens._ENCODERS.values()))
    tokens._ENCODERS.setdefault("test", encoder)
    assert encoder.encode(texts).to_pylist() == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_both_contractions_agree():
    e = tokens.Encoder(tokens.load_vocabulary(tokens.DEFAULT_VOCABULARY))
    for w in ("aaaaaaa", "the", "параметр", "abababab", "0123456789"):
        assert list(e.contract([w.encode()])[0]) == list(e.contract_long(w.encode()))


def test_table(spark, public):
    rows = [(1, "раз два"), (1, "раз два"), (2, None), (None, "x"), (3, "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "k BIGINT, t STRING, ids STRING")
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df, "k", "t").collect()), key=str)
    assert got == sorted([(k, public(t) if t else []) for k, t in rows], key=str)
    assert tokens.encode(df.limit(0), "k", "t").count() == 0
