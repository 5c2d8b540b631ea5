import random

import pytest

from deskmill.llm import leak, words


def brute(docs, items, n=13):
    out = set()
    for d, t in docs:
        ws = words.words(t, fold_yo=True, drop_tags=True)
        have = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i, q in items:
            qs = words.words(q, fold_yo=True, drop_tags=True)
            if any(tuple(qs[p : p + n]) in have for p in range(len(qs) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id BIGINT, text STRING, item_id INT")
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id BIGINT, question STRING, text STRING")
    rows = leak.leaks(d, i, **kw).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


@pytest.mark.parametrize("block, chars", [(5000, 8_000_000), (7, 8_000_000), (5000, 300), (5000, 1)])
def test_against_brute_force(spark, monkeypatch, block, chars):
    monkeypatch.setattr(leak, "BLOCK_CHARS", chars)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(300):
        body = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            qs = rnd.choice(items)[1].split()
            a = rnd.randrange(len(qs))
            body[len(body) // 2 : len(body) // 2] = qs[a : a + rnd.randint(8, 20)]
        docs.append((d, ", ".join(body)))
    want = brute(docs, items)
    assert want and run(spark, docs, items, block=block) == want


def test_cases(spark):
    q = "один два три четыре пять шесть семь восемь девять десять ёлка двенадцать тринадцать четырнадцать"
    ws = q.split()
    docs = [
        (1, q.upper().replace(" ", "\n** ")), (2, " ".join(ws[:13])), (3, " ".join(ws[:12])), (4, None), (5, ""), (6, "<b>один</b> " + " <br/> ".join(ws[1:])),
        (7, " ".join(ws[:6]) + " лишнее " + " ".join(ws[6:])), (8, q.replace("ё", "е") + " " + q), (8, q), (None, q), (9, "слово " * 200_000 + q),
    ]
    assert run(spark, docs, [(1, q), (1, q), (2, None), (3, ""), (4, "short one")]) == {(1, 1), (2, 1), (6, 1), (8, 1), (None, 1), (9, 1)}
    assert run(spark, docs, []) == set() and run(spark, [], [(1, q)]) == set()


def test_repeated_shingles_inside_an_item(spark):
    q = "a b " * 20
    assert run(spark, [(1, "a b " * 6 + "c"), (2, "a b " * 7)], [(1, q)]) == {(2, 1)}
