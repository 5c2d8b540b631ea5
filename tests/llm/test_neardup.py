import random
import re

import numpy as np
import pytest

from deskmill.llm import neardup, words


def brute(rows, k, t):
    sets = {}
    for src, i, text in rows:
        w = words.words(text)
        s = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
        if s and i is not None:
            sets[src, i] = s
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and 2 * len(sets[a] & sets[b]) * (1 + t) >= 2 * t * (len(sets[a]) + len(sets[b])) - 1e-9}


def made(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(3000)]
    rows = []
    for i in range(400):
        if rows and rnd.random() < 0.6:
            base = (rnd.choice(rows)[2] or "x").split()
            for _ in range(rnd.choice((0, 1, 2, 5, len(base) // 3))):
                if base:
                    base[rnd.randrange(len(base))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                base = base[: max(1, len(base) * 2 // 3)]
        else:
            base = [rnd.choice(vocab[:40] if rnd.random() < 0.5 else vocab) for _ in range(rnd.randint(0, 60))]
        rows.append((rnd.choice(("page", "problem")), i, " ".join(base)))
    return rows + [rows[5], rows[6], ("page", 900, None), ("page", 901, ""), ("page", 902, "a b"), ("page", None, "a b c d"), ("page", 903, "A, b; C."), ("page", 904, "a b c")]


@pytest.mark.parametrize("k, t, group", [(3, 0.5, 32), (5, 0.8, 32), (2, 0.3, 2)])
def test_against_brute_force(spark, monkeypatch, k, t, group):
    monkeypatch.setattr(neardup, "GROUP", group)
    rows = made(k)
    df = spark.createDataFrame([(*r, 1) for r in rows], "src STRING, id BIGINT, text STRING, gid INT").repartition(3)
    got = [tuple(r) for r in neardup.record_pairs(df, k, t).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, t)


def test_many_copies_and_long_text(spark):
    rows = [("page", i, "одно и то же письмо пришло снова") for i in range(200)] + [("page", 500, "слово " * 300_000), ("page", 501, "слово " * 200_000)]
    got = neardup.record_pairs(spark.createDataFrame(rows, "src STRING, id BIGINT, text STRING"), 3, 0.5).count()
    assert got == 200 * 199 // 2 + 1


def test_classes(spark):
    base = [f"x{i}" for i in range(60)]
    rows = [("page", n, " ".join(["new"] * 0 + base[n : n + 50])) for n in range(5)] + [("page", 10, " ".join(base[:50])), ("page", 20, "совсем другой текст о другом предмете вовсе"), ("problem", 1, " ".join(base[:50]))]
    got = {(r.src, r.id): (r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(rows, "src STRING, id BIGINT, text STRING")).collect()}
    assert {got["page", n][0] for n in (0, 1, 2, 3, 4, 10)} == {0} and got["page", 20] == (20, 0) and got["problem", 1] == (1, 0)
    assert got["page", 10] == got["page", 0]


def test_empty(spark):
    df = spark.createDataFrame([], "src STRING, id BIGINT, text STRING")
    assert neardup.record_pairs(df, 3, 0.5).count() == 0 and neardup.classes(df).count() == 0


def test_pack():
    x = np.array([0, 5, (1 << 40) - 1, 1 << 33], dtype=np.uint64)
    assert (neardup.unpack(neardup.pack(x)) == x).all()


def test_links_of_a_text_in_several_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_sets", lambda records, k, made=neardup._sets: made(records.repartition(8), k))
    monkeypatch.setattr(neardup, "MAX_IDS", 2)
    base = [f"x{i}" for i in range(60)]
    rows = [("page", i, "этот текст ни с каким другим не схож") for i in range(40)] + [("page", 100 + i, " ".join(base[:50])) for i in range(40)]
    rows += [("page", 200, " ".join(base[1:51])), ("page", 201, " ".join(base[2:52]))]
    got = {r.id: (r.class_id, r.n_links) for r in neardup.classes(spark.createDataFrame(rows, "src STRING, id BIGINT, text STRING")).collect()}
    assert {got[i] for i in range(40)} == {(0, 0)} and {got[i] for i in range(100, 140)} == {(100, 2)} and got[200] == got[201] == (100, 2)


def test_saturated_sketches_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BITS", 5)
    monkeypatch.setattr(neardup, "INDEX_BITS", 5)
    rows = made(9)
    df = spark.createDataFrame(rows, "src STRING, id BIGINT, text STRING").repartition(3)
    assert {tuple(r) for r in neardup.record_pairs(df, 3, 0.5).collect()} == brute(rows, 3, 0.5)


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_classes_by_brute_force_for_any_partitioning(spark, parts):
    rows = made(11)
    pairs, seen = brute(rows, 3, 0.5), {(s, i): t for s, i, t in rows if i is not None}
    words = lambda key: frozenset(zip(*[(w := re.findall(r"[^\W_]+", (seen[key] or "").lower()))[n:] for n in range(3)]))
    links: dict = {}
    for s, a, b in pairs:
        x, y = words((s, a)), words((s, b))
        if x != y:
            links.setdefault((s, a), set()).add(y)
            links.setdefault((s, b), set()).add(x)
    near: dict = {}
    for s, a, b in pairs:
        near.setdefault((s, a), set()).add((s, b))
        near.setdefault((s, b), set()).add((s, a))
    df = spark.createDataFrame(rows, "src STRING, id BIGINT, text STRING").repartition(parts)
    got = {(r.src, r.id): (r.class_id, r.n_links) for r in neardup.classes(df, 3, 0.5).collect()}
    assert {k: len(links.get(k, ())) for k in got} == {k: n for k, (_, n) in got.items()}
    for key in got:
        todo, reach = [key], {key}
        while todo:
            for other in near.get(todo.pop(), ()):
                if other not in reach:
                    reach.add(other)
                    todo.append(other)
        assert got[key][0] == min(i for _, i in reach)
