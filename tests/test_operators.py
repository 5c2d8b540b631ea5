import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskmill.config import Eligibility, RetrievalProfile, profile
from deskmill.models import EchoGenerator, HashEmbedder, RoundRobin, embed, hypothetical
from deskmill.operators import answers, chunking, context, evaluate, ingest, markdown
from deskmill.operators import retrieve as R
from deskmill.operators import tickets as K
from deskmill.operators.common import numbered


def test_eligibility_keeps_nulls(spark):
    rows = [(1, "2022-01-01", "Закрыто", None, None), (2, None, "Закрыто", "r1", "a"), (3, "2021-12-31", "Закрыто", "r1", "a"), (4, "2023-01-01", "Открыто", "r1", "a"), (5, "2023-01-01", "Закрыто", "r9", "a"), (6, "2023-01-01", "Закрыто", "r1", "b")]
    df = spark.createDataFrame(rows, "ticket_id INT, d STRING, cache_status_type STRING, cf_tip_oborud_reg STRING, who STRING").withColumn("cmf_created_at", F.try_to_timestamp("d"))
    rules = Eligibility(excluded_equipment=("r9",), excluded_assignees=("b",))
    assert [r.ticket_id for r in K.eligible(df, rules, assignee="who").collect()] == [1]
    assert {r.code for r in K.codes(spark.createDataFrame([(" rl-5",), ("RL-5",), (None,), ("x",)], "c STRING"), "c").collect()} == {"RL-5"}


def test_roles_cards_and_long_threads(spark):
    t = spark.createDataFrame([("T1", "<b>Имя</b>", None, "описание", "", "закрыто", "r1", None, "u1"), ("T2", None, "", None, None, None, "zz", "Кат", None)], "ticket_id STRING, name STRING, text STRING, description STRING, resolution STRING, cache_status_type STRING, cf_tip_oborud_reg STRING, cf_kategoriya_or_name STRING, cmf_owner_id STRING")
    at = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([(i, "T1", at + dt.timedelta(days=9 * (i // 2)), "u1" if i % 2 else "u2", "Client", f"сообщение номер {i:02d}") for i in range(12)] + [(50, "T1", at, None, None, "ok"), (51, None, at, "u1", "Client", "потерянное сообщение"), (52, "T2", at, "u1", None, "Оценка: отлично")], "comment_id INT, ticket_id STRING, cmf_created_at TIMESTAMP, cmf_owner_id STRING, author_role STRING, text STRING")
    e = spark.createDataFrame([("r1", "Прибор")], "code STRING, equipment_name STRING")
    roles = {r.comment_id: r.role for r in K.author_roles(c, t).collect()}
    assert (roles[1], roles[0], roles[50], roles[52]) == ("Client", "Engineer", "Engineer", "Unknown")
    parts = {r.part_no: r.thread.split(K.SEPARATOR) for r in K.threads(c, part=5).collect()}
    assert [len(parts[k]) for k in sorted(parts)] == [5, 5, 2] and parts[0][0].endswith("сообщение номер 00") and parts[2][1].endswith("11")
    cards = {r.ticket_id: r.page_content for r in K.cards(t, c, e).collect()}
    assert "[ТИКЕТ: T1] [Прибор]" in cards["T1"] and "[СТАТУС: Закрыто]" in cards["T1"] and "ОПИСАНИЕ:\nописание" in cards["T1"] and "ИТОГОВОЕ" not in cards["T1"]
    assert "ТЕМА: T2" in cards["T2"] and "[General]" in cards["T2"] and "[ТИП: Кат] | [СТАТУС: Unknown]" in cards["T2"] and "ПЕРЕПИСКА" not in cards["T2"]
    assert [r.ticket_id for r in K.facts(t, c, e).collect()] == ["T1"]


def test_numbered_over_months(spark):
    rows = [(k, dt.datetime(2024, 1 + m, 1) if m else None, 10 * m + i) for k in ("a", None) for m in range(4) for i in range(3)]
    df = spark.createDataFrame(rows, "k STRING, at TIMESTAMP, tie INT")
    got = sorted(((r.k or "", r.turn, r.tie) for r in numbered(df, "k", "at", "tie").collect()))
    assert got == sorted((k, n + 1, 10 * (n // 3) + n % 3) for k in ("", "a") for n in range(12))


@pytest.mark.parametrize("n, want", [(1, [0]), (2, [0, 1]), (3, [0, 2, 1]), (4, [0, 3, 1, 2]), (7, [0, 6, 1, 5, 2, 4, 3])])
def test_litm(spark, n, want):
    df = spark.range(n).select(F.lit(1).alias("query_id"), (F.col("id") + 1).alias("pos"))
    assert [r.pos - 1 for r in R.litm(df).orderBy("litm_pos").collect()] == want


def test_ranking_rules(spark):
    hits = spark.createDataFrame([(1, "docs", 10, 1, 100, 0.05), (1, "docs", 11, 2, 100, 0.9), (1, "docs", 12, 3, None, 0.9), (1, "docs", 13, 4, 999, 0.5), (1, "docs", 14, 5, 101, 0.049), (1, "tickets", 20, 1, 200, 0.07)], "query_id INT, db_source STRING, doc_id BIGINT, rank BIGINT, parent_id BIGINT, rerank DOUBLE")
    parents = spark.createDataFrame([(100,), (101,), (200,)], "parent_id BIGINT")
    p = RetrievalProfile(24, 4, litm=True)
    best = R.best_children(hits, p)
    assert {(r.doc_id, r.ord) for r in best.filter("db_source = 'docs'").collect()} == {(11, 1), (12, 2), (13, 3), (10, 4)}
    found = R.final_order(R.parents_of(best, parents), ("query_id", "db_source")).filter("db_source = 'docs'").orderBy("pos").collect()
    assert [(r.doc_id, r.parent_id, r.score) for r in found] == [(12, None, 0.9), (None, 100, 0.9)]
    assert 20 not in {r.doc_id for r in R.pooled(hits, p).collect()} and R.source_counts(best).first().n_tickets == 1
    assert R.best_children(hits, profile("fast")).filter("db_source = 'docs'").count() == 3
    assert R.litm(hits.limit(0).withColumn("pos", F.lit(1))).count() == 0


def test_dense_blocks_and_zero_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, embedding ARRAY<FLOAT>")
    q = df.filter("doc_id < 10 or doc_id = 60").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in R.dense(df, q, 5, block=3).collect()}
    m = np.array([r[1] for r in rows[:61]])
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for i in range(10):
        s = np.round(u @ u[i], 6)
        s[i] = -9
        order = sorted(range(61), key=lambda j: (-s[j], j))[:5]
        assert [got[i, k + 1][0] for k in range(5)] == order
    assert got[60, 1] == (0, 0.0) and len(got) == 55


def test_bm25_against_brute_force(spark):
    texts = {1: "alpha beta beta gamma", 2: "beta", 3: None, 4: "delta delta epsilon alpha", 5: "", 6: "alpha alpha alpha alpha zeta"}
    asks = {1: "alpha beta", 2: "delta missing", 3: "nothing here", 4: None}
    docs = spark.createDataFrame([(k, "x", t) for k, t in texts.items()], "doc_id BIGINT, db_source STRING, text STRING").repartition(3)
    queries = spark.createDataFrame(list(asks.items()), "query_id BIGINT, text STRING")
    words = {k: (t or "").split() for k, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, a in asks.items():
        for d, w in words.items():
            s = 0.0
            for t in set((a or "").split()):
                df, tf = sum(t in x for x in words.values()), w.count(t)
                s += np.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
            if s:
                want[q, d] = round(s, 6)
    for block in (1024, 1):
        got = R.bm25(docs, queries, 2, "db_source", block=block).collect()
        assert {(r.query_id, r.doc_id): r.score for r in got} == {k: s for k, s in want.items() if sorted((-x, e) for (q, e), x in want.items() if q == k[0]).index((-s, k[1])) < 2}
    assert R.bm25(docs, queries.limit(0), 2).count() == 0 and R.bm25(docs.limit(0), queries, 2).count() == 0


def test_chunks_cover_the_text(spark):
    texts = {1: "x" * 400, 2: "абв " * 200, 3: "", 4: None, 5: "y" * 401}
    rows = chunking.fixed(spark.createDataFrame(list(texts.items()), "k BIGINT, t STRING"), "k", "t").collect()
    for k, t in texts.items():
        mine = [r.text for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.ord)]
        assert "".join([mine[0], *(c[50:] for c in mine[1:])]) == t if t else mine == []
    text = "# A\n\n" + "слово " * 100 + "\n\n## B\n" + "z" * 900
    parts = markdown.split(text)
    assert all(len(p) <= 400 for p in parts) and all(w in "\n".join(parts) for w in text.split()[:100]) and markdown.split(" \n") == []
    assert markdown.chunks(spark.createDataFrame([(1, text), (2, None)], "k BIGINT, t STRING"), "k", "t").count() == len(parts)
    e = chunking.enrich(F.lit("t [КЛЮЧЕВЫЕ СЛОВА: a]"), F.lit("q?"), F.lit("b"))
    assert spark.range(1).select(e).first()[0] == "Document: t [КЛЮЧЕВЫЕ СЛОВА: a]\n\n[ПОТЕНЦИАЛЬНЫЕ ВОПРОСЫ: q?]"


def test_cascade_branches(spark):
    cases = [
        ("blank", "", "x", 0.0, None, "Пропуск"), ("error", "ok Rate limit", "x", 0.0, None, "Ошибка"), ("letters", "а) y", "a) z\nА) y", 0.0, None, "Нет"), ("letters", "а) x", "А) y", 0.0, None, "Да"),
        ("parts", "один и два", "- один\n- два", 0.0, None, "Да"), ("parts", "один", "один\nдва", 1.0, None, "Нет"), ("equal", "Ёлка!", "елка", 0.0, None, "Да"), ("contained", "это елка тут", "ёлка", 0.0, None, "Да"),
        ("similar", "p", "q", 0.82, None, "Да"), ("judge", "p", "q", 0.5, True, "Да"), ("none", "p", "q", 0.5, None, "Нет"), ("none", "p", "q", None, None, "Нет"),
    ]
    df = spark.createDataFrame([(i, "f", c[1], c[2], c[3], c[4]) for i, c in enumerate(cases)], "i INT, file STRING, a STRING, r STRING, s DOUBLE, j BOOLEAN")
    got = {r.i: (r.rule, r.verdict) for r in evaluate.cascade(df, "a", "r", F.col("s"), judge=F.col("j")).collect()}
    assert got == {i: (c[0], c[5]) for i, c in enumerate(cases)}
    stats = {r.file: r for r in evaluate.statistics(evaluate.cascade(df, "a", "r", F.col("s"))).collect()}
    assert stats[None].total == 11 and stats["f"].skipped == 1 and stats["f"].errors == 1
    assert evaluate.statistics(evaluate.cascade(df.limit(0), "a", "r")).count() == 0


def test_ingest_twice_changes_nothing(spark):
    files = ingest.hashed(spark.createDataFrame([("a", "p", b"1"), ("b", "p", b"1"), ("a", "q", b"2"), ("a", "e", b"")], "source_type STRING, path STRING, content BINARY"))
    empty = spark.createDataFrame([], "source_type STRING, path STRING, hash STRING, parent_ids ARRAY<STRING>")
    first = ingest.diff(files, empty)
    assert {r.state for r in first.collect()} == {"new"}
    parents = files.filter("path <> 'e'").select("source_type", "path", ingest.parent_id("source_type", "path", "path").alias("parent_id"))
    registry = ingest.updated_registry(first, parents)
    assert {r.path: len(r.parent_ids) for r in registry.collect()}["e"] == 0 and registry.count() == 4
    assert {r.state for r in ingest.diff(files, registry).collect()} == {"same"}
    changed = ingest.hashed(spark.createDataFrame([("a", "p", b"9"), ("a", "q", b"2")], "source_type STRING, path STRING, content BINARY"))
    d = ingest.diff(changed, registry)
    assert {(r.source_type, r.path): r.state for r in d.collect()} == {("a", "p"): "changed", ("a", "q"): "same", ("b", "p"): "deleted", ("a", "e"): "deleted"}
    assert {(r.source_type, r.path) for r in ingest.replaced(parents, d, parents.filter("source_type = 'a' and path = 'p'")).collect()} == {("a", "q"), ("a", "p")}
    assert ingest.completeness(spark.range(100), spark.range(95)).first().complete and not ingest.completeness(spark.range(100), spark.range(94)).first().complete


def test_context(spark):
    rows = [(1, 1, "x" * 30, "f1", "u1"), (1, 2, "y", "f1", "u1"), (1, 3, "z", "f2", "")]
    df = spark.createDataFrame(rows, "query_id INT, pos BIGINT, page_content STRING, source_file STRING, url STRING")
    for c in ("ticket_id", "format", "source_type", "page_title", "breadcrumb_raw", "equipment_type", "release_version"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    refs = context.references(df, "D")
    assert [(r.source_id, r.title) for r in refs.orderBy("n").collect()] == [("D1", "f1"), ("D2", "f2")]
    assert "[D2] f2 | file=f2 | url=f2" in context.rendered_sources(refs).first().sources
    text = context.context_of_pages(df).first().context
    assert text.startswith("[Unknown | Release: Unknown") and text.count("URL:") == 3
    assert context.context_of_tickets(df).count() == 0 and context.context_of_tickets(df.withColumn("format", F.lit("ticket"))).count() == 1
    q = context.ticket_query(F.lit(" t "), F.array(F.lit(" "), F.lit("A "), F.lit("B")))
    assert spark.range(1).select(q, context.quiz_prompt(F.lit("q"), F.lit(" "))).first() == ("Equipment: A, B\n\nTicket text:\nt", "q")


def test_models(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t STRING")
    v = [r.v for r in df.select(embed(F.col("t"), HashEmbedder(8)).alias("v")).collect()]
    assert round(sum(x * x for x in v[0]), 6) == 1 and sum(map(abs, v[1] + v[2])) == 0
    text, used = hypothetical(F.lit("q"), F.lit("g" * 50))
    short, _ = hypothetical(F.lit("q"), F.lit("g" * 49))
    assert spark.range(1).select(text, used, short).first() == ("g" * 50, True, "q")

    class Broken:
        def generate(self, prompts):
            raise ValueError

    both = RoundRobin([Broken(), EchoGenerator()])
    assert both.generate(["x\ny"]) == ["x"] and both.generate(["z"]) == ["z"]
    raw = '<think>no</think>```json\n{"intent": " i ", "related_topics": "one", "internal_notes": ["a", "b"], "similar_tickets": [{"ticket_id": "T", "problem_summary": "p"}], "final_answer": null, "answer": "x"}\n```'
    got = spark.createDataFrame([(raw,), ("not json",)], "r STRING").select(*answers.read_response("r")).collect()
    assert (got[0].ok, got[0].user_intent, got[0].related_topics, got[0].internal_notes, got[0].draft_private_comment, got[0].similar_tickets[0].problem_summary) == (True, "i", ["one"], ["a", "b"], "x", "p")
    assert (got[1].ok, got[1].user_intent, got[1].related_topics, got[1].similar_tickets) == (False, "", [], [])

    class Labels:
        def generate(self, prompts):
            return ["<think>x</think>КЛЮЧЕВЫЕ СЛОВА: a, b\nВОПРОСЫ: c?"] * len(prompts)

    assert answers.smart_metadata(spark.createDataFrame([(1, "t")], "i INT, t STRING"), "i", "t", Labels()).first() == (1, "a, b", "c?")


def test_profiles():
    assert profile("fast").top_k_retrieval == 16 and profile("unknown").litm and profile("deep", {"top_k_final": 5}).top_k_final == 5
    for bad in ({"top_k_retrieval": 0}, {"top_k_final": 11}, {"rerank_threshold": 1.5}):
        with pytest.raises(ValueError):
            RetrievalProfile(**bad)


def test_written_tables_are_removed(spark):
    import os

    from deskmill import session

    one, two = (session.materialise(spark.range(3).withColumnRenamed("id", "n"), "probe") for _ in range(2))
    path = one._written_to
    assert os.path.isdir(path) and one.count() == 3
    session.discard(one)
    assert not os.path.isdir(path) and two.count() == 3
    session.discard(spark.range(1))
