"""Lexical, dense and hybrid search, reranking, parent join and final order.

A query set is stated and searched against all rows. Its terms and vectors are small next to the corpus: the corpus is
scanned once, only rows that share a term with a query leave their task, and each task keeps its own best k before
anything is ranked globally. Texts are left out of scoring plans and joined for winners only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskmill.config import BM25_B, BM25_K1, RRF_K, RetrievalProfile
from deskmill.functions import text as T
from deskmill.functions import vectors as V
from deskmill.models import Reranker, hypothetical, lexical_coverage
from deskmill.models import rerank as score_with
from deskmill.operators.common import top_k
from deskmill.session import materialise


def bm25(corpus: DataFrame, queries: DataFrame, k: int, group: str | None = None, k1: float = BM25_K1, b: float = BM25_B, block: int = 1024) -> DataFrame:
    """(query_id, [group,] doc_id, score, rank): Okapi BM25 of ``queries`` (query_id, text) over ``corpus`` (doc_id, [group,] text).

    Statistics are those of all texts of a group, counted in one pass that combines in each task (a row for each term asked for). Queries go to the
    tasks in blocks of ``block``; a task scores its texts against a block at once and keeps its best k of each query,
    so that neither postings nor scores of all texts are shuffled. Null texts count as empty ones.
    """
    spark, out, low = corpus.sparkSession, None, None
    docs = corpus.select("doc_id", F.col(group).alias("grp") if group else F.lit("").alias("grp"), T.tokens("text").alias("terms"))
    while True:
        page = queries.filter(F.col("query_id").isNotNull())
        rows = (page if low is None else page.filter(F.col("query_id") > low)).orderBy("query_id").limit(block).select("query_id", F.array_distinct(T.tokens("text")).alias("terms")).collect()
        if rows:
            found = _bm25_block(docs, rows, k, k1, b)
            out = found if out is None else out.unionByName(found)
        if len(rows) < block:
            break
        low = rows[-1].query_id
    keys = ["query_id", "grp"]
    if out is None:
        out = spark.createDataFrame([], "query_id BIGINT, grp STRING, doc_id BIGINT, score DOUBLE")
    best = top_k(out, keys, [F.desc("score"), F.asc("doc_id")], k)
    return best.withColumnRenamed("grp", group) if group else best.drop("grp")


def _bm25_block(docs: DataFrame, rows: list, k: int, k1: float, b: float) -> DataFrame:
    vocabulary = sorted({t for r in rows for t in r.terms})
    place = {t: n for n, t in enumerate(vocabulary)}
    asked: list[list[int]] = [[] for _ in vocabulary]
    for n, r in enumerate(rows):
        for t in r.terms:
            asked[place[t]].append(n)
    # one pass: the empty term stands in every text, so that its row counts the texts and averages their lengths
    words = docs.sparkSession.createDataFrame([(["", *vocabulary],)], "vocabulary ARRAY<STRING>").select(F.explode("vocabulary").alias("term"))
    held = docs.select("grp", F.size("terms").alias("dl"), F.explode(F.array_union(F.array(F.lit("")), "terms")).alias("term")).join(words, "term", "left_semi")
    stats = held.groupBy("grp", "term").agg(F.count("*").alias("df"), F.avg("dl").alias("avgdl")).collect()
    sizes = {r.grp: (r.df, r.avgdl) for r in stats if r.term == ""}
    idf = {(r.grp, r.term): np.log((sizes[r.grp][0] - r.df + 0.5) / (r.df + 0.5) + 1) for r in stats}
    weight = {g: np.array([idf.get((g, t), 0.0) for t in vocabulary]) for g in sizes}
    counts = np.array([len(a) for a in asked], dtype=np.int64)
    flat = np.array([q for a in asked for q in a], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows]), place, weight, counts, np.cumsum(counts) - counts, flat, sizes))

    def run(batches):
        qid, place, weight, counts, starts, flat, sizes = shared.value
        best: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for g, part in batch.groupby("grp", sort=False):
                step = max(1, 4_000_000 // len(qid))
                for a in range(0, len(part), step):
                    some = part.iloc[a : a + step]
                    where, term, tf = [], [], []
                    for d, terms in enumerate(some["terms"]):
                        for t, n in Counter(t for t in terms if t in place).items():
                            where.append(d)
                            term.append(place[t])
                            tf.append(n)
                    if not where:
                        continue
                    where_, term_, tf_ = np.array(where), np.array(term), np.array(tf, dtype=np.float64)
                    dl = np.array([len(t) for t in some["terms"]], dtype=np.float64)[where_]
                    score = weight[g][term_] * tf_ * (k1 + 1) / (tf_ + k1 * (1 - b + b * dl / sizes[g][1]))
                    times = counts[term_]
                    first = np.cumsum(times) - times
                    asks = flat[np.repeat(starts[term_] - first, times) + np.arange(times.sum())]
                    total = np.bincount(asks * len(some) + np.repeat(where_, times), weights=np.repeat(score, times), minlength=len(qid) * len(some)).reshape(len(qid), len(some))
                    total = np.round(total, 6)
                    total[total == 0] = -np.inf
                    best[g] = _keep_best(best.get(g), qid, some["doc_id"].to_numpy(dtype=np.int64), total, k)
        for g, rows in best.items():
            yield rows.assign(grp=g)[["query_id", "grp", "doc_id", "score"]]

    return docs.filter(F.col("doc_id").isNotNull()).mapInPandas(run, "query_id BIGINT, grp STRING, doc_id BIGINT, score DOUBLE")


def _keep_best(best: pd.DataFrame | None, qid: np.ndarray, doc: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The best k rows of each query so far, ties by document; scores of -inf are no rows."""
    order = np.lexsort((np.broadcast_to(doc, scores.shape), -scores), axis=1)[:, :k]
    rows = pd.DataFrame({"query_id": np.repeat(qid, order.shape[1]), "doc_id": doc[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})
    rows = rows[np.isfinite(rows["score"])]
    return rows if best is None else pd.concat([best, rows]).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def dense(corpus: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine search of ``queries`` (query_id, embedding) in ``corpus`` (doc_id, embedding).

    Queries go to the tasks in blocks of ``block`` vectors, the bound of what is sent; each task multiplies its rows
    with a block at once and keeps its best k of each query. A query doesn't find itself. Zero vectors score 0.
    """
    spark, out, low = corpus.sparkSession, None, None
    while True:
        page = queries.filter(F.col("query_id").isNotNull() & F.col("embedding").isNotNull())
        rows = (page if low is None else page.filter(F.col("query_id") > low)).orderBy("query_id").limit(block).select("query_id", "embedding").collect()
        if rows:
            found = _dense_block(corpus, [r.query_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64), k)
            out = found if out is None else out.unionByName(found)
        if len(rows) < block:
            break
        low = rows[-1].query_id
    if out is None:
        return spark.createDataFrame([], "query_id BIGINT, doc_id BIGINT, score DOUBLE, rank BIGINT")
    return top_k(out, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _dense_block(corpus: DataFrame, ids: list[int], vectors: np.ndarray, k: int) -> DataFrame:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    shared = corpus.sparkSession.sparkContext.broadcast((np.array(ids), vectors / np.where(length > 0, length, 1)))

    def run(batches):
        qid, q = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            keep = batch["embedding"].notna() & batch["doc_id"].notna()
            if not keep.any():
                continue
            doc, m = batch["doc_id"][keep].to_numpy(dtype=np.int64), np.array(list(batch["embedding"][keep]), dtype=np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            scores = np.round(q @ (m / np.where(n > 0, n, 1)).T, 6) + 0.0
            scores[qid[:, None] == doc[None, :]] = -np.inf
            best = _keep_best(best, qid, doc, scores, k)
        if best is not None:
            yield best

    return corpus.select("doc_id", "embedding").mapInPandas(run, "query_id BIGINT, doc_id BIGINT, score DOUBLE")


def fuse(lists: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists; a list without the row adds nothing."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "doc_id", "rank"))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def equipment_filter(corpus: DataFrame, column: str, wanted: list | None, everything: str = "All") -> DataFrame:
    """Rows of the wanted values, before any scoring; an empty list or the sentinel means all rows."""
    return corpus if not wanted or everything in wanted else corpus.filter(F.col(column).isin(*wanted))


def reranked(hits: DataFrame, queries: DataFrame, corpus: DataFrame, reranker: Reranker | None = None) -> DataFrame:
    """Hits (query_id, db_source, doc_id, rank) with ``rerank``: the score of the hit's text for the original query.

    Without a model the score is the coverage of the query's terms. Only the texts of hits are read further.
    """
    texts = corpus.select("doc_id", F.col("text").alias("_text")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = hits.join(queries.select("query_id", F.col("text").alias("_query")), "query_id").join(texts, "doc_id")
    score = lexical_coverage(T.tokens("_query"), T.tokens("_text")) if reranker is None else score_with(F.col("_query"), F.col("_text"), reranker)
    return rows.withColumn("rerank", F.round(score, 6)).drop("_query", "_text")


def best_children(hits: DataFrame, profile: RetrievalProfile) -> DataFrame:
    """The profile's final children of each query and source: over the threshold (inclusive), best first, then search order."""
    if not profile.rerank:
        return top_k(hits.withColumn("rerank", F.lit(0.0)), ["query_id", "db_source"], [F.asc("rank")], profile.top_k_final, "ord")
    kept = hits.filter(F.col("rerank") >= profile.rerank_threshold)
    return top_k(kept, ["query_id", "db_source"], [F.desc("rerank"), F.asc("rank")], profile.top_k_final, "ord")


def pooled(hits: DataFrame, profile: RetrievalProfile) -> DataFrame:
    """Both sources in one list: tickets weighted down, the threshold after the weight, then the best of all."""
    weighted = hits.withColumn("rerank", F.round(F.when(F.col("db_source") == "tickets", F.col("rerank") * profile.tickets_weight).otherwise(F.col("rerank")), 6))
    kept = weighted.filter(F.col("rerank") >= profile.rerank_threshold)
    return top_k(kept, ["query_id"], [F.desc("rerank"), F.asc("db_source"), F.asc("rank")], profile.top_k_final, "ord")


def source_counts(children: DataFrame) -> DataFrame:
    """How many of each query's children come from documentation and from tickets."""
    return children.groupBy("query_id").agg(F.count_if(F.col("db_source") == "docs").alias("n_docs"), F.count_if(F.col("db_source") == "tickets").alias("n_tickets"))


def parents_of(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents of the children by best child, in order of first appearance; children without parent id stand for themselves, a missing parent is skipped.

    ``children``: query_id, db_source, doc_id (child), parent_id, rerank, ord. ``parents``: parent_id.
    """
    own = children.filter(F.col("parent_id").isNull()).select("query_id", "db_source", F.lit(False).alias("is_parent"), "doc_id", F.lit(None).cast("bigint").alias("parent_id"), F.col("rerank").alias("score"), "ord")
    best = children.filter(F.col("parent_id").isNotNull()).groupBy("query_id", "db_source", "parent_id").agg(F.max("rerank").alias("score"), F.min("ord").alias("ord"))
    known = best.join(parents.select("parent_id").distinct(), "parent_id", "left_semi")
    known = known.select("query_id", "db_source", F.lit(True).alias("is_parent"), F.lit(None).cast("bigint").alias("doc_id"), "parent_id", "score", "ord")
    return own.unionByName(known)


def final_order(found: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``pos`` from 1: by score, documentation first, own children before parents, then first appearance."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("db_source"), F.asc("is_parent"), F.asc("ord"))
    return found.withColumn("pos", F.row_number().over(w).cast("bigint"))


def litm(found: DataFrame, keys: tuple[str, ...] = ("query_id",), pos: str = "pos", name: str = "litm_pos") -> DataFrame:
    """The best at both ends of the context: places 1, n, 2, n-1, ... by the closed form; up to two rows stay as they are."""
    n = F.count("*").over(Window.partitionBy(*keys))
    r = F.col(pos) - 1
    return found.withColumn("_n", n).withColumn(name, (F.when(2 * r < F.col("_n"), 2 * r).otherwise(2 * (F.col("_n") - 1 - r) + 1) + 1).cast("bigint")).drop("_n")


def search_children(corpus: DataFrame, queries: DataFrame, profile: RetrievalProfile, reranker: Reranker | None = None, generated: DataFrame | None = None) -> DataFrame:
    """Reranked hits of ``corpus`` (doc_id, parent_id, db_source, text) for ``queries`` (query_id, text), for each source by itself.

    ``generated`` (query_id, passage): hypothetical answers, searched in place of queries where they are long enough;
    hits are reranked for the original query. The hits, at most a profile's number of each query and source, are written
    once, so that the corpus is scanned once more for their texts only.
    """
    asked = queries
    if generated is not None:
        text, _ = hypothetical(F.col("text"), F.col("passage"))
        asked = queries.join(generated, "query_id", "left").select("query_id", text.alias("text"))
    hits = bm25(corpus, asked, profile.top_k_retrieval, "db_source")
    if profile.rerank:
        hits = materialise(hits, "hits")
        hits = reranked(hits, queries, corpus, reranker)
    return hits.join(corpus.select("doc_id", "parent_id"), "doc_id")


def keep_source(found: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """One source's rows, at most ``most`` of each query."""
    rows = found.filter(F.col("db_source") == source)
    return rows if most is None else top_k(rows, ["query_id"], [F.asc("pos")], most, "kept")

