"""Search, rerank, order and context queries, each with its SQL. Queries are the quiz items, all of them.

Documentation and tickets are the children of ``rag_docs``: fixed chunks with their parent's id, told apart by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.config import Budgets, profile
from deskmill.models import ExtractiveGenerator
from deskmill.operators import answers, chunking, context
from deskmill.operators import retrieve as R
from deskmill.plans.text_queries import RAG, rag, trim_sql
from deskmill.session import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DEEP = profile("deep")
BUDGETS = Budgets()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


#: More than the chunks that any string can be cut into, so that chunk ids never clash.
CHUNKS = 1 << 23


def _children(spark, d) -> DataFrame:
    """(doc_id, parent_id, db_source, text); a chunk's id is its parent's id and number."""
    pages = rag(spark, d)
    source = pages.select(F.col("parent_id").alias("doc_id"), F.when(F.col("source_type") == "support_tickets", "tickets").otherwise("docs").alias("db_source"))
    chunks = chunking.fixed(pages, "parent_id", "page_content").join(source, "doc_id")
    return chunks.select((F.col("doc_id") * CHUNKS + F.col("ord")).alias("doc_id"), F.col("doc_id").alias("parent_id"), "db_source", "text")


def _bm25_sql(corpus: str, group: str, k: int, asked: str = "question") -> str:
    g, on = (f"{group}, ", f"USING ({group}, term)") if group else ("", "USING (term)")
    sizes = f"sizes AS (SELECT {g}count(*) AS n_docs, avg(dl) AS avgdl FROM d {f'GROUP BY {group}' if group else ''})"
    return rf"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce({asked}, '')), '[\p{{L}}\p{{N}}_]{{3,}}'))) AS term FROM eval_items),
    d AS (SELECT doc_id, {g}regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{3,}}') AS terms, len(terms) AS dl FROM {corpus}),
    {sizes},
    tf AS (SELECT doc_id, {g}dl, term, count(*) AS tf FROM (SELECT doc_id, {g}dl, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT {g}term, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf, avgdl FROM (SELECT {g}term, count(*) AS df FROM tf GROUP BY ALL) {f'JOIN sizes USING ({group})' if group else 'CROSS JOIN sizes'}),
    scored AS (SELECT query_id, {g}doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM tf JOIN w {on} JOIN q USING (term) GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id{', ' + group if group else ''} ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


_CHILDREN = f"""pages AS (SELECT * FROM {RAG}),
    children AS (SELECT parent_id * {CHUNKS} + p // 350 AS doc_id, parent_id, CASE WHEN source_type = 'support_tickets' THEN 'tickets' ELSE 'docs' END AS db_source, substring(page_content, p + 1, 400) AS text
                 FROM pages, unnest(range(0, greatest(length(page_content) - 51, 0) + 1, 350)) AS t(p) WHERE length(page_content) > 0)"""


def _hits_sql(k: int, asked: str = "question") -> str:
    return _CHILDREN + "," + _bm25_sql("children", "db_source", k, asked)


_RERANKED = r""",
    reranked AS (SELECT b.query_id, b.db_source, b.doc_id, b.rank, c.parent_id, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct))::DOUBLE / len(qt) ELSE 0 END, 6) AS rerank
                 FROM bm b JOIN (SELECT doc_id, parent_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}') AS ct FROM children) c USING (doc_id)
                 JOIN (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\p{L}\p{N}_]{3,}')) AS qt FROM eval_items) q USING (query_id)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, db_source ORDER BY rerank DESC, rank) AS ord FROM reranked WHERE rerank >= 0.05) WHERE ord <= 4),
    found AS (SELECT query_id, db_source, parent_id, max(rerank) AS score, min(ord) AS ord FROM best GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, db_source ORDER BY score DESC, ord) AS pos FROM found)"""


_HITS = _hits_sql(24) + _RERANKED


def _hits(spark, d, profile=DEEP, **models) -> DataFrame:
    """Reranked children of both sources; the children are written once, since three steps read them."""
    return R.search_children(materialise(_children(spark, d), "children"), _items(spark, d), profile, **models)


def _placed(spark, d) -> DataFrame:
    best = R.best_children(_hits(spark, d), DEEP)
    return R.final_order(R.parents_of(best, table(spark, d, "rag_docs")), ("query_id", "db_source"))


@query(f"WITH {_hits_sql(16)} SELECT query_id, db_source, doc_id, CAST(rank AS BIGINT) AS ord FROM bm WHERE rank <= 3")
def fast_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile without reranking: the first children in search order."""
    return R.best_children(_hits(spark, sf_dir, profile("fast")), profile("fast")).select("query_id", "db_source", "doc_id", "ord")


@query(f"WITH {_hits_sql(30)}{_RERANKED.replace('ord <= 4', 'ord <= 3')} SELECT query_id, db_source, doc_id, rerank, CAST(ord AS BIGINT) AS ord FROM best")
def default_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_children(_hits(spark, sf_dir, profile("default")), profile("default")).select("query_id", "db_source", "doc_id", "rerank", "ord")


_PASSAGE = "CASE WHEN length(question || ' ' || correct_answer) >= 50 THEN question || ' ' || correct_answer ELSE question END"


@query(f"WITH {_hits_sql(24, _PASSAGE)}{_RERANKED} SELECT query_id, db_source, doc_id, rerank, CAST(ord AS BIGINT) AS ord FROM best")
def hypothetical_answer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched by a hypothetical answer (here the item's own one behind its question), reranked for the question alone."""
    passages = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.concat("question", F.lit(" "), "correct_answer").alias("passage"))
    return R.best_children(_hits(spark, sf_dir, generated=passages), DEEP).select("query_id", "db_source", "doc_id", "rerank", "ord")


class LengthReranker:
    """A model in form only: the closeness of lengths, in code points."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        return [1.0 / (1 + abs(len(q or "") - len(t or ""))) for q, t in zip(queries, texts)]


@query(f"""WITH {_hits_sql(24)},
    scored_by_length AS (SELECT b.query_id, b.db_source, b.doc_id, b.rank, round(1.0::DOUBLE / (1 + abs(length(e.question) - length(c.text))), 6) AS rerank FROM bm b JOIN children c USING (doc_id) JOIN eval_items e ON e.item_id = b.query_id)
    SELECT * FROM (SELECT query_id, db_source, doc_id, rerank, row_number() OVER (PARTITION BY query_id, db_source ORDER BY rerank DESC, rank) AS ord FROM scored_by_length WHERE rerank >= 0.05) WHERE ord <= 4""")
def model_reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with a reranker model plugged in."""
    return R.best_children(_hits(spark, sf_dir, reranker=LengthReranker()), DEEP).select("query_id", "db_source", "doc_id", "rerank", "ord")


@query(f"WITH {_bm25_sql('documents', '', 10)} SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _items(spark, sf_dir), 10)


_DENSE = """dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id {0})) WHERE rank <= 10)"""


@query("WITH " + _DENSE.format("WHERE q.vec_id % 100 = 0") + " SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return R.dense(e, e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 10)


@query("WITH " + _DENSE.format("WHERE q.vec_id % 100 = 0 AND d.label IN (1, 3, 5)") + " SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM dense")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over some labels only, filtered before scoring."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return R.dense(R.equipment_filter(e, "label", [1, 3, 5]), e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 10)


@query(f"""
    WITH {_bm25_sql('documents', '', 10)}, {_DENSE.format('WHERE q.vec_id IN (SELECT item_id FROM eval_items)')},
         u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM dense)
    SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY ALL)) WHERE rank <= 10""")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense lists fused. Texts and vectors of the test tables share no key: for testing only, vec_id = doc_id and an item's vector is the one of its id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = _items(spark, sf_dir)
    vectors = e.join(items.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "embedding")
    return R.fuse([bm25_topk(spark, sf_dir), R.dense(e, vectors, 10)], 10)


@query(f"WITH {_HITS} SELECT query_id, db_source, doc_id, rerank, CAST(ord AS BIGINT) AS ord FROM best")
def rerank_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_children(_hits(spark, sf_dir), DEEP).select("query_id", "db_source", "doc_id", "rerank", "ord")


@query(f"WITH {_HITS} SELECT query_id, db_source, parent_id, score, CAST(pos AS BIGINT) AS pos FROM placed")
def parent_join_best_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("query_id", "db_source", "parent_id", "score", "pos")


_POOLED = _HITS + """,
    weighted AS (SELECT * REPLACE (round(CASE WHEN db_source = 'tickets' THEN rerank * 0.7::DOUBLE ELSE rerank END, 6) AS rerank) FROM reranked),
    pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, db_source, rank) AS ord FROM weighted WHERE rerank >= 0.05) WHERE ord <= 4),
    pfound AS (SELECT query_id, db_source, parent_id, max(rerank) AS score, min(ord) AS ord FROM pool GROUP BY ALL),
    pplaced AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, db_source, ord) AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM pfound)"""


@query(f"WITH {_POOLED} SELECT query_id, db_source, parent_id, score, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN 2 * (pos - 1) < n THEN 2 * (pos - 1) ELSE 2 * (n - pos) + 1 END + 1 AS BIGINT) AS litm_pos FROM pplaced")
def pooled_weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.final_order(R.parents_of(R.pooled(_hits(spark, sf_dir), DEEP), table(spark, sf_dir, "rag_docs")))
    return R.litm(found).select("query_id", "db_source", "parent_id", "score", "pos", "litm_pos")


@query(f"WITH {_POOLED} SELECT query_id, CAST(count(*) FILTER (db_source = 'docs') AS BIGINT) AS n_docs, CAST(count(*) FILTER (db_source = 'tickets') AS BIGINT) AS n_tickets FROM pool GROUP BY 1")
def pooled_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_counts(R.pooled(_hits(spark, sf_dir), DEEP))


@query(f"WITH {_HITS} SELECT query_id, parent_id, score, CAST(pos AS BIGINT) AS pos FROM placed WHERE db_source = 'tickets' AND pos <= 2")
def tickets_retrieval_cap2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_source(_placed(spark, sf_dir), "tickets", BUDGETS.max_tickets).select("query_id", "parent_id", "score", "pos")


@query("SELECT item_id AS query_id, CAST(n AS BIGINT) AS pos, CAST(CASE WHEN 2 * (n - 1) < m THEN 2 * (n - 1) ELSE 2 * (m - n) + 1 END + 1 AS BIGINT) AS litm_pos FROM (SELECT item_id, len(string_split(options, chr(10))) AS m, unnest(range(1, len(string_split(options, chr(10))) + 1)) AS n FROM eval_items WHERE options IS NOT NULL)")
def litm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.posexplode(F.split("options", "\n")).alias("p", "o"))
    return R.litm(rows.withColumn("pos", (F.col("p") + 1).cast("bigint"))).select("query_id", "pos", "litm_pos")


_URL = "CASE source_type WHEN 'product_html' THEN 'https://docs.example/p/' || source_file WHEN 'library_html' THEN 'https://docs.example/l/' || source_file ELSE '' END"
_FILE = "coalesce(nullif(source_file, ''), 'Unknown')"
_META = _HITS + f""",
    meta AS (SELECT p.query_id, p.db_source, p.pos, p.score, d.*, {_URL} AS url FROM placed p JOIN pages d USING (parent_id) WHERE p.db_source = 'docs' OR p.pos <= 2)"""
_REFS = f"""refs AS (SELECT query_id, db_source, CASE db_source WHEN 'docs' THEN 'D' ELSE 'T' END || row_number() OVER (PARTITION BY query_id, db_source ORDER BY pos) AS source_id, row_number() OVER (PARTITION BY query_id, db_source ORDER BY pos) AS n,
    coalesce(nullif(page_title, ''), nullif(breadcrumb_raw, ''), f) AS title, f AS source_file, url, coalesce(equipment_type, '') AS equipment_type, coalesce(release_version, '') AS release_version, coalesce(breadcrumb_raw, '') AS breadcrumb
    FROM (SELECT *, {_FILE} AS f, row_number() OVER (PARTITION BY query_id, db_source, {_FILE}, url ORDER BY pos) AS first FROM meta) WHERE first = 1)"""


def _meta(spark, d) -> DataFrame:
    roots = spark.createDataFrame([("product_html", "https://docs.example/p"), ("library_html", "https://docs.example/l")], "source_type STRING, root STRING")
    placed = materialise(_placed(spark, d).filter((F.col("db_source") == "docs") | (F.col("pos") <= BUDGETS.max_tickets)), "placed")
    pages = rag(spark, d, placed.select("parent_id").distinct()).join(roots, "source_type", "left").withColumn("direct", F.lit("")).withColumn("ticket_id", F.lit(None).cast("string"))
    pages = pages.withColumn("url", context.source_url("direct", "source_file", "root"))
    return placed.select("query_id", "db_source", "parent_id", "pos", "score").join(pages, "parent_id")


def _references(meta: DataFrame) -> DataFrame:
    parts = [context.references(meta.filter(F.col("db_source") == s), p).withColumn("db_source", F.lit(s)) for s, p in (("docs", "D"), ("tickets", "T"))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_META}, {_REFS} SELECT query_id, db_source, source_id, title, source_file, url, equipment_type, release_version, breadcrumb FROM refs")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(_meta(spark, sf_dir)).drop("n")


@query(f"""
    WITH {_META}, {_REFS}
    SELECT query_id, string_agg('[' || source_id || '] ' || title || ' | file=' || source_file || ' | url=' || coalesce(nullif(url, ''), source_file) || CASE WHEN equipment_type <> '' THEN ' | equipment=' || equipment_type ELSE '' END
           || CASE WHEN release_version <> '' THEN ' | release=' || release_version ELSE '' END || CASE WHEN breadcrumb <> '' THEN ' | section=' || breadcrumb ELSE '' END, chr(10) ORDER BY n) AS sources
    FROM refs WHERE db_source = 'docs' GROUP BY 1""")
def rendered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _meta(spark, sf_dir)
    return context.rendered_sources(context.references(meta.filter(F.col("db_source") == "docs"), "D"))


def _unknown(c: str, default: str = "Unknown") -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


_PAGE_BLOCK = f"""'[' || {_unknown('equipment_type')} || ' | Release: ' || {_unknown('release_version')} || ' | Page: ' || {_unknown('page_title')} || ' | Файл: ' || {_unknown('source_file')} || ' | Раздел: ' || {_unknown('breadcrumb_raw', 'No section')} || ' | URL: ' || url || ']' || chr(10) || {trim_sql('page_content', 1800)}"""
_TICKET_BLOCK = f"""'[TICKET | id: ' || {_unknown('source_file')} || ' | file: ' || {_unknown('source_file')} || ' | url: ' || url || ']' || chr(10) || {trim_sql('page_content', 1200)}"""


@query(f"""
    WITH {_META},
         dc AS (SELECT query_id, string_agg({_PAGE_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS c FROM meta WHERE db_source = 'docs' GROUP BY 1),
         tc AS (SELECT query_id, string_agg({_TICKET_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS c FROM meta WHERE db_source = 'tickets' GROUP BY 1)
    SELECT item_id AS query_id, coalesce({trim_sql('dc.c', 5200)}, '') AS docs_context, coalesce({trim_sql('tc.c', 2600)}, '') AS tickets_context
    FROM eval_items e LEFT JOIN dc ON dc.query_id = item_id LEFT JOIN tc ON tc.query_id = item_id""")
def support_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both sources searched, reranked, joined to parents and laid out within their budgets."""
    return _contexts(spark, sf_dir, materialise(_meta(spark, sf_dir), "found")).drop("text")


def _contexts(spark, d, meta: DataFrame) -> DataFrame:
    docs = context.context_of_pages(meta.filter(F.col("db_source") == "docs"), BUDGETS).withColumnRenamed("context", "docs_context")
    tickets = context.context_of_tickets(meta.filter(F.col("db_source") == "tickets"), BUDGETS).withColumnRenamed("context", "tickets_context")
    out = _items(spark, d).join(docs, "query_id", "left").join(tickets, "query_id", "left")
    return out.select("query_id", "text", F.coalesce("docs_context", F.lit("")).alias("docs_context"), F.coalesce("tickets_context", F.lit("")).alias("tickets_context"))


def _answers(spark, d) -> DataFrame:
    meta = materialise(_meta(spark, d), "found")
    return answers.answered(_contexts(spark, d, meta), _references(meta), ExtractiveGenerator())


_ANSWERED = f"""{_META}, {_REFS},
         dc AS (SELECT query_id, {trim_sql(f'string_agg({_PAGE_BLOCK}, chr(10) || chr(10) ORDER BY pos)', 5200)} AS c FROM meta WHERE db_source = 'docs' GROUP BY 1),
         said AS (SELECT item_id AS query_id, question, regexp_replace(split_part(coalesce(c, ''), chr(10), 1), '^\\s+|\\s+$', '', 'g') AS line FROM eval_items LEFT JOIN dc ON dc.query_id = item_id),
         n AS (SELECT query_id, count(*) FILTER (db_source = 'docs') AS n_docs, count(*) FILTER (db_source = 'tickets') AS n_tickets FROM refs GROUP BY 1)"""


@query(f"""WITH {_ANSWERED} SELECT query_id, true AS ok, line AS docs_answer, CASE WHEN line <> '' THEN 'high' ELSE 'low' END AS confidence, CAST(coalesce(n_docs, 0) AS BIGINT) AS n_doc_sources, CAST(coalesce(n_tickets, 0) AS BIGINT) AS n_ticket_sources
    FROM said LEFT JOIN n USING (query_id)""")
def answered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, context, generator, structured answer and its sources replaced by the references, for every item."""
    size = lambda c: F.size(c).cast("bigint")
    return _answers(spark, sf_dir).select("query_id", "ok", "docs_answer", "confidence", size("doc_sources").alias("n_doc_sources"), size("ticket_sources").alias("n_ticket_sources"))


@query(f"""WITH {_ANSWERED} SELECT query_id, question AS query, CAST(coalesce(n_docs, 0) + coalesce(n_tickets, 0) AS INTEGER) AS n_docs_retrieved, 'question' AS user_intent, CAST(NULL AS VARCHAR) AS error FROM said LEFT JOIN n USING (query_id)""")
def answer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.audit_rows(_answers(spark, sf_dir)).select("query_id", "query", "n_docs_retrieved", "user_intent", "error")
