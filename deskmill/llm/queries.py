"""Queries of the training-text problems, each over its whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import leak, mail, neardup, pairs, pii, sentences, split, tokens
from deskmill.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.oversized(table(spark, sf_dir, "rag_docs"), table(spark, sf_dir, "split_limits"), "parent_id", "page_content", "source_type")
    return found.select(F.col("id").alias("parent_id"), "kind")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split(table(spark, sf_dir, "rag_docs"), table(spark, sf_dir, "split_limits"), "parent_id", "page_content", "source_type")
    return split.distinct_pieces(pieces).withColumnRenamed("id", "parent_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "rag_docs").select(F.lit("page").alias("src"), F.col("parent_id").alias("id"), F.col("page_content").alias("text"))
    problems = table(spark, sf_dir, "similar_tickets").select(F.lit("problem").alias("src"), F.col("pair_id").alias("id"), F.col("problem_summary").alias("text"))
    return pages.unionByName(problems)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.record_pairs(_records(spark, sf_dir), k=3, threshold=0.5)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class at the usual setting: five words, similarity of 0.8."""
    return neardup.classes(_records(spark, sf_dir))


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comments, requests and the names that both teach."""
    comments, requests = table(spark, sf_dir, "ticket_comments"), table(spark, sf_dir, "ticket_requests")
    return comments, requests, materialise(pii.learnt_names(comments.select("text").unionByName(requests.select("text"))), "names")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments, requests, names = _notes(spark, sf_dir)
    of_comments = pii.types_found(comments, "comment_id", "text", names).select(F.lit("comment").alias("src"), "rec_id", "pii_type")
    return of_comments.unionByName(pii.types_found(requests, "request_id", "text", names).select(F.lit("request").alias("src"), "rec_id", "pii_type"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments, requests, names = _notes(spark, sf_dir)
    of_comments = pii.masked(comments, "comment_id", "text", "loaded_at", names).select(F.lit("comment").alias("src"), "rec_id", "masked_text")
    return of_comments.unionByName(pii.masked(requests, "request_id", "text", "loaded_at", names).select(F.lit("request").alias("src"), "rec_id", "masked_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "similar_tickets"))


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pairs of each defect."""
    return pairs.defects(table(spark, sf_dir, "similar_tickets")).groupBy("defect").agg(F.count("*").alias("n_pairs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.marked_lines(table(spark, sf_dir, "ticket_comments"), "comment_id", "text").select(F.col("id").alias("comment_id"), "line_no")


def p5_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.reduced(table(spark, sf_dir, "ticket_comments"), "comment_id", "text", "loaded_at").withColumnRenamed("id", "comment_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids per code point by language as labelled."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("?")).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    both = tokens.encode(docs).select("doc_id", F.size("ids").alias("n")).join(sizes, "doc_id")
    return both.groupBy("lang").agg(F.sum("n").alias("ids"), F.sum("chars").alias("chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each item leaked into and its longest leaked passage."""
    found = leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents")).select("doc_id", "end_pos")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each kind and their lengths, by language as labelled."""
    docs = table(spark, sf_dir, "documents")
    units = sentences.sentences(docs).join(docs.select("doc_id", F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("?")).alias("lang")), "doc_id")
    return units.groupBy("lang", "kind").agg(F.count("*").alias("units"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p3_found, p3_masked, p4_found, p4_profile, p5_found, p5_new_text, p7_ids, p7_fertility, p8_found, p8_report, p9_found, p9_profile)}

SQL = {
    "p1_found": r"""
        SELECT DISTINCT r.parent_id,
               CASE WHEN list_max(list_transform(regexp_split_to_array(r.page_content, '[\s\x0b\x1c-\x1f\x{85}\p{Z}。！？]'), lambda x: length(x))) > l.max_chars
                    THEN 'hard' ELSE 'soft' END AS kind
        FROM rag_docs r JOIN split_limits l USING (source_type)
        WHERE length(r.page_content) > l.max_chars
    """,
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(regexp_replace(text, '</?[A-Za-z][A-Za-z0-9]*(\s[^<>]*)?/?>', ' ', 'g')), 'ё', 'е'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
             e AS (SELECT item_id, regexp_extract_all(replace(lower(regexp_replace(question, '</?[A-Za-z][A-Za-z0-9]*(\s[^<>]*)?/?>', ' ', 'g')), 'ё', 'е'), '[\p{L}\p{N}]+') AS w FROM eval_items),
             dg AS (SELECT DISTINCT doc_id, w[p:p + 12] AS g FROM d, unnest(range(1, len(w) - 11)) AS t(p) WHERE len(w) >= 13),
             eg AS (SELECT DISTINCT item_id, w[p:p + 12] AS g FROM e, unnest(range(1, len(w) - 11)) AS t(p) WHERE len(w) >= 13)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
    """,
    "p2_found": r"""
        WITH r AS (SELECT DISTINCT 'page' AS src, parent_id AS id, page_content AS t FROM rag_docs
                   UNION SELECT 'problem', pair_id, problem_summary FROM similar_tickets),
             w AS (SELECT src, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM r WHERE t IS NOT NULL),
             s AS (SELECT DISTINCT src, id, w[p:p + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS t(p) WHERE len(w) >= 3),
             n AS (SELECT src, id, count(*) AS n FROM s GROUP BY ALL),
             c AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.src = b.src AND a.g = b.g AND a.id < b.id GROUP BY ALL)
        SELECT c.src, id_a, id_b FROM c JOIN n x ON x.src = c.src AND x.id = id_a JOIN n y ON y.src = c.src AND y.id = id_b
        WHERE 2 * c >= x.n + y.n - c
    """,
}
