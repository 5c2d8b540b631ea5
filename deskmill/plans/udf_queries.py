"""Queries of operators that SQL can't express: checked by tests, by rows only in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.models import EchoGenerator, HashEmbedder, embed
from deskmill.operators import answers, markdown
from deskmill.operators import retrieve as R
from deskmill.operators import tickets as K
from deskmill.plans.text_queries import comments, rag, requests, tickets
from deskmill.sources import markup
from deskmill.session import table


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.chunks(rag(spark, sf_dir), "parent_id", "page_content")


def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-up comments read as pages."""
    rows = comments(spark, sf_dir).filter(F.contains("text", F.lit("<"))).select(F.lit("portal_html").alias("source_type"), F.col("comment_id").cast("string").alias("path"), F.concat(F.col("comment_id").cast("string"), F.lit(".htm")).alias("name"), F.col("text").cast("binary").alias("content"))
    return markup.documents(rows).select("doc_id", "source_file", "page_title", "breadcrumb_raw", "page_content")


def embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests embedded by the default embedder; those with an id divisible by 100 search all."""
    rows = requests(spark, sf_dir).select(F.col("request_id").alias("doc_id"), embed(F.col("text"), HashEmbedder()).alias("embedding"))
    return R.dense(rows, rows.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 5)


def ticket_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = K.prompt_window(tickets(spark, sf_dir), comments(spark, sf_dir), table(spark, sf_dir, "equipment_map"))
    return answers.ticket_enrichment(window, EchoGenerator()).select("ticket_id", "ok", F.size("symptoms").alias("n_symptoms"))


QUERIES = {f.__name__: f for f in (chunk_markdown, html_documents, embed_search, ticket_enrichment)}
SQL: dict[str, str] = {}
