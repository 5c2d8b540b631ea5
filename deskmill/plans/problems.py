"""Queries of the core training-data problem: nested records to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deskmill.operators import nested
from deskmill.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = nested.flatten(table(spark, sf_dir, "ticket_files"), with_payload=False)
    return nodes.select("file_id", "kind", "node_id", "parent_id")


def p6_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(table(spark, sf_dir, "ticket_files"))["comment"]


def p6_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(table(spark, sf_dir, "ticket_files"))["reply"]


def p6_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tables(table(spark, sf_dir, "ticket_files"))["attachment"]


QUERIES = {f.__name__: f for f in (p6_found, p6_comments, p6_replies, p6_attachments)}
SQL: dict[str, str] = {}
