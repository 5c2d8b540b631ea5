"""Queries of ticket, join and ingest operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.config import Eligibility
from deskmill.functions import text as T
from deskmill.operators import ingest
from deskmill.operators import tickets as K
from deskmill.operators.common import latest, numbered, top_k
from deskmill.plans.text_queries import COMMENTS, REQUESTS, TICKETS, comments, html_sql, mask_sql, rag, requests, strip_sql, tickets
from deskmill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RULES = Eligibility(statuses=("Закрыто", "Решено", "CLOSED", "Solved"), excluded_equipment=("r03", "r08"), excluded_assignees=("u-0007",))
_NOISE = "(?i)" + T.NOISE.removeprefix("(?iu)")
_LABEL = "CASE author_role WHEN 'Client' THEN '👤 [КЛИЕНТ]' WHEN 'Engineer' THEN '🛠️ [ИНЖЕНЕР]' ELSE '💬 [СООБЩЕНИЕ]' END"
_CLEAN = f"""clean AS (SELECT *, {_LABEL} || ': ' || {mask_sql('c')} AS line FROM (SELECT *, {html_sql('text')} AS c FROM {COMMENTS}) WHERE NOT (regexp_matches(c, '{_NOISE}') OR length(c) <= 10))"""
_TURNS = "turns AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY cmf_created_at NULLS FIRST, comment_id) AS turn FROM clean WHERE ticket_id IS NOT NULL)"
_THREADS = "threads AS (SELECT ticket_id, (turn - 1) // 200 AS part_no, count(*) AS n_comments, string_agg(line, chr(10) || '---' || chr(10) ORDER BY turn) AS thread FROM turns GROUP BY ALL)"
_DESCRIBED = f"""described AS (
    SELECT t.ticket_id, {html_sql("coalesce(nullif(t.name, ''), t.ticket_id)")} AS title, {html_sql("coalesce(nullif(t.text, ''), t.description)")} AS description, {html_sql('t.resolution')} AS resolution,
           upper(left(s, 1)) || lower(substring(s, 2)) AS status, coalesce(m.equipment_name, 'General') AS equipment_type, coalesce(nullif(cf_kategoriya_or_name, ''), 'Без категории') AS category
    FROM (SELECT *, coalesce(nullif(cache_status_type, ''), 'Unknown') AS s FROM {TICKETS}) t LEFT JOIN equipment_map m ON m.code = t.cf_tip_oborud_reg)"""
_HEAD = f"'{K.PREFIX}' || chr(10) || '[ТИКЕТ: ' || ticket_id || '] [' || equipment_type || ']'"


@query(f"WITH {_CLEAN} SELECT comment_id, line FROM clean")
def ticket_comments_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_comments(comments(spark, sf_dir)).select("comment_id", "line")


@query(f"WITH {_CLEAN}, {_TURNS}, {_THREADS} SELECT ticket_id, CAST(part_no AS BIGINT) AS part_no, n_comments, thread FROM threads")
def ticket_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.threads(comments(spark, sf_dir))


@query(f"""
    WITH {_CLEAN}, {_TURNS}, {_THREADS}, {_DESCRIBED}
    SELECT ticket_id, CAST(coalesce(part_no, 0) AS BIGINT) AS part_no, title, equipment_type, status, {strip_sql(f"CASE WHEN coalesce(part_no, 0) = 0 THEN concat_ws(chr(10), {_HEAD}, '[ТИП: ' || category || '] | [СТАТУС: ' || status || ']', 'ТЕМА: ' || title || chr(10), CASE WHEN description <> '' THEN 'ОПИСАНИЕ:' || chr(10) || description || chr(10) END, CASE WHEN thread <> '' THEN 'ПЕРЕПИСКА:' || chr(10) || thread END, CASE WHEN resolution <> '' THEN chr(10) || 'ИТОГОВОЕ РЕШЕНИЕ:' || chr(10) || resolution END) ELSE concat_ws(chr(10), {_HEAD}, 'ПЕРЕПИСКА:' || chr(10) || thread) END")} AS page_content
    FROM described LEFT JOIN threads USING (ticket_id)""")
def ticket_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cards(tickets(spark, sf_dir), comments(spark, sf_dir), table(spark, sf_dir, "equipment_map"))


@query(f"""
    WITH {_CLEAN}, {_DESCRIBED}
    SELECT ticket_id, {strip_sql(f"concat_ws(chr(10), {_HEAD}, 'ТЕМА: ' || title || chr(10), 'ПРОБЛЕМА:' || chr(10) || substring(description, 1, 500) || chr(10) || chr(10) || 'РЕШЕНИЕ:' || chr(10) || resolution)")} AS page_content
    FROM described WHERE (description <> '' OR ticket_id IN (SELECT ticket_id FROM clean WHERE ticket_id IS NOT NULL)) AND upper(status) IN ('ЗАКРЫТО', 'РЕШЕНО', 'CLOSED', 'SOLVED')""")
def ticket_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.facts(tickets(spark, sf_dir), comments(spark, sf_dir), table(spark, sf_dir, "equipment_map"))


@query(f"""
    WITH {_CLEAN}, {_TURNS}, {_DESCRIBED}, talk AS (SELECT ticket_id, string_agg(line, chr(10) ORDER BY turn) AS c FROM turns WHERE turn <= 15 GROUP BY 1)
    SELECT ticket_id, substring(description, 1, 1000) AS description, coalesce(c, '') AS comments FROM described LEFT JOIN talk USING (ticket_id)""")
def ticket_llm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.prompt_window(tickets(spark, sf_dir), comments(spark, sf_dir), table(spark, sf_dir, "equipment_map"))


@query(f"""
    SELECT ticket_id FROM {TICKETS} WHERE cmf_created_at >= TIMESTAMP '2022-01-01' AND cache_status_type IN ('Закрыто', 'Решено', 'CLOSED', 'Solved')
      AND (cf_tip_oborud_reg NOT IN ('r03', 'r08') OR cf_tip_oborud_reg IS NULL) AND (cmf_owner_id <> 'u-0007' OR cmf_owner_id IS NULL)""")
def eligibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.eligible(tickets(spark, sf_dir), RULES, assignee="cmf_owner_id").select("ticket_id")


@query(f"SELECT DISTINCT upper({strip_sql('ticket_id')}) AS code FROM ticket_requests WHERE contains(upper(ticket_id), 'RL-')")
def requested_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.codes(table(spark, sf_dir, "ticket_requests"), "ticket_id")


@query(f"SELECT ticket_id FROM {TICKETS} t WHERE EXISTS (SELECT 1 FROM ticket_requests r WHERE r.ticket_id = t.ticket_id)")
def semi_requested_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).join(table(spark, sf_dir, "ticket_requests").select("ticket_id"), "ticket_id", "left_semi").select("ticket_id")


@query(f"SELECT ticket_id FROM {TICKETS} t WHERE NOT EXISTS (SELECT 1 FROM ticket_comments c WHERE c.ticket_id = t.ticket_id)")
def anti_silent_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).join(table(spark, sf_dir, "ticket_comments").select("ticket_id"), "ticket_id", "left_anti").select("ticket_id")


@query(f"""
    SELECT comment_id, CASE WHEN t.cmf_owner_id IS NOT NULL AND c.cmf_owner_id = t.cmf_owner_id THEN 'Client' WHEN t.cmf_owner_id IS NULL THEN 'Unknown' ELSE 'Engineer' END AS role
    FROM {COMMENTS} c JOIN {TICKETS} t USING (ticket_id)""")
def author_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.author_roles(comments(spark, sf_dir), tickets(spark, sf_dir)).select("comment_id", "role")


@query(f"SELECT ticket_id, coalesce(equipment_name, 'General') AS equipment, coalesce(nullif(cf_kategoriya_or_name, ''), cf_kategoriya_or, 'Без категории') AS category FROM {TICKETS} LEFT JOIN equipment_map ON code = cf_tip_oborud_reg")
def code_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "equipment_map").withColumnRenamed("code", "cf_tip_oborud_reg")
    rows = tickets(spark, sf_dir).join(names, "cf_tip_oborud_reg", "left")
    return rows.select("ticket_id", F.coalesce("equipment_name", F.lit("General")).alias("equipment"), F.coalesce(F.nullif("cf_kategoriya_or_name", F.lit("")), "cf_kategoriya_or", F.lit(K.DEFAULT_CATEGORY)).alias("category"))


@query("SELECT ticket_id, arg_max(pair_id, (created_at, pair_id)) AS pair_id FROM similar_tickets WHERE ticket_id IS NOT NULL GROUP BY 1")
def internal_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code to internal id; of several the last one wins."""
    rows = table(spark, sf_dir, "similar_tickets").filter(F.col("ticket_id").isNotNull())
    return rows.groupBy("ticket_id").agg(F.max_by("pair_id", F.struct("created_at", "pair_id")).alias("pair_id"))


@query(f"""
    SELECT ticket_id, text FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY cmf_created_at DESC NULLS LAST, comment_id DESC) AS n FROM {COMMENTS} WHERE author_role = 'Client' AND ticket_id IS NOT NULL AND length({strip_sql("coalesce(text, '')")}) > 0) WHERE n = 1""")
def last_client_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = comments(spark, sf_dir).filter((F.col("author_role") == "Client") & F.col("ticket_id").isNotNull() & T.present("text"))
    return top_k(said, ["ticket_id"], [F.desc_nulls_last("cmf_created_at"), F.desc("comment_id")], 1, "n").select("ticket_id", "text")


@query(f"""
    SELECT comment_id, CAST(row_number() OVER (PARTITION BY ticket_id ORDER BY cmf_created_at NULLS FIRST, comment_id) AS BIGINT) AS turn FROM {COMMENTS}""")
def comment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(comments(spark, sf_dir), "ticket_id", "cmf_created_at", "comment_id").select("comment_id", "turn")


# Two crawls: the registry of the first, up to a day, and the files of the second, from a day on and stored stripped.
_OLD = "(SELECT source AS source_type, CAST(doc_id AS VARCHAR) AS path, md5(coalesce(text, '')) AS hash FROM documents WHERE loaded_at < TIMESTAMP '2024-07-01')"
_NEW = f"(SELECT source AS source_type, CAST(doc_id AS VARCHAR) AS path, md5(coalesce({strip_sql('text')}, '')) AS hash FROM documents WHERE loaded_at >= TIMESTAMP '2023-01-01')"


def _crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")).withColumn("source_type", F.col("source"))
    old = ingest.hashed(docs.filter(F.col("loaded_at") < F.lit("2024-07-01").cast("timestamp")), "text")
    new = ingest.hashed(docs.filter(F.col("loaded_at") >= F.lit("2023-01-01").cast("timestamp")).withColumn("text", T.strip("text")), "text")
    return old, new


@query(f"""
    SELECT source_type, path, f.hash, r.hash AS old_hash, CASE WHEN r.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN f.hash IS NOT DISTINCT FROM r.hash THEN 'same' ELSE 'changed' END AS state
    FROM {_NEW} f FULL JOIN {_OLD} r USING (source_type, path)""")
def ingest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    return ingest.diff(new, old)


@query(f"""
    WITH n AS (SELECT (SELECT count(*) FROM {_NEW}) AS n_expected, (SELECT count(*) FROM {_OLD}) AS n_actual)
    SELECT n_expected, n_actual, n_actual >= n_expected * 0.95 AS complete FROM n""")
def index_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _crawls(spark, sf_dir)
    return ingest.completeness(new, old)


@query("SELECT parent_id, source_file FROM (SELECT DISTINCT parent_id, source_file FROM rag_docs) WHERE NOT (starts_with(source_file, '~$') OR suffix(source_file, '_print.htm'))")
def ingestible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingestible(table(spark, sf_dir, "rag_docs").select("parent_id", "source_file").distinct(), "source_file")


@query("""
    SELECT parent_id, format FROM (SELECT parent_id, format, row_number() OVER (PARTITION BY format ORDER BY parent_id) AS n FROM (SELECT DISTINCT parent_id, format FROM rag_docs WHERE format IN ('html', 'docx'))) WHERE n = 1""")
def sample_per_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rag_docs").filter(F.col("format").isin("html", "docx")).select("parent_id", "format").distinct()
    return top_k(rows, ["format"], [F.asc("parent_id")], 1, "n").drop("n")


@query(f"""
    WITH {_DESCRIBED}
    SELECT request_id, r.ticket_id, d.title, d.equipment_type, d.category, d.status, CAST(coalesce(length(r.text), 0) AS BIGINT) AS text_length, CASE WHEN length(r.text) > 500 THEN substring(r.text, 1, 500) || '...' ELSE r.text END AS preview
    FROM {REQUESTS} r LEFT JOIN described d USING (ticket_id)""")
def request_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.described(tickets(spark, sf_dir), table(spark, sf_dir, "equipment_map")).select("ticket_id", "title", "equipment_type", "category", "status")
    rows = requests(spark, sf_dir).join(d, "ticket_id", "left")
    return rows.select("request_id", "ticket_id", "title", "equipment_type", "category", "status", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("text_length"), T.preview("text").alias("preview"))


@query("""
    SELECT source_type, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT source_file) AS BIGINT) AS n_files FROM (SELECT DISTINCT parent_id, source_type, source_file FROM rag_docs) GROUP BY 1""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n_docs"), F.countDistinct("source_file").alias("n_files"))


@query("SELECT user_id, user_role, company_code FROM portal_users u WHERE EXISTS (SELECT 1 FROM ticket_comments c WHERE c.cmf_owner_id = u.user_id)")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "portal_users")
    return users.join(latest(table(spark, sf_dir, "ticket_comments"), "comment_id", "loaded_at").select(F.col("cmf_owner_id").alias("user_id")), "user_id", "left_semi").select("user_id", "user_role", "company_code")
