"""Queries of the text, chunk and field operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.functions import vectors as V
from deskmill.operators import chunking, context
from deskmill.operators.common import latest
from deskmill.session import table

WS = T.WS
RAG = "(SELECT * FROM rag_docs QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY ingested_at DESC) = 1)"
TICKETS = "(SELECT * FROM tickets QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY loaded_at DESC) = 1)"
COMMENTS = "(SELECT * FROM ticket_comments QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY loaded_at DESC) = 1)"
REQUESTS = "(SELECT * FROM ticket_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC) = 1)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def html_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')")


def mask_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '{T.FULL_NAME}', '\1[ФИО СКРЫТО]\2', 'g')"
    x = f"regexp_replace({x}, '{T.MAIL}', '[EMAIL]', 'g')"
    x = rf"regexp_replace({x}, '{T.PHONE}', '\1[ТЕЛЕФОН]\2', 'g')"
    return f"regexp_replace({x}, '(?i)(?:{'|'.join(T.COURTESY)})', '', 'g')"


def trim_sql(x: str, most: int) -> str:
    head = f"substring({x}, 1, {most})"
    lines = strip_sql(rf"regexp_replace({head}, '(?s)\n[^\n]*\z', '')")
    mark = "chr(10) || chr(10) || '[...контекст обрезан из-за лимита размера запроса...]'"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE CASE WHEN length({lines}) > 0 THEN {lines} ELSE {strip_sql(head)} END || {mark} END"


def rag(spark, d, only=None):
    """The last delivery of each page; of the pages in ``only`` (parent_id) where given, chosen before any text moves."""
    pages = table(spark, d, "rag_docs")
    return latest(pages if only is None else pages.join(only, "parent_id", "left_semi"), "parent_id", "ingested_at")


def comments(spark, d):
    return latest(table(spark, d, "ticket_comments"), "comment_id", "loaded_at")


def tickets(spark, d):
    return latest(table(spark, d, "tickets"), "ticket_id", "loaded_at")


def requests(spark, d):
    return latest(table(spark, d, "ticket_requests"), "request_id", "loaded_at")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
    SELECT parent_id AS doc_id, CAST(p // 350 AS BIGINT) AS ord, substring(page_content, p + 1, 400) AS text
    FROM {RAG}, unnest(range(0, greatest(length(page_content) - 51, 0) + 1, 350)) AS t(p) WHERE length(page_content) > 0""")
def chunk_fixed_400_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(rag(spark, sf_dir), "parent_id", "page_content")


@query(f"""
    SELECT parent_id, 'Document: ' || page_content
        || CASE WHEN coalesce(page_title, '') <> '' AND NOT contains(page_content, '[ПОТЕНЦИАЛЬНЫЕ ВОПРОСЫ:') THEN chr(10) || chr(10) || '[ПОТЕНЦИАЛЬНЫЕ ВОПРОСЫ: ' || page_title || ']' ELSE '' END
        || CASE WHEN coalesce(keywords, '') <> '' AND NOT contains(page_content, '[КЛЮЧЕВЫЕ СЛОВА:') THEN chr(10) || '[КЛЮЧЕВЫЕ СЛОВА: ' || keywords || ']' ELSE '' END AS text
    FROM {RAG}""")
def chunk_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles stand in for generated questions."""
    return rag(spark, sf_dir).select("parent_id", chunking.enrich("page_content", "page_title", "keywords").alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 3000) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 3000) ELSE text END AS text FROM documents")
def monster_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.guard_monster("text").alias("text"))


@query(f"SELECT parent_id, {trim_sql('page_content', 1200)} AS text FROM {RAG}")
def trim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag(spark, sf_dir).select("parent_id", T.trim_text("page_content", 1200).alias("text"))


@query(f"SELECT comment_id, {html_sql('text')} AS text FROM {COMMENTS}")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select("comment_id", T.strip_html("text").alias("text"))


@query(f"SELECT comment_id, {mask_sql('text')} AS text FROM {COMMENTS}")
def contact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select("comment_id", T.mask_contacts("text").alias("text"))


@query(rf"""
    SELECT file_id, coalesce(nullif(regexp_extract(file_name, '\[([A-Z]+-\d+)\]', 1), ''), 'UNKNOWN') AS ticket_id,
           substring(regexp_replace(file_name, '[<>:"/\\|?*]', '_', 'g'), 1, 60) AS safe_name,
           CASE WHEN length(payload) > 300 THEN replace(substring(payload, 1, 300), chr(10), ' ⏎ ') || '...' ELSE replace(substring(payload, 1, 300), chr(10), ' ⏎ ') END AS preview,
           replace(replace(replace(replace(replace(file_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>') AS html
    FROM ticket_files""")
def file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "ticket_files")
    return files.select("file_id", T.ticket_id("file_name").alias("ticket_id"), T.safe_file_name("file_name").alias("safe_name"), T.preview("payload", 300, " ⏎ ").alias("preview"), T.escape_html("file_name").alias("html"))


# Cascades over file names and titles: the rules are parameters, these are for the test tables' invented products.
def _equipment_rules():
    name = F.lower(F.coalesce("source_file", F.lit("")))
    return [(F.contains(name, F.lit("ux")), "Ux"), (F.contains(name, F.lit("rixs")) | F.contains(name, F.lit("safety")), "RixS"), (F.contains(name, F.lit("rix")), "Rix"), (F.contains(name, F.lit("ide")), "Ide"), (F.col("source_type") == "library_html", "Library")]


@query(f"""
    SELECT parent_id,
           CASE WHEN contains(lower(coalesce(source_file, '')), 'ux') THEN 'Ux' WHEN contains(lower(coalesce(source_file, '')), 'rixs') OR contains(lower(coalesce(source_file, '')), 'safety') THEN 'RixS'
                WHEN contains(lower(coalesce(source_file, '')), 'rix') THEN 'Rix' WHEN contains(lower(coalesce(source_file, '')), 'ide') THEN 'Ide' WHEN source_type = 'library_html' THEN 'Library' ELSE 'General' END AS equipment,
           CASE WHEN contains(lower(coalesce(source_file, '')), 'mar') OR contains(upper(substring(coalesce(breadcrumb_raw, ''), 1, 2000)), 'BEL') THEN 'Mar'
                WHEN contains(upper(substring(coalesce(breadcrumb_raw, ''), 1, 2000)), 'ZAN') THEN 'Zan' ELSE 'Универсальная' END AS library
    FROM {RAG}""")
def detect_equipment_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, crumbs = F.lower(F.coalesce("source_file", F.lit(""))), F.upper(F.substring(F.coalesce("breadcrumb_raw", F.lit("")), 1, 2000))
    library = T.first_match([(F.contains(name, F.lit("mar")) | F.contains(crumbs, F.lit("BEL")), "Mar"), (F.contains(crumbs, F.lit("ZAN")), "Zan")], "Универсальная")
    return rag(spark, sf_dir).select("parent_id", T.first_match(_equipment_rules(), "General").alias("equipment"), library.alias("library"))


@query(rf"""
    SELECT parent_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(c, '(FB_[A-Z0-9_]+)', 1) || regexp_extract_all(c, '\|\s*([A-Z0-9_]+)\s*\|', 1) || regexp_extract_all(c, '([A-Z0-9_]+)\s*\|\s*[А-Я]', 1),
           lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Z]')))), ', ') AS blocks
    FROM (SELECT parent_id, coalesce(page_content, '') AS c FROM {RAG})""")
def function_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag(spark, sf_dir).select("parent_id", T.function_blocks("page_content").alias("blocks"))


@query(rf"""
    SELECT parent_id, regexp_replace(replace(replace(regexp_replace(page_content, '(?im)^(внимание|важно)!!!?', '> ⚠️ **\1:**', 'g'), chr(61530), '> ℹ️ **ИНФОРМАЦИЯ:**' || chr(10) || '> '), chr(61553), '> ⚠️ **ВНИМАНИЕ:**' || chr(10) || '> '), '\n{{3,}}', chr(10) || chr(10), 'g') AS text
    FROM {RAG}""")
def callout_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag(spark, sf_dir).select("parent_id", T.callouts("page_content").alias("text"))


@query(f"""
    SELECT parent_id, '[ОБОРУДОВАНИЕ: ' || coalesce(equipment_type, 'General') || ']' || chr(10) || '[РЕЛИЗ: ' || coalesce(release_version, 'Неизвестно') || ']' || chr(10) || '[РАЗДЕЛ: ' || coalesce(breadcrumb_raw, 'Документация') || ']' || chr(10)
           || '[ЗАГОЛОВОК: ' || coalesce(page_title, source_file) || ']' || chr(10) || chr(10) || page_content || CASE WHEN coalesce(keywords, '') <> '' THEN chr(10) || '[КЛЮЧЕВЫЕ СЛОВА: ' || keywords || ']' ELSE '' END AS text,
           CASE source_type WHEN 'product_html' THEN 'https://docs.example/p/' || source_file WHEN 'library_html' THEN 'https://docs.example/l/' || source_file ELSE '' END AS url
    FROM {RAG} WHERE length({strip_sql("coalesce(page_content, '')")}) >= 20""")
def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 20 or more characters with their header block, and their address by source type."""
    roots = spark.createDataFrame([("product_html", "https://docs.example/p///"), ("library_html", "https://docs.example/l")], "source_type STRING, root STRING")
    tag = lambda name, c, default: F.concat(F.lit(f"[{name}: "), F.coalesce(F.col(c), default), F.lit("]"))
    text = F.concat(
        tag("ОБОРУДОВАНИЕ", "equipment_type", F.lit("General")), F.lit("\n"), tag("РЕЛИЗ", "release_version", F.lit("Неизвестно")), F.lit("\n"), tag("РАЗДЕЛ", "breadcrumb_raw", F.lit("Документация")), F.lit("\n"),
        tag("ЗАГОЛОВОК", "page_title", F.col("source_file")), F.lit("\n\n"), F.col("page_content"), F.when(F.coalesce("keywords", F.lit("")) != "", F.concat(F.lit("\n[КЛЮЧЕВЫЕ СЛОВА: "), F.col("keywords"), F.lit("]"))).otherwise(""),
    )
    docs = rag(spark, sf_dir).filter(F.length(T.strip(F.coalesce("page_content", F.lit("")))) >= 20).join(roots, "source_type", "left")
    return docs.withColumn("direct", F.lit("")).select("parent_id", text.alias("text"), context.source_url("direct", "source_file", "root").alias("url"))


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(coalesce({0}, '')), chr(9), ' '), 'ё', 'е'), '(^|\n)\s*[-•]?\s*[а-яa-z]\)\s*', '\1', 'g'), '(?m)^[\s•-]+', '', 'g'), '\s+', ' ', 'g'), '[«»"''`.,;:!?()\[\]{{}}]', '', 'g'))"""
_PARTS = r"list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[ \t\r-]+|[ \t\r-]+$', '', 'g'), '(?i)^\s*[-•]?\s*[а-яa-z]\)\s*', '')), lambda x: x <> '')"
_LETTERS = r"list_sort(list_distinct(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '(?m)^\s*[-•]?\s*([а-яa-z])\)', 1)))"


@query(f"""
    SELECT item_id, {_NORM.format('options')} AS normalized, array_to_string({_LETTERS.format('options')}, ',') AS letters, CAST(len({_PARTS.format('options')}) AS BIGINT) AS n_parts, array_to_string({_PARTS.format('options')}, '|') AS parts,
           {_LETTERS.format('options')} = {_LETTERS.format('correct_answer')} AS same_letters
    FROM eval_items""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    parts = T.reference_parts("options")
    return items.select("item_id", T.normalize_answer("options").alias("normalized"), F.array_join(T.option_letters("options"), ",").alias("letters"), F.size(parts).cast("bigint").alias("n_parts"), F.array_join(parts, "|").alias("parts"), (T.option_letters("options") == T.option_letters("correct_answer")).alias("same_letters"))


@query(f"""
    WITH m AS (SELECT pair_id, '<think>' || coalesce(relevance_reason, '') || chr(10) || '</think>```json' || chr(10) || 'КЛЮЧЕВЫЕ СЛОВА: ' || coalesce(source_file, '') || ' ' || chr(10) || 'вопросы:' || coalesce(problem_summary, '') || '```' AS raw
               FROM similar_tickets QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY created_at DESC) = 1),
         c AS (SELECT pair_id, {strip_sql("regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '```(?:json)?', '', 'g')")} AS t FROM m)
    SELECT pair_id, {strip_sql(r"regexp_extract(t, '(?i)КЛЮЧЕВЫЕ СЛОВА:\s*([^\n]*)', 1)")} AS keywords, {strip_sql(r"regexp_extract(t, '(?i)ВОПРОСЫ:\s*([^\n]*)', 1)")} AS questions,
           array_to_string(CASE WHEN coalesce(q, '') = '' THEN [k] ELSE list_filter(list_transform(regexp_split_to_array(q, '[|,;]'), lambda x: trim(x)), lambda x: length(x) > 10)[1:2] END, ' / ') AS picked
    FROM (SELECT *, {strip_sql(r"regexp_extract(t, '(?i)ВОПРОСЫ:\s*([^\n]*)', 1)")} AS q, {strip_sql(r"regexp_extract(t, '(?i)КЛЮЧЕВЫЕ СЛОВА:\s*([^\n]*)', 1)")} AS k FROM c)""")
def model_output_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts and fences stripped, labelled lines read and questions picked, from outputs put together from the pairs."""
    p = latest(table(spark, sf_dir, "similar_tickets"), "pair_id", "created_at")
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.concat(F.lit("<think>"), e("relevance_reason"), F.lit("\n</think>```json\nКЛЮЧЕВЫЕ СЛОВА: "), e("source_file"), F.lit(" \nвопросы:"), e("problem_summary"), F.lit("```"))
    rows = p.select("pair_id", T.strip_think(raw).alias("t")).select("pair_id", T.labelled_line("t", "КЛЮЧЕВЫЕ СЛОВА").alias("keywords"), T.labelled_line("t", "ВОПРОСЫ").alias("questions"))
    return rows.select("pair_id", "keywords", "questions", F.array_join(T.pick_questions("questions", "keywords"), " / ").alias("picked"))


@query(f"""
    SELECT request_id, CASE WHEN len(n) > 0 THEN 'Equipment: ' || array_to_string(n, ', ') || chr(10) || chr(10) || 'Ticket text:' || chr(10) || {strip_sql('text')} ELSE {strip_sql('text')} END AS query,
           text IS NOT NULL AND length({strip_sql('text')}) > 0 AS valid
    FROM (SELECT *, list_filter(list_transform(equipment, lambda x: {strip_sql('x')}), lambda x: x <> '') AS n FROM {REQUESTS})""")
def request_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", context.ticket_query("text", "equipment").alias("query"), T.present("text").alias("valid"))


@query(f"""
    SELECT item_id, CASE WHEN options IS NOT NULL AND length({strip_sql('options')}) > 0 THEN {strip_sql('question')} || chr(10) || chr(10) || 'Варианты ответа:' || chr(10) || {strip_sql('options')} ELSE {strip_sql('question')} END AS prompt
    FROM eval_items""")
def quiz_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", context.quiz_prompt("question", "options").alias("prompt"))


@query("""
    SELECT vec_id, CAST(p AS BIGINT) AS pos, round(CASE WHEN n > 0 THEN embedding[p]::DOUBLE / n ELSE 0.0 END, 6) AS value
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), unnest(range(1, len(embedding) + 1)) AS t(p)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("v", 6).alias("value"))


@query(f"""
    SELECT pair_id, CASE WHEN length(solution_summary) >= 50 THEN solution_summary ELSE problem_summary END AS search_text, coalesce(length(solution_summary) >= 50, false) AS used
    FROM similar_tickets QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY created_at DESC) = 1""")
def hyde_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deskmill.models import hypothetical

    text, used = hypothetical(F.col("problem_summary"), F.col("solution_summary"))
    return latest(table(spark, sf_dir, "similar_tickets"), "pair_id", "created_at").select("pair_id", text.alias("search_text"), used.alias("used"))


@query(f"SELECT comment_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM {COMMENTS}")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select("comment_id", T.word_count("text").alias("n_words"))
