"""Evaluation, resume, report and audit queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.functions import vectors as V
from deskmill.operators import analyze, context, evaluate
from deskmill.operators.common import latest, top_k
from deskmill.plans.text_queries import _LETTERS, _NORM, _PARTS, COMMENTS, comments, rag, strip_sql
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


_PAIRS = "(SELECT * FROM similar_tickets QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY created_at DESC) = 1)"


def _pairs(spark, d):
    return latest(table(spark, d, "similar_tickets"), "pair_id", "created_at")


# Answers to judge: each quiz item's options answer it, by a rule on the item's number that gives every branch its share.
_ANSWERS = """answers AS (SELECT item_id, split_name AS file, correct_answer AS reference,
    CASE item_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Ответ. ERROR: timeout' WHEN 2 THEN correct_answer WHEN 3 THEN options WHEN 4 THEN substring(correct_answer, 4) WHEN 5 THEN 'Верно: ' || substring(correct_answer, 4) || ' единиц' WHEN 6 THEN question ELSE '  ' END AS answer,
    CASE item_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.82 ELSE 0.1 END::DOUBLE AS similarity FROM eval_items)"""


def _answers(spark, d):
    k = F.col("item_id") % 8
    bare = F.substring("correct_answer", 4, 1000)
    answer = F.when(k == 0, None).when(k == 1, F.lit("Ответ. ERROR: timeout")).when(k == 2, F.col("correct_answer")).when(k == 3, F.col("options")).when(k == 4, bare).when(k == 5, F.concat(F.lit("Верно: "), bare, F.lit(" единиц"))).when(k == 6, F.col("question")).otherwise(F.lit("  "))
    similarity = F.when(F.col("item_id") % 3 == 0, 0.9).when(F.col("item_id") % 3 == 1, 0.82).otherwise(0.1)
    return table(spark, d, "eval_items").select("item_id", F.col("split_name").alias("file"), F.col("correct_answer").alias("reference"), answer.alias("answer"), similarity.alias("similarity"))


_ERROR = " OR ".join(f"contains(answer, '{m}')" for m in T.ERROR_MARKERS)
_JUDGED = f"""{_ANSWERS},
    f AS (SELECT *, {_NORM.format('answer')} AS na, {_NORM.format('reference')} AS nr, {_LETTERS.format('answer')} AS la, {_LETTERS.format('reference')} AS lr, list_filter(list_transform({_PARTS.format('reference')}, lambda x: {_NORM.format('x')}), lambda x: x <> '') AS parts,
                 length({strip_sql("coalesce(answer, '')")}) > 0 AND length({strip_sql("coalesce(reference, '')")}) > 0 AS filled FROM answers),
    ruled AS (SELECT *, CASE WHEN NOT filled THEN 'blank' WHEN {_ERROR} THEN 'error' WHEN na <> '' AND nr <> '' AND len(la) > 0 AND len(lr) > 0 THEN 'letters' WHEN na <> '' AND nr <> '' AND len(parts) > 1 THEN 'parts'
                 WHEN na <> '' AND nr <> '' AND na = nr THEN 'equal' WHEN na <> '' AND nr <> '' AND contains(na, nr) THEN 'contained' WHEN similarity >= 0.82::DOUBLE THEN 'similar' ELSE 'none' END AS rule FROM f),
    judged AS (SELECT item_id, file, rule, CASE rule WHEN 'blank' THEN 'Пропуск' WHEN 'error' THEN 'Ошибка' WHEN 'letters' THEN CASE WHEN la = lr THEN 'Да' ELSE 'Нет' END
                 WHEN 'parts' THEN CASE WHEN len(list_filter(parts, lambda x: NOT contains(na, x))) = 0 THEN 'Да' ELSE 'Нет' END WHEN 'none' THEN 'Нет' ELSE 'Да' END AS verdict, round(similarity, 4) AS similarity FROM ruled)"""


@query(f"""
    WITH {_JUDGED} SELECT item_id, rule, verdict, CASE WHEN rule = 'blank' THEN NULL WHEN rule = 'error' THEN 0.0::DOUBLE WHEN rule IN ('similar', 'none') THEN similarity WHEN verdict = 'Да' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM judged""")
def eval_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cascade(_answers(spark, sf_dir), "answer", "reference", F.col("similarity")).select("item_id", "rule", "verdict", "score")


@query(f"""
    WITH {_JUDGED}, s AS (SELECT file, count(*) FILTER (verdict <> 'Пропуск') AS total, count(*) FILTER (verdict = 'Да') AS correct, count(*) FILTER (verdict = 'Нет') AS incorrect, count(*) FILTER (verdict = 'Ошибка') AS errors, count(*) FILTER (verdict = 'Пропуск') AS skipped, CAST(grouping(file) AS INT) AS all_files FROM judged GROUP BY ROLLUP (file))
    SELECT *, CASE WHEN total > 0 THEN round(correct / total * 100, 1) ELSE 0.0 END AS accuracy FROM s""")
def eval_accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.statistics(evaluate.cascade(_answers(spark, sf_dir), "answer", "reference", F.col("similarity")))


@query(f"WITH {_ANSWERS} SELECT item_id FROM answers WHERE item_id NOT IN (SELECT item_id FROM answers WHERE answer IS NOT NULL AND length({strip_sql('answer')}) > 0 AND NOT starts_with(answer, 'ОШИБКА:'))")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return evaluate.pending(a.select("item_id"), a.select("item_id", "answer"), "item_id", "answer")


@query("SELECT item_id, split_name FROM (SELECT *, row_number() OVER (PARTITION BY split_name ORDER BY item_id) AS n FROM eval_items) WHERE n <= 20")
def questions_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 questions of each file: the limit of an autotest run."""
    return top_k(table(spark, sf_dir, "eval_items"), ["split_name"], [F.asc("item_id")], 20, "n").select("item_id", "split_name")


_CONFLICTS = f"""c AS (SELECT pair_id, CASE WHEN relevance_reason IS NULL THEN [] WHEN length(relevance_reason) < 40 THEN ['❌ Ошибка LLM: ' || relevance_reason] ELSE ['**Вопрос: ' || problem_summary || '**' || chr(10) || relevance_reason] END AS conflicts,
    coalesce(length({strip_sql('solution_summary')}) > 0, false) AS has_data, coalesce(length(relevance_reason) >= 40, false) AS has_conflict FROM {_PAIRS}),
    t AS (SELECT *, CASE WHEN len(conflicts) > 0 THEN array_to_string(conflicts, chr(10) || chr(10)) WHEN NOT has_data THEN '{analyze.NO_DATA}' ELSE '{analyze.NO_CONFLICT}' END AS text FROM c),
    k AS (SELECT *, CASE WHEN contains(lower(text), 'ошибка llm') THEN 'error' WHEN NOT has_data THEN 'nodata' WHEN has_conflict THEN 'conflict' ELSE 'ok' END AS kind FROM t)"""


def _conflicts(spark, d):
    p = _pairs(spark, d)
    conflicts = F.when(F.col("relevance_reason").isNull(), F.array().cast("array<string>")).when(F.length("relevance_reason") < 40, F.array(F.concat(F.lit("❌ Ошибка LLM: "), "relevance_reason"))).otherwise(F.array(F.concat(F.lit("**Вопрос: "), "problem_summary", F.lit("**\n"), "relevance_reason")))
    rows = p.select("pair_id", conflicts.alias("conflicts"), T.present("solution_summary").alias("has_data"), F.coalesce(F.length("relevance_reason") >= 40, F.lit(False)).alias("has_conflict"))
    rows = rows.withColumn("text", analyze.conflict_text(F.col("conflicts"), F.col("has_data")))
    return rows.withColumn("kind", analyze.conflict_class(F.col("text"), F.col("has_data"), F.col("has_conflict")))


@query(f"WITH {_CONFLICTS} SELECT pair_id, kind, text, CASE kind WHEN 'conflict' THEN 0 WHEN 'nodata' THEN 1 WHEN 'ok' THEN 2 ELSE 3 END AS severity FROM k")
def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's class, text and place in the report (severity, then number)."""
    return _conflicts(spark, sf_dir).select("pair_id", "kind", "text", analyze.severity(F.col("kind")).alias("severity"))


@query(f"WITH {_CONFLICTS} SELECT kind, count(*) AS n, bool_or(has_conflict) AS any_conflict, bool_or(has_data) AS any_data FROM k GROUP BY 1")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.bool_or("has_conflict").alias("any_conflict"), F.bool_or("has_data").alias("any_data"))


@query(f"SELECT *, rate < 80 AS too_low FROM (SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, round(avg(CASE WHEN coalesce(ok, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 1) AS rate FROM (SELECT length({strip_sql('solution_summary')}) > 3 AS ok FROM {_PAIRS}))")
def enrich_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.success_rate(_pairs(spark, sf_dir).select((F.length(T.strip("solution_summary")) > 3).alias("ok")), "ok")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""
    SELECT grp, term, n, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, term) AS r FROM (
        SELECT source AS grp, term, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{3,}}')) AS term FROM documents)
        WHERE term NOT IN ({_STOP}) AND NOT regexp_matches(term, '^\p{{N}}+$') GROUP BY ALL)) WHERE r <= 30""")
def keyword_top30_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.top_terms(table(spark, sf_dir, "documents"), "source", "text")


@query("""
    SELECT event_type, count(*) AS n, round(avg(value), 3) AS avg_elapsed, round(max(value), 3) AS max_elapsed, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS sum_k
    FROM events GROUP BY 1""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for audit records: value is the time taken, props the free extras."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("avg_elapsed"), F.round(F.max("value"), 3).alias("max_elapsed"), F.countDistinct("user_id").alias("n_users"), F.sum(F.coalesce(k, F.lit(0))).alias("sum_k"))


@query("SELECT count(*) AS n, count(*) FILTER (json_valid(payload)) AS n_ok, count(*) FILTER (NOT json_valid(payload)) AS n_broken FROM ticket_files WHERE payload IS NOT NULL AND length(trim(payload, ' ' || chr(9) || chr(10) || chr(13))) > 0")
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient reading of JSON: broken records are kept and counted."""
    log = analyze.audit_log(table(spark, sf_dir, "ticket_files"), "payload")
    return log.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_broken"))


@query(f"""
    SELECT author_role, count(*) AS n, CAST(sum(w) AS BIGINT) AS words FROM (SELECT author_role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS w FROM {COMMENTS}) GROUP BY ROLLUP (author_role)""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comments(spark, sf_dir).select(F.col("author_role"), T.word_count("text").alias("w"))
    return rows.rollup("author_role").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


@query("""
    SELECT a.vec_id, round(CASE WHEN na * nb > 0 THEN d / (na * nb) ELSE 0.0 END, 4) AS similarity FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS d,
        sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS na, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nb FROM embeddings) a""")
def answer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and its reverse, rounded as in reports."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 4).alias("similarity"))


@query(f"""
    SELECT pair_id, coalesce(relevance_reason, '') || chr(10) || chr(10) || '---' || chr(10) || '**Информация из документации:**' || chr(10) || coalesce(problem_summary, '')
        || CASE WHEN length({strip_sql("coalesce(problem_summary, '')")}) > 0 OR length({strip_sql("coalesce(solution_summary, '')")}) > 0 THEN chr(10) || chr(10) || '---' || chr(10) || '**Похожие обращения:**' || chr(10) || '- **' || coalesce(ticket_id, '') || '**: ' || coalesce(problem_summary, '') || '. Решение/действие: ' || coalesce(solution_summary, '') ELSE '' END
        || CASE WHEN length({strip_sql("coalesce(relevance_reason, '')")}) > 0 THEN chr(10) || chr(10) || '**Обоснование по источникам:**' || chr(10) || '- ' || relevance_reason || ' [D1]' ELSE '' END
        || chr(10) || chr(10) || '**Источники похожих обращений:**' || chr(10) || '- [T1] ' || coalesce(nullif(ticket_id, ''), nullif(source_file, ''), 'Источник')
        || CASE WHEN coalesce(source_file, '') <> '' AND source_file <> coalesce(nullif(ticket_id, ''), nullif(source_file, ''), 'Источник') THEN ' (' || source_file || ')' ELSE '' END || CASE WHEN coalesce(ticket_url, '') <> '' THEN ': ' || ticket_url ELSE '' END
        || chr(10) || chr(10) || '**Уверенность:** high' AS answer
    FROM {_PAIRS}""")
def answer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final answer put together from each pair's fields."""
    no = F.lit(None).cast("string")
    ticket = F.array(F.struct("ticket_id", "problem_summary", "solution_summary"))
    evidence = F.array(F.struct(F.col("relevance_reason").alias("claim"), F.array(F.lit("D1")).alias("source_ids"), F.lit("").alias("comment")))
    source = F.array(F.struct(F.lit("T1").alias("source_id"), F.col("ticket_id").alias("title"), "source_file", F.col("ticket_url").alias("url"), no.alias("equipment_type"), no.alias("release_version"), no.alias("breadcrumb")))
    none = F.array().cast("array<struct<source_id:string,title:string,source_file:string,url:string,equipment_type:string,release_version:string,breadcrumb:string>>")
    return _pairs(spark, sf_dir).select("pair_id", context.answer_markdown(F.col("relevance_reason"), F.col("problem_summary"), ticket, evidence, none, source, F.lit("high")).alias("answer"))


@query("SELECT source_type, array_to_string(list_sort(list(DISTINCT equipment_type)), ', ') AS equipment FROM rag_docs GROUP BY 1")
def equipment_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag(spark, sf_dir).groupBy("source_type").agg(F.array_join(F.array_sort(F.collect_set("equipment_type")), ", ").alias("equipment"))
