"""Corpus statistics, conflict reports and audit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.operators.common import top_k

CLASSES = {"conflict": 0, "nodata": 1, "ok": 2, "error": 3}
NO_DATA = "⚠️ Похожих фрагментов в базе не найдено — нет возможности сравнить."
NO_CONFLICT = "НЕСТЫКОВОК НЕТ"


def top_terms(docs: DataFrame, group: str, text: str, k: int = 30, stop_words: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """(group, term, n, rank): most frequent terms without stop words and plain numbers; ties by term."""
    terms = docs.select(F.col(group).alias("grp"), F.explode(T.tokens(text)).alias("term"))
    terms = terms.filter(~F.col("term").isin(*stop_words) & ~F.col("term").rlike(r"^\p{N}+$"))
    counts = terms.groupBy("grp", "term").agg(F.count("*").alias("n"))
    return top_k(counts, ["grp"], [F.desc("n"), F.asc("term")], k)


def conflict_text(conflicts: Column, has_data: Column) -> Column:
    """The conflicts joined, or that nothing could be compared, or that there are none."""
    return F.when(F.size(conflicts) > 0, F.array_join(conflicts, "\n\n")).when(~has_data, NO_DATA).otherwise(NO_CONFLICT)


def conflict_class(text: Column, has_data: Column, has_conflict: Column) -> Column:
    """error before nodata before conflict before ok."""
    return F.when(F.contains(F.lower(text), F.lit("ошибка llm")), "error").when(~F.coalesce(has_data, F.lit(False)), "nodata").when(F.coalesce(has_conflict, F.lit(False)), "conflict").otherwise("ok")


def severity(kind: Column) -> Column:
    out = F.lit(9)
    for name, n in CLASSES.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def success_rate(flags: DataFrame, flag: str, least: float = 80.0) -> DataFrame:
    """Share of rows that succeeded, in percent, and whether it is too low."""
    rate = F.round(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")) * 100, 1)
    return flags.agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_ok"), rate.alias("rate")).withColumn("too_low", F.col("rate") < least)


def audit_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Audit records of JSON lines: broken lines are kept with ``ok`` false, blank ones dropped, missing keys get defaults."""
    v = F.try_parse_json(F.col(line))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = lines.filter(T.present(line))
    return rows.select(
        v.isNotNull().alias("ok"), get("$.ts", "string").alias("ts"), F.coalesce(get("$.query", "string"), F.lit("")).alias("query"), F.coalesce(get("$.elapsed_sec", "double"), F.lit(0.0)).alias("elapsed_sec"),
        F.coalesce(get("$.n_docs_retrieved", "int"), F.lit(0)).alias("n_docs_retrieved"), F.coalesce(get("$.final_answer", "string"), get("$.draft_private_comment", "string"), F.lit("")).alias("answer"), F.col(line).alias("raw"),
    )
