"""Bounded, source-numbered context from found documents, and the texts built around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskmill.config import Budgets
from deskmill.functions import text as T

# fixed values: labels of the context, which prompts refer to
NO_SOURCES = "Источники не найдены."


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def is_ticket() -> Column:
    """A ticket by id, format or source type; nulls count as no."""
    return F.coalesce(F.col("ticket_id") != "", F.lit(False)) | F.coalesce(F.col("format") == "ticket", F.lit(False)) | F.coalesce(F.col("source_type") == "support_tickets", F.lit(False))


def source_url(direct: str, file: str, *roots: str) -> Column:
    """The direct address, else the first root with the file name, else ''."""
    root = F.coalesce(*[F.nullif(F.col(r), F.lit("")) for r in roots])
    built = F.when(root.isNotNull() & (F.coalesce(F.col(file), F.lit("")) != ""), F.concat(T.base_url(root), F.col(file)))
    return F.coalesce(F.nullif(F.col(direct), F.lit("")), built, F.lit(""))


def page_block(content: Column, url: Column) -> Column:
    """A page's header line and its text."""
    parts = [_or("equipment_type", "Unknown")] + [F.concat(F.lit(f"{label}: "), _or(c, default)) for label, c, default in (("Release", "release_version", "Unknown"), ("Page", "page_title", "Unknown"), ("Файл", "source_file", "Unknown"), ("Раздел", "breadcrumb_raw", "No section"))]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts, F.concat(F.lit("URL: "), url)), F.lit("]\n"), content)


def ticket_block(content: Column, url: Column) -> Column:
    head = F.concat(F.lit("[TICKET | id: "), F.coalesce(F.nullif(F.col("ticket_id"), F.lit("")), _or("source_file", "Unknown")), F.lit(" | file: "), _or("source_file", "Unknown"), F.lit(" | url: "), url, F.lit("]\n"))
    return F.concat(head, content)


def assemble(found: DataFrame, block: Column, total: int, key: str = "query_id", order: str = "pos") -> DataFrame:
    """(key, context): blocks of each key in order, joined by a blank line and trimmed to ``total`` characters.

    Found rows of a key are at most the profile's final number, so a key's list is bounded.
    """
    rows = found.select(key, order, block.alias("_block")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_block"))).alias("_b"))
    return rows.select(key, T.trim_text(F.array_join(F.transform("_b", lambda x: x["_block"]), "\n\n"), total).alias("context"))


def context_of_pages(found: DataFrame, budgets: Budgets = Budgets(), text: str = "page_content", url: str = "url") -> DataFrame:
    return assemble(found, page_block(T.trim_text(text, budgets.doc), F.col(url)), budgets.docs)


def context_of_tickets(found: DataFrame, budgets: Budgets = Budgets(), text: str = "page_content", url: str = "url") -> DataFrame:
    return assemble(found.filter(is_ticket()), ticket_block(T.trim_text(text, budgets.ticket), F.col(url)), budgets.tickets)


def references(found: DataFrame, prefix: str, key: str = "query_id", order: str = "pos") -> DataFrame:
    """Sources of each key, once by (source_file, url), numbered by first appearance: D1, D2, ..."""
    file = F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.nullif(F.col("ticket_id"), F.lit("")), F.lit("Unknown"))
    rows = found.withColumn("source_file", file).withColumn("_first", F.row_number().over(Window.partitionBy(key, "source_file", "url").orderBy(order))).filter("_first = 1")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    title = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("page_title", "ticket_id", "breadcrumb_raw")], F.col("source_file"))
    return rows.select(key, F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("source_id"), title.alias("title"), "source_file", "url", _or("equipment_type", "").alias("equipment_type"), _or("release_version", "").alias("release_version"), _or("breadcrumb_raw", "").alias("breadcrumb"), F.col("_n").cast("bigint").alias("n"))


def rendered_sources(refs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, sources): the list a prompt cites from."""
    detail = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f" | {name}="), F.col(c))).otherwise("")
    line = F.concat(F.lit("["), F.col("source_id"), F.lit("] "), F.col("title"), F.lit(" | file="), F.col("source_file"), F.lit(" | url="), F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("source_file")), detail("equipment", "equipment_type"), detail("release", "release_version"), detail("section", "breadcrumb"))
    rows = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("_l"))
    return rows.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("sources"))


def ticket_query(text: Column | str, equipment: Column | str) -> Column:
    """Search text of a request, with its equipment in front where any is given."""
    names = F.filter(F.transform(T.col(equipment), lambda x: T.strip(x)), lambda x: x != "")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.concat(F.lit("Equipment: "), F.array_join(names, ", "), F.lit("\n\nTicket text:\n"), T.strip(text))).otherwise(T.strip(text))


def quiz_prompt(question: Column | str, options: Column | str) -> Column:
    return F.when(T.present(options), F.concat(T.strip(question), F.lit("\n\nВарианты ответа:\n"), T.strip(options))).otherwise(T.strip(question))


def answer_markdown(draft: Column, docs_answer: Column, tickets: Column, evidence: Column, doc_sources: Column, ticket_sources: Column, confidence: Column) -> Column:
    """The final answer. Arrays of structs: tickets (ticket_id, problem_summary, solution_summary), evidence (claim, source_ids, comment), sources (source_id, title, source_file, url, equipment_type, release_version, breadcrumb)."""
    said = F.filter(tickets, lambda t: T.present(t["problem_summary"]) | T.present(t["solution_summary"]))
    ticket_lines = F.transform(said, lambda t: F.concat(F.lit("- **"), F.coalesce(t["ticket_id"], F.lit("")), F.lit("**: "), F.coalesce(t["problem_summary"], F.lit("")), F.lit(". Решение/действие: "), F.coalesce(t["solution_summary"], F.lit(""))))
    claims = F.filter(evidence, lambda e: T.present(e["claim"]))
    ids = lambda e: F.when(F.size(e["source_ids"]) > 0, F.concat(F.lit(" ["), F.array_join(e["source_ids"], ", "), F.lit("]"))).otherwise("")
    note = lambda e: F.when(F.coalesce(e["comment"], F.lit("")) != "", F.concat(F.lit(" - "), e["comment"])).otherwise("")
    claim_lines = F.transform(claims, lambda e: F.concat(F.lit("- "), e["claim"], ids(e), note(e)))

    def block(lead: str, lines: Column) -> Column:
        return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(lead), F.array_join(lines, "\n"))).otherwise("")

    def source_line(s: Column) -> Column:
        get = lambda f: F.coalesce(s[f], F.lit(""))
        label = F.coalesce(F.nullif(s["title"], F.lit("")), F.nullif(s["source_file"], F.lit("")), F.lit("Источник"))
        suffix = F.when((get("source_file") != "") & (get("source_file") != label), F.concat(F.lit(" ("), get("source_file"), F.lit(")"))).otherwise("")
        head = F.when(get("source_id") != "", F.concat(F.lit("["), get("source_id"), F.lit("] "))).otherwise("")
        url = F.when(get("url") != "", F.concat(F.lit(": "), get("url"))).otherwise("")
        details = F.filter(F.array(*[F.when(get(f) != "", F.concat(F.lit(f"{n}: "), get(f))) for n, f in (("Оборудование", "equipment_type"), ("Релиз", "release_version"), ("Раздел", "breadcrumb"))]), lambda x: x.isNotNull())
        return F.concat(F.lit("- "), head, label, suffix, url, F.when(F.size(details) > 0, F.concat(F.lit("\n  "), F.array_join(details, " | "))).otherwise(""))

    return F.concat(
        F.coalesce(draft, F.lit("")),
        F.lit("\n\n---\n**Информация из документации:**\n"), F.coalesce(docs_answer, F.lit("")),
        block("\n\n---\n**Похожие обращения:**\n", ticket_lines),
        block("\n\n**Обоснование по источникам:**\n", claim_lines),
        block("\n\n**Источники документации:**\n", F.transform(doc_sources, source_line)),
        block("\n\n**Источники похожих обращений:**\n", F.transform(ticket_sources, source_line)),
        F.lit("\n\n**Уверенность:** "), F.coalesce(confidence, F.lit("")),
    )
