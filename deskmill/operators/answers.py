"""Model outputs: lenient reading of structured answers, smart metadata and ticket enrichment over a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.models import Generator, generate
from deskmill.operators.context import answer_markdown

# fixed values: names under which models return a field
ALIASES = {
    "user_intent": ("user_intent", "intent"),
    "docs_answer": ("docs_answer", "documentation_answer"),
    "missing_context": ("missing_context", "missing"),
    "draft_private_comment": ("draft_private_comment", "draft_comment", "final_answer", "answer"),
    "confidence": ("confidence",),
}
LISTS = ("related_topics", "recommended_questions", "internal_notes")


def _text(v: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(T.strip(F.try_variant_get(v, f"$.{n}", "string")), F.lit("")) for n in names], F.lit(""))


def _list(v: Column, name: str) -> Column:
    """An array of strings; a string becomes an array of one, anything else an empty one."""
    items = F.try_variant_get(v, f"$.{name}", "array<string>")
    one = F.nullif(T.strip(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))
    return F.coalesce(items, F.when(one.isNotNull() & ~F.startswith(one, F.lit("[")), F.array(one)), F.array().cast("array<string>"))


def read_response(raw: Column | str) -> list[Column]:
    """Columns of a structured answer from a model's raw output. What can't be parsed gives empty fields and ``ok`` false."""
    v = F.try_parse_json(T.strip_think(raw))
    tickets = F.try_variant_get(v, "$.similar_tickets", "array<struct<ticket_id:string,problem_summary:string,solution_summary:string>>")
    notes = F.try_variant_get(v, "$.evidence_notes", "array<struct<claim:string,source_ids:array<string>,comment:string>>")
    out = [v.isNotNull().alias("ok"), *[_text(v, names).alias(c) for c, names in ALIASES.items()], *[_list(v, c).alias(c) for c in LISTS]]
    return [*out, F.coalesce(tickets, F.array().cast("array<struct<ticket_id:string,problem_summary:string,solution_summary:string>>")).alias("similar_tickets"), F.coalesce(notes, F.array().cast("array<struct<claim:string,source_ids:array<string>,comment:string>>")).alias("evidence_notes")]


def prompt(question: Column | str, docs_context: Column | str, tickets_context: Column | str, sources: Column | str) -> Column:
    """What a generator gets: the question, both contexts and the list that it cites from; empty parts are left out."""
    parts = [(head, T.col(c)) for head, c in (("QUESTION", question), ("DOCUMENTATION", docs_context), ("TICKETS", tickets_context), ("SOURCES", sources))]
    return F.concat_ws("\n\n", *[F.when(T.present(c), F.concat(F.lit(f"{head}:\n"), c)) for head, c in parts])


#: A row of the audit: what was asked, found and answered.
AUDIT = "ts TIMESTAMP, query_id BIGINT, query STRING, n_docs_retrieved INT, retrieved_docs ARRAY<STRUCT<source STRING, equipment STRING, preview STRING>>, user_intent STRING, final_answer STRING, missing_context STRING, error STRING"


def answered(asked: DataFrame, references: DataFrame, generator: Generator) -> DataFrame:
    """Questions (query_id, text, docs_context, tickets_context) answered by a generator from their contexts.

    ``references``: query_id, db_source, n and the fields of a source. A model's own idea of its sources is replaced by
    the references that were in the prompt. An output that can't be read, or a generator's null, gives an empty answer
    with ``ok`` false; the row stays.
    """
    fields = ("source_id", "title", "source_file", "url", "equipment_type", "release_version", "breadcrumb")
    source = F.struct("n", *fields)
    ranked = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("db_source") == kind, source))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    lists = references.groupBy("query_id").agg(ranked("docs").alias("doc_sources"), ranked("tickets").alias("ticket_sources"))
    none = F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    rows = asked.join(lists, "query_id", "left").withColumns({c: F.coalesce(c, none) for c in ("doc_sources", "ticket_sources")})
    cited = F.array_join(F.transform(F.concat("doc_sources", "ticket_sources"), lambda x: F.concat(F.lit("["), x["source_id"], F.lit("] "), x["title"])), "\n")
    raw = rows.withColumn("raw", generate(prompt("text", "docs_context", "tickets_context", cited), generator))
    read = raw.select("query_id", "text", "doc_sources", "ticket_sources", *read_response("raw"))
    markdown = answer_markdown(*[F.col(c) for c in ("draft_private_comment", "docs_answer", "similar_tickets", "evidence_notes", "doc_sources", "ticket_sources", "confidence")])
    return read.withColumn("final_answer", markdown)


def audit_rows(answers: DataFrame, at: Column | None = None, preview: int = 200) -> DataFrame:
    """One audit row for each answer, in the shape of ``AUDIT``."""
    found = F.transform(F.concat("doc_sources", "ticket_sources"), lambda x: F.struct(x["source_file"].alias("source"), x["equipment_type"].alias("equipment"), F.substring(x["title"], 1, preview).alias("preview")))
    return answers.select(
        (F.current_timestamp() if at is None else at).alias("ts"), "query_id", F.col("text").alias("query"), F.size(found).alias("n_docs_retrieved"), found.alias("retrieved_docs"),
        "user_intent", "final_answer", "missing_context", F.when(~F.col("ok"), F.lit("unreadable answer")).alias("error"),
    )


def smart_metadata(docs: DataFrame, id_col: str, text_col: str, generator: Generator, chars: int = 1500) -> DataFrame:
    """(id, keywords, questions) read from a generator's labelled lines over the first ``chars`` characters."""
    prompt = F.concat(F.lit("КЛЮЧЕВЫЕ СЛОВА: и ВОПРОСЫ: к тексту\n"), F.substring(F.col(text_col), 1, chars))
    raw = docs.select(id_col, T.strip_think(generate(prompt, generator)).alias("_raw"))
    return raw.select(id_col, T.labelled_line("_raw", "КЛЮЧЕВЫЕ СЛОВА").alias("keywords"), T.labelled_line("_raw", "ВОПРОСЫ").alias("questions"))


def ticket_enrichment(windows: DataFrame, generator: Generator) -> DataFrame:
    """(ticket_id, symptoms, solution, ok) from a generator's JSON over prompt windows (ticket_id, description, comments)."""
    prompt = F.concat_ws("\n", F.lit('JSON {"symptoms": [], "solution": []}'), "description", "comments")
    raw = windows.select("ticket_id", F.try_parse_json(T.strip_think(generate(prompt, generator))).alias("_v"))
    return raw.select("ticket_id", _list(F.col("_v"), "symptoms").alias("symptoms"), _list(F.col("_v"), "solution").alias("solution"), F.col("_v").isNotNull().alias("ok"))
