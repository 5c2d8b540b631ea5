"""Support tickets: eligibility, author roles, clean comments, cards and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.config import Eligibility
from deskmill.functions import text as T
from deskmill.operators.common import numbered

PREFIX = "Техническое обращение: диагностика и решение проблемы."
DEFAULT_CATEGORY = "Без категории"
SEPARATOR = "\n---\n"


def kept(column: str, excluded: tuple[str, ...]) -> Column:
    """NOT IN as tables of the desk use it: a null is no excluded value and stays."""
    return ~F.coalesce(F.col(column).isin(*excluded), F.lit(False)) if excluded else F.lit(True)


def eligible(tickets: DataFrame, rules: Eligibility, created: str = "cmf_created_at", status: str = "cache_status_type", equipment: str = "cf_tip_oborud_reg", assignee: str | None = None, requester: str | None = None) -> DataFrame:
    """Tickets since a date, in a listed state, without excluded equipment and people; an unknown date drops a row."""
    tests = [F.col(created) >= F.lit(rules.since).cast("timestamp"), F.col(status).isin(*rules.statuses), kept(equipment, rules.excluded_equipment)]
    tests += [kept(c, x) for c, x in ((assignee, rules.excluded_assignees), (requester, rules.excluded_requesters)) if c]
    return tickets.filter(reduce(lambda a, b: a & b, tests))


def codes(rows: DataFrame, column: str, pattern: str = "RL-") -> DataFrame:
    """Distinct codes that contain the pattern in any case, trimmed and upper-cased."""
    code = F.upper(T.strip(column))
    return rows.select(code.alias("code")).filter(F.col("code").contains(pattern.upper())).distinct()


def author_roles(comments: DataFrame, tickets: DataFrame) -> DataFrame:
    """Role of each comment's author against its ticket's owner: the owner is the client, no owner is unknown."""
    owners = tickets.select("ticket_id", F.col("cmf_owner_id").alias("owner"))
    joined = comments.join(owners, "ticket_id")
    role = F.when(F.col("owner").isNotNull() & (F.col("cmf_owner_id") == F.col("owner")), "Client").when(F.col("owner").isNull(), "Unknown").otherwise("Engineer")
    return joined.withColumn("role", role)


def clean_comments(comments: DataFrame) -> DataFrame:
    """Comments with content: markup stripped, tracker messages dropped, contacts masked, role in front."""
    plain = comments.withColumn("clean", T.strip_html("text")).filter(~T.is_noise("clean"))
    return plain.withColumn("line", F.concat(T.role_label("author_role"), F.lit(": "), T.mask_contacts("clean"))).drop("clean")


def threads(comments: DataFrame, part: int = 200) -> DataFrame:
    """(ticket_id, part_no, n_comments, thread): each ticket's comments in order, joined, at most ``part`` in a row.

    A thread of any length is complete over its parts, and no row or task has to hold more than one part.
    """
    placed = numbered(clean_comments(comments.filter(F.col("ticket_id").isNotNull())), "ticket_id", "cmf_created_at", "comment_id")
    parts = placed.groupBy("ticket_id", F.expr(f"(turn - 1) div {part}").alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return parts.select("ticket_id", "part_no", F.size("lines").cast("bigint").alias("n_comments"), F.array_join(F.transform("lines", lambda x: x["line"]), SEPARATOR).alias("thread"))


def described(tickets: DataFrame, equipment: DataFrame) -> DataFrame:
    """Tickets with their display fields; unknown codes and empty fields take the defaults."""
    names = equipment.select(F.col("code").alias("cf_tip_oborud_reg"), "equipment_name")
    status = F.coalesce(F.nullif(F.col("cache_status_type"), F.lit("")), F.lit("Unknown"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return tickets.join(names, "cf_tip_oborud_reg", "left").select(
        "ticket_id",
        T.strip_html(F.coalesce(blank("name"), F.col("ticket_id"))).alias("title"),
        T.strip_html(F.coalesce(blank("text"), F.col("description"))).alias("description"),
        T.strip_html("resolution").alias("resolution"),
        F.concat(F.upper(F.left(status, F.lit(1))), F.lower(F.substring(status, 2, 1000))).alias("status"),
        F.coalesce("equipment_name", F.lit("General")).alias("equipment_type"),
        F.coalesce(blank("cf_kategoriya_or_name"), F.lit(DEFAULT_CATEGORY)).alias("category"),
    )


def _head() -> list[Column]:
    return [F.lit(PREFIX), F.concat(F.lit("[ТИКЕТ: "), F.col("ticket_id"), F.lit("] ["), F.col("equipment_type"), F.lit("]"))]


def cards(tickets: DataFrame, comments: DataFrame, equipment: DataFrame) -> DataFrame:
    """(ticket_id, part_no, page_content) of each ticket; parts after the first go on with the thread."""
    thread = threads(comments)
    rows = described(tickets, equipment).join(thread, "ticket_id", "left").withColumn("part_no", F.coalesce("part_no", F.lit(0).cast("bigint")))
    filled = lambda c, *x: F.when(F.length(c) > 0, F.concat(*x))
    first = F.concat_ws(
        "\n",
        *_head(),
        F.concat(F.lit("[ТИП: "), F.col("category"), F.lit("] | [СТАТУС: "), F.col("status"), F.lit("]")),
        F.concat(F.lit("ТЕМА: "), F.col("title"), F.lit("\n")),
        filled("description", F.lit("ОПИСАНИЕ:\n"), F.col("description"), F.lit("\n")),
        filled("thread", F.lit("ПЕРЕПИСКА:\n"), F.col("thread")),
        filled("resolution", F.lit("\nИТОГОВОЕ РЕШЕНИЕ:\n"), F.col("resolution")),
    )
    later = F.concat_ws("\n", *_head(), F.concat(F.lit("ПЕРЕПИСКА:\n"), F.col("thread")))
    return rows.select("ticket_id", "part_no", "title", "equipment_type", "status", F.when(F.col("part_no") == 0, T.strip(first)).otherwise(T.strip(later)).alias("page_content"))


def facts(tickets: DataFrame, comments: DataFrame, equipment: DataFrame) -> DataFrame:
    """(ticket_id, page_content) of resolved tickets that have a description or a comment."""
    talked = clean_comments(comments).select("ticket_id").distinct().withColumn("talked", F.lit(True))
    rows = described(tickets, equipment).join(talked, "ticket_id", "left")
    rows = rows.filter(((F.length("description") > 0) | F.coalesce("talked", F.lit(False))) & F.upper("status").isin(*T.RESOLVED))
    body = F.concat(F.lit("ПРОБЛЕМА:\n"), F.substring("description", 1, 500), F.lit("\n\nРЕШЕНИЕ:\n"), F.col("resolution"))
    return rows.select("ticket_id", T.strip(F.concat_ws("\n", *_head(), F.concat(F.lit("ТЕМА: "), F.col("title"), F.lit("\n")), body)).alias("page_content"))


def bullet_facts(symptoms: Column, solution: Column) -> Column:
    """Fact text from a model's lists of symptoms and steps."""
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("СИМПТОМЫ ПРОБЛЕМЫ:\n"), bullets(symptoms), F.lit("\n\nРЕШЕНИЕ:\n"), bullets(solution))


def prompt_window(tickets: DataFrame, comments: DataFrame, equipment: DataFrame, most: int = 15, chars: int = 1000) -> DataFrame:
    """What a model sees of a ticket: the first ``chars`` of its description and its first ``most`` comments."""
    placed = numbered(clean_comments(comments.filter(F.col("ticket_id").isNotNull())), "ticket_id", "cmf_created_at", "comment_id").filter(F.col("turn") <= most)
    talk = placed.groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    rows = described(tickets, equipment).join(talk, "ticket_id", "left")
    return rows.select("ticket_id", F.substring("description", 1, chars).alias("description"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")).alias("comments"))
