"""Child chunks of parent documents and their enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.config import CHUNK_OVERLAP, CHUNK_SIZE

DOCUMENT_PREFIX = "Document: "


def fixed(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, ord, text): windows of ``size`` code points that start every ``size - overlap``; none lies wholly in the overlap before it. Null and empty texts have none."""
    step = size - overlap
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).filter(F.length("_text") > 0)
    rows = rows.select("doc_id", "_text", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("_text") - overlap - 1, F.lit(0)), F.lit(step))).alias("ord", "_at"))
    return rows.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.expr(f"substring(_text, _at + 1, {size})").alias("text"))


def enrich(text: Column | str, questions: Column | str, keywords: Column | str, prefix: str = DOCUMENT_PREFIX) -> Column:
    """A chunk with the parent's questions and keywords, each only if it isn't there yet, and the document prefix in front."""
    t, q, k = (F.col(c) if isinstance(c, str) else c for c in (text, questions, keywords))
    more = lambda value, tag, lead: F.when((F.coalesce(value, F.lit("")) != "") & ~F.contains(t, F.lit(tag)), F.concat(F.lit(f"{lead}{tag} "), value, F.lit("]"))).otherwise("")
    return F.concat(F.lit(prefix), t, more(q, "[ПОТЕНЦИАЛЬНЫЕ ВОПРОСЫ:", "\n\n"), more(k, "[КЛЮЧЕВЫЕ СЛОВА:", "\n"))
