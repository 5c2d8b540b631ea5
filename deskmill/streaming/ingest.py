"""Streams: incremental ingest of arriving documents, and audit windows. The batch operators do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deskmill.operators import chunking
from deskmill.session import discard, materialise
from deskmill.sources.files import exists, write_partitions


#: Parts of a chunk store; a batch rewrites only those of its changed documents.
BUCKETS = 64
STORED = "doc_id BIGINT, ord BIGINT, text STRING, bucket INT"


def upsert(batch: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, buckets: int = BUCKETS) -> None:
    """Chunks of the batch's documents in place of their older ones; a null or empty text removes a document's chunks.

    Of several rows of a document the last one by ``order_col`` counts, else any one. Each document has one further row
    (``ord`` -1) with the hash of its text, by which unchanged documents are left alone and removed ones stay known. A
    batch that is run again changes nothing.
    """
    spark = batch.sparkSession
    rows = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(order_col or id_col).alias("_at"))
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("text"), F.struct("_at", F.struct("text"))).alias("_t")).select("doc_id", "_t.text")
    marks = last.select("doc_id", F.lit(-1).cast("bigint").alias("ord"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")
    if exists(spark, store):
        have = spark.read.schema(STORED).parquet(store)
        known = have.filter("ord = -1")
        due = materialise(marks.select("*", bucket).join(known.select("doc_id", "text"), ["doc_id", "text"], "left_anti"), "due")
        touched = F.col("bucket").isin([r.bucket for r in due.select("bucket").distinct().collect()])  # at most ``buckets`` numbers
        kept = have.filter(touched).join(due.select("doc_id"), "doc_id", "left_anti")
    else:
        due = materialise(marks.select("*", bucket), "due")
        kept = spark.createDataFrame([], STORED)
    fresh = chunking.fixed(last.join(due.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text").select("doc_id", "ord", "text", bucket)
    # written beside the store first, since the parts it replaces are read
    after = materialise(kept.select("doc_id", "ord", "text", "bucket").unionByName(fresh).unionByName(due.select("doc_id", "ord", "text", "bucket")), "chunks")
    write_partitions(after, store, "bucket")
    discard(after)
    discard(due)


def stored_chunks(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, ord, text) of a store."""
    return spark.read.schema(STORED).parquet(store).filter("ord >= 0").select("doc_id", "ord", "text")


def ingest(documents: DataFrame, store: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> StreamingQuery:
    """Chunks of arriving, changed and removed documents kept in ``store``, see :func:`upsert`."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(batch, store, id_col, text_col, order_col)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count and mean time of each kind in tumbling windows; rows later than ``late`` are left out."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, size), F.col(kind).alias("kind"))
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "kind", "n", "mean")
