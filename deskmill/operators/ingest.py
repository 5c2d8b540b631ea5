"""Incremental ingest: what changed, what goes, what is written, and whether it is complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.config import COMPLETENESS
from deskmill.session import materialise


def ingestible(files: DataFrame, name: str = "name") -> DataFrame:
    """Without lock files and print versions."""
    return files.filter(~(F.startswith(F.col(name), F.lit("~$")) | F.endswith(F.col(name), F.lit("_print.htm"))))


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.md5(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))))


def diff(files: DataFrame, registry: DataFrame, keys: tuple[str, ...] = ("source_type", "path")) -> DataFrame:
    """(keys, hash, old_hash, state): new, changed, same or deleted; a file is known by type and path, not by name."""
    f, r = files.select(*keys, "hash", F.lit(True).alias("_f")), registry.select(*keys, F.col("hash").alias("old_hash"), F.lit(True).alias("_r"))
    state = F.when(F.col("_r").isNull(), "new").when(F.col("_f").isNull(), "deleted").when(F.col("hash").eqNullSafe(F.col("old_hash")), "same").otherwise("changed")
    return f.join(r, list(keys), "full_outer").select(*keys, "hash", "old_hash", state.alias("state"))


def parent_id(source_type: str, path: str, ord_: str):
    """A parent's id from where it stands, so that a second run gives the same ids."""
    return F.md5(F.concat_ws("\x1f", F.col(source_type), F.col(path), F.col(ord_).cast("string")))


def updated_registry(changes: DataFrame, parents: DataFrame) -> DataFrame:
    """The registry after a run: every attempt is recorded, also files that gave no parent; deleted files are gone."""
    ids = parents.groupBy("source_type", "path").agg(F.array_sort(F.collect_list("parent_id")).alias("parent_ids"))
    return changes.filter("state <> 'deleted'").join(ids, ["source_type", "path"], "left").select("source_type", "path", "hash", F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"))


def replaced(store: DataFrame, changes: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("source_type", "path")) -> DataFrame:
    """The parent store without rows of changed and deleted files, plus the fresh rows."""
    gone = changes.filter(F.col("state").isin("changed", "deleted")).select(*keys)
    return store.join(gone, list(keys), "left_anti").unionByName(fresh)


def completeness(expected: DataFrame, actual: DataFrame, least: float = COMPLETENESS) -> DataFrame:
    """One row: counts of what should be and what is in the index, and whether it is enough."""
    n = expected.agg(F.count("*").alias("n_expected"))
    m = actual.agg(F.count("*").alias("n_actual"))
    # two single rows side by side
    return n.join(m, F.lit(True)).withColumn("complete", F.col("n_actual") >= F.col("n_expected") * least)


REGISTRY = "source_type STRING, path STRING, hash STRING, parent_ids ARRAY<STRING>"


def run(files: DataFrame, store: str, registry: str, parse: Callable[[DataFrame], DataFrame], schema: str, complete: bool = True) -> DataFrame:
    """One incremental ingest: (state, n) of the files seen.

    ``files``: source_type, path, hash and content; ``parse`` makes parents (``schema``, with parent_id, source_type and
    path) of them. Parents of changed and, if the listing is ``complete``, of deleted files leave the store, those of new
    and changed ones enter; the same files again change nothing. Store and registry are written as new versions, the
    store first: a run that breaks off between them leaves the old registry, and the next one repeats it.
    """
    from deskmill.sources.files import latest_version

    spark = files.sparkSession
    before, n = latest_version(spark, store, schema)
    known, m = latest_version(spark, registry, REGISTRY)
    changes = diff(files, known)
    if not complete:
        changes = changes.withColumn("state", F.when(F.col("state") == "deleted", "same").otherwise(F.col("state"))).withColumn("hash", F.coalesce("hash", "old_hash"))
    changes = materialise(changes, "changes")
    counts = changes.groupBy("state").agg(F.count("*").alias("n"))
    if not changes.filter("state <> 'same'").isEmpty():
        due = changes.filter(F.col("state").isin("new", "changed")).select("source_type", "path")
        # files of a run that broke off may be in the store without being known
        fresh = parse(files.join(due, ["source_type", "path"], "left_semi"))
        gone = changes.filter("state <> 'same'").withColumn("state", F.lit("changed"))
        after = replaced(before, gone, fresh.select(before.columns))
        after.write.mode("overwrite").parquet(f"{store}/v{n + 1}")
        written, _ = latest_version(spark, store, schema)
        updated_registry(changes, written).write.mode("overwrite").parquet(f"{registry}/v{m + 1}")
    return counts
