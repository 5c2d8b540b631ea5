"""File sources and sinks of the pipeline, each lazy and distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions import text as T
from deskmill.operators import nested
from deskmill.operators.ingest import hashed, ingestible


def pattern_for(source_type: str) -> str:
    """Which files a source type holds."""
    if source_type.endswith("_docx"):
        return "*.docx"
    return "*.json" if source_type == "support_tickets" else "*.{html,htm}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(source_type, path, name, content, hash) of all files below each source type's folder; a missing folder gives nothing."""
    out = None
    for kind, folder in folders.items():
        if not exists(spark, folder):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern_for(kind)).load(folder)
        rows = files.select(F.lit(kind).alias("source_type"), "path", F.url_decode(F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\+", "%2B")).alias("name"), "content")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "source_type STRING, path STRING, name STRING, content BINARY, hash STRING")
    return hashed(ingestible(out))


def ticket_nodes(files: DataFrame) -> DataFrame:
    """Comments, replies and attachments of scanned ticket files."""
    rows = files.select(F.xxhash64("path").alias("file_id"), F.decode("content", "UTF-8").alias("payload"))
    return nested.flatten(rows)


def portal_csv(spark: SparkSession, path: str, created: str, fmt: str = "dd.MM.yyyy HH:mm:ss") -> DataFrame:
    """A portal export: ``;``, header, malformed lines dropped, text columns; ``created`` is read leniently as UTC time."""
    rows = spark.read.csv(path, sep=";", header=True, mode="DROPMALFORMED", enforceSchema=False)
    return rows.withColumn(created, F.coalesce(F.try_to_timestamp(created, F.lit(fmt)), F.try_to_timestamp(created)))


def json_arrays(spark: SparkSession, path: str, item: str, skip: tuple[str, ...] = ("summary.json", "full_report_", "incorrect_answers_", "_errors.json")) -> DataFrame:
    """Items (schema ``item``) of files that each hold one JSON array, with ``file``; other files and reports are skipped."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
    for name in skip:
        rows = rows.filter(~F.startswith(F.col("file"), F.lit(name)))
    whole = rows.filter(F.startswith(F.trim(F.regexp_replace("value", "^\\s+", "")), F.lit("[")))
    items = whole.select("file", F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{item}>>")).alias("ord", "item"))
    return items.select("file", "ord", "item.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and number of characters, for logs of one record a line."""
    return spark.read.text(path).filter(T.present("value"))


def write_new(df: DataFrame, path: str) -> None:
    """A new index version: an existing one is never touched."""
    df.write.mode("errorifexists").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str = "source_type") -> None:
    """Replaces only the partitions that ``df`` holds; rows below one path are those of its last write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the store lacks, so that a repeated run adds nothing; returns what was missing. A store that can't be read is an error, only one that isn't there is empty."""
    missing = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti") if exists(df.sparkSession, path) else df
    missing.write.mode("append").parquet(path)
    return missing


def latest_version(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(rows of the newest whole version below ``path``, its number); no rows and 0 where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    whole = [int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and exists(spark, f"{path}/{p.getName()}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], schema), 0
    return spark.read.schema(schema).parquet(f"{path}/v{max(whole)}"), max(whole)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows as JSON lines behind those that are there."""
    rows.write.mode("append").json(path)


def audit_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records of an audit log, its bad lines with file, line number from 1 and text). Each file is read whole, for its line numbers."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    read = texts.filter(T.present("line")).select("file", (F.col("at") + 1).cast("bigint").alias("line_no"), "line", F.from_json("line", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = read.filter(F.col("r._bad").isNull())
    return good.select("file", "line_no", "r.*").drop("_bad"), read.filter(F.col("r._bad").isNotNull()).select("file", "line_no", "line")


def write_report(judged: DataFrame, path: str) -> None:
    """All judged rows and the ones not right as JSON, the statistics as ``;`` CSV."""
    from deskmill.operators.evaluate import NO, ERROR, statistics

    judged.write.mode("overwrite").json(f"{path}/full_report")
    judged.filter(F.col("verdict").isin(NO, ERROR)).write.mode("overwrite").json(f"{path}/incorrect_answers")
    statistics(judged).write.mode("overwrite").csv(f"{path}/summary", sep=";", header=True, encoding="UTF-8")
