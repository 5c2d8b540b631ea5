"""Session helpers: table access, shared-folder materialisation, task sizing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SHIPPED: dict[str, str] = {}
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own; on a cluster the
    setting is required, because a machine-local folder can't be read by the other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="deskmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, partitioned by the column ``by`` if given, and read it back: lineage is cut and a lost executor costs nothing.

    The folder is removed by :func:`discard`, or at the latest when the application's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the folder of a materialised table that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _remove(path)


def _remove(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    active = SparkContext._active_spark_context
    settings = active._jsc.hadoopConfiguration() if active is not None else jvm.org.apache.hadoop.conf.Configuration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(settings).delete(at, True)


def _remove_all() -> None:
    while _WRITTEN:
        try:
            _remove(_WRITTEN.pop())
        except Exception:  # the JVM may be gone: what is left lies in the cluster's own checkpoint folder
            return


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application, served by the driver."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="deskmill-")  # on the driver only, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "deskmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    _SHIPPED["app"] = sc.applicationId
