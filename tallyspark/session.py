"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; extra settings by keyword, dots written as `__`."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        at = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark_package.zip"
        at.write_bytes(data.getvalue())
        sc.addPyFile(os.fspath(at))
    _SHIPPED.add(sc.applicationId)


#: Tables of each application that may be deleted, in the order in which they were made.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one, in local mode only (tests); on a cluster that is an error, as executors couldn't see it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tallyspark-')}")
        where = spark.sparkContext.getCheckpointDir()
    return where


def as_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again with its own schema. Unless keep, `scratch` and `drop_tables` delete it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _TABLES.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owned(spark: SparkSession, path: str) -> str:
    """Marks a path in the shared folder as one that `scratch` and `drop_tables` delete."""
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_tables(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that `as_table` has made in this application, but the first `since`, and returns how many. Results that read them have to be written before."""
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since:]
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables made inside, but those to keep. What is returned from inside must have been written."""
    since = len(_TABLES.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_tables(spark, since)
