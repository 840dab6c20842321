"""Session settings, shipping of this package to executors, and tables in the folder that executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Where `stored` tables lie, so that `discard` can remove them.
_AT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that functions run there need no PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corvane-ship-")
    at = os.path.join(folder, "corvane_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where one process runs everything, as in tests, a new local one stands in."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str = "stored", **options: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, without lineage, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _AT[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of `stored` tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = _AT.pop(df, None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
