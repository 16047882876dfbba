"""Session helpers shared by every operator: scratch tables and shipping this package to Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests, a laptop) a folder of this machine is made and set where that is unset; executors
    of a cluster wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/strandwork/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the application's folder in the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that aren't stored yet can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and any executor can reread it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_strandwork_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for top, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("strandwork", os.path.relpath(full, _PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="strandwork-src-"), "strandwork_src.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._strandwork_shipped = True


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the text that one Arrow batch holds: rows of long documents are many times the usual size. A session whose
    setting isn't Spark's own keeps it."""
    setting, spark_default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(setting, spark_default) == spark_default:
        spark.conf.set(setting, str(rows))
