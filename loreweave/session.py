"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of what one query has shuffled, when it has ended


def build_session(app: str = "loreweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; any may be overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Whole documents travel through Arrow, so bound a batch by rows as well as by bytes.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.parquet.filterPushdown": "true",
        # Per-user limits go up to 2,000 rows; keep them inside the map-side group limit.
        "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A folder of our own is used only where the setting is missing and driver and executor are one process, as in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def store_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and read it back; also its path, for :func:`delete_tables`.

    Later plans start from files: nothing upstream is recomputed when an executor is lost or when several
    branches read the result, and the optimiser knows its real size and columns. For the same reason the shuffles that
    the table was made by are of no further use, and their files go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored and read back; the table stays until :func:`delete_run_tables`."""
    return store_table(df)[0]


def delete_tables(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_run_tables(spark: SparkSession) -> None:
    """Delete every table that this application stored; call it when its results are written."""
    delete_tables(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, so that they need no path of their own."""
    context = spark.sparkContext
    if getattr(context, "_loreweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "loreweave_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._loreweave_shipped = True
