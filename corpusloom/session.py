"""Session settings and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only when it was counted and holds at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Bound of an Arrow batch towards Python, whatever its number of rows.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
FIXED_SIZE = ("boolean", "int", "bigint", "double", "date", "timestamp")


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library relies on; a cluster normally supplies its own."""
    builder = (
        SparkSession.builder.appName("corpusloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Page bodies vary from bytes to megabytes: batches are kept short in rows, here and towards Python.
        .config("spark.sql.parquet.columnarReaderBatchSize", "512")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless the job was submitted with it, and bound their batches.

    Rows hold whole texts and pages, so a batch is bounded in bytes; a session that sets a lower bound keeps it.
    """
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    spark.conf.set(_BATCH_SETTING, str(min(bound, BATCH_BYTES)))
    shipped = spark.conf.get("spark.corpusloom.shipped", None)
    if shipped == spark.sparkContext.applicationId:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-code-")) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("spark.corpusloom.shipped", spark.sparkContext.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` when the session names one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.corpusloom.scratch", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.corpusloom.scratch", local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's own scratch folder, which is removed when the application ends."""
    folder = f"{scratch_root(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if spark.conf.get("spark.corpusloom.folder", None) != folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.conf.set("spark.corpusloom.folder", folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage in storage that outlives executors, and gives the planner true sizes for
    whatever is joined with the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(tables: Sequence[tuple[DataFrame, str]]) -> list[DataFrame]:
    """:func:`materialize` for independent tables, whose jobs then run side by side."""
    with ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(lambda table: materialize(*table), tables))


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most ``limit`` rows and holds at most ``max_bytes``."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) if kind not in FIXED_SIZE else F.lit(8) for c, kind in df.dtypes]
    total = sum(sizes, F.lit(0).cast("bigint"))
    rows, held = df.limit(limit + 1).agg(F.count("*"), F.sum(total)).first()
    return rows <= limit and (held or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a *stored*, narrow table that was counted to be within ``limit`` rows.

    Beyond the limit the table is returned without a hint and the join shuffles.
    """
    return F.broadcast(df) if is_small(df, limit) else df
