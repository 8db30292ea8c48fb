"""Session helpers: where intermediate tables live, and how they are written."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_ending: set[str] = set()
TASK_ROWS = 1 << 16  # rows of ids and numbers that one task may write
SENT_ROWS = 1 << 16  # rows of ids and numbers that the driver may hold and send to every task


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    A cluster must name a folder that every executor reaches.  Only a local
    master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="fallow-")
    return _local_dirs[app]


def app_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared folder; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _ending:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)  # only what exists is noted for deletion
        files.deleteOnExit(target)
        _ending.add(folder)
    return folder


def in_few_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, known to have ``rows`` rows at most, in no more partitions than so many rows need, one per core at least.

    A small table behind a shuffle otherwise makes a task, a file and a later read of each shuffle partition.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have some ``rows`` rows, as a side of a join: many rows are merged and never sent to every task.

    Spark judges a table by its files and an exploded one by its source.  Zeros and repeated values take next to no
    room in files, so a table that looks small may be hundreds of times as large in the memory of the driver.
    """
    return df.hint("merge") if rows > SENT_ROWS else df


def settle(df: DataFrame, compression: str = "") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where several later passes need the same result.  It cuts the lineage
    (a lost executor re-reads files instead of recomputing the job), keeps
    column pruning for the later passes, and gives the optimizer the real size,
    so that it broadcasts the table only when that size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    ``compression`` names another codec than the session's, such as the denser zstd for texts.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    written = df.write.option("compression", compression) if compression else df.write
    written.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{app_dir(spark)}/{package.name}.zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target.toString())
    _shipped.add(app)
