"""What every operator needs from the session: table paths, code on the executors, durable intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Settings of the session by Spark's default and this package's, as texts are long: rows (and bytes) of an Arrow batch, rows of a Parquet reader's.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(4 << 20)),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
    "spark.sql.columnVector.offheap.enabled": ("false", "true"),
}
#: Bytes of a row group in tables that only the next step reads. A writer holds a row group of long texts in memory.
ROW_GROUP = ("parquet.block.size", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in Python there, and keep batches of texts small.

    BATCHES are settings of the session: what it has set to other than Spark's default stays, and the others hold from then on.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        for name, (default, own) in BATCHES.items():
            if default is None or spark.conf.get(name, default) == default:
                spark.conf.set(name, own)
    if sc.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="dissona"), f"dissona_{sc.applicationId.replace('-', '_')}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir, a local one only where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="dissona-checkpoint"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df as a Parquet table in the shared folder, compressed by column, for as long as the block runs."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option(*ROW_GROUP).parquet(folder)
    try:
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        remove(spark, folder)


def written(df: DataFrame) -> DataFrame:
    """df read back from a Parquet table in the shared folder, which stays as a checkpoint does; compressed by column, it takes a fraction of one."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/result-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option(*ROW_GROUP).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is such a folder or file, by any address that Spark can open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def rename(spark: SparkSession, folder: str, name: str) -> None:
    """Another name for a folder, whose parent is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(folder), path(name)):
        raise OSError(f"{folder} couldn't be renamed")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder by any address that Spark can open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder, bucketed by key into as many buckets as a shuffle has partitions, for as long as the block runs.

    Joins on the key deal out only the other side.
    """
    spark = df.sparkSession
    name = f"dissona_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{name}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option(*ROW_GROUP).option("path", folder).saveAsTable(name)
    try:
        yield spark.read.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)


def rows_bound(df: DataFrame, bound: int) -> bool:
    """Whether df has at most `bound` rows, read without counting further than that."""
    return df.limit(bound + 1).count() <= bound


# Fixed value: what the models of a check take on the driver's machine, in MB.
MODELS_MB = 2500


def available_memory_mb() -> int | None:
    """What this machine has left, or None where it can't be told."""
    try:
        return next(int(line.split()[1]) >> 10 for line in Path("/proc/meminfo").read_text().splitlines() if line.startswith("MemAvailable:"))
    except (OSError, StopIteration):
        return None


def preflight_memory(least_mb: int | None = None) -> str | None:
    """A warning where the models may not fit, None where they do or nothing is known; under least_mb, if given, a ValueError."""
    left = available_memory_mb()
    if left is None:
        return None
    if least_mb is not None and left < least_mb:
        raise ValueError(f"{left} MB are available, below max_memory_mb={least_mb}; close other processes, lower it, or take a smaller model")
    return f"{left} MB are available; the models of a check take about {MODELS_MB}, so it may run out of memory" if left < MODELS_MB else None
