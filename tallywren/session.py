"""Session creation and the shared work folder in which lineage is cut."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tallywren", cores: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '*')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.driver.memory", os.environ.get("TALLYWREN_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a single machine that has none gets a
    temporary folder; on a cluster that is an error, as executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallywren-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tallywren/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    return path


# A writer looks at the size of a page or a row group only after 100 rows; rows of megabytes would stand in memory until then.
PACKED = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str = "step", packed: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends
    here, so that a lost executor costs only the tasks after this point. ``packed`` rows are large and compressed already."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(PACKED if packed else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver drop the shuffle files of plans that nothing refers to any more; otherwise they stay until it happens to collect its garbage.
    The last plan's files are let go by the first collection and found by the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def materialize_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str = "step") -> DataFrame:
    """Writes several tables of one schema as one, one after the other, so that only one's shuffle files exist at a time."""
    path, schema = new_path(spark, name), None
    for part in parts:
        if schema is not None:
            release(spark)
        schema = part.schema
        part.write.mode("append").option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every table written meanwhile. What is to outlive it must have been written
    to a path taken before; its results must not be read lazily from inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            remove_path(spark, path)
