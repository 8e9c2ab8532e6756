"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "plumbline") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and Spark runs on this machine alone (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            made = tempfile.mkdtemp(prefix="plumbline-")
            sc.setCheckpointDir(f"file://{made}")
            current = sc._jsc.sc().getCheckpointDir()
        place = current.get()
    return place.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


def materialize(df: DataFrame, label: str = "part", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage as a checkpoint does, survives lost executors, and keeps
    column pruning and filter push-down for whatever reads it. ``partition_by``
    gives each of its values a folder of its own; those columns come last. The
    files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    atexit.register(_remove, spark, path)
    schema = df.schema
    if partition_by:
        schema = type(schema)([f for f in schema if f.name not in partition_by] + [schema[c] for c in partition_by])
    table = spark.read.schema(schema).parquet(path)
    table._plumbline_path = path
    return table


def release(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again, such as the last round's of an iteration."""
    path = getattr(table, "_plumbline_path", None)
    if path is not None:
        _remove(table.sparkSession, path)
