"""Session defaults and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    n = shuffle_partitions or (int(cores) if cores.isdigit() else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("redliner")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: rows of one task of ``spread``
SPREAD_ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give row work that burns CPU at least one task per core, and tasks that stay of one size as the table grows.

    A scan with fewer splits (a few small files, or long row groups, of which a
    task gets whole ones) is hash-partitioned first; anything finer passes
    through untouched, without a shuffle. Rows are counted from file footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


def workers_find_package(spark: SparkSession) -> None:
    """Put the folder of this package on the path of the Python workers.

    Code that tasks import by name is then found wherever the session was
    started. On a cluster the package comes with ``--py-files`` or is installed;
    a folder that does not exist there is ignored.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def durable_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The one the cluster names in ``spark.checkpoint.dir``. Only a local master
    may go without (tests, laptops): a fresh folder is made and named there.
    On any other master executors write to their own disks, so a missing
    setting is an error and no machine-local folder is made up.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="redliner-checkpoint-"))
        named = context.getCheckpointDir()
    return named


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the input and is therefore never collected for a broadcast.

    Spark judges a table by its compressed bytes, which may be a tenth of what
    the driver holds when it builds the broadcast.
    """
    return df.hint("merge")


_WRITTEN: dict[str, list[str]] = {}


def remove_durables(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written so far; returns their number.

    For the end of a job: frames that still read from them can no longer be evaluated.
    """
    jvm = spark.sparkContext._jvm
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def durable(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and read it back.

    The table survives lost executors, and the reader knows its size, so later
    joins with a small result can still be broadcast. ``codec`` names a Parquet
    compression other than the session's.
    """
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/redliner-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense(df: DataFrame) -> DataFrame:
    """``durable`` for wide rows, compressed harder."""
    return durable(df, "zstd")
