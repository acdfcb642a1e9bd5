"""Session settings, table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on.

    Timestamps are instants in UTC everywhere; parquet timestamps without a
    zone are read as UTC instants so that range filters still reach the scan.
    """
    # Python workers find the package where the driver has it; elsewhere it is shipped with the job.
    home, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # What a Python worker holds of large pages or texts follows their size, not only their number.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "curator") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel(os.environ.get("CURATOR_LOG", "FATAL"))
    return configure(spark)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, several tasks each: for costly expressions over a table of few and small files."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows of the largest table dealt by `dealt` that go to one task.
_TASK_ROWS = 250_000


def dealt(key: str, *tables: DataFrame) -> list[DataFrame]:
    """`tables` dealt by `key` over as many tasks as the rows of the largest of them need.

    Joins and groups by the key that follow hold a bounded number of rows in a task, however well the rows compress:
    Spark by itself sizes tasks by the compressed bytes, within a fixed number of them.
    """
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-max(t.count() for t in tables) // _TASK_ROWS))
    return [t.repartition(tasks, key) for t in tables]


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is done by a shuffle, however small `df` is.

    A broadcast passes its side through the driver. That is cheap once, but not in each of many joins and rounds over
    tables that grow with the input.
    """
    return df.hint("merge")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir`.

    Where that is unset, a local session gets a temporary folder of its own, which goes when Python ends; on a cluster
    executors would not see it, so the setting is required there.
    """
    global _local_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[[^\]]*\])?$", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_scratch is None or not os.path.isdir(_local_scratch):
        _local_scratch = tempfile.mkdtemp(prefix="curator-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where an iterative operator must cut its lineage or where one costly
    input is read several times; the files survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
