"""Shared plumbing of the streaming jobs.

Every job runs with `availableNow` by default: it handles what has landed and
stops, which is how the periodic collector works. Results go to parquet tables
in folders given by the caller; stateful results are written per micro-batch
under `batch=<id>`, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table (folder or file pattern) as a stream, with its stored schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _finish(writer, checkpoint: str):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed folds need (column families), for one job."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stateless or deduplicated stream to a parquet table."""
    return _finish(stream.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return _finish(stream.writeStream.foreachBatch(handle).outputMode(mode), checkpoint)


def write_updates(stream: DataFrame, path: str, checkpoint: str):
    """Write the changed rows of a streaming aggregate, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(stream, write, checkpoint, "update")


def latest_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Current rows of a table made by `write_updates`."""
    from curator.operators.windows import latest

    return latest(spark.read.parquet(path), key, ["batch"]).drop("batch")


def previous_state(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """All folders written before `batch_id`; empty at the start."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("batch") < batch_id)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return spark.createDataFrame([], schema)
        raise
