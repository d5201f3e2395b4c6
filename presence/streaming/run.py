"""Starting streams with their state and output on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def start(
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = True,
    interval: str = "10 seconds",
    idle_batches: bool = True,
) -> StreamingQuery:
    """Start a stream into ``folder``/out (or a batch function) with its
    checkpoint beside it. The state store keeps state off the JVM heap.
    Event-time streams need a batch without input to close their last windows;
    one whose state expires by the clock would ask for them for ever, so it
    ends with its input (``idle_batches`` false)."""
    spark = stream.sparkSession
    settings = {STATE_STORE: ROCKSDB, IDLE: str(idle_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        if each_batch is not None:
            return writer.foreachBatch(each_batch).start()
        return writer.format("parquet").option("path", f"{folder}/out").start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(stream: DataFrame, folder: str, **kwargs) -> DataFrame:
    """Process everything available now and read the output back."""
    query = start(stream, folder, **kwargs)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
