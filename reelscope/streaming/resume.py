"""Runs that go on where they stopped: batch resumption by joins, and the same on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def still_open(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks that are not done yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def still_wanted(done: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Earlier results whose task is in the current list."""
    return done.join(tasks.select(key).distinct(), key, "left_semi")


def resumed(tasks: DataFrame, done: DataFrame, work, key: str = "task_id") -> DataFrame:
    """Earlier results that are still wanted, and work() of the tasks left."""
    return still_wanted(done, tasks, key).unionByName(work(still_open(tasks, done, key)))


def thinned_stream(frames: DataFrame, feature: str, bound: float, by: str = "video_id", order: str = "idx") -> DataFrame:
    """by, idx of the frames of a stream that differ by more than bound (largest absolute difference) from the last one that stayed.

    The state of a video is the last feature that stayed. Frames of one micro-batch are put in order; batches must come in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        last = np.asarray(state.get[0]) if state.exists else None
        kept = []
        for at, value in zip(rows[order], rows[feature], strict=True):
            value = np.atleast_1d(np.asarray(value, np.float64))
            if last is None or np.abs(last - value).max() > bound:
                last = value
                kept.append(at)
        state.update((last.tolist(),))
        yield pd.DataFrame({by: [key[0]] * len(kept), order: kept})

    kind = frames.schema[by].dataType.simpleString()
    return frames.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {order} long", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Handles what has arrived, each input once over all runs, and stops. Stopping early keeps what is committed."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stop_on(running: StreamingQuery, wanted: Callable[[], bool], every: float = 1.0) -> bool:
    """Waits for a run to end, and stops it between micro-batches once `wanted` says so; says whether it was stopped. What is committed stays."""
    while not running.awaitTermination(every):
        if wanted():
            running.stop()
            return True
    return False


def signalled(spark: SparkSession, path: str) -> Callable[[], bool]:
    """Whether a file of that name exists, on any file system that Spark knows."""

    def there() -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    return there
