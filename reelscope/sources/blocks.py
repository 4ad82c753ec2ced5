"""A store of packed blocks that grows by appending, and the index of its videos.

A store is a folder of versions, each a folder of Parquet with the blocks that an append made, and a log. An append writes the blocks of
the new frames, and again the one or two old blocks that these change: the last, if it was not full, and the one whose neighbours they
are. Its line in the log, written last, says from which block on it counts; earlier versions count below it. So files that are there are
never written again, an append that dies leaves a version that nobody reads, and readers see it whole or not at all. A version's folder
name is its own, so that two attempts never share files.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.config import Retrieval
from reelscope.operators import retrieve
from reelscope.sources.tables import indexed

_LOG = "place int, version string, first_block long, frames long, window int"


class BlockStore:
    """The packed blocks in a folder. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def log(self) -> list[dict]:
        """The appends so far, in order: place, version, first_block, frames (of the store after it), window."""
        if not self._exists(f"{self.path}/log"):
            return []
        return [r.asDict() for r in self.spark.read.schema(_LOG).json(f"{self.path}/log").orderBy("place").collect()]

    def read(self) -> DataFrame:
        """The blocks that count. Each version is read below the first block of the versions after it, which its scan gets as a filter."""
        log = self.log()
        if not log:
            raise FileNotFoundError(f"no store of blocks in {self.path}")
        end, parts = None, []
        for line in reversed(log):
            if end is None or line["first_block"] < end:
                part = self.spark.read.schema(retrieve.BLOCKS).parquet(f"{self.path}/{line['version']}")
                parts.append(part if end is None else part.filter(F.col("block") < end))
                end = line["first_block"]
        whole = parts.pop()
        for part in reversed(parts):
            whole = whole.unionByName(part)
        return whole

    def append(self, frames: DataFrame, window: int = Retrieval.window) -> None:
        """Adds frames (idx, embedding, and video_id if there is one), whose idx go on where the store ends; a new store begins at 0.

        Frames that are not the next ones, each once, are an error, and so is another window than the store's. No frames change nothing.
        """
        log = self.log()
        start = log[-1]["frames"] if log else 0
        if log and log[-1]["window"] != window:
            raise ValueError(f"the store has blocks for a window of {log[-1]['window']}")
        low, high, n, distinct = frames.agg(F.min("idx"), F.max("idx"), F.count("idx"), F.countDistinct("idx")).collect()[0]
        if not n:
            return
        if (low, high, n) != (start, start + n - 1, distinct):
            raise ValueError(f"frames {low} to {high} ({n}, {distinct} distinct) do not go on at {start}")
        first = max(0, (start - window) // retrieve.BLOCK) if start else 0
        if start:
            old = unpacked(self.read().filter(F.col("block") >= first - 1), frames).filter(F.col("idx") >= first * retrieve.BLOCK - window)
            if "video_id" not in frames.columns:
                old = old.drop("video_id")
            frames = old.unionByName(frames.select(*old.columns))
        version = f"blocks-{len(log):06d}-{uuid.uuid4().hex}"
        retrieve.packed(frames, window).filter(F.col("block") >= first).write.parquet(f"{self.path}/{version}")
        line = (len(log), version, first, start + n, window)
        self.spark.createDataFrame([line], _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")


def unpacked(blocks: DataFrame, like: DataFrame) -> DataFrame:
    """idx, embedding (of like's type), video_id of the blocks' own frames."""
    kind = like.schema["embedding"].dataType.simpleString()
    number = np.float64 if "double" in kind else np.float32

    def run(batches):
        for batch in batches:
            for block, idx, raw, videos in batch.itertuples(index=False):
                own = idx // retrieve.BLOCK == block
                vectors = np.frombuffer(raw, number).reshape(len(idx), -1)[own]
                yield pd.DataFrame({"idx": idx[own], "embedding": list(vectors), "video_id": np.asarray(videos, object)[own]})

    return blocks.select("block", "idx", "vectors", "videos").mapInPandas(run, f"idx long, embedding {kind}, video_id string")


def index_of(frames: DataFrame) -> DataFrame:
    """video_id, start, n: where each video's frames stand in the index; the log that appended_index goes by."""
    return frames.groupBy("video_id").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("n"))


def appended_index(files: DataFrame, log: DataFrame) -> DataFrame:
    """files (video_id, frame_file, ...) of videos that are not in the log yet, with idx and frame_ms: by video and file name, behind the frames of the log.

    log: video_id, start, n. Only the new files are numbered, and only the log's greatest end is looked up. If all videos of the log come
    before the new ones by name, the index is that of all files at once.
    """
    end = log.agg(F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0))).collect()[0][0]
    new = files.join(log.select("video_id"), "video_id", "left_anti")
    return indexed(new).withColumn("idx", F.col("idx") + F.lit(end))
