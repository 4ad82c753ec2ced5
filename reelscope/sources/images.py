"""Images and videos: reading files, decoding and thinning frames, reading the texts that they show."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import perf_counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.config import Sampling
from reelscope.functions.pixels import prepared
from reelscope.functions.text import frame_ms
from reelscope.operators.thinning import image_distance


class FrameDecoder(Protocol):
    def open(self, path: str) -> tuple[float, int] | None:
        """Frames a second and number of frames, or None for a video that cannot be opened."""

    def frame(self, path: str, index: int) -> tuple[bytes, np.ndarray] | tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None:
        """An encoded image and its pixels (height by width by blue, green, red, 8 bits), or its hue, saturation and value at 128 by 128; None where it cannot be read."""


class TextReader(Protocol):
    def read(self, images: list[bytes]) -> list[list[str]]:
        """The texts seen in each image."""


def read_images(spark: SparkSession, root: str, pattern: str = "*.webp") -> DataFrame:
    """video_id (the folder), frame_file, frame_ms, content. Columns that are not asked for are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    name = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)$", k)
    return files.select(name(1).alias("video_id"), name(2).alias("frame_file"), frame_ms(name(2)).alias("frame_ms"), "content")


_EXTRACTED = "video_id string, frame_ms long, frame_file string, content binary, saved long, skipped long"


def extraction(videos: DataFrame, decoder: FrameDecoder, how: Sampling = Sampling()) -> DataFrame:
    """The frames that stay (video_id, frame_ms, frame_file, content), and for each video a last row with its counts saved and skipped.

    videos: video_id, path. A video is sampled every `interval` seconds, up to its first frame that cannot be read; a sampled frame
    stays if it differs by more than `change` from the last one that stayed. Videos that cannot be opened, or have no frame rate,
    give no row, so they are tried again by the next run.
    """
    names = ["video_id", "frame_ms", "frame_file", "content", "saved", "skipped"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                opened = decoder.open(path)
                hop = round(opened[0] * how.interval) if opened else 0
                if hop < 1:
                    continue
                last, rows, saved, skipped = None, [], 0, 0
                for index in range(0, opened[1], hop):
                    found = decoder.frame(path, index)
                    if found is None:
                        break
                    planes = found[1:] if len(found) == 4 else prepared(found[1])
                    if last is not None and image_distance(last, planes) <= how.change:
                        skipped += 1
                        continue
                    last = planes
                    ms = int(index / opened[0] * 1000)
                    rows.append((video, ms, f"frame_{ms:08d}.webp", found[0], None, None))
                    saved += 1
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame([*rows, (video, None, None, None, saved, skipped)], columns=names)

    return videos.select("video_id", "path").mapInPandas(run, _EXTRACTED)


def extracted_frames(videos: DataFrame, decoder: FrameDecoder, how: Sampling = Sampling()) -> DataFrame:
    """The frames alone: video_id, frame_ms, frame_file, content."""
    return extraction(videos, decoder, how).filter("frame_file IS NOT NULL").select("video_id", "frame_ms", "frame_file", "content")


def write_extraction(rows: DataFrame, path: str) -> None:
    """Adds the rows of extraction() to the store at path, frames and completed videos by one committed job, in folders of their own."""
    kind = F.when(F.col("frame_file").isNull(), "completed").otherwise("frames")
    rows.withColumn("kind", kind).write.mode("append").partitionBy("kind").parquet(path)


def read_extracted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The frames (video_id, frame_ms, frame_file, content) and the completed videos (video_id, saved, skipped) of such a store."""
    both = spark.read.schema(f"{_EXTRACTED}, kind string").parquet(path)
    frames = both.filter("kind = 'frames'").select("video_id", "frame_ms", "frame_file", "content")
    return frames, both.filter("kind = 'completed'").select("video_id", "saved", "skipped")


def totals(completed: DataFrame) -> DataFrame:
    """One row: videos, saved, skipped."""
    return completed.agg(F.count(F.lit(1)).alias("videos"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


def timed(rows: DataFrame, write: Callable[[DataFrame], None], name: str = "rate") -> dict[str, float]:
    """rows, seconds and rows a second of write(rows), counted while they are written."""
    from pyspark.sql import Observation

    seen, start = Observation(name), perf_counter()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    seconds = perf_counter() - start
    return {"rows": seen.get["rows"], "seconds": seconds, "rate": seen.get["rows"] / seconds if seconds > 0 else 0.0}


def counted(frames: DataFrame, name: str = "frames") -> tuple[DataFrame, object]:
    """frames, and an observation of how many went by and of how many videos (about), without a second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return frames.observe(seen, F.count(F.lit(1)).alias("saved"), F.approx_count_distinct("video_id").alias("videos")), seen


def texts_seen(candidates: DataFrame, images: DataFrame, reader: TextReader) -> DataFrame:
    """video, frame, texts of the distinct candidates (video, frame) that have an image (video_id, frame_ms, content); each is read once."""
    wanted = candidates.select("video", "frame").distinct()
    found = wanted.join(images.select(F.col("video_id").alias("video"), F.col("frame_ms").alias("frame"), "content"), ["video", "frame"]).filter(F.col("content").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.iloc[at : at + 16]
                yield pd.DataFrame({"video": part["video"], "frame": part["frame"], "texts": reader.read([bytes(x) for x in part["content"]])})

    return found.mapInPandas(run, "video string, frame long, texts array<string>")
