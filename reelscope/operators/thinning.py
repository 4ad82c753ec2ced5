"""Sampling of frames, and thinning by change: a frame stays if it differs enough from the last one that stayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.histograms import BINS
from reelscope.functions.text import frame_file, hop, milliseconds


def sampled(videos: DataFrame, interval: float) -> DataFrame:
    """video_id, frame_index, frame_ms, frame_file: every hop-th frame of each video (video_id, fps, frames).

    Videos without frames, or whose hop is 0, give no row.
    """
    step = hop(F.col("fps"), interval)
    usable = videos.withColumn("hop", step).filter((F.col("frames") > 0) & (F.col("hop") > 0))
    rows = usable.select("video_id", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1, F.col("hop").cast("long"))).alias("frame_index"))
    ms = milliseconds(F.col("frame_index"), F.col("fps"))
    return rows.select("video_id", "frame_index", ms.alias("frame_ms"), frame_file(ms).alias("frame_file"))


def until_failure(frames: DataFrame, read: str) -> DataFrame:
    """Rows of each video before the first one whose column `read` is null."""
    broken = F.min(F.when(F.col(read).isNull(), F.col("frame_index"))).over(Window.partitionBy("video_id"))
    return frames.withColumn("broken", broken).filter(F.col("broken").isNull() | (F.col("frame_index") < F.col("broken"))).drop("broken")


def thin(features: np.ndarray, bound: float, distance: Callable[[np.ndarray, np.ndarray], float]) -> list[int]:
    """Places that stay, in order: the first, then each whose distance to the last one that stayed exceeds the bound."""
    kept: list[int] = []
    for k in range(len(features)):
        if not kept or distance(features[kept[-1]], features[k]) > bound:
            kept.append(k)
    return kept


def absolute(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a - b).max())


def one_minus_dot(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - float(np.dot(a, b))


#: Where the overlapping tiles of a 128-by-128 image start, on either axis, and their side.
TILES, TILE_SIDE = (0, 32, 64), 64


def tiles_over(place: Column) -> Column:
    """The starts of the tiles that cover a place of one axis, as an array."""
    return F.filter(F.array(*map(F.lit, TILES)), lambda o: (place >= o) & (place < o + TILE_SIDE))


def tile_histograms(h: np.ndarray, s: np.ndarray, v: np.ndarray, dark: float = 40.0, grey: float = 20.0) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """For the nine overlapping 64-by-64 tiles of a 128-by-128 image: brightness histogram, hue-saturation histogram, night."""
    out = []
    for y in TILES:
        for x in TILES:
            cut = slice(y, y + TILE_SIDE), slice(x, x + TILE_SIDE)
            of_v = np.bincount((v[cut].ravel().astype(np.int64) * BINS) // 256, minlength=BINS).astype(np.float64)
            place = (h[cut].ravel().astype(np.int64) * BINS) // 180 * BINS + (s[cut].ravel().astype(np.int64) * BINS) // 256
            out.append((of_v, np.bincount(place, minlength=BINS * BINS).astype(np.float64), bool(v[cut].mean() < dark or s[cut].mean() < grey)))
    return out


def histogram_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Bhattacharyya distance after scaling both to 0 to 1."""
    scale = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.zeros_like(x)
    a, b = scale(a), scale(b)
    mass = float(a.sum() * b.sum())
    return float(np.sqrt(max(0.0, 1.0 - (float(np.sqrt(a * b).sum()) / np.sqrt(mass) if mass > 0 else 0.0))))


def image_distance(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The largest tile distance of two (hue, saturation, value) images; whether b's tile is dark picks the histogram."""
    best = 0.0
    for (va, hsa, _), (vb, hsb, night) in zip(tile_histograms(*a), tile_histograms(*b), strict=True):
        best = max(best, histogram_distance(va, vb) if night else histogram_distance(hsa, hsb))
    return best


def thinned(frames: DataFrame, order: str, feature: str, bound: float, distance: Callable[[np.ndarray, np.ndarray], float], by: str = "video_id") -> DataFrame:
    """frames with kept, decided within each video in order.

    Rows stream through a worker sorted, with one kept feature as state, so a video of any length needs no memory of its own.
    """
    kinds = frames.withColumn("kept", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, last = object(), None
        for batch in batches:
            kept = []
            for name, value in zip(batch[by], batch[feature], strict=True):
                value = np.atleast_1d(np.asarray(value, np.float64))
                if last is None or name != video or distance(last, value) > bound:
                    video, last = name, value
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch.assign(kept=kept)

    return frames.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, kinds)
