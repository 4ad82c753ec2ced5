"""Videos as rows of sampled frames: format("video"), and a decoder of uncompressed YUV4MPEG2 files (.y4m) that needs NumPy alone.

A reader's partition is one video. Its frames are sought by index, every hop-th one, up to the first that cannot be read; the frames in
between are not touched. Any other decoder of the protocol takes the place of the one here (`reader_of`). Files are opened by the workers,
so the path must be one that all of them see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelscope.sources.images import FrameDecoder

#: Ways of the file format to write colours: how many columns and rows share one value (fixed values of the format).
SHARED = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}
#: Red, green and blue of 8-bit studio-range luma (from 16), blue and red difference (from 128), by ITU-R BT.601 (fixed values).
COLOURS = ((1.164, 0.0, 1.596), (1.164, -0.392, -0.813), (1.164, 2.017, 0.0))
FRAME = b"FRAME\n"


@dataclass(frozen=True)
class Shape:
    """What a file's first line says, and where its frames are."""

    width: int
    height: int
    rate: Fraction
    colours: str
    start: int
    frames: int

    @property
    def chroma(self) -> tuple[int, int]:
        """Height and width of a plane of colour differences; 0 by 0 where there is none."""
        if SHARED[self.colours] is None:
            return 0, 0
        across, down = SHARED[self.colours]
        return -(-self.height // down), -(-self.width // across)

    @property
    def size(self) -> int:
        """Bytes of a frame, without the line before it."""
        return self.width * self.height + 2 * self.chroma[0] * self.chroma[1]


def shape_of(path: str) -> Shape | None:
    """The shape of a .y4m file; None if it is none, has no frame rate, or writes colours in a way that is not read here."""
    try:
        with open(path, "rb") as file:
            line = file.readline(4096)
    except OSError:
        return None
    words = line.decode("latin-1").split()
    if not line.endswith(b"\n") or not words or words[0] != "YUV4MPEG2":
        return None
    told = {w[0]: w[1:] for w in words[1:]}
    try:
        width, height = int(told["W"]), int(told["H"])
        over, under = map(int, told["F"].split(":"))
    except (KeyError, ValueError):
        return None
    colours = told.get("C", "420jpeg")
    if min(width, height, over, under) < 1 or colours not in SHARED:
        return None
    own = Shape(width, height, Fraction(over, under), colours, len(line), 0)
    return Shape(width, height, own.rate, colours, own.start, (os.path.getsize(path) - own.start) // (len(FRAME) + own.size))


def pixels_of(raw: bytes, own: Shape) -> np.ndarray:
    """Height by width by blue, green, red, 8 bits."""
    n, (rows, columns) = own.width * own.height, own.chroma
    luma = np.frombuffer(raw, np.uint8, n).reshape(own.height, own.width).astype(np.float64) - 16
    planes = [luma, np.zeros_like(luma), np.zeros_like(luma)]
    if rows:
        across, down = SHARED[own.colours]
        for k in (0, 1):
            plane = np.frombuffer(raw, np.uint8, rows * columns, n + k * rows * columns).reshape(rows, columns).astype(np.float64) - 128
            planes[k + 1] = plane.repeat(down, 0).repeat(across, 1)[: own.height, : own.width]
    red, green, blue = (sum(w * p for w, p in zip(weights, planes, strict=True)) for weights in COLOURS)
    return np.clip(np.rint(np.stack([blue, green, red], 2)), 0, 255).astype(np.uint8)


class Y4mDecoder:
    """Reads .y4m files; the encoded image of a frame is a binary PPM."""

    def open(self, path: str) -> tuple[float, int] | None:
        own = shape_of(path)
        return (float(own.rate), own.frames) if own else None

    def frame(self, path: str, index: int) -> tuple[bytes, np.ndarray] | None:
        own = shape_of(path)
        if own is None or not 0 <= index < own.frames:
            return None
        with open(path, "rb") as file:
            file.seek(own.start + index * (len(FRAME) + own.size))
            if file.read(len(FRAME)) != FRAME:  # frames with settings of their own are of another length, so what follows cannot be sought
                return None
            raw = file.read(own.size)
        if len(raw) < own.size:
            return None
        pixels = pixels_of(raw, own)
        return b"P6\n%d %d\n255\n" % (own.width, own.height) + pixels[:, :, ::-1].tobytes(), pixels


@dataclass
class Video(InputPartition):
    path: str


class VideoReader(DataSourceReader):
    def __init__(self, root: str, ending: str, interval: float, decoder: FrameDecoder):
        self.root, self.ending, self.interval, self.decoder = root, ending, interval, decoder

    def partitions(self) -> list[Video]:
        found = [self.root] if os.path.isfile(self.root) else [os.path.join(d, f) for d, _, files in os.walk(self.root) for f in files if f.endswith(self.ending)]
        return [Video(p) for p in sorted(found)]

    def read(self, partition: Video) -> Iterator[tuple]:
        if not isinstance(partition, Video):  # a folder without videos
            return
        opened = self.decoder.open(partition.path)
        hop = round(opened[0] * self.interval) if opened else 0
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for index in range(0, opened[1], hop) if hop >= 1 else ():
            found = self.decoder.frame(partition.path, index)
            if found is None:
                return
            height, width = found[1].shape[:2]
            yield name, partition.path, index, int(index / opened[0] * 1000), height, width, bytearray(found[0]), bytearray(found[1].tobytes())


class VideoSource(DataSource):
    """format("video").load(folder or file): video_id (the file's name), path, frame_index, frame_ms, height, width, content (the encoded image), pixels (blue, green, red by row).

    Options: interval, seconds between frames (1.0); ending, of the files to read (.y4m). Files that cannot be opened, or whose rate is too
    low for a hop of a frame, give no row.
    """

    decoder: FrameDecoder = Y4mDecoder()

    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return "video_id string, path string, frame_index long, frame_ms long, height int, width int, content binary, pixels binary"

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options["path"], self.options.get("ending", ".y4m"), float(self.options.get("interval", "1.0")), self.decoder)


def reader_of(plugged: FrameDecoder, called: str = "video") -> type[VideoSource]:
    """A source of the name `called` that reads with another decoder, which must give pixels."""

    class Plugged(VideoSource):
        decoder = plugged

        @classmethod
        def name(cls) -> str:
            return called

    return Plugged


def read_videos(spark: SparkSession, root: str, interval: float = 1.0, source: type[VideoSource] = VideoSource, ending: str = ".y4m") -> DataFrame:
    """The sampled frames of all videos under root."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("interval", interval).option("ending", ending).load(root)
