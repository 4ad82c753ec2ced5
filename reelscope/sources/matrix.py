"""The store of a single machine, a matrix file and a list of entries, as frames: format("matrix") and its writer.

The file is .npy: a header that names the type and shape, then the rows. A reader's partition is a range of rows, whose place in the file
follows from the header, so partitions read side by side and no task sees the whole. Pickled objects are never read. Files are opened by
the workers, so the path must be one that all of them see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelscope.sources.tables import normalised_metadata

#: Rows that a batch of the reader has, and bytes of a partition where the number of these is not given.
ROWS, BYTES = 4096, 64_000_000


@dataclass(frozen=True)
class Header:
    """What a matrix file's header says: rows, columns, type of a value, and the bytes before the first row."""

    rows: int
    columns: int
    kind: np.dtype
    start: int


def header(path: str) -> Header:
    """The header of a matrix file. A file that is none, is cut short, holds objects, is not of two dimensions or lies column by column is an error."""
    with open(path, "rb") as file:
        try:
            version = np.lib.format.read_magic(file)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
            shape, by_column, kind = read(file)
        except (ValueError, KeyError, EOFError) as wrong:
            raise ValueError(f"{path} is no matrix file: {wrong}") from wrong
        if kind.hasobject or kind.kind != "f" or len(shape) != 2 or (by_column and min(shape) > 1):
            raise ValueError(f"{path} has {kind} of shape {shape}, not rows of floats")
        start = file.tell()
    if os.path.getsize(path) < start + shape[0] * shape[1] * kind.itemsize:
        raise ValueError(f"{path} is shorter than its {shape[0]} rows of {shape[1]}")
    return Header(*shape, kind, start)


@dataclass
class Rows(InputPartition):
    first: int
    end: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, partitions: int | None):
        self.path, self.header = path, header(path)
        self.count = partitions or -(-os.path.getsize(path) // BYTES)

    def partitions(self) -> list[Rows]:
        n = self.header.rows
        cuts = np.linspace(0, n, max(1, min(self.count, n)) + 1).astype(int).tolist()
        return [Rows(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        own = self.header
        with open(self.path, "rb") as file:
            file.seek(own.start + partition.first * own.columns * own.kind.itemsize)
            for at in range(partition.first, partition.end, ROWS):
                n = min(ROWS, partition.end - at)
                values = np.fromfile(file, own.kind, n * own.columns).astype(np.float32 if own.kind.itemsize <= 4 else np.float64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values), own.columns) if own.columns else pa.array([[]] * n, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists.cast(pa.list_(pa.float32() if own.kind.itemsize <= 4 else pa.float64()))], ["idx", "embedding"])


class MatrixSource(DataSource):
    """format("matrix").load(path): idx and embedding of each row; option partitions: ranges of rows (else by size)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return f"idx long, embedding array<{'float' if header(self.options['path']).kind.itemsize <= 4 else 'double'}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("partitions", "0")) or None)


def read_matrix(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """idx and embedding of a matrix file."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("partitions", partitions or 0).load(path)


def read_matrix_store(spark: SparkSession, folder: str, matrix: str = "all_embeddings.npy", metadata: str = "metadata.json") -> DataFrame:
    """idx, embedding, video_id, frame_ms, tar_name: the rows of the matrix with the entries of the metadata (a JSON array), by position.

    A row without an entry is of video "unknown" at 0 ms; entries beyond the rows count for nothing.
    """
    text = spark.read.text(f"{folder}/{metadata}", wholetext=True)
    entries = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "entry"))
    found = normalised_metadata(entries.withColumn("idx", F.col("idx").cast("long")))
    told = read_matrix(spark, f"{folder}/{matrix}").join(found, "idx", "left")
    default = {"video_id": F.lit("unknown"), "frame_ms": F.lit(0).cast("long"), "tar_name": F.lit("")}
    return told.select("idx", "embedding", *(F.coalesce(F.col(c), d).alias(c) for c, d in default.items()))


def write_matrix(frames: DataFrame, path: str) -> None:
    """The embeddings of frames (idx 0, 1, ..., embedding) as a matrix file of 32-bit floats, each partition its own rows in place.

    The driver writes the header and the file's length; no row goes through it. Rows of other lengths than the first, repeated or missing
    idx are an error.
    """
    first = frames.filter("idx = 0").select(F.size("embedding").alias("n")).collect()
    rows, distinct, most, least, longest = frames.agg(F.count("idx"), F.countDistinct("idx"), F.max("idx"), F.min(F.size("embedding")), F.max(F.size("embedding"))).collect()[0]
    columns = first[0]["n"] if first else 0
    if rows and (rows != distinct or most != rows - 1 or not least == longest == columns):
        raise ValueError("frames are not rows 0, 1, ... of one length")
    with open(path, "wb") as file:
        np.lib.format.write_array_header_1_0(file, {"descr": "<f4", "fortran_order": False, "shape": (rows, columns)})
        start = file.tell()
        file.truncate(start + rows * columns * 4)

    def place(batches):
        with open(path, "r+b") as out:
            for batch in batches:
                for idx, vector in zip(batch["idx"], batch["embedding"], strict=True):
                    out.seek(start + idx * columns * 4)
                    out.write(np.asarray(vector, "<f4").tobytes())
        yield pd.DataFrame({"idx": pd.Series([], dtype="int64")})

    frames.select("idx", "embedding").mapInPandas(place, "idx long").write.format("noop").mode("overwrite").save()



def write_entries(frames: DataFrame, path: str) -> None:
    """The entries of frames (idx, video_id, frame_ms) as one JSON array in the order of idx; rows come to the driver a partition at a time, as a stream."""
    entry = F.to_json(F.struct(F.col("idx").alias("index"), "video_id", "frame_ms"))
    with open(path, "w", encoding="utf-8") as out:
        for k, row in enumerate(frames.orderBy("idx").select(entry.alias("entry")).toLocalIterator()):
            out.write(("[" if not k else ",") + "\n" + row["entry"])
        out.write("\n]" if frames.limit(1).count() else "[]")
