"""What the operators share: reading tables, tables written in the cluster's shared folder, chunks of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every operator: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"
#: Rows that a worker looks at together.
BATCH = 1000
#: A word, as Java and Python regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(eq=False)
class _Written:
    """A table of written(), and what deletes it."""

    frame: DataFrame
    path: str
    jvm: object
    conf: object

    def delete(self) -> None:
        place = self.jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.conf).delete(place, True)


_written: list[_Written] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a local master gets a temporary one, kept for the session; on a cluster, whose executors would each write to
    a disk of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="reelscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither repeat its work nor need the executors that did it.

    narrow: rows of a few numbers, of which four tasks a core make enough; spares small tables a file for each shuffle partition.
    The table is deleted by the scratch() around, by drop_written(), or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_clear_at_exit)
        atexit.register(_clear_at_exit)
    frame = spark.read.schema(df.schema)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    found = frame.parquet(path)
    _written.append(_Written(found, path, spark._jvm, spark._jsc.hadoopConfiguration()))
    return found


def _drop(which: Callable[[_Written], bool]) -> None:
    for x in [x for x in _written if which(x)]:
        _written.remove(x)
        x.delete()


def drop_written(*frames: DataFrame) -> None:
    """Deletes these tables of written(). Only for when no result that reads them is still wanted."""
    _drop(lambda x: any(x.frame is f for f in frames))


def _clear_at_exit() -> None:
    """What the process leaves behind is deleted while its JVM still answers; a JVM that is gone can delete nothing."""
    with contextlib.suppress(Exception):
        _drop(lambda x: True)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Gives a list. On leaving, the tables written inside are deleted, but for those put on the list, which the results still read."""
    before, kept = list(_written), []
    yield kept
    _drop(lambda x: not any(x is y for y in before) and not any(x.frame is f for f in kept))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); run gets batches of at most BATCH rows, and a worker returns its memory after each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(big.slice(at, BATCH) for big in batches for at in range(0, max(big.num_rows, 1), BATCH))
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(whole, schema)


def of_process(kind: str, key: tuple, make: Callable):
    """make(*key), made once in this process and kept while it lives.

    Tasks get the functions of this package by value, and the module's variables with them; what a worker makes outlives a task only where
    the process itself keeps it.
    """
    held = sys.modules.setdefault("_reelscope_of_process", types.ModuleType("_reelscope_of_process")).__dict__
    if (kind, key) not in held:
        held[kind, key] = make(*key)
    return held[kind, key]


def crc32_of_id(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_chunks(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, row after the last, their UTF-8 bytes, offsets into these.

    A null counts as an empty text. One longer text is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
