"""A table to which each micro-batch of a stream is added once, however often it is run.

Structured Streaming gives foreachBatch each batch at least once: one that was written when its run died comes again. Here an attempt
writes its rows to a folder of its own, and then creates an empty file whose name is all that the commit says: the run, the batch and the
folder. Readers take, for each batch, the first attempt by name that was committed, and look at no other folder. So an attempt that dies
leaves nothing to be seen, one that comes after a commit is left out, and of two attempts at the same time that both commit one counts.
Nothing is renamed or overwritten, so any store will do that shows a file when it was created.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelscope.streaming.resume import still_open


class OnceTable:
    """The table in a folder; schema is that of its rows. Any number of runs may write, each under a name of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _listed(self, name: str) -> list:
        files, place = self._place(name)
        return list(files.listStatus(place)) if files.exists(place) else []

    def batches(self) -> dict[tuple[str, int], str]:
        """The folder that counts for each committed batch (run, number)."""
        found: dict[tuple[str, int], str] = {}
        for name in sorted(x.getPath().getName() for x in self._listed("committed")):
            run, batch, folder = name.split(".")
            found.setdefault((run, int(batch)), folder)
        return found

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        folders = [f"{self.path}/rows/{f}" for f in self.batches().values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, run: str, batch: int) -> bool:
        """Adds the rows of a batch, unless the batch is there; says whether it added them."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
            raise ValueError(f"the name of a run is of letters, digits, _ and -, not {run!r}")
        if (run, batch) in self.batches():
            return False
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{folder}")
        self._commit(run, batch, folder)
        return True

    def _commit(self, run: str, batch: int, folder: str) -> None:
        files, place = self._place(f"committed/{run}.{batch:012d}.{folder}")
        files.create(place, False).close()

    def clean(self, older_than: float = 86400.0) -> int:
        """Deletes the folders that no batch counts and nobody has written to for so many seconds; says how many."""
        counted, gone = set(self.batches().values()), 0
        for found in self._listed("rows"):
            place = found.getPath()
            if place.getName() not in counted and found.getModificationTime() / 1000 < time() - older_than:
                gone += bool(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True))
        return gone


def work_once(stream: DataFrame, table: OnceTable, run: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Adds work(batch) to the table for each micro-batch of a stream, once, and stops when all that has arrived is done.

    With a key (of the stream and of the table's rows), work gets each key once: not those that the table has, and of rows of a batch
    that share a key any one. A batch that comes again is not worked on again if it was committed.
    """

    def add(rows: DataFrame, batch: int) -> None:
        if (run, batch) in table.batches():
            return
        if key:
            rows = still_open(rows.filter(F.col(key).isNotNull()).dropDuplicates([key]), table.read(), key)
        table.add(work(rows), run, batch)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
