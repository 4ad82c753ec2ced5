"""Streams whose batches come out of order, twice, or to an end halfway."""

import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reelscope.operators.thinning import absolute, one_minus_dot, thin
from reelscope.streaming.late import rocks, thinned_late
from reelscope.streaming.once import OnceTable, work_once
from reelscope.streaming.resume import run_available

KIND = "video_id string, idx long, x array<double>, done boolean"


class Arrivals:
    def __init__(self, spark, path, kind=KIND):
        self.spark, self.path, self.kind, self.n = spark, str(path), kind, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.parquet(f"{self.path}/in/{self.n:03d}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.kind).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, *how, **more):
        with rocks(self.spark):
            query = run_available(thinned_late(self.stream(), "x", *how, **more), f"{self.path}/out", f"{self.path}/state")
        assert query.awaitTermination(120)
        return sorted((tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").collect()), key=lambda r: (r[0] or "", r[1]))


@pytest.mark.parametrize("distance,bound", [(absolute, 0.7), (one_minus_dot, 0.9)])
def test_shuffled_batches_give_what_ordered_frames_give(spark, tmp_path, distance, bound):
    own, late, n = np.random.default_rng(5), 12, 60
    arrivals, wanted = Arrivals(spark, tmp_path), []
    videos = {name: own.normal(size=(n + k, 3)) for k, name in enumerate(("a", "b", "c"))}
    for name, vectors in videos.items():
        wanted += [(name, 2 * k, False) for k in thin(vectors, bound, distance)]
    order = {name: np.argsort(np.arange(len(v)) + own.uniform(0, late / 2, len(v))) for name, v in videos.items()}
    for start in range(0, n + 2, 9):
        rows = [(name, 2 * int(k), videos[name][k].tolist(), False) for name in videos for k in order[name][start : start + 9]]
        arrivals.add([rows[i] for i in own.permutation(len(rows))])
    arrivals.add([(name, None, None, True) for name in videos])
    assert arrivals.run(bound, 2 * late, distance, end="done") == wanted


def test_late_repeated_and_closed(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path)
    arrivals.add([("v", 2, [13.0], None), ("v", 0, [0.0], None), ("v", 5, [38.0], None), ("w", 7, [1.0], None), ("v", None, [9.0], None), (None, 3, [1.0], None)])
    assert arrivals.run(12.0, 3, end="done") == [("v", 0, False), ("v", 2, False)]
    arrivals.add([("v", 1, [12.0], False), ("v", 3, [25.0], False), ("v", 4, [26.0], False), ("v", 4, [26.0], False), ("v", 5, [38.0], False)])
    arrivals.add([("v", 9, [0.0], True), ("w", 9, [2.0], False)])
    assert arrivals.run(12.0, 3, end="done") == [("v", 0, False), ("v", 1, True), ("v", 2, False), ("v", 4, False)]
    arrivals.add([("v", 10, [500.0], False), ("w", None, None, True), (None, None, None, True)])
    got = arrivals.run(12.0, 3, end="done")
    assert sorted(set(got) - {("v", 0, False), ("v", 1, True), ("v", 2, False), ("v", 4, False)}, key=str) == [("v", 10, True), ("w", 7, False), (None, 3, False)]


def test_earlier_runs_are_gone_on_from(spark, tmp_path):
    kept = spark.createDataFrame([("v", 3, [0.0]), ("v", 7, [10.0]), ("w", None, [1.0])], "video_id string, idx long, x array<double>")
    arrivals = Arrivals(spark, tmp_path)
    arrivals.add([("v", 8, [11.0], False), ("v", 9, [0.0], False), ("v", 7, [10.0], False), ("w", 1, [5.0], False), ("v", None, None, True), ("w", None, None, True)])
    assert arrivals.run(5.0, 4, end="done", kept=kept) == [("v", 7, True), ("v", 9, False), ("w", 1, False)]


def test_a_silent_video_is_decided(spark, tmp_path):
    arrivals = Arrivals(spark, tmp_path)
    arrivals.add([("v", 2, [2.0], False), ("v", 1, [0.0], False), ("v", 3, [2.0], False)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with rocks(spark):
        writer = thinned_late(arrivals.stream(), "x", 1.0, 50, quiet=500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        running = writer.trigger(processingTime="200 milliseconds").start()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    try:
        until, got = time.time() + 60, []
        while len(got) < 2 and time.time() < until and running.isActive:
            time.sleep(0.5)
            got = sorted(tuple(r) for r in spark.read.schema("video_id string, idx long, late boolean").parquet(f"{tmp_path}/out").collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        running.stop()
    assert got == [("v", 1, False), ("v", 2, False)]


RESULTS = "task_id string, n long"
TASKS = "task_id string, query string"


def _work(batch):
    return batch.select("task_id", F.length("query").cast("long").alias("n"))


@pytest.mark.parametrize("dies", ["before the commit", "after the commit", "while writing"])
def test_a_batch_that_runs_twice_counts_once(spark, tmp_path, monkeypatch, dies):
    arrivals, table = Arrivals(spark, tmp_path, TASKS), OnceTable(spark, f"{tmp_path}/results", RESULTS)
    arrivals.add([("1", "a"), ("2", "bb")])
    arrivals.add([("3", "ccc"), ("2", "bb")])
    commit, runs = OnceTable._commit, []

    def dying(self, run, batch, folder):
        runs.append(batch)
        if dies == "after the commit" or len(runs) != 2:
            commit(self, run, batch, folder)
        if len(runs) == 2:
            raise RuntimeError("lost")

    def work(batch):
        if dies == "while writing" and not runs:
            runs.append(None)
            return _work(batch).withColumn("n", F.col("n") + F.raise_error(F.lit("lost")).cast("long"))
        return _work(batch)

    if dies != "while writing":
        monkeypatch.setattr(OnceTable, "_commit", dying)
    start = lambda: work_once(arrivals.stream(), table, "run", work, f"{tmp_path}/state")
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    assert len(table.batches()) == {"before the commit": 1, "after the commit": 2, "while writing": 0}[dies]
    assert start().awaitTermination(120)
    assert sorted(tuple(r) for r in table.read().collect()) == [("1", 1), ("2", 2), ("2", 2), ("3", 3)]
    folders = len(list((tmp_path / "results" / "rows").iterdir()))
    assert folders - len(table.batches()) == (dies != "after the commit")
    assert table.clean(3600.0) == 0 and table.clean(-60.0) == (dies != "after the commit")
    assert table.read().count() == 4 and table.clean(-60.0) == 0


def test_two_attempts_that_both_commit(spark, tmp_path):
    table = OnceTable(spark, f"{tmp_path}/t", RESULTS)
    assert table.read().count() == 0 and table.clean() == 0
    rows = spark.createDataFrame([("1", 1)], RESULTS)
    assert table.add(rows, "r", 0) and not table.add(rows, "r", 0) and table.add(rows, "other", 0) and table.add(rows.limit(0), "r", 1)
    rows.write.parquet(f"{tmp_path}/t/rows/0000")
    table._commit("r", 0, "0000")
    assert table.read().count() == 2 and table.batches()[("r", 0)] == "0000"
    with pytest.raises(ValueError):
        table.add(rows, "a.b", 0)


def test_each_key_once(spark, tmp_path):
    arrivals, table = Arrivals(spark, tmp_path, TASKS), OnceTable(spark, f"{tmp_path}/results", RESULTS)
    arrivals.add([("1", "a"), ("2", "bb"), ("2", "bb"), (None, "x")])
    arrivals.add([("3", "ccc"), ("2", "bbbb")])
    assert work_once(arrivals.stream(), table, "first", _work, f"{tmp_path}/state", "task_id").awaitTermination(120)
    assert sorted(tuple(r) for r in table.read().collect()) == [("1", 1), ("2", 2), ("3", 3)]
    assert work_once(arrivals.stream(), table, "again", _work, f"{tmp_path}/another", "task_id").awaitTermination(120)
    assert table.read().count() == 3 and len(table.batches()) == 4
