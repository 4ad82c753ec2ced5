"""Thinning of a stream whose frames come out of order, on state that Spark keeps: what a video waits for, and the last frame that stayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from reelscope.operators.thinning import absolute

#: A video that was closed: no frame of it can still be in time.
CLOSED = 2**63 - 1
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which thinned_late needs, and write of it what changed. The session's own settings come back."""
    before = {name: spark.conf.get(name, None) for name in _ROCKS}
    for name, value in _ROCKS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class _Thinner(StatefulProcessor):
    """Per video: how far frames were seen, how far they are decided, the last that stayed, and the frames that wait for earlier ones."""

    def __init__(self, by: str, order: str, bound: float, late: int, quiet: int | None, distance: Callable[[np.ndarray, np.ndarray], float]):
        self.by, self.order, self.bound, self.late, self.quiet, self.distance = by, order, bound, late, quiet, distance

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seen long, decided long, last array<double>, timer long")
        self.waiting = handle.getListState("waiting", "place long, value array<double>")

    def _decided(self, key: tuple, frames: dict[int, list[float]], place: tuple, upto: int, tardy: list[int]) -> pd.DataFrame:
        """Decides the frames up to a place in order, and keeps the rest. tardy: those that came behind their turn, given with late true."""
        seen, decided, last, timer = place
        last = None if last is None else np.asarray(last, np.float64)
        kept = []
        for at in sorted(f for f in frames if f <= upto):
            value = np.asarray(frames.pop(at), np.float64)
            if last is None or self.distance(last, value) > self.bound:
                last = value
                kept.append(at)
        if frames:
            self.waiting.put(list(frames.items()))
        elif self.waiting.exists():
            self.waiting.clear()
        goes_on = last is not None and upto < CLOSED  # of a closed video only that it is closed stays
        self.place.update((seen, max(decided, upto), last.tolist() if goes_on else None, self._timer(timer, bool(frames))))
        rows = [(at, False) for at in kept] + [(at, True) for at in tardy]
        columns = {self.by: [key[0]] * len(rows), self.order: [at for at, _ in rows], "late": [x for _, x in rows]}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})  # Spark joins those of several videos, which must not be in pandas' string type

    def _timer(self, before: int, wanted: bool) -> int:
        """One timer a video, pushed on by each batch that brings frames; 0 is none."""
        if self.quiet is None:
            return 0
        if before:
            self.handle.deleteTimer(before)
        if not wanted:
            return 0
        self.handle.registerTimer(self.now + self.quiet)
        return self.now + self.quiet

    def _state(self) -> tuple[dict[int, list[float]], tuple]:
        place = self.place.get() if self.place.exists() else None
        waits = {at: value for at, value in self.waiting.get()} if self.waiting.exists() else {}
        return waits, tuple(place) if place else (-(2**63), -(2**63), None, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.quiet is not None else 0
        frames, (seen, decided, last, timer) = self._state()
        tardy, closes = [], False
        for batch in rows:
            for at, value, end in zip(batch["place"], batch["value"], batch["end"], strict=True):
                if end:
                    closes = True
                elif at <= decided:
                    tardy.append(int(at))
                else:
                    frames.setdefault(int(at), np.atleast_1d(np.asarray(value, np.float64)).tolist())
                    seen = max(seen, int(at))
        upto = CLOSED if closes else max(decided, seen - self.late)
        yield self._decided(key, frames, (seen, decided, last, timer), upto, tardy)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.now = timerValues.getCurrentProcessingTimeInMs()
        frames, (seen, decided, last, _) = self._state()
        yield self._decided(key, frames, (seen, decided, last, 0), max(decided, seen), [])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        self.place.update((int(first["place"]), int(first["place"]), np.atleast_1d(np.asarray(first["value"], np.float64)).tolist(), 0))

    def close(self) -> None:
        pass


def thinned_late(
    frames: DataFrame, feature: str, bound: float, late: int, distance: Callable[[np.ndarray, np.ndarray], float] = absolute, by: str = "video_id", order: str = "idx",
    end: str | None = None, quiet: int | None = None, kept: DataFrame | None = None,
) -> DataFrame:
    """by, order, late: the frames of a stream that stay, as `thinned` would decide them in order, and with late true those that came too late to be decided.

    A frame is decided when its video has shown one `late` places or more behind it, so batches may bring frames in any order within that
    bound. What waits is decided when the video closes (a row whose column `end` is true, which is no frame itself), or when it has been
    silent for `quiet` milliseconds. Without either, the last `late` places of a video wait for frames to come. A frame that comes again
    while it waits counts once; one at a place that is decided, closed videos' too, is given as late: nothing goes unseen.
    The state of a video is its last kept frame and what waits; once closed, a few numbers.

    kept (by, order, feature): frames that stayed in earlier runs, of which the last of each video is what its first frame here is held
    against. Rows of a null place are left out. Start the query within rocks().
    """
    kind = frames.schema[by].dataType.simpleString()
    value = lambda df: F.col(feature).cast("array<double>") if "array" in df.schema[feature].dataType.simpleString() else F.array(F.col(feature).cast("double"))
    closes = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = frames.select(by, F.col(order).cast("long").alias("place"), value(frames).alias("value"), closes.alias("end")).filter("place is not null or end")
    before = None
    if kept is not None:
        last = kept.select(by, F.col(order).cast("long").alias("place"), value(kept).alias("value")).filter("place is not null")
        before = last.groupBy(by).agg(F.max_by(F.struct("place", "value"), "place").alias("x")).select(by, "x.*").groupBy(by)
    return rows.groupBy(by).transformWithStateInPandas(
        _Thinner(by, order, bound, late, quiet, distance), f"{by} {kind}, {order} long, late boolean", "append", "none" if quiet is None else "processingTime", before
    )
