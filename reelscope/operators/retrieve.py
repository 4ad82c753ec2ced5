"""The core query: score every frame for every task, with a bonus from its neighbours, and keep each task's best.

Frames are scored in blocks of the index. A packed block is one row: its frames and `window` rows of its neighbours on both sides, so
its scores need nothing else. A store that is written as packed blocks (`write_blocks`) is scanned without a shuffle; other frames are
packed on the way, which moves each vector once. A worker multiplies a block with a tile of task vectors at a time; the neighbours'
maxima are array work. It keeps one bounded list a task over all its blocks, and only that leaves it: at most `candidates` rows a task and
partition, of score 0 only those of the last `candidates` frames, which fill a list that is too short. So what is shuffled does not grow
with frames times tasks, and ranking takes one exchange.

What cannot be among the best is not multiplied. A packed block has a summary: for each strip of STRIP frames a centre and the greatest
distances from it of the strip's frames, and of these with their neighbours. By Cauchy and Schwarz, a frame's product with a task is at
most the centre's plus that distance times the task's length, and so a strip's scores have an upper bound. Strips that stay at or below
the threshold score 0 whatever is in them; strips below the last score of a full list cannot enter it. The lists of written blocks start
with a bound: the blocks of the highest upper bounds are scored first, and the last score of a task's list over them is below nothing
that the full list can lose. All bounds are exact: vectors that are not finite have none, and are always multiplied.

The task vectors go to every worker, and each keeps a list for each task. Both are counted first: beyond `MOST_TASK_BYTES` the tasks are
scored in turn, in slices of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.config import Retrieval
from reelscope.functions.vectors import first_or_null

#: Frames of a block.
BLOCK = 2048
#: Tasks that one product takes.
TILE = 64
#: Frames of a strip, which has a summary of its own.
STRIP = 64
#: Blocks of each task that are scored first, to start its list with a bound.
FIRST = 2
#: Bytes that the task vectors of one scoring, and the lists of their best frames, may take in a worker.
MOST_TASK_BYTES = 256_000_000


def neighbour_max(raw: np.ndarray, window: int, ahead: bool, videos: np.ndarray | None = None) -> np.ndarray:
    """For each row the largest of the `window` rows before it (ahead: after it), 0 where there is none. NaN wins over numbers.

    raw may have a column for each task. videos: rows of another video do not count.
    """
    out = np.full(raw.shape, -np.inf)
    for k in range(1, min(window, len(raw) - 1) + 1):
        here, there = (slice(None, -k), slice(k, None)) if ahead else (slice(k, None), slice(None, -k))
        near = raw[there]
        if videos is not None:
            same = videos[there] == videos[here]
            near = np.where(same if raw.ndim == 1 else same[:, None], near, -np.inf)
        out[here] = np.maximum(out[here], near)
    out[np.isneginf(out)] = 0.0
    return out


def combined(main: np.ndarray, before: np.ndarray, after: np.ndarray, how: Retrieval) -> np.ndarray:
    """Scores from similarities and the neighbours' maxima, which are 0 where a task has no such context."""
    bonus = 1.0 + how.before * np.maximum(before - how.threshold, 0.0) + how.after * np.maximum(after - how.threshold, 0.0)
    return np.maximum(main - how.threshold, 0.0) ** 2 * bonus


def fused(main: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, videos: np.ndarray | None, how: Retrieval) -> np.ndarray:
    """Scores of frames in index order from raw similarities."""
    pooled = [np.zeros(main.shape) if raw is None else neighbour_max(raw, how.window, ahead, videos) for raw, ahead in ((before, False), (after, True))]
    return combined(main, *pooled, how)


def summary(vectors: np.ndarray, own: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each strip of the rows own (the indices of a block's own rows, one run): centre, and greatest distance from it of its rows, and of these with window more on both sides.

    A strip with a value that is not finite has distances that are not, which bound nothing.
    """
    starts = range(int(own[0]), int(own[-1]) + 1, STRIP)
    with np.errstate(all="ignore"):
        centres = np.stack([vectors[a : min(a + STRIP, int(own[-1]) + 1)].astype(np.float64).mean(0) for a in starts]).astype(np.float32)
        spread = lambda c, a, b: np.sqrt(((vectors[max(a, 0) : b].astype(np.float64) - c) ** 2).sum(1)).max()
        ends = [min(a + STRIP, int(own[-1]) + 1) for a in starts]
        radius = np.array([spread(c, a, b) for c, a, b in zip(centres.astype(np.float64), starts, ends, strict=True)])
        reach = np.array([spread(c, a - window, b + window) for c, a, b in zip(centres.astype(np.float64), starts, ends, strict=True)])
    return centres, radius, reach


#: A packed block.
BLOCKS = "block long, idx array<long>, vectors binary, videos array<string>, centres binary, radius array<double>, reach array<double>"


_KINDS = {"block": pa.int64(), "idx": pa.list_(pa.int64()), "vectors": pa.binary(), "videos": pa.list_(pa.string()), "centres": pa.binary(), "radius": pa.list_(pa.float64()), "reach": pa.list_(pa.float64())}


def packed(frames: DataFrame, window: int = Retrieval.window) -> DataFrame:
    """A row for each block of frames (idx, embedding, and video_id if there is one): block, idx, vectors (row by row, as float or double), videos, and the summary: centres, radius, reach.

    Frames without an embedding are left out. A block has at most BLOCK rows and twice `window` more, whatever the table.
    """

    double = frames.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = np.float64 if double else np.float32

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx").combine_chunks()
        flat = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        idx, videos = (pa.array([group.column(c).to_pylist()], _KINDS[t]) for c, t in (("idx", "idx"), ("video_id", "videos")))
        own = np.flatnonzero(group.column("idx").to_numpy() // BLOCK == group.column("block")[0].as_py())
        if not len(own):  # neighbours of frames that are not there
            return pa.table({name: pa.array([], kind) for name, kind in _KINDS.items()})
        centres, radius, reach = summary(flat.reshape(group.num_rows, -1), own, window)
        told = {name: pa.array([value], _KINDS[name]) for name, value in (("centres", centres.tobytes()), ("radius", radius.tolist()), ("reach", reach.tolist()))}
        return pa.table({"block": group.column("block")[:1], "idx": idx, "vectors": pa.array([flat.tobytes()], pa.binary()), "videos": videos, **told})

    here = F.floor(F.col("idx") / BLOCK)
    near = F.array_distinct(F.array(here, F.floor((F.col("idx") - window) / BLOCK), F.floor((F.col("idx") + window) / BLOCK)))
    video = F.col("video_id").cast("string") if "video_id" in frames.columns else F.lit(None).cast("string").alias("video_id")
    placed = frames.filter(F.col("embedding").isNotNull()).select(F.explode(near.cast("array<bigint>")).alias("block"), "idx", F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"), video)
    return placed.groupBy("block").applyInArrow(pack, BLOCKS)


def write_blocks(frames: DataFrame, path: str, window: int = Retrieval.window) -> None:
    """The frame store as packed blocks, made once when frames come in; it serves windows of up to `window` rows."""
    packed(frames, window).write.mode("overwrite").parquet(path)


def _task_rows(tasks: DataFrame, most: int, candidates: int) -> Iterator[list[dict]]:
    """Slices of the tasks' vectors that fit into `most` bytes with their lists of best frames, which grow to twice their length."""
    rows = tasks.select("task_id", "main_vec", first_or_null(F.col("before_vecs")).alias("before"), first_or_null(F.col("after_vecs")).alias("after")).filter(F.col("main_vec").isNotNull())
    part, size = [], 0
    for r in rows.toLocalIterator():
        own = 8 * sum(len(v) for v in (r["main_vec"], r["before"], r["after"]) if v is not None) + 2 * 48 * candidates
        if part and size + own > most:
            yield part
            part, size = [], 0
        part.append(r.asDict())
        size += own
    if part:
        yield part


#: What frames may be ranked by.
RANKED_BY = ("score", "max_before", "max_after")


class Scan:
    """Counts of a scoring: strips times tasks that were multiplied and that were left out, and rows that left the workers. A task that runs twice counts twice."""

    def __init__(self, spark: SparkSession):
        self._counts = {name: spark.sparkContext.accumulator(0) for name in ("multiplied", "skipped", "rows")}

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self._counts[name].add(n)

    def counts(self) -> dict[str, int]:
        return {name: a.value for name, a in self._counts.items()}


def stacked(rows: list[dict]) -> tuple:
    """What Tasks is made of, as lists and arrays, which a broadcast can carry to workers that do not have this package: ids, main, before and after vectors, who has these two."""
    width = len(rows[0]["main_vec"])
    stack = lambda name: np.array([t[name] if t[name] is not None else [0.0] * width for t in rows], np.float64)
    return [t["task_id"] for t in rows], *map(stack, ("main_vec", "before", "after")), *(np.array([t[name] is not None for t in rows]) for name in ("before", "after"))


class Tasks:
    """Vectors of some tasks as matrices (rows of zeros where a task has no such context), and how their frames are ranked."""

    def __init__(self, made: tuple, how: Retrieval, by: str):
        self.ids, self.main, self.before, self.after, self.has_before, self.has_after = made
        self.how, self.by, self.width = how, by, self.main.shape[1]

    def pooled(self, vectors: np.ndarray, videos: np.ndarray | None, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the tasks numbered of: the neighbours' maxima before and after each row."""
        out = []
        for context, has, ahead in ((self.before, self.has_before, False), (self.after, self.has_after, True)):
            best, with_one = np.zeros((len(vectors), len(of))), has[of]
            if with_one.any():
                best[:, with_one] = neighbour_max(vectors @ context[of[with_one]].T, self.how.window, ahead, videos)
            out.append(best)
        return tuple(out)

    def upper(self, centres: np.ndarray, radius: np.ndarray, reach: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Bounds (strips by tasks) that no frame's rank value exceeds, as computed; NaN where there is none."""
        with np.errstate(all="ignore"):
            lengths = np.sqrt((centres**2).sum(1))[:, None]

            def most(context: np.ndarray, far: np.ndarray) -> np.ndarray:
                size = np.sqrt((context[of] ** 2).sum(1))
                return centres @ context[of].T + (far[:, None] + 1e-9 * (lengths + far[:, None])) * size  # and what products are rounded by

            near = [np.where(has[of], np.maximum(most(context, reach), 0.0), 0.0) for context, has in ((self.before, self.has_before), (self.after, self.has_after))]
            if self.by != "score":
                return near[RANKED_BY.index(self.by) - 1]
            how = self.how
            bonus = 1.0 + max(how.before, 0.0) * np.maximum(near[0] - how.threshold, 0.0) + max(how.after, 0.0) * np.maximum(near[1] - how.threshold, 0.0)
            return np.maximum(most(self.main, radius) - how.threshold, 0.0) ** 2 * bonus * (1 + 1e-12)


def ranked(values: np.ndarray) -> np.ndarray:
    """Numbers in the order that Spark ranks these: NaN is more than infinity, which is more than the rest."""
    return np.nan_to_num(values, nan=np.inf, posinf=np.finfo(np.float64).max, neginf=-np.inf)


class BestRows:
    """For each task the best `candidates` rows met so far, by rank value and then by the later index: a list that is cut when it has grown to twice that."""

    def __init__(self, tasks: int, candidates: int, bounds: np.ndarray):
        self.most, self.bounds = candidates, bounds.copy()
        self.rows: list[list[tuple]] = [[] for _ in range(tasks)]
        self.sizes = [0] * tasks

    def add(self, task: int, value: np.ndarray, idx: np.ndarray, *columns: np.ndarray) -> None:
        self.rows[task].append((value, idx, *columns))
        self.sizes[task] += len(idx)
        if self.sizes[task] >= 2 * self.most:
            self.best(task)

    def best(self, task: int) -> tuple | None:
        """The task's list, cut; its last value becomes the bound below which rows need not be added."""
        if not self.rows[task]:
            return None
        columns = tuple(map(np.concatenate, zip(*self.rows[task], strict=True)))
        if self.sizes[task] >= self.most:
            at = np.lexsort((-columns[1], -columns[0]))[: self.most]
            columns = tuple(c[at] for c in columns)
            self.bounds[task] = max(self.bounds[task], columns[0][-1])
        self.rows[task], self.sizes[task] = [columns], len(columns[0])
        return columns


#: Columns of scores.
SCORES = "task_id string, idx long, main double, max_before double, max_after double, score double"


def _unpacked(batch: pa.RecordBatch, k: int, width: int, by_video: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    idx = batch.column("idx")[k].values.to_numpy()
    raw = batch.column("vectors")[k].as_py()
    vectors = np.frombuffer(raw, np.float64 if len(raw) == 8 * width * len(idx) else np.float32).reshape(len(idx), -1)
    return idx, vectors, np.array(batch.column("videos")[k].as_py(), object) if by_video else None


def _summaries(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centres = np.frombuffer(batch.column("centres")[k].as_py(), np.float32).reshape(-1, width).astype(np.float64)
    return centres, *(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("radius", "reach"))


def _batch(task_id: str, columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task_id] * len(columns[0]), pa.string()), *map(pa.array, columns)], SCORES.replace(",", "").split()[::2])


def runs(rows: np.ndarray, window: int) -> list[slice]:
    """The runs of marked rows with `window` rows more on both sides; runs that then meet are one."""
    edges = np.zeros(len(rows) + 1, np.int64)
    at = np.flatnonzero(rows)
    np.add.at(edges, np.maximum(at - window, 0), 1)
    np.add.at(edges, np.minimum(at + window + 1, len(rows)), -1)
    near = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    return [slice(a, b) for a, b in zip(np.flatnonzero(near[1:] & ~near[:-1]).tolist(), np.flatnonzero(near[:-1] & ~near[1:]).tolist(), strict=True)]


def every_score(blocks: DataFrame, rows: list[dict], how: Retrieval) -> DataFrame:
    """task_id, idx, main, max_before, max_after, score of all rows for all tasks."""
    shared = blocks.sparkSession.sparkContext.broadcast(stacked(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, by_video = Tasks(shared.value, how, "score"), how.neighbours == "video"
        for batch in batches:
            for k in range(batch.num_rows):
                idx, vectors, videos = _unpacked(batch, k, tasks.width, by_video)
                mine = idx // BLOCK == batch.column("block")[k].as_py()
                vectors = vectors.astype(np.float64)
                for start in range(0, len(tasks.ids), TILE):
                    of = np.arange(start, min(start + TILE, len(tasks.ids)))
                    main, pooled = vectors @ tasks.main[of].T, tasks.pooled(vectors, videos, of)
                    score = combined(main, *pooled, how)
                    for j, t in enumerate(of):
                        yield _batch(tasks.ids[t], (idx[mine], *(x[mine, j] for x in (main, *pooled, score))))

    return blocks.select("block", "idx", "vectors", *["videos"] * (how.neighbours == "video")).mapInArrow(run, SCORES)


def scored_blocks(blocks: DataFrame, rows: list[dict], how: Retrieval, tail: int, by: str = "score", bounds: dict[str, float] | None = None, scan: Scan | None = None) -> DataFrame:
    """task_id, idx, main, max_before, max_after, score of each partition's best rows for each task.

    Those are the best by `by`, of what is above 0 (or NaN) if that is the score, and what is of index `tail` on. bounds: of a task, what at
    least `candidates` rows of the whole store reach or exceed. scan: counts what is done.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((stacked(rows), np.array([(bounds or {}).get(t["task_id"], -np.inf) for t in rows])))
    told = "centres" in blocks.columns

    def score(own: Tasks, best: BestRows, idx: np.ndarray, vectors: np.ndarray, videos: np.ndarray | None, mine: np.ndarray, of: np.ndarray) -> None:
        """Adds to best what the rows marked mine have for the tasks numbered of."""
        main, pooled = vectors @ own.main[of].T, own.pooled(vectors, videos, of)
        total = combined(main, *pooled, how)
        rank = total if by == "score" else pooled[RANKED_BY.index(by) - 1]
        value = ranked(rank)
        wanted = mine[:, None] & (value >= best.bounds[of])
        if by == "score":
            wanted &= (value > 0) | (idx >= tail)[:, None]
        for j in np.flatnonzero(wanted.any(0)):
            at = np.flatnonzero(wanted[:, j])
            best.add(of[j], value[at, j], idx[at], *(x[at, j] for x in (main, *pooled, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = Tasks(shared.value[0], how, by), shared.value[1]
        best = BestRows(len(own.ids), how.candidates, first)
        for batch in batches:
            for k in range(batch.num_rows):
                idx, raw, videos = _unpacked(batch, k, own.width, how.neighbours == "video")
                mine = idx // BLOCK == batch.column("block")[k].as_py()
                at, vectors = np.flatnonzero(mine), None
                if not len(at):
                    continue
                if told:
                    centres, radius, reach = _summaries(batch, k, own.width)
                    strip = np.full(len(idx), -1)
                    strip[at] = np.arange(len(at)) // STRIP
                    last = np.zeros(len(radius), bool)
                    last[strip[mine & (idx >= tail)]] = True
                for start in range(0, len(own.ids), TILE):
                    of = np.arange(start, min(start + TILE, len(own.ids)))
                    if not told:
                        score(own, best, idx, raw.astype(np.float64), videos, mine, of)
                        continue
                    upper = own.upper(centres, radius, reach, of)
                    idle = upper < best.bounds[of]
                    if by == "score":
                        idle |= (upper <= 0) & ~last[:, None]
                    live, needed = np.flatnonzero(~idle.all(1)), of[~idle.all(0)]
                    if scan is not None:
                        scan.add(multiplied=len(live) * len(needed), skipped=idle.size - len(live) * len(needed))
                    if not len(live):
                        continue
                    vectors = raw.astype(np.float64) if vectors is None else vectors
                    rows = mine & np.isin(strip, live)
                    for part in runs(rows, how.window):
                        score(own, best, idx[part], vectors[part], videos[part] if videos is not None else None, rows[part], needed)
        for t in range(len(own.ids)):
            found = best.best(t)
            if found is not None:
                if scan is not None:
                    scan.add(rows=len(found[0]))
                yield _batch(own.ids[t], found[1:])

    columns = ["block", "idx", "vectors"] + ["videos"] * (how.neighbours == "video") + ["centres", "radius", "reach"] * told
    return blocks.select(*columns).mapInArrow(run, SCORES)


def first_bounds(blocks: DataFrame, rows: list[dict], how: Retrieval, tail: int, by: str) -> dict[str, float]:
    """For each task what `candidates` rows of the store reach: the last value of its list over the blocks of the FIRST highest upper bounds of each task.

    Reads the summaries of all blocks, and the vectors of as many blocks as tasks times FIRST at most.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(stacked(rows))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tasks(shared.value, how, by)
        of = np.arange(len(own.ids))
        place, value = np.zeros((0, len(of)), np.int64), np.zeros((0, len(of)))
        for batch in batches:
            bounds = [own.upper(*_summaries(batch, k, own.width), of).max(0, initial=0.0) for k in range(batch.num_rows)]
            if bounds:
                place = np.concatenate([place, np.repeat(batch.column("block").to_numpy()[:, None], len(of), 1)])
                value = np.concatenate([value, np.nan_to_num(np.array(bounds), nan=np.inf, posinf=np.inf)])
                at = np.argsort(-value, axis=0, kind="stable")[:FIRST]
                place, value = np.take_along_axis(place, at, 0), np.take_along_axis(value, at, 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(of, len(place))), pa.array(place.ravel()), pa.array(value.ravel())], ["task", "block", "upper"])

    top = Window.partitionBy("task").orderBy(F.col("upper").desc(), "block")
    found = blocks.select("block", "centres", "radius", "reach").mapInArrow(highest, "task long, block long, upper double")
    chosen = found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= FIRST).select("block").distinct()
    part = scored_blocks(blocks.join(F.broadcast(chosen), "block", "left_semi"), rows, how, tail, by)  # as many as tasks times FIRST
    order = Window.partitionBy("task_id").orderBy(F.col(by).desc(), F.col("idx").desc())
    last = part.withColumn("place", F.row_number().over(order)).filter(F.col("place") == how.candidates).select("task_id", by).collect()
    return dict(zip([r["task_id"] for r in last], ranked(np.array([r[by] for r in last], np.float64)).tolist(), strict=True))


def _scored(frames: DataFrame, tasks: DataFrame, how: Retrieval, by: str, every: bool, blocks: DataFrame | None, scan: Scan | None = None) -> DataFrame:
    if by not in RANKED_BY:
        raise ValueError(f"frames are ranked by one of {RANKED_BY}")
    if blocks is None:
        places = frames.filter(F.col("embedding").isNotNull()).select("idx")
    else:
        places = blocks.select("block", F.explode("idx").alias("idx")).filter(F.floor(F.col("idx") / BLOCK) == F.col("block")).select("idx")
    last = [r[0] for r in places.orderBy(F.col("idx").desc()).limit(how.candidates).collect()]
    found, store = None, packed(frames, how.window) if blocks is None else blocks
    for rows in _task_rows(tasks, MOST_TASK_BYTES, how.candidates) if last else ():
        if every:
            part = every_score(store, rows, how)
        else:
            bounds = first_bounds(store, rows, how, last[-1], by) if blocks is not None and "centres" in store.columns else None
            part = scored_blocks(store, rows, how, last[-1], by, bounds, scan)
        found = part if found is None else found.unionByName(part)
    return frames.sparkSession.createDataFrame([], SCORES) if found is None else found


def top_frames(frames: DataFrame, tasks: DataFrame, how: Retrieval = Retrieval(), by: str = "score", blocks: DataFrame | None = None, scan: Scan | None = None) -> DataFrame:
    """task_id, rank, idx, score: the best `candidates` frames of each task, by score (or another of RANKED_BY) and then by the later index.

    frames: idx (0, 1, ... in time order), embedding, and video_id if neighbours are by video. tasks: task_id, main_vec, before_vecs,
    after_vecs; only the first vector of either list counts, and a task without main_vec is left out. blocks: the same frames,
    packed for a window as large as how's, which are read instead. scan: counts strips that were multiplied and skipped.
    """
    order = Window.partitionBy("task_id").orderBy(F.col(by).desc(), F.col("idx").desc())
    return _scored(frames, tasks, how, by, False, blocks, scan).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.candidates).select("task_id", "rank", "idx", "score")


def all_scores(frames: DataFrame, tasks: DataFrame, how: Retrieval = Retrieval(), blocks: DataFrame | None = None) -> DataFrame:
    """task_id, idx, main, max_before, max_after, score for all frames and tasks, for audits: its result has a row for each frame and task."""
    return _scored(frames, tasks, how, "score", True, blocks)


def described(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """candidates with video, frame and tar_name of their frame; an unknown frame is of video "unknown" at 0 ms."""
    meta = frames.select("idx", *[c for c in ("video_id", "frame_ms", "tar_name") if c in frames.columns])
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in meta.columns else F.lit(d)
    ms = F.coalesce(F.col("frame_ms"), F.lit(0)).cast("long") if "frame_ms" in meta.columns else F.lit(0).cast("long")
    return candidates.join(meta, "idx", "left").select("task_id", "rank", "idx", "score", text("video_id", "unknown").alias("video"), ms.alias("frame"), text("tar_name", "").alias("tar_name"))
