"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring; a key belongs to the arc that ends at the next point clockwise. A shard takes no more
than its bound. First each shard keeps the keys of its own arcs, in ring order, up to the bound; then what is left of each arc
walks clockwise to the next point whose shard has room. So a key leaves its home shard only if that shard is full, and loads are
bounded whatever the hashes do.

Only counts by arc and part of an arc (shards * vnodes * PARTS numbers) reach the driver; the walk yields at most arcs + shards
segments. A row finds its segment by its rank within its arc: the rows of the parts before, and its rank within its part. Rows fall
into parts by a hash of all that tells them apart, so one hot key, as a null one, is ranked in PARTS tasks.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table


#: Parts of an arc that are ranked apart.
PARTS = 64


@dataclass(frozen=True)
class Ring:
    """points: ascending positions (int64); owners: the shard of each."""

    shards: int
    points: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, shards: int, vnodes: int, seed: str) -> Ring:
        found = sorted((int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
        return cls(shards, np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int64))

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, hashes, "left")
        return np.where(at == len(self.points), 0, at)


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """slack 0: exact shares, the first total % shards one larger; otherwise (1 + slack) times the mean, rounded up, for all."""
    if slack:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def segments(ring: Ring, counts: np.ndarray, bound: list[int]) -> list[tuple[int, int, int]]:
    """(arc, shard, rows) for all arcs in ring order; an arc's own share comes first, then what walked on, nearest shard first."""
    room = list(bound)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    left = {}
    for arc, (n, shard) in enumerate(zip(counts.tolist(), ring.owners.tolist(), strict=True)):
        own = min(n, room[shard])
        room[shard] -= own
        if own:
            out[arc].append((arc, shard, own))
        if n > own:
            left[arc] = n - own
    free = {s: np.flatnonzero(ring.owners == s).tolist() for s in range(ring.shards) if room[s]}
    open_points = sorted(p for points in free.values() for p in points)
    for arc, n in left.items():
        while n:
            k = bisect.bisect_right(open_points, arc) % len(open_points)
            shard = int(ring.owners[open_points[k]])
            took = min(n, room[shard])
            out[arc].append((arc, shard, took))
            room[shard] -= took
            n -= took
            if not room[shard]:
                open_points = [p for p in open_points if ring.owners[p] != shard]
    return [x for part in out for x in part]


def shard_rows(rows: DataFrame, key: str, shards: int, vnodes: int = 64, slack: float = 0.0, seed: str = "ring", order_by: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (0, 1, ... within the shard); columns of these names are replaced.

    slack 0 gives counts that differ by one at most; larger values move fewer keys when rows or shards come and go.
    order_by: columns that tell rows of one key apart, so that a rerun gives each the same place.
    Rows of a null key share one point of the ring, as rows of any repeated key do, and spread over shards by the same bound.
    Equal rows are interchangeable. An empty table gives an empty result.
    """
    ring = Ring.of(shards, vnodes, seed)
    points, owners = ring.points, ring.owners

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        at = np.searchsorted(points, h.to_numpy(), "left")
        return pd.Series(np.where(at == len(points), 0, at).astype(np.int32))

    place = F.xxhash64(F.lit(seed), F.col(key))
    part = F.pmod(F.xxhash64(F.lit(f"{seed}/part"), F.col(key), *(F.col(c) for c in order_by)), F.lit(PARTS)).cast("int")
    found = rows.select(arc_of(place).alias("arc"), part.alias("part")).groupBy("arc", "part").count().collect()
    of_part = np.zeros((len(points), PARTS), np.int64)
    for r in found:
        of_part[r["arc"], r["part"]] = r["count"]
    counts = of_part.sum(axis=1)
    part_base = (np.cumsum(of_part, axis=1) - of_part).ravel()
    parts = segments(ring, counts, bounds(int(counts.sum()), shards, slack))
    arc_base = np.concatenate([[0], np.cumsum(counts)])[:-1]
    ends = np.cumsum([n for _, _, n in parts]).astype(np.int64)
    sizes = np.array([n for _, _, n in parts], np.int64)
    shard_of = np.array([s for _, s, _ in parts], np.int64)
    slot_base = np.zeros(len(parts), np.int64)
    filled = [0] * shards
    for i, (_, s, n) in enumerate(parts):
        slot_base[i] = filled[s]
        filled[s] += n

    @F.pandas_udf("shard int, slot long")
    def placed(arc: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        arc, part = arc.to_numpy(), part.to_numpy()
        at = arc_base[arc] + part_base[arc * PARTS + part] + rank.to_numpy() - 1
        k = np.searchsorted(ends, at, "right")
        return pd.DataFrame({"shard": shard_of[k].astype(np.int32), "slot": slot_base[k] + at - (ends[k] - sizes[k])})

    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    order = Window.partitionBy("arc", "part").orderBy("h", *(F.col(f"row.{c}") for c in (key, *order_by)))
    ranked = rows.select(F.struct(*kept).alias("row"), place.alias("h"), part.alias("part")).withColumn("arc", arc_of("h")).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("place", placed("arc", "part", "rank")).select("row.*", "place.shard", "place.slot")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard of 40 and a slot in it for every document, by law `rows`: bounded loads with no slack.

    A null text is of size 16; rows of a null or repeated id share a point of the ring and spread by the bound; an empty table gives
    no row. At this slack a further shard moves about 4 of 100 keys, with slack 0.25 (see shard_rows) about 2.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(docs, "doc_id", shards=40, order_by=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
