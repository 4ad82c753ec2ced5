"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

The exact table counts, for each line key, the documents that have it. A shard has the keys of its part of the hash range that
reached `at_least` documents: a cuckoo filter of them, and behind it the keys themselves. Adding or removing documents changes the
counts exactly, inserts the keys that cross the bound upwards and deletes those that cross it downwards, so an index after add and
remove equals one never touched. A shard is small, as their number grows with the keys and lines.

Lines are looked up where the shards are, in one plan for any size. The heavy keys, those with more than 1 / `heavy` of all (line,
document) pairs, are fewer than `heavy` whatever the corpus, so they go to every worker and their lines move nowhere. The other
keys of a document go to their shards, where none of them is more than that share of all; a worker holds one shard, streams the
keys through its filter and looks up in the exact keys what the filter passes. What is found goes back to the documents by a
hash of the row.

A key is 128 bits of the line without white space at its ends, A to Z in lower case. Rows are documents: a repeated row counts
again. A null or empty text is one empty line, which has no key and always stays. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cuckoo import CuckooFilter, Full
from .shared import in_arrow, table, written

STRIPPED = b" \t\n\x0b\f\r"
#: The query's bound.
AT_LEAST = 10
#: Shards at least, and frequent keys and (line, document) pairs of one that their number aims at.
LEAST_SHARDS, SHARD_KEYS, SHARD_PAIRS = 64, 100_000, 20_000_000
#: Keys that every worker gets are fewer than this: 16 bytes each.
HEAVY = 20_000


def line_key(line: bytes) -> bytes:
    """16 bytes, or none for a line of white space."""
    bare = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(bare.lower()) if bare else b""


def keys_of(text: str | None) -> list[bytes]:
    return [line_key(line) for line in (text or "").encode().split(b"\n")]


def _halves(keys: list[bytes]) -> np.ndarray:
    """Rows of two signed 64-bit numbers."""
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


class KeySet:
    """128-bit keys as two sorted arrays: 16 bytes a key."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        self.hi, self.lo = hi[order], lo[order]

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.hi, hi, "left"), np.searchsorted(self.hi, hi, "right")
        out = np.zeros(len(hi), bool)
        one = last - first == 1
        out[one] = self.lo[first[one]] == lo[one]
        for k in np.flatnonzero(last - first > 1):
            out[k] = lo[k] in self.lo[first[k] : last[k]]
        return out


def line_counts(docs: DataFrame) -> DataFrame:
    """hi, lo, n: the documents (rows of docs) that have the line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[bytes] = []
            for text in batch.column("text"):
                own += {k for k in keys_of(text.as_py()) if k}
            both = _halves(own)
            for at in range(0, len(both), 50_000):
                part = both[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], ["hi", "lo"])

    return in_arrow(docs.select("text"), run, "hi long, lo long").groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")


def _shards_for(counts: DataFrame, at_least: int) -> int:
    found = counts.agg(F.count(F.when(F.col("n") >= at_least, 1)).alias("keys"), F.sum("n").alias("pairs")).collect()[0]
    return max(LEAST_SHARDS, -(-found["keys"] // SHARD_KEYS), -(-(found["pairs"] or 0) // SHARD_PAIRS))


_FILTERS = "shard int, filter binary, keys binary"


def _filter_row(shard: int, own: CuckooFilter, hi: np.ndarray, lo: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "filter": [own.to_bytes()], "keys": [np.concatenate([hi, lo]).astype(np.int64).tobytes()]})


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard of the exact keys (hi, lo), and the keys: all hi, then all lo."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (part[c].to_numpy(np.int64) for c in ("hi", "lo"))
        return _filter_row(int(part["shard"].iloc[0]), CuckooFilter.built(lo.view(np.uint64)), hi, lo)

    return keys.select(_shard(shards), "hi", "lo").groupBy("shard").applyInPandas(build, _FILTERS)


def _found(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """uid, hi, lo of the keys (uid, hi, lo) that are in the shards' exact keys; each shard's filter is asked first."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = keys.select(_shard(shards), F.lit(True).alias("asked"), "uid", "hi", "lo", none("binary").alias("filter"), none("binary").alias("keys"))
    shard_rows = filters.select("shard", F.lit(False).alias("asked"), none("long").alias("uid"), none("long").alias("hi"), none("long").alias("lo"), "filter", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, exact = -1, None, None
        for batch in batches:
            shard, asked = batch.column("shard").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | ~asked[1:] | ~asked[:-1])) if len(shard) else []
            for start, end in zip(starts, [*starts[1:], len(shard)], strict=True):
                if not asked[start]:
                    both = np.frombuffer(batch.column("keys")[start].as_py(), np.int64)
                    at, own, exact = shard[start], CuckooFilter.from_bytes(batch.column("filter")[start].as_py()), KeySet(*np.split(both, 2))
                elif shard[start] == at:
                    part = batch.slice(start, end - start)
                    hi, lo = (part.column(c).to_numpy() for c in ("hi", "lo"))
                    hit = np.flatnonzero(own.contains(lo.view(np.uint64)))
                    hit = hit[exact.contains(hi[hit], lo[hit])]
                    if len(hit):
                        yield part.select(["uid", "hi", "lo"]).take(pa.array(hit))

    placed = shard_rows.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "asked")
    return placed.mapInArrow(run, "uid long, hi long, lo long")


@dataclass
class LineIndex:
    """counts (hi, lo, n) and filters (shard, filter, keys), both tables in the shared folder."""

    counts: DataFrame
    filters: DataFrame
    at_least: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, at_least: int = AT_LEAST) -> LineIndex:
        return cls._of(written(line_counts(docs), "line-counts"), at_least)

    @classmethod
    def _of(cls, counts: DataFrame, at_least: int) -> LineIndex:
        shards = _shards_for(counts, at_least)
        return cls(counts, written(_filters(counts.filter(F.col("n") >= at_least), shards), "line-filters"), at_least, shards)

    def add(self, docs: DataFrame) -> LineIndex:
        return self._changed(line_counts(docs))

    def remove(self, docs: DataFrame) -> LineIndex:
        """docs must have been added before, with the same texts."""
        return self._changed(line_counts(docs).withColumn("n", -F.col("n")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        bound = self.at_least
        both = self.counts.withColumn("d", F.lit(0).cast("long")).unionByName(delta.withColumnRenamed("n", "d").withColumn("n", F.lit(0).cast("long")))
        both = written(both.groupBy("hi", "lo").agg(F.sum("n").alias("was"), F.sum(F.col("n") + F.col("d")).alias("n")), "line-changes")
        counts = written(both.filter("n > 0").select("hi", "lo", "n"), "line-counts")
        if _shards_for(counts, bound) > 2 * self.shards:
            return self._of(counts, bound)
        crossed = both.filter((F.col("was") >= bound) != (F.col("n") >= bound)).select(_shard(self.shards), "hi", "lo", (F.col("n") >= bound).alias("up"))
        frequent = counts.filter(F.col("n") >= bound)

        def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = int((old if len(old) else keys)["shard"].iloc[0])
            own = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(keys))
            hi, lo = np.split(np.frombuffer(old["keys"].iloc[0], np.int64), 2) if len(old) else (np.zeros(0, np.int64),) * 2
            of = lambda c, which: keys[c].to_numpy(np.int64)[which]
            up = keys["up"].to_numpy(bool)
            own.delete(of("lo", ~up).view(np.uint64))
            stay = ~KeySet(of("hi", ~up), of("lo", ~up)).contains(hi, lo)
            try:
                own.insert(of("lo", up).view(np.uint64))
            except Full:
                return pd.DataFrame({"shard": [shard], "filter": [b""], "keys": [b""]})
            return _filter_row(shard, own, np.append(hi[stay], of("hi", up)), np.append(lo[stay], of("lo", up)))

        changed = written(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change, _FILTERS), "line-filters")
        full = changed.filter(F.octet_length("filter") == 0).select("shard")
        rebuilt = _filters(frequent.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").select("hi", "lo"), self.shards)
        return LineIndex(counts, written(changed.filter(F.octet_length("filter") > 0).unionByName(rebuilt), "line-filters"), bound, self.shards)

    def kept_lines(self, docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
        """All columns of docs (with doc_id and text) as they came, and n_lines long, n_dropped long, kept_text string.

        A column of docs that has one of these names is replaced, _line_uid and _line_gone too. heavy: see the module.
        """
        pairs = self.counts.agg(F.sum("n")).collect()[0][0] or 0
        often = self.counts.filter((F.col("n") >= self.at_least) & (F.col("n") * heavy > pairs)).select("hi", "lo").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo")))
        base = docs.drop("n_lines", "n_dropped", "kept_text", "_line_uid", "_line_gone")
        columns = base.columns
        made_fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
        # rows of one uid have equal texts, or else share a list of keys all of which are frequent, so that nothing else is dropped
        uid = F.xxhash64("doc_id", "text")

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = KeySet(*shared.value)
            for batch in batches:
                uids, keys = [], []
                for u, text in zip(batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                    own = {k for k in keys_of(text.as_py()) if k}
                    uids += [u] * len(own)
                    keys += own
                both = _halves(keys)
                left = np.flatnonzero(~known.contains(both[:, 0], both[:, 1]))
                out = pa.RecordBatch.from_arrays([pa.array(np.array(uids, np.int64)[left]), pa.array(both[left, 0]), pa.array(both[left, 1])], ["uid", "hi", "lo"])
                for at in range(0, len(left), 50_000):
                    yield out.slice(at, 50_000)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = KeySet(*shared.value)
            for big in batches:
                for start in range(0, big.num_rows, 256):
                    yield dropped(big.slice(start, 256), known)

        def dropped(batch: pa.RecordBatch, known: KeySet) -> pa.RecordBatch:
            texts = [t.as_py() or "" for t in batch.column("text")]
            of_rows = [t.encode().split(b"\n") for t in texts]
            keys = [line_key(x) for lines in of_rows for x in lines]
            gone = np.array([bool(k) for k in keys])
            at = np.flatnonzero(gone)
            both = _halves([keys[k] for k in at])
            gone[at] = known.contains(both[:, 0], both[:, 1])
            ends = np.cumsum([len(lines) for lines in of_rows])
            counts, n_dropped, kept = [], [], []
            for text, lines, end, listed in zip(texts, of_rows, ends, batch.column("_line_gone").to_pylist(), strict=True):
                flags = gone[end - len(lines) : end].tolist()
                if listed:
                    own = {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in listed}
                    flags = [g or k in own for g, k in zip(flags, keys[end - len(lines) : end], strict=True)]
                counts.append(len(lines))
                n_dropped.append(sum(flags))
                kept.append(b"\n".join([x for x, g in zip(lines, flags, strict=True) if not g]).decode() if any(flags) else text)
            made = [pa.array(counts, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, "n_lines", "n_dropped", "kept_text"])

        asked = in_arrow(base.select(uid.alias("uid"), "text"), rare, "uid long, hi long, lo long")
        gone = _found(self.filters, asked, self.shards).distinct().groupBy(F.col("uid").alias("_line_uid")).agg(F.collect_list(F.struct("hi", "lo")).alias("_line_gone"))
        joined = base.withColumn("_line_uid", uid).join(gone, "_line_uid", "left").select(*columns, "_line_gone")
        return in_arrow(joined, drop, T.StructType([*base.schema.fields, *made_fields]))


def dropped_lines(docs: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """LineIndex.kept_lines of docs by the counts of docs."""
    return LineIndex.build(docs, at_least).kept_lines(docs)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after those that ten documents or more share are dropped.

    A null text is one empty line; rows that repeat are documents of their own; an empty table gives no row.
    """
    kept = dropped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
k AS (SELECT r, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS kept
      FROM (SELECT k.*, key IN (SELECT key FROM f) AS gone FROM k) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN o USING (r)
"""
