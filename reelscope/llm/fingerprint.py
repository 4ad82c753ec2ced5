"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for two prime moduli, the sum of code point * base ** position up to each place. Two lookups
give any span's hash, independent of where the span lies, so spans of any texts are compared in constant time, and the longest
common extension of two places is found by binary search.

A fingerprint has the length and whole hash of the text and the `KEEP` least of the hashes of all its spans of `WIDTH` code points
(a shorter text is one span). Likeness of two fingerprints estimates from these the share of spans that the texts have in common
(Dice: 1 for equal span sets, about a half for texts that share one half each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, table
from .words import mixed

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WIDTH = 24
KEEP = 64
#: Documents that a block of neighbours aims at, and bounds of blocks that the driver holds (8 bytes each): beyond
#: BLOCK * CUTS documents blocks grow, to 20,000 documents at 2e10.
BLOCK, CUTS = 500, 1_000_000

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grown(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


def power_tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse, at least n of each; grown to the longest text seen."""
    if k not in _tables or len(_tables[k][0]) < n:
        _tables[k] = _grown(BASES[k], PRIMES[k], n), _grown(pow(BASES[k], -1, PRIMES[k]), PRIMES[k], n)
    return _tables[k]


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = len(points)
        self.prefix = []
        for k in (0, 1):
            up, _ = power_tables(k, self.length + 1)
            sums = np.zeros(self.length + 1, np.uint64)
            np.cumsum(points * up[: self.length] % np.uint64(PRIMES[k]), out=sums[1:])
            self.prefix.append(sums % np.uint64(PRIMES[k]))

    def span(self, start: int, end: int) -> int:
        """The 62-bit hash of code points start to end - 1."""
        out = 0
        for k in (0, 1):
            down = power_tables(k, self.length + 1)[1]
            out = out << 31 | (int(self.prefix[k][end]) - int(self.prefix[k][start])) * int(down[start]) % PRIMES[k]
        return out

    def spans(self, width: int) -> np.ndarray:
        """The hashes of all spans of a width, by their start."""
        n = self.length - width + 1
        out = np.zeros(n, np.uint64)
        for k in (0, 1):
            prime = np.uint64(PRIMES[k])
            down = power_tables(k, self.length + 1)[1]
            own = (self.prefix[k][width:] + prime - self.prefix[k][:n]) * down[:n] % prime
            out = out << np.uint64(31) | own
        return out


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The most code points that agree from place i of a and j of b on."""
    low, high = 0, min(a.length - i, b.length - j)
    while low < high:
        middle = (low + high + 1) // 2
        if equal_spans(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def least_spans(hashes: PrefixHashes) -> np.ndarray:
    """The KEEP least mixed span hashes, 40 bits each, ascending and distinct."""
    if not hashes.length:
        return np.zeros(0, np.uint64)
    found = mixed(hashes.spans(min(WIDTH, hashes.length))) >> np.uint64(24)
    if len(found) > 4 * KEEP:
        some = np.unique(np.partition(found, 4 * KEEP)[: 4 * KEEP])
        if len(some) >= KEEP:
            return some[:KEEP]
    return np.unique(found)[:KEEP]


def fingerprint_of(hashes: PrefixHashes, least: np.ndarray) -> str:
    return f"{hashes.length:x}-{hashes.span(0, hashes.length):016x}-" + "".join(f"{x:010x}" for x in least.tolist())


def fingerprint(text: str | None) -> str:
    own = PrefixHashes(text or "")
    return fingerprint_of(own, least_spans(own))


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    either, times = np.unique(np.concatenate([a, b]), return_counts=True)
    both = times[: max(len(a), len(b))] if max(len(a), len(b)) == KEEP else times
    share = float((both == 2).sum()) / len(both)
    return 2 * share / (1 + share)


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone. Equal fingerprints give 1."""
    of = [np.array([int(x[k : k + 10], 16) for k in range(0, len(x), 10)], np.uint64) for x in (a.rpartition("-")[2], b.rpartition("-")[2])]
    return 1.0 if a == b else _likeness(*of)


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) in blocks of adjacent ids, with the first row of the next block at the end of each (tail).

    Block bounds are the ids of the table whose hash is divisible by the documents of a block, so they are spread evenly whatever
    the ids; the last block ends with the first document of all. So each text moves once, and few move twice. A block is sorted
    with spills and streamed. Null ids stand last. Rows of one id stay in one block, by text.
    """
    ids = docs.filter("doc_id is not null")
    aim = max(BLOCK, -(-ids.count() // CUTS))
    low = ids.agg(F.min("doc_id")).collect()[0][0]
    cuts = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(aim)) == 0).select("doc_id").distinct().toArrow().column(0).to_numpy()
    bounds = np.union1d(cuts.astype(np.int64), np.array([] if low is None else [low], np.int64))

    @F.pandas_udf("block int, first boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), max(len(bounds) - 1, 0), np.int32)
        own = ids[known].to_numpy(np.int64)
        at[known] = np.searchsorted(bounds, own, "right") - 1
        first = np.zeros(len(ids), bool)
        first[known] = bounds[at[known]] == own
        return pd.DataFrame({"block": at, "first": first})

    count = max(len(bounds), 1)
    here = F.struct(F.col("at.block").alias("block"), F.lit(False).alias("tail"))
    before = F.struct(((F.col("at.block") + count - 1) % count).alias("block"), F.lit(True).alias("tail"))
    placed = docs.select("doc_id", "text", place("doc_id").alias("at")).select("doc_id", "text", F.explode(F.when(F.col("at.first"), F.array(here, before)).otherwise(F.array(here))).alias("to"))
    placed = placed.select("to.block", "to.tail", "doc_id", "text")
    return placed.repartition("block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_last(), "text")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    """(doc_id, text, next document's text) of the rows that are no tails."""
    held, opening, done = None, "", None
    for batch in batches:
        for block, tail, doc, text in zip(batch.column("block").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if block == done:
                continue
            text = text.as_py() or ""
            if held is not None and held[0] != block:
                yield held[1], held[2], opening
                held = None
            if held is not None:
                yield held[1], held[2], text
            elif not tail:
                opening = text
            if tail:
                held, done = None, block
            else:
                held = (block, doc, text)
    if held is not None:
        yield held[1], held[2], opening


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and common_prefix (of text and edited text).

    A null text is an empty one. A single document is its own next. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        ahead: tuple[str, PrefixHashes, np.ndarray] | None = None
        for doc, text, following in _with_next(batches):
            own = ahead if ahead is not None and ahead[0] == text else None
            if own is None:
                hashes = PrefixHashes(text)
                own = (text, hashes, least_spans(hashes))
            hashes = PrefixHashes(following)
            ahead = (following, hashes, least_spans(hashes))
            changed = edited(text, following)
            other = PrefixHashes(changed)
            least = least_spans(other)
            rows.append(
                (
                    doc,
                    len(text),
                    hashlib.sha256(changed.encode()).hexdigest(),
                    fingerprint_of(own[1], own[2]),
                    fingerprint_of(other, least),
                    1.0 if changed == text else _likeness(own[2], least),
                    1.0 if following == text else _likeness(own[2], ahead[2]),
                    common_extension(own[1], 0, other, 0),
                )
            )
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(neighbours(ids), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    A null text is an empty one; null ids stand behind all others, rows of one id by text; a single document is its own next; an
    empty table gives no row.
    """
    return fingerprinted(table(spark, sf_dir, "documents"))
