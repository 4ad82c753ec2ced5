"""A quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader.

Features of a text are its words and word pairs, A to Z in lower case, the shape of each word (which kinds of character it has),
and of each word pair whether it repeats its word and whether the text has it again; all hashed into 2 ** 18 columns. A column's
value grows with the logarithm of its count; the vector is scaled to unit length, short ones less, so that a text of two words is
not judged by them alone. A text without words has no feature and scores by the bias alone.

Learning takes at most `most` labelled texts, those of the least hash of their id, in one task on an executor: the features of a
text are a bounded sparse vector by then. Each pass goes over them in a seeded order and updates per coordinate; the rarer label weighs
more, by the square root of its rarity. Scoring is one sparse dot product a text, in the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc32_of_id, in_arrow, table, text_chunks
from .words import IN_WORD, mixed, word_hashes

BITS = 18
#: Labelled texts that a fit takes, at most.
MOST = 6000
#: Steps of learning, at least: a small sample is passed over more often.
UPDATES = 12_000
#: What is added to a vector's squared length before it is scaled by it.
SHORT = 12.0
#: The least score of an accepted text, fixed by the query's contract.
ACCEPTED = 0.3

#: Kinds of byte: lower, upper, digit, other ASCII, start of a longer character.
_KIND = np.full(256, 3, np.uint64)
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
_KIND_BIT = (np.uint64(1) << _KIND).astype(np.uint8)


def _shapes(data: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """For each word, which kinds of byte it has, and its last byte if that is ASCII punctuation."""
    inside = IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, np.flatnonzero(first))
    kinds = np.bitwise_or.reduceat(_KIND_BIT[data[at]], begin) if count else np.zeros(0, np.uint8)
    last = data[at[np.append(begin[1:], len(at)) - 1]] if count else np.zeros(0, np.uint8)
    return kinds.astype(np.uint64) * np.uint64(256) + np.where(_KIND[last] == 3, last, 0).astype(np.uint64)


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, columns, values) for each text with a word."""
    mask = np.uint64(2**BITS - 1)
    for first, last, data, offsets in text_chunks(texts):
        hashes, begin = word_hashes(data, offsets)
        shapes = mixed(_shapes(data, offsets, len(hashes)) + np.uint64(7 << 40))
        pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
        doubled = mixed((hashes[:-1] == hashes[1:]).astype(np.uint64) + np.uint64(8 << 40)) if len(hashes) > 1 else hashes[:0]
        for row in range(last - first):
            a, b = int(begin[row]), int(begin[row + 1])
            if a == b:
                continue
            _, place, times = np.unique(pairs[a : b - 1], return_inverse=True, return_counts=True)
            again = mixed(np.minimum(times[place], 3).astype(np.uint64) + np.uint64(9 << 40))
            columns, counts = np.unique(np.concatenate([hashes[a:b], pairs[a : b - 1], shapes[a:b], doubled[a : b - 1], again]) & mask, return_counts=True)
            values = np.log1p(counts)
            yield first + row, columns.astype(np.int64), values / np.sqrt(np.dot(values, values) + SHORT)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int, seed: int) -> np.ndarray:
        """Weights; the last one is the bias, the labels' own log-odds, which is not learned."""
        size = 2**BITS + 1
        z, n = np.zeros(size), np.zeros(size)
        good = int((labels == 1).sum())
        bias = float(np.clip(np.log(max(good, 1) / max(len(labels) - good, 1)), -3, 3)) if 0 < good < len(labels) else 0.0
        of_label = {v: np.sqrt(len(labels) / (2 * max(1, int((labels == v).sum())))) for v in (0, 1)}
        rng = np.random.default_rng(seed)
        for _ in range(max(passes, UPDATES // max(len(rows), 1)) if len(rows) else 0):
            for k in rng.permutation(len(rows)):
                at, x = rows[k]
                own_z, own_n = z[at], n[at]
                own = np.where(np.abs(own_z) <= self.l1, 0.0, -(own_z - np.sign(own_z) * self.l1) / ((self.beta + np.sqrt(own_n)) / self.alpha + self.l2))
                p = 1.0 / (1.0 + np.exp(-np.clip(bias + np.dot(own, x), -35, 35)))
                g = (p - labels[k]) * x * of_label[int(labels[k])]
                more = own_n + g * g
                z[at] = own_z + g - (np.sqrt(more) - np.sqrt(own_n)) / self.alpha * own
                n[at] = more
        w = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        w[-1] = bias
        return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, passes: int = 5, seed: int = 11) -> np.ndarray:
    """Weights learned from the texts of docs (doc_id, text) that labels (doc_id, label 0 or 1) marks; other labels count for nothing.

    The sample is drawn from the labels: at most `most` of them, which is what is broadcast, so no other text moves.
    Without rows all weights are 0 and every score is 0.5.
    """
    drawn = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "label", F.xxhash64(F.lit(seed), "doc_id").alias("turn"))
    drawn = drawn.orderBy("turn", "doc_id", "label").limit(most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.zeros(0, np.int64), np.zeros(0))] * batch.num_rows
            for row, columns, values in text_features(batch.column("text")):
                rows[row] = (columns, values)
            yield pa.RecordBatch.from_pydict(
                {
                    "turn": batch.column("turn"),
                    "label": batch.column("label").cast(pa.int32()),
                    "columns": pa.array([c.astype(np.int32) for c, _ in rows], pa.list_(pa.int32())),
                    "values": pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32())),
                }
            )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "label"], kind="stable")
        rows = [(np.asarray(c, np.int64), np.asarray(v, np.float64)) for c, v in zip(group["columns"], group["values"], strict=True)]
        return pd.DataFrame({"weights": [Ftrl().fit(rows, group["label"].to_numpy(np.float64), passes, seed).astype(np.float32).tobytes()]})

    made = in_arrow(chosen.select("turn", "label", "text"), vectors, "turn long, label int, columns array<int>, values array<float>")
    made = made.orderBy("turn", "label").limit(most)
    found = made.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32).astype(np.float64) if found else np.zeros(2**BITS + 1)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of docs (with text) and score (0 to 1); a column of that name is replaced. Null and empty texts have a score."""
    base = docs.drop("score")
    columns = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, float(w[-1]))
            for row, at, values in text_features(batch.column("text")):
                out[row] += np.dot(w[at], values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(1.0 / (1.0 + np.exp(-out)))], [*columns, "score"])

    return in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))


def fit_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Weights from the labels of docs whose crc32(doc_id) mod 5 is not 0; the rest is held out."""
    labels = table(spark, sf_dir, "labels").filter(crc32_of_id() % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, by weights learned from the labelled ones outside the held-out fifth.

    A text without words (null, empty) scores by the labels' log-odds; a null id is not held out; rows that repeat score alike; an empty
    table gives no row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit_on_labels(spark, docs, sf_dir)
    found = scored(docs, weights)
    return found.select("doc_id", F.coalesce(crc32_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))
