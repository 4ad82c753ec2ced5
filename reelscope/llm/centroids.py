"""Clustering of whole-number vectors around centroids, with annulus search for the nearest one.

Centroids stand sorted by norm. A vector's distance to the one of the next norm bounds its distance to the nearest from above; by the
triangle inequality a centroid whose norm differs from the vector's by more than that bound cannot be nearest. So binary search of the norms
finds the annulus, and only the centroids in it, those on its borders included, are compared, exactly.

A round reads the vectors once. The centroids (k of them) go to the workers; what comes back is a sum for each cluster, component and task,
added up by Spark. No vector moves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, scratch, table, written

#: Components up to this size are handled as floats, whose sums of squares are exact: 4096 components of 2 ** 20 at most stay below 2 ** 53.
EXACT = 1 << 20
LONGEST = 4096
#: The largest long; sums beyond it are given as this.
LARGEST = 2**63 - 1


def kept_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors with exactly that many components, none null, NaN or infinite."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.filter((F.size("embedding") == dimension) & finite)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in floats where these are exact for what follows, else as Python's integers."""
    made = np.floor(values * scale)
    if (np.abs(made) <= EXACT).all():
        return made
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


class Annulus:
    """The nearest of these centroids (lists of integers, all of one length) for whole-number vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.far = any(abs(x) > EXACT for c in centroids for x in c) or len(centroids[0]) > LONGEST
        self.centroids = np.array(centroids, object if self.far else np.float64)
        if not self.far:
            norms = np.sqrt((self.centroids**2).sum(1))
            self.order = np.argsort(norms, kind="stable")
            self.norms = norms[self.order]

    def distances(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """Squared, exact: of components up to EXACT no sum reaches 2 ** 53."""
        return ((vectors - self.centroids[k]) ** 2).sum(1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid, of equals the smallest, and the squared distance."""
        n, own = len(vectors), vectors
        if self.far or own.dtype == object:  # beyond exact floats: all centroids, in Python's integers
            own = np.array([[int(x) for x in v] for v in own.tolist()], object).reshape(own.shape)
            every = np.array([[sum((x - int(y)) ** 2 for x, y in zip(v, c, strict=True)) for c in self.centroids.tolist()] for v in own.tolist()], object)
            best = np.array([min(range(len(self.centroids)), key=lambda k, r=row: (r[k], k)) for row in every.tolist()], np.int64)
            return best, np.array([row[k] for row, k in zip(every.tolist(), best.tolist(), strict=True)], object)
        norms = np.sqrt((own**2).sum(1))
        guess = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        bound = np.zeros(n)
        for k in np.unique(guess):
            rows = guess == k
            bound[rows] = self.distances(own[rows], self.order[k])
        radius = np.sqrt(bound)
        slack = 1e-9 * (norms + radius + self.norms[-1])  # of rounded roots; what it lets in is compared exactly
        low, high = np.searchsorted(self.norms, norms - radius - slack, "left"), np.searchsorted(self.norms, norms + radius + slack, "right")
        best, least = np.full(n, len(self.norms)), np.full(n, np.inf)
        for place, k in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high))
            found = self.distances(own[rows], k)
            better = (found < least[rows]) | ((found == least[rows]) & (k < best[rows]))
            best[rows[better]], least[rows[better]] = k, found[better]
        return best, least


def _batches(batches: Iterator[pa.RecordBatch], scale: int, dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("vec_id"), whole(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension), scale)


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str = "1") -> list[list[int]]:
    """The k vectors of the smallest sha256 of `seed:vec_id`, as whole numbers, in that order; null ids come last, of one id the least vector first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(hashed.alias("hash"), "embedding").orderBy(F.col("hash").asc_nulls_last(), "embedding").limit(k).collect()
    return [[int(x) for x in whole(np.array(r["embedding"], np.float64), scale).tolist()] for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after a round: the floor of each cluster's mean, and an empty cluster's centroid as it was."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    k, dimension = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's count and sums for each cluster; the sums in limbs of 30 bits, so that Spark can add them up whatever their size."""
        annulus, count, total = Annulus(shared.value), [0] * k, [[0] * dimension for _ in range(k)]
        for _, vectors in _batches(batches, scale, dimension):
            best, _ = annulus.nearest(vectors)
            for c in np.unique(best).tolist():
                own = vectors[best == c]
                count[c] += len(own)
                total[c] = [x + int(y) for x, y in zip(total[c], own.sum(0).tolist(), strict=True)]
        rows = [(c, j, count[c], place, limb) for c in range(k) if count[c] for j in range(dimension) for place, limb in enumerate(limbs(total[c][j]))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        names = ["cluster", "component", "n", "place", "limb"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names)

    parts = in_arrow(kept, sums, "cluster int, component int, n long, place int, limb long")
    found = parts.groupBy("cluster", "component", "place").agg(F.sum("limb").alias("limb"), F.sum("n").alias("n")).collect()
    total: dict[tuple[int, int], int] = {}
    count: dict[int, int] = {}
    for r in found:
        total[r["cluster"], r["component"]] = total.get((r["cluster"], r["component"]), 0) + (r["limb"] << 30 * r["place"])
        if not r["place"]:
            count[r["cluster"]] = r["n"]
    return [[total[c, j] // count[c] for j in range(dimension)] if c in count else old for c, old in enumerate(centroids)]


def limbs(x: int) -> list[int]:
    """x as digits of base 2 ** 30, the lowest first, all of the sign of x; at least one."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & (1 << 30) - 1))
        x >>= 30
    return out


def assigned(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """vec_id, cluster, distance (squared; LARGEST where it is larger)."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)
    dimension = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(shared.value)
        for ids, vectors in _batches(batches, scale, dimension):
            best, least = annulus.nearest(vectors)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array([min(int(x), LARGEST) for x in least.tolist()], pa.int64())], ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return in_arrow(kept, run, f"vec_id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, embedding), see op13_centroids.

    Vectors of another length, or with a null, NaN or infinite component, are left out; so are null vectors. Rows that repeat are vectors of
    their own, and so are rows of a null id. With fewer than k vectors each starts a cluster; an empty table gives no row.
    """
    kept = kept_vectors(vectors, dimension)
    centroids = first_centroids(kept, k, scale, seed)
    if not centroids:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    with scratch() as keep:
        rows = written(assigned(kept, centroids, scale), "assigned")
        keep.append(rows)
    sums = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    hashed = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, min(sums[c], LARGEST), hashed[c]) for c in sorted(sums)]
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows at most
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"), "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds around 16 centroids, with sums of squared distances and the centroid's digest. See clustered for awkward rows."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """The assignment to the centroids c{k}, and the centroids after it."""
    return f"""
d{k} AS MATERIALIZED (SELECT rid, c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (j) GROUP BY rid, c),
a{k} AS MATERIALIZED (SELECT rid, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1),
m{k} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{k} JOIN v USING (rid) GROUP BY c, j),
c{k + 1} AS MATERIALIZED (SELECT o.c, j, CAST(CASE WHEN n IS NULL THEN o.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x FROM c{k} o LEFT JOIN m{k} USING (c, j))"""


OP13_SQL = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
v AS MATERIALIZED (SELECT rid, j, CAST(floor(64 * e[j]) AS BIGINT) AS x FROM e, range(1, 65) r(j)),
f AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS c FROM e QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, j, x FROM f JOIN v USING (rid)),{_round(0)},{_round(1)},{_round(2)},{_round(3)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a3 JOIN e USING (rid) JOIN h USING (c)"""
