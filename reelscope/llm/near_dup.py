"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has `coordinates` bins. In round i every shingle of a document is placed into a bin and gets a value, both from the
hash of that round; a bin keeps the least (round, value). After `coordinates` rounds, later round i puts all shingles into bin
i - coordinates, so every bin fills. Rounds stop once all bins are full, which a document of n shingles needs about
coordinates * log(coordinates) / n of; two documents agree in a bin with probability equal to their similarity, and agreements
concentrate as for independent bins.

Bands of `rows` coordinates are the candidates' keys. With 48 bands of 6 a pair of similarity 0.8 misses all bands with
probability (1 - 0.8 ** 6) ** 48, below one in two million. Documents with equal shingle sets form a class, and only one
document of each class, the least id, goes on.

Links are confirmed on whole sets and never all drawn: each band's bucket first links its members to two of them, that of least id
and the one that meets most others over all buckets, which is where a group of copies of one text has its centre; then only members that are still in different components are paired, bucket by bucket. So a group of m near
copies costs about 2 m tests a bucket at most, no bucket is capped, and no component is split.

Shingles that only one candidate document has bound what it can share with any other: a pair whose rest is too small for the
similarity is never drawn. In a large group of near copies these are the copies that are too far from all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import in_arrow, scratch, table, text_chunks, written
from .words import mixed, shingle_hashes, word_hashes

BANDS = 48
ROWS = 6
#: Links need this similarity, in hundredths.
PERCENT = 80
#: Members of a bucket that one task of a join by bucket aims at.
SLICE = 256

_SEEDS = mixed(np.arange(1, 4097, dtype=np.uint64))


def sketch(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """The (round, value) of every bin as one 64-bit number, for distinct shingle hashes, at least one."""
    t = coordinates
    n = len(hashes)
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done, step = 0, max(1, math.ceil(1.2 * t * math.log(t) / n))
    low = np.uint64(0xFFFFFFFF)
    while done < t:
        rounds = np.arange(done, min(t, done + step), dtype=np.uint64)
        x = mixed(hashes[None, :] ^ _SEEDS[rounds.astype(np.int64), None])
        place = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(bins, place.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (x & low)).ravel())
        done += len(rounds)
        if int(bins.max()) >> 32 < done:
            return bins
        step = max(1, step // 4)
    late = np.flatnonzero(bins == np.iinfo(np.uint64).max) + t
    values = (mixed(hashes[None, :] ^ _SEEDS[late, None]) & low).min(axis=1)
    bins[late - t] = (late.astype(np.uint64) << np.uint64(32)) | values
    return bins


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key a band."""
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out ^ bins[k * bands : (k + 1) * bands]) + np.uint64(k)
    return out.view(np.int64)


def sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (distinct shingles), class (128 bits of the set; null for none) and keys array<long>, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in text_chunks(batch.column("text")):
                hashes, begin = word_hashes(data, offsets)
                counts, classes, keys = [], [], []
                for row in range(last - first):
                    own = shingle_hashes(hashes[begin[row] : begin[row + 1]], size)
                    counts.append(len(own))
                    if not len(own):
                        classes.append(None)
                        keys.append(None)
                        continue
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    if digest not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[digest] = band_keys(sketch(own, bands * rows), bands, rows)
                    classes.append(digest)
                    keys.append(known[digest])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "class", "keys"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, class binary, keys array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its set, array<long>, for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in text_chunks(batch.column("text")):
                hashes, begin = word_hashes(data, offsets)
                sets = [shingle_hashes(hashes[begin[k] : begin[k + 1]], size).view(np.int64) for k in range(last - first)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, shingles array<long>")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, common (shingles that both whole sets have) and linked for the pairs (a, b)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    linked = F.col("common") * 100 >= (F.size("of_a") + F.size("of_b") - F.col("common")) * percent
    return both.select("a", "b", F.col("common").cast("long").alias("common"), linked.alias("linked"))


def _by_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (bucket, rep, m, ...) joined with the row of their bucket (bucket, m, ...).

    m, the members that a bucket had at first, tells into how many slices its rows are dealt, each of which meets a copy of the
    bucket's row; so a hot bucket is no task of its own. Rows of two buckets of one hash differ in m; the greater one makes the copies.
    """
    slices = F.ceil(F.col("m") / SLICE)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("rep"), slices))
    copies = buckets.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("m")
    return dealt.join(copies, ["bucket", "slice"]).drop("slice")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Words of letters A to Z in any case are equal. A text of fewer words than `size` has one shingle, its whole sequence; a null
    text or one without words has none and is linked with nothing. component_id is the least doc_id reachable over links.
    Rows that repeat a doc_id are one node. A null doc_id has the component of the rows with the same set; alone it has none
    (null). Other columns are not looked at. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    with scratch() as kept:
        marked = written(sketched(docs, size, bands, rows), "sketches")
        classes = written(marked.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
        members = classes.filter("rep is not null").select("rep", "n", F.posexplode("keys").alias("band", "key"))
        shared = members.groupBy("band", "key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high").select("band", "key", "m")
        members = written(members.join(shared, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "rep", "n", "m"), "buckets")
        met = members.groupBy("rep").agg(F.sum("m").alias("met"))
        sets = written(shingle_sets(docs.join(met.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), size), "sets")
        alone = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("rep")).filter("c = 1")
        alone = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("alone"))
        about = met.join(alone, "rep", "left").select("rep", "met", F.coalesce("alone", F.lit(0)).alias("alone"))
        members = members.join(about, "rep").select("bucket", "rep", "n", (F.col("n") - F.col("alone")).alias("f"), "met", "m")
        members = written(members.filter(F.col("f") * 100 >= F.col("n") * percent), "buckets")
        one = F.struct("rep", "n", "f", "met")
        ranked = members.groupBy("bucket").agg(F.min(one).alias("least"), F.min_by(one, F.struct(-F.col("met"), F.col("rep"))).alias("other"), F.max("m").alias("m"))

        may = lambda most: most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
        pair = [F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")]
        hubs = _by_bucket(members, ranked).select("rep", "n", "f", F.explode(F.array_distinct(F.array("least", "other"))).alias("hub"))
        hubs = hubs.select("rep", "n", "f", F.col("hub.rep").alias("rep2"), F.col("hub.n").alias("n2"), F.col("hub.f").alias("f2"), F.col("hub.met").alias("met2"))
        hubs = hubs.filter(F.col("rep") != F.col("rep2")).filter(may(F.least("f", "f2"))).distinct()
        hubs = written(hubs, "hubs", narrow=True)
        tested = written(measured(hubs.select(*pair).distinct(), sets, percent), "measured")
        of_node = components(tested.filter("linked"))

        # what each member shares with its hub, the most central one of those that it was tested against and itself
        own = hubs.select("rep", F.col("rep2").alias("hub"), "met2", *pair).join(tested, ["a", "b"]).select("rep", "hub", "met2", "common")
        own = own.unionByName(members.select("rep", F.col("rep").alias("hub"), F.col("met").alias("met2"), F.col("n").alias("common")).distinct())
        own = own.groupBy("rep").agg(F.max_by(F.struct("hub", "common"), F.struct("met2", "hub", "common")).alias("own"))
        info = members.select("rep", "n", "f").distinct().join(own, "rep", "left").join(of_node, F.col("rep") == F.col("node"), "left")
        info = info.select("rep", "n", "f", F.coalesce("own.hub", "rep").alias("hub"), F.coalesce("own.common", "n").alias("c"), F.coalesce("component", "rep").alias("comp"))
        labelled = members.select("bucket", "rep", "m").join(info, "rep")
        split = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("m")).filter("low <> high").select("bucket", "m")
        labelled = written(_by_bucket(labelled, split), "split-buckets")
        as_second = lambda df: df.select(*(F.col(c) if c in ("bucket", "shingle") else F.col(c).alias(f"{c}2") for c in df.columns))

        # beyond what both share with the same hub, a pair shares only shingles that the hub has not
        can = may(F.least("f", "f2")) & ((F.col("hub") != F.col("hub2")) | may(F.least("c", "c2")))
        edge = labelled.groupBy("bucket").agg(F.min("n").alias("n2"), F.max("f").alias("f2"), F.max("c").alias("c2"), F.min("hub").alias("low"), F.max("hub").alias("high"), F.max("m").alias("m"))
        viable = _by_bucket(labelled, edge).filter(may(F.least("f", "f2")) & ((F.col("low") != F.col("high")) | may(F.least("c", "c2")))).drop("n2", "f2", "c2", "low", "high", "m")
        parts = viable.groupBy("bucket", "comp", "hub").agg(F.min("n").alias("n"), F.max("f").alias("f"), F.max("c").alias("c"))
        apart = parts.join(as_second(parts), "bucket").filter((F.col("comp") < F.col("comp2")) & can).select("bucket", "comp", "hub", "comp2", "hub2", "n2", "f2", "c2")
        half = apart.join(viable, ["bucket", "comp", "hub"]).filter(can).drop("n2", "f2", "c2")
        by_hub = half.join(as_second(viable), ["bucket", "comp2", "hub2"]).filter(can).select(*pair)
        inside = labelled.select("rep", "n", "hub", "c", "comp").distinct()
        least = inside.groupBy("hub").agg(F.min("n").alias("n2"))
        need = F.ceil((F.col("n") + F.col("n2")) * percent / F.lit(100 + percent)) - F.col("c")
        inside = inside.join(least, "hub").withColumn("need", need).drop("n2")
        rest = inside.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep").join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
        rest = rest.select("rep", "n", "hub", "c", "comp", "need", F.explode(F.array_except("shingles", "of_hub")).alias("shingle"))
        rest = written(rest, "rests")
        often = rest.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
        # a pair that shares `need` of these has one among the rarest, all but need - 1, of both
        own = Window.partitionBy("hub", "rep")
        rest = rest.join(often, ["hub", "shingle"]).withColumn("turn", F.row_number().over(own.orderBy("often", "shingle"))).withColumn("d", F.count(F.lit(1)).over(own))
        rest = written(rest.filter(F.col("turn") <= F.col("d") - F.greatest(F.col("need"), F.lit(1)) + 1).select("rep", "n", "hub", "c", "comp", "d", "shingle"), "rests")
        sharing = rest.join(as_second(rest).withColumnRenamed("hub2", "hub"), ["hub", "shingle"])
        by_rest = sharing.filter((F.col("comp") < F.col("comp2")) & may(F.least("c", "c2") + F.least("d", "d2"))).select(*pair)
        pairs = by_hub.unionByName(by_rest).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        more = written(measured(pairs, sets, percent).filter("linked"), "confirmed")
        if not more.isEmpty():
            of_node = components(more.select("a", "b").unionByName(of_node.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        kept += [marked, classes, of_node]

    reps = classes.select("class", "rep")
    joined = marked.select("doc_id", "n", "class").join(reps, "class", "left").join(of_node, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over links of similarity 0.8 or more of four-word shingles; its least id is kept.

    A null text or one without words has no shingle and is its own component; rows that repeat an id are one node, each a row of the
    result; a null id has the component of its equals, or none; an empty table gives no row.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS shingle FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y, i.doc_id AS of_x, j.doc_id AS of_y, c = a.n AND c = b.n AS equal
  FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y JOIN d i ON i.r = x JOIN d j ON j.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT of_x AS x, of_y AS y FROM l WHERE of_x <> of_y UNION ALL SELECT of_y, of_x FROM l WHERE of_x <> of_y),
r AS (SELECT DISTINCT x AS node, x AS least FROM e UNION SELECT e.y, r.least FROM r JOIN e ON e.x = r.node WHERE r.least < e.y),
g AS (SELECT node, min(least) AS component FROM r GROUP BY node),
u AS (SELECT x AS r, of_y AS same FROM l WHERE equal AND of_x IS NULL AND of_y IS NOT NULL UNION ALL SELECT y, of_x FROM l WHERE equal AND of_y IS NULL AND of_x IS NOT NULL),
z AS (SELECT r, min(coalesce(g.component, same)) AS component FROM u LEFT JOIN g ON g.node = same GROUP BY r),
o AS (SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN d.doc_id IS NULL THEN z.component WHEN n.n IS NULL THEN d.doc_id ELSE coalesce(g.component, d.doc_id) END AS component_id
      FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN g ON g.node = d.doc_id LEFT JOIN z ON z.r = d.r)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
