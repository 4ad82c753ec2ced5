"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the words wanted; a source stops at `epochs` times its own words, and what it cannot
take goes to the others by weight, until none is above. With sources in ascending order of limit / weight the clamped ones are a
prefix, so one pass of running sums finds the fixed point that repeated clamping would reach.

A source of rate r repeats every document floor(r) times; the fraction left is a seeded sample: documents in the order of a hash
of their id, one more repetition each while the words fit the quota. So what is taken is a prefix of the order, and one document a
source, the last of the prefix, says it all: the documents themselves do not move, they are held against that row. The order is cut
into 1024 ranges of the hash, whose sums show which range the prefix ends in; only that range is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, table, written

#: The weights of sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words wanted, as a share of all words.
SHARE = 1.5
#: A source is repeated this often at most.
EPOCHS = 2.0
SEED = "mix"
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, source_size), a row for each source, with weight and target.

    Sources stand by code point, null last. One without words gets a target of 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = (
        sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("wanted", F.sum("source_size").over(everything) * share)
        .withColumn("left", F.col("wanted") - (F.sum("cap").over(upto) - F.col("cap")))
        .withColumn("open", F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")))
        .withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("open"))
    )
    level = F.max(F.when(~F.col("full"), F.struct(F.col("open"), F.col("left")))).over(everything)
    return asked.withColumn("level", level).select(
        "source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.open")).alias("target")
    )


def _hash(seed: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _name() -> F.Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _place(size: F.Column) -> F.Column:
    """Where a document stands among those of one hash."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"), size.alias("size"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """name, source_size, target, whole, cut, last for each source of docs (doc_id, source, size): see copies()."""
    rows = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), _hash(seed).alias("h"), _name().alias("name"))
    rows = rows.withColumn("part", F.shiftright("h", 22).cast("int"))
    parts = rows.groupBy("name", "part").agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    sums = targets(parts.groupBy("name").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size")).drop("name"), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sums = sums.select(_name().alias("name"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("quota"))
    before = Window.partitionBy("name").orderBy("part")
    ends = parts.drop("source").withColumn("before", F.sum("part_size").over(before) - F.col("part_size")).join(sums.select("name", "quota"), "name")
    ends = ends.filter((F.col("before") <= F.col("quota")) & (F.col("before") + F.col("part_size") > F.col("quota"))).select("name", "part", "before", "quota")
    # rows of one id and size count together: the first `tied` of `ties` of them are taken
    groups = rows.join(ends, ["name", "part"]).groupBy("name", "before", "quota", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("ties")).withColumn("place", _place(F.col("size")))
    inside = Window.partitionBy("name").orderBy("h", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("ahead", F.col("before") + F.sum(F.col("size") * F.col("ties")).over(inside) - F.col("size") * F.col("ties"))
    first = F.col("ahead") * 2 + F.col("size") <= F.col("quota") * 2
    most = F.floor((F.col("quota") * 2 - F.col("ahead") * 2 - F.col("size")) / (F.col("size") * 2)) + 1
    tied = F.when(~first, 0).when((F.col("ties") == 1) | (F.col("size") == 0), F.col("ties")).otherwise(F.greatest(F.lit(1), F.least(most, F.col("ties")))).cast("long")
    last = groups.withColumn("tied", tied).filter("tied > 0").groupBy("name").agg(F.max(F.struct("h", "place", "tied", "ties")).alias("last"))
    return sums.drop("quota").join(ends.select("name", F.col("part").alias("cut")), "name", "left").join(last, "name", "left")


def with_copies(rows: DataFrame, found: DataFrame, size: F.Column, has_words: F.Column, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, ...) with the columns of plan() and copies: whole times, and once more before the end of its source's prefix.

    size is looked at only for documents of the last one's hash; one without words is taken whole times. Nothing is shuffled but the
    rows that share the last one's id and size, and these only where not all of them are taken.
    """
    joined = rows.withColumn("name", _name()).join(found, "name").withColumn("h", _hash(seed))
    part = F.shiftright("h", 22)
    at_end = F.when(F.col("h") == F.col("last.h"), _place(size) <= F.col("last.place")).otherwise(F.col("h") < F.col("last.h"))
    more = F.when(F.col("cut").isNull() | (part < F.col("cut")), True).when(part > F.col("cut"), False).otherwise(F.coalesce(at_end, F.lit(False)))
    joined = joined.withColumn("copies", F.col("whole") + (has_words & more).cast("long"))
    if not found.filter("last.tied < last.ties").isEmpty():
        tie = F.coalesce((F.col("last.tied") < F.col("last.ties")) & (F.col("h") == F.col("last.h")), F.lit(False))
        tie = F.when(tie, _place(size) == F.col("last.place")).otherwise(False)
        turn = F.row_number().over(Window.partitionBy("name").orderBy(*(F.col(c) for c in rows.columns if c in ("doc_id", "text"))))
        among = joined.filter(tie).withColumn("copies", F.col("whole") + (has_words & (turn <= F.col("last.tied"))).cast("long"))
        joined = joined.filter(~tie).unionByName(among)
    return joined.drop("h")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs (doc_id, source, size).

    size null counts as 0. Rows of equal id and size are interchangeable; rows of a null id are one id. An empty table gives an
    empty result; other columns are not looked at.
    """
    narrow = written(docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")), "mixing")
    found = written(plan(narrow, weights, share, epochs, seed), "mixing-plan", narrow=True)
    return with_copies(narrow, found, F.col("size"), F.col("size") > 0, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, and its source's size and target.

    A null text has no words and is taken 0 times its size; documents of a null source are one source; rows that repeat are documents
    of their own; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Every document as often as the mix takes it, never more than EPOCHS times; the texts stay where they are.

    Columns of docs named like those of plan() are kept as they are.
    """
    narrow = written(docs.select("doc_id", "source", words().alias("size")), "mixing")
    found = written(plan(narrow, share=share), "mixing-plan", narrow=True)
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    taken = with_copies(rows, found, words(), F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER u - cap) AS lft,
             sum(weight) OVER () - (sum(weight) OVER u - weight) AS opn
      FROM w WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, lft * weight > cap * opn AS full_ FROM f),
l AS (SELECT max_by(lft, opn) AS lft, max(opn) AS opn FROM g WHERE NOT full_),
t AS (SELECT g.source, source_size, CASE WHEN full_ THEN cap ELSE l.lft * weight / l.opn END AS target FROM g LEFT JOIN l ON true),
q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
c AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN ahead * 2 + size <= quota * 2 THEN 1 ELSE 0 END) AS taken FROM c
"""
