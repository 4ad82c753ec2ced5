"""From documents to token ids: quality, line dedup, near-dup, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import bpe, line_dedup, mixing, near_dup, quality
from reelscope.llm.shared import drop_written, scratch, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels outside the held-out fifth, accepts.

    A null or empty text scores by the labels' log-odds; rows that repeat stay or go together; an empty table gives none.
    """
    weights = quality.fit_on_labels(spark, docs, sf_dir)
    return quality.scored(docs, weights).filter(F.col("score") >= quality.ACCEPTED).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more share; n_chars follows the text.

    A null text stays null; an empty one is one empty line and stays; rows that repeat are documents of their own; an empty table gives none.
    """
    kept = line_dedup.dropped_lines(docs)
    kept = kept.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def own_nodes(docs: DataFrame) -> DataFrame:
    """docs with a column node that no two rows share: doc_id, or for rows of a null or repeated id, all but the least text's, one beyond all ids."""
    odd = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id")), "odd-ids")
    if odd.isEmpty():
        return docs.withColumn("node", F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("odd_id"))
    rows = written(docs.join(odd, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "odd-rows")
    ends = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("low"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("high")).collect()[0]
    beyond = F.lit(ends["high"] + 1) + F.col("row") if ends["high"] < 2**61 else F.lit(ends["low"] - 1) - F.col("row")
    first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by("row", F.struct("text", "row")).alias("row")).select("row", F.lit(True).alias("first"))
    rows = rows.join(first, "row", "left").withColumn("node", F.when(F.col("first"), F.col("doc_id")).otherwise(beyond))
    return docs.join(odd, same, "left_anti").withColumn("node", F.col("doc_id")).unionByName(rows.select(*docs.columns, "node"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8), the one of least id.

    Rows that repeat an id and rows of a null id are members like any other and stand behind the ids. Documents without words belong
    to no group.
    """
    nodes = own_nodes(docs)
    found = near_dup.near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text"))
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("node")).distinct()
    return nodes.join(gone, "node", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated where their source is short, left out where it is over its target.

    Documents without words, of a null or empty text too, have size 0; null sources are one source; rows that repeat are documents of their
    own; an empty table gives none.
    """
    return mixing.mixed_documents(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded_sha256 (of the bytes that the ids decode to).

    A null or empty text has no ids; rows that repeat are rows of their own; an empty table gives none.
    """
    return bpe.tokenized(docs, *bpe.public_vocabulary())


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dup", near_dup_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: The classifier and the tokenizer have no SQL; the tests hold every stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for itself goes when it is done, and what it read goes with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
