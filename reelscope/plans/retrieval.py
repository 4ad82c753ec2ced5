"""A whole run: tasks and a frame store in, a ranked submission out, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.config import Retrieval, TextRerank
from reelscope.operators.rerank import reranked, submission_rows
from reelscope.operators.retrieve import described, top_frames


def retrieve(frames: DataFrame, tasks: DataFrame, seen: DataFrame, how: Retrieval = Retrieval(), text: TextRerank = TextRerank(), blocks: DataFrame | None = None) -> DataFrame:
    """task_id, ordinal, results. tasks: task_id, ordinal, main_vec, before_vecs, after_vecs, ocr_texts. seen: video, frame, texts. blocks: the frames, packed."""
    best = described(top_frames(frames, tasks, how, blocks=blocks), frames).select("task_id", "rank", "video", "frame", "score")
    ranked = reranked(best, tasks, seen, how.results, text, how.candidates)
    return submission_rows(ranked, tasks.filter(F.col("main_vec").isNotNull()))


def with_variants(tasks: DataFrame, variants: DataFrame, anchor: float = 2.0) -> DataFrame:
    """task_id, variant, query, weight: each task's own query as variant 0 with the weight `anchor`, and each of its variants from 1 on with weight 1.

    tasks: task_id, description. variants: task_id, variants (array of texts, from any expander); a task may have none.
    """
    own = tasks.select("task_id", F.lit(0).alias("variant"), F.col("description").alias("query"), F.lit(anchor).alias("weight"))
    more = variants.join(tasks.select("task_id"), "task_id").select("task_id", F.posexplode("variants").alias("place", "query"))
    return own.unionByName(more.select("task_id", (F.col("place") + 1).alias("variant"), "query", F.lit(1.0).alias("weight")))


def fused_ranks(lists: DataFrame, constant: float = 60.0) -> DataFrame:
    """task_id, idx, score, rank: reciprocal-rank fusion of several lists (task_id, idx, rank, weight)."""
    from pyspark.sql import Window

    scores = lists.groupBy("task_id", "idx").agg(F.sum(F.col("weight") / (F.col("rank") + constant)).alias("score"))
    order = Window.partitionBy("task_id").orderBy(F.col("score").desc(), F.col("idx").desc())
    return scores.withColumn("rank", F.row_number().over(order))
