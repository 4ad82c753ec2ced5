"""Reranking of candidates by the text seen in their frames, and the submission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.config import Retrieval, TextRerank
from reelscope.functions.providers import Judge
from reelscope.functions.text import best_ratios, slots


def text_bonus(ratios: Column, how: TextRerank = TextRerank()) -> Column:
    """Sum over targets of weight * ratio where the ratio is accepted, at most `most`."""
    counted = F.transform(ratios, lambda r: F.when(r >= how.accept, r * how.weight).otherwise(0.0))
    return F.least(F.aggregate(counted, F.lit(0.0), lambda s, x: s + x), F.lit(how.most))


#: Candidates of tasks with targets that go to the workers, at most; more are joined by shuffling.
MOST_SENT = 1_000_000


def of_candidates(seen: DataFrame, candidates: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """The rows of seen (video, frame, ...) that are candidates of a task with targets, before anything of seen is shuffled.

    The candidates, `most` a task, go to the workers where tasks times most are MOST_SENT at most.
    """
    asked = targets.filter(F.size("ocr_texts") > 0).select("task_id")
    wanted = candidates.join(asked, "task_id", "left_semi").select("video", "frame")
    return seen.join(F.broadcast(wanted) if asked.count() * most <= MOST_SENT else wanted, ["video", "frame"], "left_semi")


def reranked(candidates: DataFrame, targets: DataFrame, seen: DataFrame, results: int = Retrieval.results, how: TextRerank = TextRerank(), most: int = Retrieval.candidates) -> DataFrame:
    """task_id, rank, video, frame, score: each task's results.

    candidates: task_id, rank, video, frame, score. targets: task_id, ocr_texts. seen: video, frame, texts; a frame that is not in it
    has no image, and of a frame that repeats the least texts count. A task without targets, or none of whose candidates has an image, keeps its first candidates; any other task
    ranks those with an image by score * (1 + bonus), ties by rank. Only tasks with targets are matched, and of seen only their candidates
    are shuffled. most: candidates a task, at most.
    """
    place, task = ["video", "frame"], Window.partitionBy("task_id")
    texts = of_candidates(seen, candidates, targets, most).groupBy(*place).agg(F.min("texts").alias("texts"))
    found = candidates.join(targets.select("task_id", "ocr_texts"), "task_id", "left").withColumn("ocr_texts", F.coalesce("ocr_texts", F.array().cast("array<string>")))
    found = found.join(texts.select(*place, F.lit(True).alias("has_image")), place, "left")
    found = found.withColumn("plain", (F.size("ocr_texts") == 0) | ~F.coalesce(F.max("has_image").over(task), F.lit(False)))
    found = found.filter(F.col("plain") | F.col("has_image"))
    # `results` candidates reach this score without a bonus; what cannot with the greatest one need not be matched
    whole = task.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("least", F.nth_value("score", results).over(whole))
    found = found.filter(F.col("plain") | F.col("least").isNull() | (F.col("score") * (1 + how.most) >= F.col("least")))
    # matching is dear for its few bytes, so it is spread over all cores; texts move once
    asked = F.when(~F.col("plain"), F.col("ocr_texts"))
    found = found.repartition(slots(candidates), *place).join(texts, place, "left").withColumn("bonus", text_bonus(best_ratios(asked, F.col("texts"), how.accept), how))
    found = found.withColumn("final", F.when(F.col("plain"), F.col("score")).otherwise(F.col("score") * (1 + F.col("bonus"))))
    order = task.orderBy(F.when(F.col("plain"), 0.0).otherwise(F.col("final")).desc(), "rank")
    placed = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= results)
    return placed.select("task_id", F.col("place").alias("rank"), "video", "frame", F.col("final").alias("score"))


def judged(results: DataFrame, tasks: DataFrame, images: DataFrame, judge: Judge, batch_size: int = 16) -> DataFrame:
    """results (task_id, rank, video, frame, score) in the order of a second look at their images, by the judge's score and then by rank.

    tasks: task_id, description. images: video_id, frame_ms, content. Results without an image stand behind all others in their
    order; score stays what it was. Each pair of task and image is judged once.
    """
    shown = images.select(F.col("video_id").alias("video"), F.col("frame_ms").alias("frame"), "content").filter(F.col("content").isNotNull())
    pairs = results.select("task_id", "video", "frame").distinct().join(tasks.select("task_id", "description"), "task_id").join(shown.dropDuplicates(["video", "frame"]), ["video", "frame"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                yield part[["task_id", "video", "frame"]].assign(judged=[float(x) for x in judge.judge(list(part["description"]), [bytes(x) for x in part["content"]])])

    kind = results.select("task_id", "video", "frame").schema
    found = pairs.mapInPandas(look, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind) + ", judged double")
    order = Window.partitionBy("task_id").orderBy(F.col("judged").desc_nulls_last(), "rank")
    return results.join(found, ["task_id", "video", "frame"], "left").withColumn("rank", F.row_number().over(order)).select("task_id", "rank", "video", "frame", "score")


def submission_rows(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_id, ordinal and results (array of rank, video_id, frame_ms) for each task of results' candidates.

    tasks: task_id, ordinal; those that were scored. One without any candidate gets a single empty result.
    """
    one = F.struct(F.col("rank").cast("int").alias("rank"), F.col("video").alias("video_id"), F.col("frame").cast("long").alias("frame_ms"))
    lists = results.groupBy("task_id").agg(F.sort_array(F.collect_list(one)).alias("results"))
    empty = F.array(F.struct(F.lit(1).alias("rank"), F.lit("").alias("video_id"), F.lit(0).cast("long").alias("frame_ms")))
    return tasks.select("task_id", "ordinal").join(lists, "task_id", "left").withColumn("results", F.coalesce("results", empty))
