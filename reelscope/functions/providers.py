"""What a run plugs in for its tasks: query parsers and encoders; each works on batches in the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import nullcontext
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.text import quoted
from reelscope.sources.tables import PARSED, with_defaults
from reelscope.streaming.resume import still_open


class QueryParser(Protocol):
    def parse(self, queries: list[str]) -> list[dict | None]:
        """For each query its parts (context_before, main_shot, context_after, ocr_texts), or None where it failed."""


class Judge(Protocol):
    def judge(self, queries: list[str], images: list[bytes]) -> list[float]:
        """How well each image shows what the query in its place asks for."""


class Encoder(Protocol):
    dimension: int

    def encode(self, items: list) -> list[list[float]]:
        """A vector for each text or image."""


def parsed_queries(tasks: DataFrame, parser: QueryParser) -> DataFrame:
    """task_id and the parts of each task (task_id, description). A query that fails, or raises, is its own main shot without parts.

    A parser with open() is opened once for each partition, and what that gives is closed at the partition's end.
    """

    @F.pandas_udf(PARSED)
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with parser.open() if hasattr(parser, "open") else nullcontext(parser) as own:
            for batch in batches:
                texts = ["" if t is None else t for t in batch]
                try:
                    found = own.parse(texts)
                except Exception:  # a parser is a service outside; its failure must not fail the run
                    found = [None] * len(texts)
                rows = [{**{"context_before": [], "main_shot": t, "context_after": [], "ocr_texts": []}, **(p or {}), "original_query": t} for t, p in zip(texts, found, strict=True)]
                yield pd.DataFrame(rows, columns=["original_query", "context_before", "main_shot", "context_after", "ocr_texts"])

    return with_defaults(tasks.select("task_id", parts("description").alias("p")).select("task_id", "p.*"))


def quote_parsed(tasks: DataFrame) -> DataFrame:
    """The offline parser of this package: the whole query is the main shot, what it quotes is looked for as text."""
    none = F.array().cast("array<string>")
    return tasks.select("task_id", F.col("description").alias("original_query"), none.alias("context_before"), F.col("description").alias("main_shot"), none.alias("context_after"), quoted(F.col("description")).alias("ocr_texts"))


def task_vectors(parsed: DataFrame, encoder: Encoder | Callable[[], Encoder]) -> DataFrame:
    """task_id, main_vec, before_vecs, after_vecs, ocr_texts of parsed queries. The main vector is of the query as it was asked, else of its main shot."""
    none = F.array().cast("array<array<float>>")
    texts = parsed.select(
        "task_id", "ocr_texts", F.explode(F.flatten(F.array(
            F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("place"), F.coalesce("original_query", "main_shot", F.lit("")).alias("text"))),
            F.transform("context_before", lambda t, i: F.struct(F.lit(1).alias("part"), i.alias("place"), t.alias("text"))),
            F.transform("context_after", lambda t, i: F.struct(F.lit(2).alias("part"), i.alias("place"), t.alias("text"))),
        ))).alias("t")).select("task_id", "ocr_texts", "t.*")
    made = encoded(texts, "text", "vec", encoder).groupBy("task_id").agg(F.first("ocr_texts").alias("ocr_texts"), F.sort_array(F.collect_list(F.struct("part", "place", "vec"))).alias("all"))
    of = lambda part: F.transform(F.filter("all", lambda x: x["part"] == part), lambda x: x["vec"])
    return made.select("task_id", F.get(of(0), F.lit(0)).alias("main_vec"), F.coalesce(of(1), none).alias("before_vecs"), F.coalesce(of(2), none).alias("after_vecs"), "ocr_texts")


def encoder_for(frames: DataFrame, encoders: list[Encoder]) -> Encoder:
    """The first of the encoders whose vectors have the length of the store's, so that queries and frames cannot be of two models."""
    found = frames.select(F.size("embedding").alias("n")).filter("n > 0").limit(1).collect()
    for encoder in encoders:
        if not found or encoder.dimension == found[0]["n"]:
            return encoder
    raise ValueError(f"no encoder makes vectors of length {found[0]['n'] if found else 'any'}")


def encoded(df: DataFrame, column: str, into: str, encoder: Encoder | Callable[[], Encoder], batch_size: int = 64) -> DataFrame:
    """df with the encoder's vector of a column, scaled to unit length; the encoder gets up to batch_size items at once.

    encoder: one that is sent to the workers, or what makes one, which each worker calls once: models are loaded where they run.
    """

    def unit(made) -> np.ndarray:
        made = np.asarray(made, np.float64)
        return (made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    if isinstance(encoder, type) or not hasattr(encoder, "encode"):

        def load():
            own = encoder()
            return lambda items: unit(own.encode(list(items)))

        return df.withColumn(into, predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)(F.col(column)))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            items, out = list(batch), []
            for at in range(0, len(items), batch_size):
                out += list(unit(encoder.encode(items[at : at + batch_size])))
            yield pd.Series(out)

    return df.withColumn(into, vectors(column))


def add_vectors(tasks: DataFrame, frames: DataFrame, path: str, encoders: list, parser: QueryParser | None = None) -> DataFrame:
    """The table at path of the tasks' vectors (as task_vectors gives them), with those of tasks (task_id, description) that were not in it yet.

    Each task is parsed and encoded once, whatever reads the table and however often a run is begun again. Of the encoders, the one whose
    vectors have the length of the store's is taken; without a parser, what a query quotes is looked for as text.
    """
    spark = tasks.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        tasks = still_open(tasks, spark.read.parquet(path), "task_id")
    parsed = quote_parsed(tasks) if parser is None else parsed_queries(tasks, parser)
    task_vectors(parsed, encoder_for(frames, encoders)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
