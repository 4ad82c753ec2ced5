"""A run from files: python -m reelscope.plans.run --frames STORE... --tasks TASKS.jsonl --vectors TABLE --output OUT.json
[--encoder MODULE:NAME...] [--parser MODULE:NAME] [--seen TABLE] [--blocks TABLE].

STORE is the frame store; the first of those given that exists is read. TABLE of --vectors has task_id, main_vec, before_vecs, after_vecs,
ocr_texts. With --encoder the run makes these itself, for tasks that the table does not have yet: NAME is a class with encode and
dimension, of which each worker makes one; of several, the one of the store's length is taken. --parser names a class that takes queries
apart; without it, what a query quotes is looked for as text. TABLE of --blocks has the same frames as packed blocks (or is a folder that
a BlockStore appends to), that of --seen video, frame, texts. Missing inputs are an error.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions.providers import add_vectors
from reelscope.plans.retrieval import retrieve
from reelscope.sources.blocks import BlockStore
from reelscope.sources.tables import first_store, read_frames, read_tasks, write_submission


def same_dimension(frames: DataFrame, tasks: DataFrame) -> None:
    """Raises unless the vectors of the store and of the tasks have one length. Of the store, whose vectors are one model's, the first that is found is looked at."""
    of = lambda df, column: df.select(F.size(column).alias("n")).filter("n >= 0")
    found = {r["n"] for r in of(frames, "embedding").limit(1).collect() + of(tasks, "main_vec").distinct().limit(3).collect()}
    if len(found) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(found)}")


def named(place: str):
    """What MODULE:NAME names."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def blocks_at(spark: SparkSession, path: str) -> DataFrame:
    """The packed blocks of a store that grows by appending, or of a table."""
    store = BlockStore(spark, path)
    return store.read() if store.log() else spark.read.parquet(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    says = argparse.ArgumentParser(description=__doc__)
    says.add_argument("--frames", required=True, nargs="+")
    for name in ("tasks", "vectors", "output"):
        says.add_argument(f"--{name}", required=True)
    says.add_argument("--encoder", nargs="+")
    says.add_argument("--parser")
    says.add_argument("--seen")
    says.add_argument("--blocks")
    given = says.parse_args(args)
    spark = spark or SparkSession.builder.appName("reelscope").getOrCreate()
    frames = read_frames(spark, first_store(spark, given.frames))
    tasks = read_tasks(spark, given.tasks)
    if given.encoder:
        vectors = add_vectors(tasks, frames, given.vectors, [named(x) for x in given.encoder], named(given.parser)() if given.parser else None)
    else:
        vectors = spark.read.parquet(given.vectors)
    tasks = tasks.join(vectors, "task_id")
    same_dimension(frames, tasks)
    seen = spark.read.parquet(given.seen) if given.seen else spark.createDataFrame([], "video string, frame long, texts array<string>")
    blocks = blocks_at(spark, given.blocks) if given.blocks else None
    write_submission(retrieve(frames, tasks, seen, blocks=blocks), given.output)


if __name__ == "__main__":
    main()
