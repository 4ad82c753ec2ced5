"""Readers and writers: tasks, query lists, parsed queries, frame stores, video catalogues, submissions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.text import chunk_name, frame_ms, legacy_frame, video_name

PARSED = "struct<original_query:string,context_before:array<string>,main_shot:string,context_after:array<string>,ocr_texts:array<string>>"


def _required(column: str) -> F.Column:
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"a task has no {column}"))).otherwise(F.col(column)).alias(column)


def numbered(tasks: DataFrame, order: F.Column | None = None) -> DataFrame:
    """tasks with ordinal (0, 1, ...), by position in the file or by order. Task lists are small: one partition numbers them."""
    return tasks.withColumn("ordinal", F.row_number().over(Window.orderBy(order if order is not None else F.monotonically_increasing_id())) - 1)


def first_of_each(tasks: DataFrame) -> DataFrame:
    """Of tasks that share an id, the one of least ordinal."""
    at = Window.partitionBy("task_id").orderBy("ordinal")
    return tasks.withColumn("turn", F.row_number().over(at)).filter("turn = 1").drop("turn")


def tasks_of(lines: DataFrame, order: F.Column | None = None) -> DataFrame:
    """task_id, description, ordinal of JSON lines (value). Blank lines are skipped; a bad line or a missing key is an error."""
    told = F.from_json("value", "task_id string, description string", {"mode": "FAILFAST"})
    raw = numbered(lines.filter(F.trim("value") != ""), order).select(told.alias("t"), "ordinal").select("t.*", "ordinal")
    return first_of_each(raw.select(_required("task_id"), _required("description"), "ordinal"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a JSON-lines file, see tasks_of."""
    return tasks_of(spark.read.text(path))


def query_list_of(text: DataFrame) -> DataFrame:
    """task_id, query, ordinal of one JSON array (value) of {id, query} objects or bare strings; a bare string's id is its position."""
    rows = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "item"))
    item = F.when(F.col("item").startswith("{"), F.from_json("item", "struct<id:string,query:string>"))
    return rows.select(F.coalesce(item["id"], F.col("ordinal").cast("string")).alias("task_id"), F.coalesce(item["query"], F.col("item")).alias("query"), "ordinal")


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    return query_list_of(spark.read.text(path, wholetext=True))


def parsed_of(text: DataFrame) -> DataFrame:
    """One row for each entry of JSON objects (value) of parsed queries by id."""
    return with_defaults(text.select(F.explode(F.from_json("value", f"map<string,{PARSED}>")).alias("task_id", "p")).select("task_id", "p.*"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return parsed_of(spark.read.text(path, wholetext=True))


def with_defaults(parsed: DataFrame) -> DataFrame:
    """Missing lists are empty, a missing main shot is the query itself."""
    none = F.array().cast("array<string>")
    return parsed.select(
        "task_id",
        "original_query",
        F.coalesce("context_before", none).alias("context_before"),
        F.coalesce("main_shot", "original_query").alias("main_shot"),
        F.coalesce("context_after", none).alias("context_after"),
        F.coalesce("ocr_texts", none).alias("ocr_texts"),
    )


def write_frames(frames: DataFrame, path: str) -> None:
    """The frame store: Parquet, a folder a video, in index order."""
    frames.repartition("video_id").sortWithinPartitions("video_id", "idx").write.mode("overwrite").partitionBy("video_id").parquet(path)


def first_store(spark: SparkSession, places: list[str]) -> str:
    """The first of the places that exists; an error if none does."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return place
    raise FileNotFoundError(f"no frame store in {places}")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def indexed(files: DataFrame) -> DataFrame:
    """files (video_id, frame_file, ...) with idx, 0, 1, ... by video and file name, and frame_ms from the name.

    Ranks are made by video and shifted by the frames of the videos before, so no task sees all frames.
    """
    own = files.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_file")) - 1)
    sizes = files.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.withColumn("start", F.sum("n").over(upto) - F.col("n")).select("video_id", "start")
    return own.join(starts, "video_id").withColumn("idx", F.col("start") + F.col("place")).withColumn("frame_ms", frame_ms(F.col("frame_file"))).drop("place", "start")


def normalised_metadata(raw: DataFrame, entry: str = "entry") -> DataFrame:
    """idx, video_id, frame_ms, tar_name from entries written as JSON: {video_id | video, frame_ms | frame, tar_name} or [video, file]."""
    obj = F.from_json(entry, "struct<video_id:string,video:string,frame_ms:bigint,frame:bigint,tar_name:string>")
    pair = F.from_json(entry, "array<string>")
    listed = F.col(entry).startswith("[")
    return raw.select(
        "idx",
        F.when(listed, pair[0]).otherwise(F.coalesce(obj["video_id"], obj["video"], F.lit("unknown"))).alias("video_id"),
        F.when(listed, legacy_frame(pair[1])).otherwise(F.coalesce(obj["frame_ms"], obj["frame"], F.lit(0).cast("bigint"))).alias("frame_ms"),
        F.when(listed, F.lit("")).otherwise(F.coalesce(obj["tar_name"], F.lit(""))).alias("tar_name"),
    )


def video_catalogue(spark: SparkSession, root: str, datasets: tuple[str, ...] = ("V3C1", "V3C2")) -> DataFrame:
    """path, dataset, folder, video_id of {root}/{dataset}/videos/{name}/{name}.mp4; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", True).load(root).select("path")
    return catalogue_of(files, datasets)


def catalogue_of(paths: DataFrame, datasets: tuple[str, ...] = ("V3C1", "V3C2")) -> DataFrame:
    shape = r"/([^/]+)/videos/([^/]+)/([^/]+)\.mp4$"
    found = paths.select("path", *(F.regexp_extract("path", shape, k).alias(n) for k, n in ((1, "dataset"), (2, "folder"), (3, "stem"))))
    return found.filter(F.col("dataset").isin(*datasets) & (F.col("folder") == F.col("stem"))).select("path", "dataset", "folder", video_name(F.col("dataset"), F.col("folder")).alias("video_id"))


_PREDICTIONS = "array<struct<task_id:string,results:array<struct<rank:int,video_id:string,frame_ms:bigint>>>>"


def parts_of(texts: DataFrame) -> DataFrame:
    """task_id, results, part, place of submission parts (value, part): an array of predictions, or an object that has them. Others are skipped."""
    whole = F.from_json("value", f"struct<predictions:{_PREDICTIONS}>")["predictions"]
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", _PREDICTIONS)).otherwise(whole)
    rows = texts.select(found.alias("all"), "part").filter("all IS NOT NULL").select("part", F.posexplode("all").alias("place", "p"))
    return rows.select("p.task_id", "p.results", "part", "place").filter("task_id IS NOT NULL")


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """task_id and results of all submission files that match; unreadable ones are skipped."""
    return _part_files(spark, pattern).select("task_id", "results")


def _part_files(spark: SparkSession, pattern: str) -> DataFrame:
    text = spark.read.option("ignoreCorruptFiles", True).text(pattern, wholetext=True)
    return parts_of(text.select("value", F.input_file_name().alias("part")))


def merged(parts: DataFrame) -> DataFrame:
    """ordinal, task_id, results of parts (task_id, results, part, place): by name of the part and place in it. Of a task that repeats, the first counts."""
    order = Window.orderBy("part", "place")
    return first_of_each(parts.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))).select("ordinal", "task_id", "results")


def merge_parts(spark: SparkSession, pattern: str, path: str) -> None:
    """One submission of all parts that match."""
    write_submission(merged(_part_files(spark, pattern)), path)


def write_candidates(candidates: DataFrame, path: str, size: int) -> None:
    """candidates (task_id, ordinal, ...) as JSON lines, a folder for each chunk of so many tasks, to look at."""
    candidates.withColumn("chunk", chunk_name(F.col("ordinal"), size)).write.mode("overwrite").partitionBy("chunk").json(path)


def submission(rows: DataFrame) -> DataFrame:
    """One row, document: {"predictions": [{task_id, results}]} in the order of ordinal. A run has as many entries as tasks."""
    every = F.sort_array(F.collect_list(F.struct("ordinal", "task_id", "results")))
    return rows.agg(F.to_json(F.struct(F.transform(every, lambda r: F.struct(r["task_id"].alias("task_id"), r["results"].alias("results"))).alias("predictions"))).alias("document"))


def write_submission(rows: DataFrame, path: str) -> None:
    """One indented JSON file on the driver."""
    document = submission(rows).collect()[0]["document"]
    with open(path, "w", encoding="utf-8") as out:
        json.dump(json.loads(document), out, ensure_ascii=False, indent=4)


FRAMES = T.StructType([T.StructField("idx", T.LongType()), T.StructField("video_id", T.StringType()), T.StructField("frame_ms", T.LongType()), T.StructField("frame_file", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
