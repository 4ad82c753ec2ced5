"""Queries over the shared test tables that stand in for frames, tasks and pixels, each with its SQL where SQL can say it.

embeddings are frames (label is the video), benchmark items are tasks, lineitem rows are pixels, orders and parts are sampled frames.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.config import CHUNK, Retrieval
from reelscope.functions.histograms import BINS, bhattacharyya, hue_saturation_bin, is_night, min_max, value_bin
from reelscope.functions.pixels import hsv
from reelscope.functions.providers import quote_parsed
from reelscope.functions.services import prompt, prompt_of
from reelscope.functions.text import best_ratios, chunk_name, frame_file, frame_ms, milliseconds, partial_ratio_of, spread, stripped
from reelscope.functions.vectors import dot, first_or_null, norm, unit, weighted_sum
from reelscope.operators.rerank import reranked, submission_rows, text_bonus
from reelscope.operators.retrieve import all_scores, described, top_frames
from reelscope.operators.thinning import one_minus_dot, sampled, thinned, tiles_over, until_failure
from reelscope.plans.retrieval import fused_ranks, retrieve, with_variants
from reelscope.sources.blocks import BlockStore
from reelscope.sources.images import totals
from reelscope.sources.matrix import read_matrix_store, write_entries, write_matrix
from reelscope.sources.tables import catalogue_of, first_of_each, indexed, merged, normalised_metadata, numbered, parsed_of, parts_of, query_list_of, submission, tasks_of
from reelscope.streaming.late import rocks, thinned_late
from reelscope.streaming.once import OnceTable, work_once
from reelscope.streaming.resume import resumed, still_open, still_wanted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), (F.col("vec_id") * 40).alias("frame_ms"), "embedding")


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with vectors of three frames that its number picks; some items have no context, some two before."""
    items = _read(spark, sf_dir, "benchmark")
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = max(vectors.count(), 1)
    pick = lambda name, at: vectors.select(F.col("vec_id").alias(at), F.col("embedding").alias(name))
    joined = (
        items.withColumn("m", F.expr(f"item_id * 7 % {n}")).withColumn("b", F.expr(f"(item_id * 11 + 3) % {n}")).withColumn("a", F.expr(f"(item_id * 13 + 5) % {n}"))
        .join(pick("main_vec", "m"), "m").join(pick("bv", "b"), "b").join(pick("av", "a"), "a")
    )
    none = F.array().cast("array<array<float>>")
    return joined.select(
        F.col("item_id").cast("string").alias("task_id"),
        F.col("item_id").cast("int").alias("ordinal"),
        "main_vec",
        F.expr("CASE WHEN item_id % 3 = 0 THEN array() WHEN item_id % 5 = 0 THEN array(bv, av) ELSE array(bv) END").cast("array<array<float>>").alias("before_vecs"),
        F.when(F.col("item_id") % 2 == 0, F.array("av")).otherwise(none).alias("after_vecs"),
        F.when(F.col("item_id") % 4 == 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("ocr_texts"),
    )


_TASK_CTE = """
t AS (SELECT CAST(item_id AS VARCHAR) AS task_id, CAST(item_id AS INT) AS ordinal, m.embedding::DOUBLE[] AS mv,
             CASE WHEN item_id % 3 <> 0 THEN b.embedding::DOUBLE[] END AS bv, CASE WHEN item_id % 2 = 0 THEN a.embedding::DOUBLE[] END AS av
      FROM (SELECT *, (SELECT count(*) FROM embeddings) AS n FROM benchmark) JOIN embeddings m ON m.vec_id = item_id * 7 % n
      JOIN embeddings b ON b.vec_id = (item_id * 11 + 3) % n JOIN embeddings a ON a.vec_id = (item_id * 13 + 5) % n),
r AS (SELECT task_id, ordinal, vec_id AS idx, label, list_dot_product(embedding::DOUBLE[], mv) AS main,
             list_dot_product(embedding::DOUBLE[], bv) AS rb, list_dot_product(embedding::DOUBLE[], av) AS ra FROM t, embeddings),
p AS (SELECT *, coalesce(max(rb) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS mb,
             coalesce(max(ra) OVER (PARTITION BY task_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS ma FROM r),
s AS (SELECT *, greatest(main - 0.24::DOUBLE, 0) * greatest(main - 0.24::DOUBLE, 0)
             * (1 + 0.1::DOUBLE * greatest(mb - 0.24::DOUBLE, 0) + 0.1::DOUBLE * greatest(ma - 0.24::DOUBLE, 0)) AS score FROM p)"""


def _same_video(value: str, shift: str) -> str:
    """The largest of the six rows before or after that are of the same video."""
    rows = ", ".join(f"CASE WHEN {shift}(label, {k}) OVER w = label THEN {shift}({value}, {k}) OVER w END" for k in range(1, 7))
    return f"coalesce(greatest({rows}), 0)"


_GLOBAL = _TASK_CTE
_BY_VIDEO = _TASK_CTE[: _TASK_CTE.index("p AS")] + f"p AS (SELECT *, {_same_video('rb', 'lag')} AS mb, {_same_video('ra', 'lead')} AS ma FROM r WINDOW w AS (PARTITION BY task_id ORDER BY idx))" + _TASK_CTE[_TASK_CTE.index(",\ns AS") :]
_TOP_CTE = f"{_GLOBAL}, k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, idx DESC) AS rank FROM s)"


@query(f"WITH {_TOP_CTE} SELECT task_id, CAST(rank AS INT) AS rank, idx, round(score, 9) AS score FROM k WHERE rank <= 500")
def top_frames_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_frames(_frames(spark, sf_dir), _tasks(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and workers share: in spark.checkpoint.dir; on a local master without that setting, a temporary one that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="reelscope-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


@query(f"WITH {_TOP_CTE} SELECT task_id, CAST(rank AS INT) AS rank, idx, round(score, 9) AS score FROM k WHERE rank <= 500")
def top_frames_of_a_grown_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames out of a store of packed blocks that was written in two appends, with strips skipped and lists started with a bound."""
    frames = _frames(spark, sf_dir)
    store, half = BlockStore(spark, _folder(spark)), frames.count() // 2
    store.append(frames.filter(F.col("idx") < half))
    store.append(frames.filter(F.col("idx") >= half))
    return top_frames(frames, _tasks(spark, sf_dir), blocks=store.read()).withColumn("score", F.round("score", 9))


@query("""SELECT vec_id AS idx, len(embedding) AS n, embedding[1]::DOUBLE AS first, round(list_sum(embedding::DOUBLE[]), 9) AS total,
round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS folded, 'v' || label AS video_id, vec_id * 40 AS frame_ms, '' AS tar_name FROM embeddings""")
def frames_of_a_matrix_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames written as a matrix file with its list of entries, and read back by ranges of rows."""
    frames, place = _frames(spark, sf_dir), _folder(spark).removeprefix("file://")
    os.makedirs(place)
    write_matrix(frames, f"{place}/all_embeddings.npy")
    write_entries(frames, f"{place}/metadata.json")
    own, vector = read_matrix_store(spark, place), F.col("embedding").cast("array<double>")
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)
    return own.select("idx", F.size(vector).alias("n"), vector[0].alias("first"), F.round(total, 9).alias("total"), F.round(dot(vector, F.reverse(vector)), 9).alias("folded"), "video_id", "frame_ms", "tar_name")


@query(f"WITH {_GLOBAL} SELECT task_id, idx, round(main, 9) AS main, round(mb, 9) AS max_before, round(ma, 9) AS max_after, round(score, 9) AS score FROM s")
def fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_scores(_frames(spark, sf_dir), _tasks(spark, sf_dir))
    return found.select("task_id", "idx", *(F.round(c, 9).alias(c) for c in ("main", "max_before", "max_after", "score")))


@query(f"WITH {_BY_VIDEO}, k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, idx DESC) AS rank FROM s) SELECT task_id, CAST(rank AS INT) AS rank, idx, round(score, 9) AS score FROM k WHERE rank <= 100")
def top_frames_within_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_frames(_frames(spark, sf_dir), _tasks(spark, sf_dir), Retrieval(candidates=100, neighbours="video")).withColumn("score", F.round("score", 9))


@query(f"WITH {_TOP_CTE} SELECT task_id, CAST(rank AS INT) AS rank, 'v' || label AS video, idx * 40 AS frame, '' AS tar_name FROM k WHERE rank <= 20")
def described_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return described(top_frames(frames, _tasks(spark, sf_dir), Retrieval(candidates=20)), frames).select("task_id", "rank", "video", "frame", "tar_name")


@query(f"""WITH {_TOP_CTE}, l AS (SELECT ordinal, task_id, list(struct_pack(rank := CAST(rank AS INT), video_id := 'v' || label, frame_ms := idx * 40) ORDER BY rank) AS results FROM k WHERE rank <= 10 GROUP BY ALL)
SELECT task_id, ordinal, CAST(to_json(results) AS VARCHAR) AS results FROM l""")
def results_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of tasks that look for no text."""
    tasks = _tasks(spark, sf_dir).withColumn("ocr_texts", F.array().cast("array<string>"))
    seen = spark.createDataFrame([], "video string, frame long, texts array<string>")
    return retrieve(_frames(spark, sf_dir), tasks, seen).withColumn("results", F.to_json("results"))


@query()
def results_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run, with fuzzy text matching; SQL has no such match, tests hold it against a plain one."""
    seen = _read(spark, sf_dir, "documents").select((F.col("doc_id") * 40).alias("frame"), F.array("text").alias("texts"))
    placed = _frames(spark, sf_dir).select(F.col("video_id").alias("video"), F.col("frame_ms").alias("frame"))
    return retrieve(_frames(spark, sf_dir), _tasks(spark, sf_dir), placed.join(seen, "frame")).withColumn("results", F.to_json("results"))


@query(f"""WITH {_TOP_CTE}, l AS (SELECT ordinal, task_id, list(struct_pack(rank := CAST(rank AS INT), video_id := 'v' || label, frame_ms := idx * 40) ORDER BY rank) AS results FROM k WHERE rank <= 10 GROUP BY ALL)
SELECT CAST(to_json(struct_pack(predictions := list(struct_pack(task_id := task_id, results := results) ORDER BY ordinal))) AS VARCHAR) AS document FROM l""")
def submission_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, tasks = _frames(spark, sf_dir), _tasks(spark, sf_dir)
    best = described(top_frames(frames, tasks, Retrieval(candidates=10)), frames).select("task_id", "rank", "video", "frame")
    return submission(submission_rows(best, tasks))


@query(f"""WITH {_TOP_CTE}, c AS (SELECT task_id, rank, idx, score, idx % 3 <> 0 AS img, CASE WHEN CAST(task_id AS INT) % 4 = 0 THEN [0.85 + (idx % 4) * 0.05::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE] ELSE [] END AS ratios FROM k WHERE rank <= 100),
f AS (SELECT *, CASE WHEN len(ratios) > 0 THEN score * (1 + least(list_sum(list_transform(ratios, lambda x: CASE WHEN x >= 0.9::DOUBLE THEN x * 0.1::DOUBLE ELSE 0 END)), 0.2::DOUBLE)) ELSE score END AS final FROM c WHERE len(ratios) = 0 OR img)
SELECT task_id, idx, CAST(place AS INT) AS place, round(final, 9) AS final FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY final DESC, rank) AS place FROM f) WHERE place <= 10""")
def rerank_by_given_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus, cap, image filter and order of the text rerank, with ratios given instead of matched."""
    best = top_frames(_frames(spark, sf_dir), _tasks(spark, sf_dir), Retrieval(candidates=100))
    given = F.when(F.col("task_id").cast("int") % 4 == 0, F.array(F.lit(0.85) + F.col("idx") % 4 * F.lit(0.05), F.lit(0.95), F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    shown = best.withColumn("ratios", given).filter((F.size("ratios") == 0) | (F.col("idx") % 3 != 0))
    final = shown.withColumn("final", F.when(F.size("ratios") > 0, F.col("score") * (1 + text_bonus(F.col("ratios")))).otherwise(F.col("score")))
    placed = final.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("final").desc(), "rank")))
    return placed.filter("place <= 10").select("task_id", "idx", "place", F.round("final", 9).alias("final"))


@query()
def fuzzy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each document's text matches that of the benchmark item in turn."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("text").alias("target"), (F.row_number().over(Window.orderBy("item_id")) - 1).alias("turn"))
    docs = _read(spark, sf_dir, "documents").withColumn("turn", F.pmod("doc_id", F.lit(max(items.count(), 1))))
    return spread(docs).join(F.broadcast(items), "turn", "left").select("doc_id", partial_ratio_of(F.lower("target"), F.lower("text")).alias("ratio"))


@query("SELECT CAST(item_id AS VARCHAR) AS task_id, text AS description, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ordinal FROM benchmark")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of JSON lines, with blank ones between and tasks that come again, read."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("description"))).alias("line"))
    again = F.to_json(F.struct(F.col("item_id").cast("string").alias("task_id"), F.lit("again").alias("description")))
    lines = items.select("item_id", F.posexplode(F.array("line", F.lit("  "))).alias("k", "value")).unionByName(items.select((F.col("item_id") + 10**9).alias("item_id"), F.lit(0).alias("k"), again.alias("value")))
    return tasks_of(lines, F.struct("item_id", "k")).select("task_id", "description", F.col("ordinal").cast("int").alias("ordinal"))


@query("SELECT CAST(conv_id AS VARCHAR) AS task_id, text AS description FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def first_of_repeated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id"), F.col("text").alias("description"), F.col("turn").alias("ordinal"))
    return first_of_each(rows).select("task_id", "description")


@query("SELECT CAST(item_id AS VARCHAR) AS task_id, text AS query, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ordinal FROM benchmark")
def query_list_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of {id, query}, written and taken apart again."""
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"))
    text = _read(spark, sf_dir, "benchmark").agg(F.to_json(F.sort_array(F.collect_list(F.struct("item_id", one.alias("q"))))["q"]).alias("value"))
    return query_list_of(text)


@query("""SELECT CAST(item_id AS VARCHAR) AS task_id, text AS original_query, CAST(len([] :: VARCHAR[]) AS INT) AS n_before, text AS main_shot,
CASE WHEN item_id % 2 = 0 THEN 'shown' ELSE '' END AS ocr FROM benchmark""")
def quoted_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(' "shown"'))).otherwise(F.col("text"))
    parsed = quote_parsed(_read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), said.alias("description")))
    bare = lambda c: F.regexp_replace(c, ' "shown"$', "")
    return parsed.select("task_id", bare("original_query").alias("original_query"), F.size("context_before").alias("n_before"), bare("main_shot").alias("main_shot"), F.array_join("ocr_texts", "|").alias("ocr"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS task_id, 'q' || conv_id AS original_query, CASE WHEN conv_id % 2 = 0 THEN 'm' ELSE 'q' || conv_id END AS main_shot,
CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_before, CAST(0 AS INT) AS n_ocr FROM (SELECT DISTINCT conv_id FROM conversations)""")
def parsed_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object of parsed queries by id, with keys missing or null, exploded and completed."""
    ids = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    text = ids.select(F.concat(F.lit('{"'), F.col("conv_id").cast("string"), F.lit('":{"original_query":"q'), F.col("conv_id").cast("string"), F.lit('"'), F.when(F.col("conv_id") % 2 == 0, ',"main_shot":"m"').otherwise(',"main_shot":null'), F.when(F.col("conv_id") % 3 == 0, ',"context_before":["b"]').otherwise(""), F.lit("}}")).alias("value"))
    rows = parsed_of(text)
    return rows.select("task_id", "original_query", "main_shot", F.size("context_before").alias("n_before"), F.size("ocr_texts").alias("n_ocr"))


@query("SELECT conv_id, CAST(count(*) AS INT) AS turns, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("said"))
    return told.select("conv_id", F.size("said").alias("turns"), first_or_null(F.col("said"))["text"].alias("first_text"))


@query("""SELECT o_orderkey, CAST(trunc(o_custkey / (24.0::DOUBLE + o_custkey % 7) * 1000) AS BIGINT) AS ms,
printf('frame_%08d.webp', CAST(trunc(o_custkey / (24.0::DOUBLE + o_custkey % 7) * 1000) AS BIGINT)) AS file, CAST(trunc(o_custkey / (24.0::DOUBLE + o_custkey % 7) * 1000) AS BIGINT) AS parsed FROM orders""")
def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = milliseconds(F.col("o_custkey"), F.lit(24.0) + F.col("o_custkey") % 7)
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", ms.alias("ms"))
    return rows.withColumn("file", frame_file(F.col("ms"))).withColumn("parsed", frame_ms(F.col("file")))


_SAMPLED = """v AS (SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_size / 2.0::DOUBLE AS fps, CAST(p_partkey % 90 AS BIGINT) AS frames FROM part),
h AS (SELECT *, CAST(round_even(fps * 1.0, 0) AS BIGINT) AS hop FROM v),
f AS (SELECT video_id, fps, unnest(range(0, frames, hop)) AS frame_index FROM h WHERE frames > 0 AND hop > 0)"""


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), (F.col("p_size") / 2.0).alias("fps"), (F.col("p_partkey") % 90).alias("frames"))


@query(f"WITH {_SAMPLED} SELECT video_id, frame_index, CAST(trunc(frame_index / fps * 1000) AS BIGINT) AS frame_ms, printf('frame_%08d.webp', CAST(trunc(frame_index / fps * 1000) AS BIGINT)) AS frame_file FROM f")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(_videos(spark, sf_dir), 1.0)


@query(f"WITH {_SAMPLED} SELECT video_id, frame_index FROM f WHERE frame_index < coalesce((SELECT min(g.frame_index) FROM f g WHERE g.video_id = f.video_id AND g.frame_index % 17 = 16), 1000000)")
def frames_before_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampled(_videos(spark, sf_dir), 1.0).withColumn("image", F.when(F.col("frame_index") % 17 != 16, F.lit("x")))
    return until_failure(rows, "image").select("video_id", "frame_index")


@query("""WITH p AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'V3C1' WHEN 1 THEN 'V3C2' ELSE 'OTHER' END AS d, printf('%05d', s_suppkey) AS f FROM supplier)
SELECT d AS dataset, f AS folder, lower(d) || '_' || f AS video_id FROM p WHERE d <> 'OTHER' AND s_suppkey % 5 <> 0""")
def video_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    folder = F.format_string("%05d", k)
    dataset = F.when(k % 3 == 0, "V3C1").when(k % 3 == 1, "V3C2").otherwise("OTHER")
    stem = F.when(k % 5 == 0, F.lit("other")).otherwise(folder)
    paths = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("file:/data/"), dataset, F.lit("/videos/"), folder, F.lit("/"), stem, F.lit(".mp4")).alias("path"))
    return catalogue_of(paths).drop("path")


@query("""WITH f AS (SELECT 'v' || o_custkey % 20 AS video_id, printf('frame_%08d.webp', o_orderkey) AS frame_file, o_orderkey AS frame_ms FROM orders)
SELECT video_id, frame_file, CAST(row_number() OVER (ORDER BY video_id, frame_file) - 1 AS BIGINT) AS idx, frame_ms FROM f""")
def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "orders").select(F.concat(F.lit("v"), (F.col("o_custkey") % 20).cast("string")).alias("video_id"), frame_file(F.col("o_orderkey")).alias("frame_file"))
    return indexed(files)


@query("""SELECT s_suppkey AS idx, CASE s_suppkey % 4 WHEN 0 THEN 'a' || s_suppkey WHEN 1 THEN 'b' || s_suppkey WHEN 2 THEN 'unknown' ELSE 'c' END AS video_id,
CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 10 WHEN 1 THEN s_suppkey WHEN 2 THEN 0 ELSE CASE WHEN s_suppkey % 8 = 3 THEN s_suppkey ELSE 0 END END AS BIGINT) AS frame_ms,
CASE s_suppkey % 4 WHEN 1 THEN 't' ELSE '' END AS tar_name FROM supplier""")
def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    entry = F.expr("s_suppkey % 4")
    text = (
        F.when(entry == 0, F.concat(F.lit('{"video_id":"a'), k, F.lit('","frame_ms":'), (F.col("s_suppkey") * 10).cast("string"), F.lit("}")))
        .when(entry == 1, F.concat(F.lit('{"video":"b'), k, F.lit('","frame":'), k, F.lit(',"tar_name":"t"}')))
        .when(entry == 2, F.lit("{}"))
        .otherwise(F.concat(F.lit('["c","frame_'), F.when(F.col("s_suppkey") % 8 == 3, F.lpad(k, 8, "0")).otherwise(F.lit("bad")), F.lit('.jpg"]')))
    )
    return normalised_metadata(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), text.alias("entry")))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS length, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(v), 9).alias("length"), F.round(unit(v, 1e-12)[0], 9).alias("first"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id), first_value(embedding::DOUBLE[]) OVER (ORDER BY vec_id)) AS x FROM embeddings)
SELECT vec_id, round(list_dot_product(list_transform(e, lambda y, i: y * 10 + x[i] * 4), e), 9) AS likeness FROM v""")
def weighted_vector_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and that of the next id, after the last the first; the places are those of the frame index."""
    files = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit("v").alias("video_id"), F.format_string("frame_%020d.webp", "vec_id").alias("frame_file"))
    v = indexed(files).select("idx", "vec_id", "embedding")
    n = max(v.count(), 1)
    other = v.select(F.pmod(F.col("idx") - 1, F.lit(n)).alias("idx"), F.col("embedding").alias("next"))
    return v.join(other, "idx").select("vec_id", F.round(dot(weighted_sum(F.array("embedding", "next"), F.array(F.lit(10.0), F.lit(4.0))), F.col("embedding")), 9).alias("likeness"))


@query(f"""WITH {_TOP_CTE}, a AS (SELECT task_id, idx, rank, 2.0::DOUBLE AS w FROM k WHERE rank <= 50 UNION ALL
SELECT task_id, idx, row_number() OVER (PARTITION BY task_id ORDER BY mb DESC, idx DESC) AS rank, 1.0::DOUBLE FROM s QUALIFY rank <= 50),
u AS (SELECT task_id, idx, sum(w / (rank + 60.0::DOUBLE)) AS score FROM a GROUP BY ALL)
SELECT task_id, idx, round(score, 9) AS score FROM u""")
def reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, tasks = _frames(spark, sf_dir), _tasks(spark, sf_dir)
    lists = [top_frames(frames, tasks, Retrieval(candidates=50), by=by).select("task_id", "idx", "rank", F.lit(weight).alias("weight")) for by, weight in (("score", 2.0), ("max_before", 1.0))]
    return fused_ranks(lists[0].unionByName(lists[1])).select("task_id", "idx", F.round("score", 9).alias("score"))


_PIXELS = "px AS (SELECT l_suppkey AS frame, l_partkey * 7 % 256 AS v, l_orderkey * 5 % 180 AS h, l_linenumber * 37 % 256 AS s FROM lineitem)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), F.expr("l_partkey * 7 % 256").alias("v"), F.expr("l_orderkey * 5 % 180").alias("h"), F.expr("l_linenumber * 37 % 256").alias("s"))


@query(f"WITH {_PIXELS} SELECT frame, CAST(v * 32 // 256 AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("frame", value_bin(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PIXELS} SELECT frame, CAST((h * 32 // 180) * 32 + s * 32 // 256 AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL")
def hue_saturation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("frame", hue_saturation_bin(F.col("h"), F.col("s")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PIXELS} SELECT frame, round(avg(v), 6) AS mean_v, round(avg(s), 6) AS mean_s, avg(v) < 128 OR avg(s) < 100 AS night FROM px GROUP BY frame")
def day_or_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _pixels(spark, sf_dir).groupBy("frame").agg(F.avg("v").alias("v"), F.avg("s").alias("s"))
    return means.select("frame", F.round("v", 6).alias("mean_v"), F.round("s", 6).alias("mean_s"), is_night(F.col("v"), F.col("s"), 128, 100).alias("night"))


@query(f"""WITH {_PIXELS}, c AS (SELECT frame, v * 32 // 256 AS b, count(*) AS n FROM px GROUP BY ALL),
d AS (SELECT f.frame, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT frame FROM px) f CROSS JOIN (SELECT unnest(range(0, 32)) AS b) g LEFT JOIN c ON c.frame = f.frame AND c.b = g.b),
m AS (SELECT frame, b, CASE WHEN max(n) OVER w > min(n) OVER w THEN (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w)::DOUBLE ELSE 0 END AS x FROM d WINDOW w AS (PARTITION BY frame)),
j AS (SELECT a.frame, sum(sqrt(a.x * z.x)) AS shared, sqrt(sum(a.x) * sum(z.x)) AS mass FROM m a JOIN m z ON z.frame = a.frame + 1 AND z.b = a.b GROUP BY a.frame)
SELECT frame, round(sqrt(greatest(0, 1 - CASE WHEN mass > 0 THEN shared / mass ELSE 0 END)), 7) AS distance FROM j""")
def histogram_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pixels(spark, sf_dir).groupBy("frame", value_bin(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by_bin = counts.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = by_bin.select("frame", min_max(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))).alias("x"))
    after = dense.select((F.col("frame") - 1).alias("frame"), F.col("x").alias("y"))
    return dense.join(after, "frame").select("frame", F.round(bhattacharyya(F.col("x"), F.col("y")), 7).alias("distance"))


@query("""WITH px AS (SELECT l_suppkey AS frame, l_partkey % 128 AS x, l_orderkey % 128 AS y, l_linenumber AS v FROM lineitem), t AS (SELECT unnest([0, 32, 64]) AS o)
SELECT frame, a.o AS tile_x, b.o AS tile_y, count(*) AS n, round(avg(v), 6) AS mean FROM px JOIN t a ON x >= a.o AND x < a.o + 64 JOIN t b ON y >= b.o AND y < b.o + 64 GROUP BY ALL""")
def overlapping_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel goes to the tiles of side 64 and step 32 that cover it."""
    px = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 128).alias("x"), (F.col("l_orderkey") % 128).alias("y"), F.col("l_linenumber").alias("v"))
    placed = px.withColumn("tile_x", F.explode(tiles_over(F.col("x")))).withColumn("tile_y", F.explode(tiles_over(F.col("y"))))
    return placed.groupBy("frame", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT label, vec_id, n, e AS last, true AS kept FROM o WHERE n = 1 UNION ALL
SELECT o.label, o.vec_id, o.n, CASE WHEN 1 - list_dot_product(w.last, o.e) > 0.9 THEN o.e ELSE w.last END, 1 - list_dot_product(w.last, o.e) > 0.9 FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1)
SELECT 'v' || label AS video_id, vec_id AS idx, kept FROM w""")
def thinned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinned(_frames(spark, sf_dir).select("video_id", "idx", "embedding"), "idx", "embedding", 0.9, one_minus_dot).select("video_id", "idx", "kept")


@query("""WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT label, vec_id, n, e AS last, true AS kept FROM o WHERE n = 1 UNION ALL
SELECT o.label, o.vec_id, o.n, CASE WHEN 1 - list_dot_product(w.last, o.e) > 0.9 THEN o.e ELSE w.last END, 1 - list_dot_product(w.last, o.e) > 0.9 FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1)
SELECT 'v' || label AS video_id, vec_id AS idx, false AS late FROM w WHERE kept""")
def thinned_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that stay, out of a stream that runs while they come in: three times, and each time some that should have come before."""
    place, frames = _folder(spark), _frames(spark, sf_dir).select("video_id", "idx", "embedding", F.lit(False).alias("done"))
    span = max(1, math.ceil(((frames.agg(F.max("idx")).collect()[0][0] or 0) + 1) / 2))
    comes = (F.floor(F.col("idx") / span) + F.pmod(F.xxhash64("idx"), F.lit(2))).cast("int")
    closing = frames.select("video_id").distinct().select("video_id", F.lit(None).cast("long").alias("idx"), F.lit(None).cast(frames.schema["embedding"].dataType).alias("embedding"), F.lit(True).alias("done"))
    frames.limit(0).write.parquet(f"{place}/in")
    with rocks(spark):
        thinned_now = thinned_late(spark.readStream.schema(frames.schema).parquet(f"{place}/in"), "embedding", 0.9, span, one_minus_dot, end="done")
        running = thinned_now.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").start()
    try:
        for turn in range(3):
            came = frames.filter(comes == turn)
            (came.unionByName(closing) if turn == 2 else came).write.mode("append").parquet(f"{place}/in")
            running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema("video_id string, idx long, late boolean").parquet(f"{place}/out")


@query(f"WITH {_TOP_CTE} SELECT task_id, CAST(rank AS INT) AS rank, idx, round(score, 9) AS score FROM k WHERE rank <= 20")
def results_of_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frames of tasks that come in by two batches, kept once each, though a second run reads all tasks again."""
    place, tasks = _folder(spark), _tasks(spark, sf_dir)
    table = OnceTable(spark, f"{place}/results", "task_id string, rank int, idx long, score double")
    for turn in range(2):
        tasks.filter(F.col("ordinal") % 2 == turn).write.mode("append").parquet(f"{place}/in")
        for run in ("first", "second"):
            stream = spark.readStream.schema(tasks.schema).parquet(f"{place}/in")
            work = lambda batch: top_frames(_frames(batch.sparkSession, sf_dir), batch, Retrieval(candidates=20)).select("task_id", F.col("rank").cast("int"), F.col("idx").cast("long"), F.round("score", 9).alias("score"))
            work_once(stream, table, run, work, f"{place}/{run}", "task_id").awaitTermination()
    return table.read()


@query("""WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT label, n, e AS last, true AS kept FROM o WHERE n = 1 UNION ALL
SELECT o.label, o.n, CASE WHEN 1 - list_dot_product(w.last, o.e) > 0.9 THEN o.e ELSE w.last END, 1 - list_dot_product(w.last, o.e) > 0.9 FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1)
SELECT count(*) FILTER (WHERE kept) AS saved, count(*) FILTER (WHERE NOT kept) AS skipped, count(DISTINCT label) AS videos FROM w""")
def saved_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = thinned(_frames(spark, sf_dir).select("video_id", "idx", "embedding"), "idx", "embedding", 0.9, one_minus_dot)
    return totals(kept.groupBy("video_id").agg(F.count(F.when(F.col("kept"), 1)).alias("saved"), F.count(F.when(~F.col("kept"), 1)).alias("skipped")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tasks_still_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return still_open(_read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def results_still_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return still_wanted(_read(spark, sf_dir, "labels").select("doc_id", "quality"), _read(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    return resumed(docs, labels, lambda left: left.withColumn("quality", F.lit(-1)), "doc_id")


@query(f"SELECT item_id, printf('%02d', CAST((row_number() OVER (ORDER BY item_id) - 1) // {CHUNK} + 1 AS INT)) AS chunk FROM benchmark")
def task_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_read(spark, sf_dir, "benchmark").select("item_id"), F.col("item_id")).select("item_id", chunk_name(F.col("ordinal"), CHUNK).alias("chunk"))


@query("""WITH p AS (SELECT CAST(item_id AS VARCHAR) AS task_id, part, row_number() OVER (PARTITION BY part ORDER BY item_id) AS place,
CAST(to_json([struct_pack(rank := 1, video_id := 'p' || part, frame_ms := item_id)]) AS VARCHAR) AS results
FROM benchmark, (SELECT unnest([1, 2, 3]) AS part) WHERE (item_id + part) % 3 <> 0),
o AS (SELECT *, row_number() OVER (ORDER BY part, place) - 1 AS ordinal FROM p)
SELECT CAST(ordinal AS INT) AS ordinal, task_id, results FROM o QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ordinal) = 1""")
def united_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission parts, written as arrays and as documents, that share tasks, and one file that is none, merged."""
    items = _read(spark, sf_dir, "benchmark").withColumn("part", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter("(item_id + part) % 3 <> 0")
    result = F.struct(F.lit(1).alias("rank"), F.concat(F.lit("p"), F.col("part").cast("string")).alias("video_id"), F.col("item_id").cast("long").alias("frame_ms"))
    one = F.struct("item_id", F.struct(F.col("item_id").cast("string").alias("task_id"), F.array(result).alias("results")).alias("p"))
    told = items.groupBy("part").agg(F.sort_array(F.collect_list(one))["p"].alias("predictions"))
    texts = told.select(F.when(F.col("part") == 2, F.to_json(F.struct("predictions"))).otherwise(F.to_json("predictions")).alias("value"), F.concat(F.lit("part_"), F.col("part").cast("string")).alias("part"))
    return merged(parts_of(texts.unionByName(spark.createDataFrame([("no submission", "part_0")], "value string, part string")))).withColumn("results", F.to_json("results"))


@query("""SELECT conv_id, CAST(len(list_slice(l, 1, 3)) AS INT) AS head, array_to_string(list_slice(l, 1, 2), '|') AS first_two, l[len(l)] AS last FROM (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id)""")
def list_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")))["role"].alias("l"))
    return told.select("conv_id", F.size(F.slice("l", 1, 3)).alias("head"), F.array_join(F.slice("l", 1, 2), "|").alias("first_two"), F.reverse("l")[0].alias("last"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT min(event_type) AS first FROM events),
x AS (SELECT user_id, max(n) FILTER (WHERE event_type = first) AS n FROM m, f GROUP BY user_id)
SELECT m.user_id, event_type, m.n, coalesce(x.n, 0) AS found, -1::BIGINT AS absent FROM m JOIN x USING (user_id) WHERE m.n > 1""")
def map_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a map by a condition, and look-ups with a default, of a key that most maps have and of one that none has."""
    events = _read(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    first = events.agg(F.min("event_type")).collect()[0][0] or ""
    look = lambda key, other: F.coalesce(F.try_element_at("m", F.lit(key)), F.lit(other).cast("long"))
    return maps.select("user_id", look(first, 0).alias("found"), look("no such type", -1).alias("absent"), F.explode(F.map_filter("m", lambda k, v: v > 1)).alias("event_type", "n"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(chr(9) || text || chr(10), '^\\s+', ''), '\\s+$', '') AS bare, lower(source) || '_x' AS name FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", stripped(F.concat(F.lit("\t"), "text", F.lit("\n"))).alias("bare"), F.concat_ws("_", F.lower("source"), F.lit("x")).alias("name"))


@query("""SELECT CAST(item_id AS VARCHAR) AS task_id, CAST(v AS INT) AS variant, CASE WHEN v = 0 THEN text ELSE text || ' #' || v END AS query, CASE WHEN v = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS v) WHERE v <= item_id % 4""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("description"), "item_id")
    made = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.col("item_id") % 4).cast("int")), lambda v: F.concat("description", F.lit(" #"), v.cast("string")))
    return with_variants(items, items.select("task_id", made.alias("variants")))


@query("SELECT CAST(item_id AS VARCHAR) AS task_id, '" + prompt("\0").replace("'", "''").replace("\0", "' || text || '") + "' AS prompt FROM benchmark")
def parser_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), prompt_of(F.col("text")).alias("prompt"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey * 7 % 256 AS b, l_orderkey * 5 % 256 AS g, l_suppkey * 37 % 256 AS r FROM lineitem),
x AS (SELECT *, greatest(b, g, r) AS t, greatest(b, g, r) - least(b, g, r) AS d FROM p),
k AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = r THEN 30.0::DOUBLE * (g - b) / d WHEN t = g THEN 60 + 30.0::DOUBLE * (b - r) / d ELSE 120 + 30.0::DOUBLE * (r - g) / d END AS hue FROM x)
SELECT l_orderkey, l_linenumber, CAST((floor(hue + 0.5) + 180) % 180 AS INT) AS h, CAST(CASE WHEN t = 0 THEN 0 ELSE floor(255.0::DOUBLE * d / t + 0.5) END AS INT) AS s, CAST(t AS INT) AS v FROM k""")
def pixel_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 7 % 256").alias("b"), F.expr("l_orderkey * 5 % 256").alias("g"), F.expr("l_suppkey * 37 % 256").alias("r"))
    return px.select("l_orderkey", "l_linenumber", hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("""WITH p AS (SELECT p_partkey, 5 + p_partkey % 40 AS p, 1 + p_partkey % 5 AS q FROM part)
SELECT p_partkey, CAST(round_even(2.0::DOUBLE * q / (p + q) * 100, 0) AS INT) AS ratio, [round_even(2.0::DOUBLE * q / (p + q) * 100, 0) / 100, 1.0::DOUBLE, 0.0::DOUBLE] AS best FROM p""")
def known_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose ratio has a closed form: p times a, looked for in fewer (q) times a and p times b, is best at the stretch of q characters."""
    part = _read(spark, sf_dir, "part").select("p_partkey", F.expr("repeat('a', CAST(5 + p_partkey % 40 AS INT))").alias("target"), F.expr("repeat('a', CAST(1 + p_partkey % 5 AS INT)) || repeat('b', CAST(5 + p_partkey % 40 AS INT))").alias("found"))
    targets, found = F.array(F.upper("target"), F.lit("zz top"), F.lit("999")), F.array("found", F.lit("see ZZ Top here"), F.lit("bbb"))
    return part.select("p_partkey", partial_ratio_of(F.col("target"), F.col("found")).alias("ratio"), best_ratios(targets, found).alias("best"))


@query(f"""WITH {_TOP_CTE}, c AS (SELECT task_id, rank, idx, label, score, CAST(task_id AS INT) AS i FROM k WHERE rank <= 100),
f AS (SELECT *, i % 4 = 0 AS asks, idx % 3 <> 0 AND i % 5 <> 0 AS img, CASE WHEN idx % 4 = 0 THEN CASE WHEN i % 8 = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END ELSE 0 END AS bonus FROM c),
g AS (SELECT *, CASE WHEN asks AND i % 5 <> 0 THEN score * (1 + bonus) ELSE score END AS final FROM f WHERE NOT asks OR i % 5 = 0 OR img)
SELECT task_id, CAST(place AS INT) AS rank, 'v' || label AS video, idx * 40 AS frame, round(final, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN asks AND i % 5 <> 0 THEN final ELSE 0 END DESC, rank) AS place FROM g) WHERE place <= 10""")
def reranked_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text rerank, with texts that either hold a target or share no letter with it; tasks of every fifth number see no image at all."""
    frames = _frames(spark, sf_dir)
    tasks = _tasks(spark, sf_dir).withColumn("i", F.col("task_id").cast("int"))
    wanted = F.when(F.col("i") % 8 == 0, F.array(F.lit("Exit"), F.lit("sign"), F.lit("exit sign"))).when(F.col("i") % 4 == 0, F.array(F.lit("exit"))).otherwise(F.array().cast("array<string>"))
    tasks = tasks.withColumn("ocr_texts", wanted)
    best = described(top_frames(frames, tasks, Retrieval(candidates=100)), frames).select("task_id", "rank", "video", "frame", "score")
    texts = F.when(F.col("idx") % 4 == 0, F.array(F.lit("qqqq"), F.lit("an EXIT SIGN here"))).otherwise(F.array(F.lit("qqqq")))
    seen = frames.filter("idx % 3 <> 0").select(F.col("video_id").alias("video"), F.col("frame_ms").alias("frame"), texts.alias("texts"))
    blind = F.col("task_id").cast("int") % 5 == 0
    apart = best.withColumn("video", F.when(blind, F.concat(F.lit("blind "), "video")).otherwise(F.col("video")))
    return reranked(apart, tasks, seen).select("task_id", "rank", F.regexp_replace("video", "^blind ", "").alias("video"), "frame", F.round("score", 9).alias("score"))
