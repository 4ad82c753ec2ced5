import json

import pytest
from pyspark.sql import functions as F

from reelscope.functions.providers import encoded, parsed_queries, quote_parsed
from reelscope.operators.thinning import one_minus_dot, sampled, thinned, until_failure
from reelscope.sources import tables
from reelscope.streaming.resume import resumed, run_available, signalled, stop_on, thinned_stream


def test_tasks(spark, tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text('{"task_id": 7, "description": "a"}\n\n{"task_id": "x", "description": "b", "more": 1}\n{"task_id": 7, "description": "c"}\n')
    got = tables.read_tasks(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["task_id"], r["description"]) for r in got] == [("7", "a"), ("x", "b")]
    path.write_text('{"task_id": "7"}\n')
    with pytest.raises(Exception, match="no description"):
        tables.read_tasks(spark, str(path)).collect()
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        tables.read_tasks(spark, str(path)).collect()


def test_query_list_and_parsed(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": 3, "query": "a"}, "bare"]))
    got = tables.read_query_list(spark, str(tmp_path / "q.json")).orderBy("ordinal").collect()
    assert [(r["task_id"], r["query"]) for r in got] == [("3", "a"), ("1", "bare")]
    (tmp_path / "p.json").write_text(json.dumps({"1": {"original_query": "q", "main_shot": None, "ocr_texts": ["t"]}, "2": {"original_query": "r", "main_shot": "m", "context_before": ["b", "c"]}}))
    rows = {r["task_id"]: r for r in tables.read_parsed(spark, str(tmp_path / "p.json")).collect()}
    assert rows["1"]["main_shot"] == "q" and rows["1"]["context_before"] == [] and rows["1"]["ocr_texts"] == ["t"]
    assert rows["2"]["main_shot"] == "m" and rows["2"]["context_before"] == ["b", "c"]


def test_metadata(spark):
    entries = ['{"video_id":"v","frame_ms":5}', '{"video":"w","frame":7,"tar_name":"t"}', '["x","frame_00012.jpg"]', '["x","bad"]', "{}"]
    rows = spark.createDataFrame(list(enumerate(entries)), "idx long, entry string")
    got = [tuple(r)[1:] for r in tables.normalised_metadata(rows).orderBy("idx").collect()]
    assert got == [("v", 5, ""), ("w", 7, "t"), ("x", 12, ""), ("x", 0, ""), ("unknown", 0, "")]


def test_catalogue(spark, tmp_path):
    for d, folder, name in (("V3C1", "00001", "00001"), ("V3C2", "00002", "other"), ("V3C3", "00003", "00003")):
        (tmp_path / d / "videos" / folder).mkdir(parents=True)
        (tmp_path / d / "videos" / folder / f"{name}.mp4").write_bytes(b"x")
    assert [r["video_id"] for r in tables.video_catalogue(spark, str(tmp_path)).collect()] == ["v3c1_00001"]


def test_store_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("b", "frame_00000040.webp", [1.0]), ("a", "frame_00000080.webp", [2.0]), ("a", "frame_00000000.webp", [3.0])], "video_id string, frame_file string, embedding array<float>")
    frames = tables.indexed(files)
    tables.write_frames(frames, str(tmp_path / "store"))
    assert tables.first_store(spark, [str(tmp_path / "none"), str(tmp_path / "store")]) == str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        tables.first_store(spark, [str(tmp_path / "none")])
    got = tables.read_frames(spark, str(tmp_path / "store")).orderBy("idx").collect()
    assert [(r["idx"], r["video_id"], r["frame_ms"]) for r in got] == [(0, "a", 0), (1, "a", 80), (2, "b", 40)]


def test_providers(spark):
    class Parser:
        def parse(self, queries):
            if any("fail" in q for q in queries):
                raise OSError("service away")
            return [{"main_shot": q.upper(), "context_before": ["x"]} if q != "none" else None for q in queries]

    class Lengths:
        dimension = 2

        def encode(self, items):
            return [[float(len(x)), 0.0] for x in items]

    tasks = spark.createDataFrame([("1", "a"), ("2", "none")], "task_id string, description string")
    rows = {r["task_id"]: r for r in parsed_queries(tasks, Parser()).collect()}
    assert rows["1"]["main_shot"] == "A" and rows["1"]["context_before"] == ["x"] and rows["1"]["ocr_texts"] == []
    assert rows["2"]["main_shot"] == "none" == rows["2"]["original_query"]
    failed = parsed_queries(spark.createDataFrame([("1", "fail")], tasks.schema), Parser()).collect()
    assert failed[0]["main_shot"] == "fail" and failed[0]["context_after"] == []
    quoted = quote_parsed(spark.createDataFrame([("1", 'The text “was slim” and "b".')], tasks.schema)).collect()
    assert quoted[0]["ocr_texts"] == ["was slim", "b"]
    assert encoded(tasks, "description", "v", Lengths()).collect()[0]["v"] == [1.0, 0.0]


def test_sampling(spark):
    videos = spark.createDataFrame([("a", 2.0, 5), ("none", 2.0, 0), ("slow", 0.5, 9)], "video_id string, fps double, frames long")
    got = sampled(videos, 1.0).orderBy("frame_index").collect()
    assert [(r["video_id"], r["frame_index"], r["frame_ms"]) for r in got] == [("a", 0, 0), ("a", 2, 1000), ("a", 4, 2000)]
    read = spark.createDataFrame([("a", 0, "x"), ("a", 2, None), ("a", 4, "x"), ("b", 0, "x")], "video_id string, frame_index long, image string")
    assert sorted(tuple(r)[:2] for r in until_failure(read, "image").collect()) == [("a", 0), ("b", 0)]


def test_thinned(spark):
    rows = spark.createDataFrame([("v", i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(6)] + [("w", 9, [1.0, 0.0])], "video_id string, idx long, embedding array<double>")
    got = {r["idx"]: r["kept"] for r in thinned(rows, "idx", "embedding", 0.5, one_minus_dot).collect()}
    assert [i for i, k in sorted(got.items()) if k] == [0, 3, 9]


def test_resumed(spark):
    tasks = spark.createDataFrame([("1",), ("2",)], "task_id string")
    done = spark.createDataFrame([("1", "old"), ("3", "stale")], "task_id string, r string")
    got = resumed(tasks, done, lambda left: left.withColumn("r", F.lit("new"))).collect()
    assert sorted(map(tuple, got)) == [("1", "old"), ("2", "new")]


def test_stream_goes_on(spark, tmp_path):
    def arrive(name, rows):
        spark.createDataFrame(rows, "video_id string, idx long, x double").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema("video_id string, idx long, x double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        run_available(thinned_stream(stream, "x", 12.0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("a", [("v", 0, 0.0), ("v", 1, 12.0), ("v", 2, 13.0), ("v", 3, 25.0)])
    assert run() == [0, 2]
    arrive("b", [("v", 4, 26.0), ("v", 5, 38.0), ("v", 6, 51.0)])
    assert run() == [0, 2, 4, 6]


def test_parser_over_http(spark):
    """Against a server that answers well, in prose, with other types, with an error and not at all."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from reelscope.functions.services import HttpParser, prompt, prompt_of

    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            query = body["prompt"].rsplit("For the description: ", 1)[1].strip()
            found = {"good": {"context_before": ["b"], "main_shot": "m", "context_after": [], "ocr_texts": "one"}, "odd": {"main_shot": 3, "context_before": None, "extra": 1}}.get(query)
            self.send_response(500 if query == "error" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": json.dumps(found) if found else "no json"}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    tasks = spark.createDataFrame([("1", "good"), ("2", "odd"), ("3", "prose"), ("4", "error")], "task_id string, description string")
    try:
        got = {r["task_id"]: r for r in parsed_queries(tasks, HttpParser(f"http://127.0.0.1:{server.server_port}/api/generate", "some-model", 10.0)).collect()}
    finally:
        server.shutdown()
    assert tuple(got["1"])[1:] == ("good", ["b"], "m", [], ["one"])
    assert all(tuple(got[k])[1:] == (q, [], q, [], []) for k, q in (("2", "odd"), ("3", "prose"), ("4", "error")))
    assert {b["model"] for b in asked} == {"some-model"} and all(b["stream"] is False and b["format"] == "json" and b["options"] == {"temperature": 0.0} for b in asked)
    away = parsed_queries(tasks, HttpParser("http://127.0.0.1:9/none", "m", 0.5)).collect()
    assert all(r["main_shot"] == r["original_query"] for r in away)
    assert sorted(r[0] for r in tasks.select(prompt_of(F.col("description"))).collect()) == sorted(prompt(q) for q in ("good", "odd", "prose", "error"))


def test_parts_are_merged(spark, tmp_path):
    import json

    one = lambda t, v: {"task_id": t, "results": [{"rank": 1, "video_id": v, "frame_ms": 40}]}
    (tmp_path / "part_01.json").write_text(json.dumps([one("a", "v1"), one("b", "v1")]))
    (tmp_path / "part_02.json").write_text(json.dumps({"predictions": [one("b", "v2"), one("c", "v2")]}))
    (tmp_path / "part_03.json").write_text("{broken")
    tables.merge_parts(spark, str(tmp_path / "part_*.json"), str(tmp_path / "all.json"))
    found = json.loads((tmp_path / "all.json").read_text())["predictions"]
    assert [(p["task_id"], p["results"][0]["video_id"]) for p in found] == [("a", "v1"), ("b", "v1"), ("c", "v2")]
    rows = spark.createDataFrame([("a", 0, 1), ("b", 30, 1)], "task_id string, ordinal int, rank int")
    tables.write_candidates(rows, str(tmp_path / "candidates"), 25)
    assert {r["task_id"]: int(r["chunk"]) for r in spark.read.json(str(tmp_path / "candidates")).collect()} == {"a": 1, "b": 2}


def test_a_run_is_stopped_by_a_signal(spark, tmp_path):
    spark.createDataFrame([("v", 0, 0.0)], "video_id string, idx long, x double").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("video_id string, idx long, x double").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    start = lambda name: stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state"))
    assert stop_on(start("ends").trigger(availableNow=True).start(), lambda: False, 0.2) is False
    signal = tmp_path / "stop.signal"
    running = start("runs").trigger(processingTime="1 second").start()
    wanted = signalled(spark, str(signal))
    assert not wanted()
    running.processAllAvailable()
    signal.write_text("")
    assert stop_on(running, wanted, 0.2) is True and spark.read.parquet(str(tmp_path / "runs")).count() == 1
