import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscope.config import model_of
from reelscope.functions import pixels
from reelscope.functions.providers import encoded, encoder_for, quote_parsed, task_vectors
from reelscope.plans.run import main
from reelscope.sources import images, tables
from reelscope.streaming.resume import still_open


def test_extracted_frames(spark):
    class Decoder:
        """Video of shots of four seconds; the third shot of "cut" cannot be read."""

        def open(self, path):
            return None if path == "gone" else (2.0, 24)

        def frame(self, path, index):
            shot = index // 8
            if path == "cut" and shot == 2:
                return None
            own = np.random.default_rng(shot)
            return bytes([index]), *(own.integers(shot * 20, shot * 20 + 30, (128, 128)) for _ in range(3))

    videos = spark.createDataFrame([("a", "whole"), ("b", "cut"), ("c", "gone")], "video_id string, path string")
    frames, seen = images.counted(images.extracted_frames(videos, Decoder()))
    got = sorted((r["video_id"], r["frame_ms"], r["frame_file"]) for r in frames.collect())
    assert [x[:2] for x in got] == [("a", 0), ("a", 4000), ("a", 8000), ("b", 0), ("b", 4000)]
    assert got[1][2] == "frame_00004000.webp" and seen.get == {"saved": 5, "videos": 2}


def test_images_and_texts(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "frame_00000040.webp").write_bytes(b"exit")
    (tmp_path / "v1" / "note.txt").write_bytes(b"x")

    class Reader:
        def read(self, batch):
            return [[x.decode()] for x in batch]

    found = images.read_images(spark, str(tmp_path))
    candidates = spark.createDataFrame([("v1", 40), ("v1", 40), ("v2", 40)], "video string, frame long")
    got = images.texts_seen(candidates, found, Reader()).collect()
    assert [tuple(r) for r in got] == [("v1", 40, ["exit"])]


def test_run_from_files(spark, tmp_path):
    class Letters:
        dimension = 26

        def encode(self, items):
            return [[1.0 * t.count(chr(97 + k)) for k in range(26)] for t in items]

    names = ["aaa", "abc", "zzz", "xyz"]
    files = spark.createDataFrame([("v", f"frame_{k * 40:08d}.webp", Letters().encode([t])[0]) for k, t in enumerate(names)], "video_id string, frame_file string, embedding array<double>")
    tables.write_frames(tables.indexed(files), str(tmp_path / "store"))
    (tmp_path / "tasks.jsonl").write_text('{"task_id": 1, "description": "zzz"}\n{"task_id": 2, "description": "abc"}\n')
    tasks = tables.read_tasks(spark, str(tmp_path / "tasks.jsonl"))
    task_vectors(quote_parsed(tasks), Letters()).write.parquet(str(tmp_path / "vectors"))
    args = [x for k in ("frames", "tasks", "vectors", "output") for x in (f"--{k}", str(tmp_path / {"frames": "store", "tasks": "tasks.jsonl", "vectors": "vectors", "output": "out.json"}[k]))]
    main(args, spark)
    made = json.loads((tmp_path / "out.json").read_text())["predictions"]
    assert [p["task_id"] for p in made] == ["1", "2"]
    assert made[0]["results"][0] == {"rank": 1, "video_id": "v", "frame_ms": 80} and made[1]["results"][0]["frame_ms"] == 40
    spark.createDataFrame([("1", [1.0], [], [], [])], "task_id string, main_vec array<double>, before_vecs array<array<double>>, after_vecs array<array<double>>, ocr_texts array<string>").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="lengths"):
        main([*args[:5], str(tmp_path / "short"), *args[6:]], spark)
    with pytest.raises(Exception):
        main([*args[:1], str(tmp_path / "nowhere"), *args[2:]], spark)


def test_resize_is_the_mean_by_area():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (256, 384, 3)).astype(np.uint8)
    want = image.reshape(128, 2, 128, 3, 3).astype(float).mean(axis=(1, 3))
    assert (pixels.resized(image) == np.rint(np.round(want, 9))).all()
    odd = rng.integers(0, 256, (100, 333, 3)).astype(np.uint8)
    assert abs(pixels.resized(odd, 10).mean() - odd.mean()) < 1 and pixels.resized(odd, 10).shape == (10, 10, 3)
    flat = np.full((17, 900, 3), 77, np.uint8)
    assert (pixels.resized(flat) == 77).all()


def test_colours(spark):
    import colorsys

    rng = np.random.default_rng(4)
    image = np.concatenate([rng.integers(0, 256, (30, 30, 3)), np.zeros((1, 30, 3)), np.full((1, 30, 3), 255)]).astype(np.uint8)
    h, s, v = pixels.hue_saturation_value(image)
    for (b, g, r), hue, saturation, value in zip(image.reshape(-1, 3).tolist(), h.ravel(), s.ravel(), v.ravel(), strict=True):
        x, y, z = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert min(abs(hue - x * 180), 180 - abs(hue - x * 180)) <= 0.5 + 1e-9 and abs(saturation - y * 255) <= 0.5 + 1e-9 and value == round(z * 255)
    rows = spark.createDataFrame([tuple(p) for p in image.reshape(-1, 3)[::7].tolist()], "b int, g int, r int")
    got = rows.select(pixels.hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == list(zip(*(x.ravel()[::7].tolist() for x in (h, s, v)), strict=True))


def test_extraction_store_goes_on(spark, tmp_path):
    """Frames of whole pixels; a video that cannot be opened is tried again, one that is cut short is done."""

    class Decoder:
        def __init__(self, gone):
            self.gone = gone

        def open(self, path):
            return None if path in self.gone else (1.0, 9)

        def frame(self, path, index):
            if path == "cut" and index == 5:
                return None
            return bytes([index]), np.full((40, 50, 3), 40 + 60 * (index // 3), np.uint8) + np.arange(3, dtype=np.uint8) * 30

    videos = spark.createDataFrame([("a", "whole"), ("b", "cut"), ("c", "late")], "video_id string, path string")
    path = str(tmp_path / "store")
    images.write_extraction(images.extraction(videos, Decoder({"late"})), path)
    frames, completed = images.read_extracted(spark, path)
    assert sorted(map(tuple, completed.collect())) == [("a", 3, 6), ("b", 2, 3)]
    left = still_open(videos, completed, "video_id")
    assert [r["video_id"] for r in left.collect()] == ["c"]
    rate = images.timed(images.extraction(left, Decoder(set())), lambda rows: images.write_extraction(rows, path))
    assert rate["rows"] == 4 and rate["seconds"] > 0 and rate["rate"] > 0
    frames, completed = images.read_extracted(spark, path)
    assert sorted((r["video_id"], r["frame_ms"]) for r in frames.collect()) == [("a", 0), ("a", 3000), ("a", 6000), ("b", 0), ("b", 3000), ("c", 0), ("c", 3000), ("c", 6000)]
    assert tuple(images.totals(completed).collect()[0]) == (3, 8, 15) and tuple(images.totals(completed.limit(0)).collect()[0]) == (0, 0, 0)


def test_encoder_of_the_store(spark):
    class Of:
        def __init__(self, dimension):
            self.dimension, self.seen = dimension, []

        def encode(self, items):
            assert len(items) <= 2
            return [[1.0] * self.dimension for _ in items]

    frames = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "idx long, embedding array<float>")
    small, large = Of(2), Of(3)
    assert encoder_for(frames, [small, large]) is large and encoder_for(frames.limit(0), [small, large]) is small
    with pytest.raises(ValueError, match="length 3"):
        encoder_for(frames, [small])
    assert encoded(spark.createDataFrame([(str(k),) for k in range(7)], "t string"), "t", "v", large, batch_size=2).count() == 7
    assert model_of("1280D")[2] == 1280 and model_of("own", ("m", "w", 8))[0] == "m"
    with pytest.raises(ValueError, match="no set-up"):
        model_of("own")


def test_run_from_tasks_alone(spark, tmp_path, monkeypatch):
    """Parsing, encoding by the model of the store's length, retrieval and submission in one call; begun again, only new tasks are encoded."""
    import sys
    import types

    from pyspark import cloudpickle

    plugged = types.ModuleType("plugged_models")

    class Letters:
        dimension = 26

        def encode(self, items):
            with open(f"{place}/calls", "a") as out:
                out.writelines(f"{t}\n" for t in items)
            return [[1.0 * t.count(chr(97 + k)) for k in range(26)] for t in items]

    class Two:
        dimension = 2

        def encode(self, items):
            raise AssertionError("not the model of the store")

    class Parser:
        def parse(self, queries):
            return [{"context_before": [q.split(" after ")[1]], "main_shot": q} if " after " in q else None for q in queries]

    place = str(tmp_path)
    plugged.Letters, plugged.Two, plugged.Parser = Letters, Two, Parser
    monkeypatch.setitem(sys.modules, "plugged_models", plugged)
    cloudpickle.register_pickle_by_value(plugged)
    values = [[1.0 * t.count(chr(97 + k)) for k in range(26)] for t in ("aaa", "abc", "zzz", "xyz")]
    files = spark.createDataFrame([("v", f"frame_{k * 40:08d}.webp", v) for k, v in enumerate(values)], "video_id string, frame_file string, embedding array<double>")
    tables.write_frames(tables.indexed(files), f"{place}/store")
    call = ["--frames", f"{place}/store", "--tasks", f"{place}/tasks.jsonl", "--vectors", f"{place}/vectors", "--output", f"{place}/out.json", "--encoder", "plugged_models:Two", "plugged_models:Letters", "--parser", "plugged_models:Parser"]
    lines = [{"task_id": 1, "description": "z"}, {"task_id": 2, "description": "a after z"}]
    (tmp_path / "tasks.jsonl").write_text("\n".join(map(json.dumps, lines)))
    main(call, spark)
    first = json.loads((tmp_path / "out.json").read_text())
    assert [(p["task_id"], p["results"][0]["frame_ms"]) for p in first["predictions"]] == [("1", 80), ("2", 0)]
    assert sorted((tmp_path / "calls").read_text().split("\n")[:-1]) == ["a after z", "z", "z"]
    (tmp_path / "tasks.jsonl").write_text("\n".join(map(json.dumps, [*lines, {"task_id": 3, "description": "xyz"}])))
    main(call, spark)
    again = json.loads((tmp_path / "out.json").read_text())
    assert again["predictions"][:2] == first["predictions"] and again["predictions"][2]["results"][0]["frame_ms"] == 120
    assert sorted((tmp_path / "calls").read_text().split("\n")[:-1]) == ["a after z", "xyz", "z", "z"]
