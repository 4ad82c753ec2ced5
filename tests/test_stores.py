import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscope.config import Retrieval
from reelscope.operators import retrieve
from reelscope.sources import blocks as op
from reelscope.sources import matrix
from reelscope.sources.tables import indexed


def frames_of(spark, n, kind="float", width=5):
    values = np.random.default_rng(n).normal(size=(n, width)).astype(np.float32).tolist()
    return spark.createDataFrame([(i, f"v{i // 9}", values[i]) for i in range(n)], f"idx long, video_id string, embedding array<{kind}>")


def rows_of(blocks):
    return {r["block"]: (r["idx"], bytes(r["vectors"]), r["videos"], bytes(r["centres"]), r["radius"], r["reach"]) for r in blocks.collect()}


@pytest.mark.parametrize(("kind", "cuts"), [("float", [0, 5, 16, 17, 40]), ("double", [0, 32, 33]), ("float", [0, 3, 4, 5, 6, 50])])
def test_appended_store_is_the_store_built_at_once(spark, monkeypatch, tmp_path, kind, cuts):
    monkeypatch.setattr(retrieve, "BLOCK", 16)
    frames = frames_of(spark, cuts[-1], kind)
    store = op.BlockStore(spark, str(tmp_path))
    written = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        store.append(frames.filter((F.col("idx") >= a) & (F.col("idx") < b)))
        files = {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in tmp_path.rglob("*.parquet")}
        assert written.items() <= files.items()  # what was there is as it was
        written = files
        assert rows_of(store.read()) == rows_of(retrieve.packed(frames.filter(F.col("idx") < b)))
    last = store.log()[-1]
    assert last["frames"] == cuts[-1] and last["first_block"] >= (cuts[-2] - 6) // 16
    newest = spark.read.parquet(f"{tmp_path}/{last['version']}")
    assert newest.count() == (cuts[-1] - 1) // 16 - last["first_block"] + 1  # only the new blocks and those that changed
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert not last["first_block"] or "(block#" in plan and f"< {last['first_block']})" in plan
    store.append(frames.limit(0))
    assert len(store.log()) == len(cuts) - 1


def test_an_append_that_dies_or_does_not_fit(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieve, "BLOCK", 16)
    frames = frames_of(spark, 40)
    store = op.BlockStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.append(frames.filter("idx < 20"))
    before = rows_of(store.read())
    frames.limit(1).write.parquet(f"{tmp_path}/blocks-000001-dead")  # no line in the log
    assert rows_of(store.read()) == before
    for wrong in (frames.filter("idx >= 21"), frames.filter("idx >= 19"), frames.filter("idx >= 20").unionByName(frames.filter("idx = 25"))):
        with pytest.raises(ValueError, match="go on at 20"):
            store.append(wrong)
    with pytest.raises(ValueError, match="window"):
        store.append(frames.filter("idx >= 20"), window=3)
    store.append(frames.filter("idx >= 20"))
    assert rows_of(store.read()) == rows_of(retrieve.packed(frames))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    tasks = spark.createDataFrame([("a", [0.5] * 5, [], [])], "task_id string, main_vec array<double>, before_vecs array<array<double>>, after_vecs array<array<double>>")
    how = Retrieval(candidates=7)
    assert retrieve.top_frames(frames, tasks, how, blocks=store.read()).collect() == retrieve.top_frames(frames, tasks, how).collect()


def test_index_of_new_videos(spark):
    files = spark.createDataFrame([(v, f"frame_{k:08d}.webp") for v in ("a", "b", "d", "c") for k in range(0, 40, 10)] + [("c", "frame_00000040.webp")], "video_id string, frame_file string")
    old = indexed(files.filter("video_id < 'c'"))
    new = op.appended_index(files, op.index_of(old))
    at = lambda rows: sorted((r["video_id"], r["frame_file"], r["idx"], r["frame_ms"]) for r in rows.collect())
    assert at(old.unionByName(new)) == at(indexed(files))
    assert op.appended_index(files, op.index_of(indexed(files))).count() == 0
    assert at(op.appended_index(files, op.index_of(old.limit(0)))) == at(indexed(files))


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<f2"])
def test_matrix_file(spark, tmp_path, kind):
    values = np.random.default_rng(1).normal(size=(23, 6)).astype(kind)
    np.save(tmp_path / "m.npy", values)
    got = matrix.read_matrix(spark, str(tmp_path / "m.npy"), partitions=4)
    assert got.rdd.getNumPartitions() == 4
    assert [(r["idx"], r["embedding"]) for r in got.orderBy("idx").collect()] == list(enumerate(values.astype(np.float32 if kind != "<f8" else np.float64).tolist()))
    np.save(tmp_path / "none.npy", values[:0])
    assert matrix.read_matrix(spark, str(tmp_path / "none.npy")).count() == 0


def test_files_that_are_no_matrix(tmp_path):
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}]), allow_pickle=True)
    np.save(tmp_path / "flat.npy", np.zeros(4))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.zeros((3, 4))))
    np.save(tmp_path / "whole.npy", np.zeros((3, 4), np.int64))
    np.save(tmp_path / "cut.npy", np.zeros((300, 4)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    (tmp_path / "text.npy").write_bytes(b"no matrix")
    for name in ("objects", "flat", "columns", "whole", "cut", "text"):
        with pytest.raises(ValueError, match=f"{name}.npy"):
            matrix.header(str(tmp_path / f"{name}.npy"))


def test_matrix_store(spark, tmp_path):
    frames = frames_of(spark, 50).repartition(3)
    matrix.write_matrix(frames, str(tmp_path / "all_embeddings.npy"))
    values = np.load(tmp_path / "all_embeddings.npy")
    assert [r["embedding"] for r in frames.orderBy("idx").collect()] == values.tolist()
    entries = [{"index": k, "video_id": f"v{k // 9}", "frame_ms": k * 40, "frame_file": "f"} for k in range(48)]
    entries[7] = ["w", "frame_99.jpg"]
    entries[8] = {"video": "old", "frame": 3, "tar_name": "t"}
    (tmp_path / "metadata.json").write_text(json.dumps(entries))
    got = {r["idx"]: r for r in matrix.read_matrix_store(spark, str(tmp_path)).collect()}
    assert len(got) == 50 and [got[k]["embedding"] for k in range(50)] == values.tolist()
    assert [(got[k]["video_id"], got[k]["frame_ms"], got[k]["tar_name"]) for k in (0, 7, 8, 47, 48)] == [("v0", 0, ""), ("w", 99, ""), ("old", 3, "t"), ("v5", 1880, ""), ("unknown", 0, "")]
    with pytest.raises(ValueError, match="rows 0, 1"):
        matrix.write_matrix(frames.filter("idx <> 4"), str(tmp_path / "gap.npy"))
