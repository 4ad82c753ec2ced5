import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelscope.config import Retrieval
from reelscope.operators import retrieve as op
from reelscope.operators.rerank import judged, reranked, submission_rows, text_bonus
from reelscope.plans.retrieval import fused_ranks, with_variants
from reelscope.sources import tables

MAIN = [0.30, 0.10, 0.50, 0.24, 0.44, 0.64, 0.20, 0.34]
BEFORE = [0.90, 0.05, 0.30, 0.10, 0.44, 0.00, 0.24, 0.99]
AFTER = [0.20, 0.34, 0.10, 0.64, 0.25, 0.05, 0.74, 0.90]
SCORES = [0.00378, 0, 0.0765232, 0, 0.04528, 0.18112, 0, 0.0102]


def test_fusion_golden():
    got = op.fused(np.array(MAIN), np.array(BEFORE), np.array(AFTER), None, Retrieval())
    assert got == pytest.approx(SCORES, abs=1e-9)


def plain(vectors, task, how, videos=None):
    m, out = vectors @ task["main"], []
    for i in range(len(m)):
        bonus = 1.0
        for name, ahead, w in (("before", False, how.before), ("after", True, how.after)):
            if task[name] is None:
                continue
            raw = vectors @ task[name]
            near = [j for k in range(1, 7) if 0 <= (j := i + k if ahead else i - k) < len(m) and (videos is None or videos[i] == videos[j])]
            bonus += w * max([max(raw[j] - how.threshold, 0) for j in near], default=0)
        out.append(max(m[i] - how.threshold, 0) ** 2 * bonus)
    return np.array(out)


def frames_and_tasks(spark, n, seed, tasks=3):
    rng = np.random.default_rng(seed)
    unit = lambda k: (x := rng.normal(size=(k, 4))) / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, videos = unit(n), [f"v{i // 7}" for i in range(n)]
    frames = spark.createDataFrame([(i, videos[i], i * 40, vectors[i].tolist()) for i in range(n)], "idx long, video_id string, frame_ms long, embedding array<double>")
    made = [{"id": str(k), "main": unit(1)[0], "before": unit(1)[0] if k else None, "after": unit(1)[0] if k != 1 else None} for k in range(tasks)]
    rows = [(t["id"], int(t["id"]), t["main"].tolist(), [t["before"].tolist(), [9.0] * 4] if t["before"] is not None else [], [t["after"].tolist()] if t["after"] is not None else [], []) for t in made]
    return vectors, videos, frames, made, spark.createDataFrame(rows, "task_id string, ordinal int, main_vec array<double>, before_vecs array<array<double>>, after_vecs array<array<double>>, ocr_texts array<string>")


@pytest.mark.parametrize(("n", "block", "neighbours"), [(5, 16384, "global"), (60, 8, "global"), (60, 13, "video"), (60, 16384, "global")])
def test_top_frames_in_blocks(spark, monkeypatch, n, block, neighbours):
    """Block bounds, short stores, lists longer than the store and zero scores do not change the result."""
    monkeypatch.setattr(op, "BLOCK", block)
    how = Retrieval(candidates=20, neighbours=neighbours)
    vectors, videos, frames, made, tasks = frames_and_tasks(spark, n, n + block)
    got = op.top_frames(frames, tasks, how).collect()
    audit = {(r["task_id"], r["idx"]): r["score"] for r in op.all_scores(frames, tasks, how).collect()}
    for t in made:
        scores = plain(vectors, t, how, videos if neighbours == "video" else None)
        order = sorted(range(n), key=lambda i: (-scores[i], -i))[:20]
        mine = sorted((r["rank"], r["idx"], r["score"]) for r in got if r["task_id"] == t["id"])
        assert [i for _, i, _ in mine] == order
        assert [s for _, _, s in mine] == pytest.approx([scores[i] for i in order], abs=1e-12)
        assert [audit[t["id"], i] for i in range(n)] == pytest.approx(scores.tolist(), abs=1e-12)


@pytest.mark.parametrize("by", ["max_before", "max_after"])
def test_frames_ranked_by_context(spark, monkeypatch, by):
    monkeypatch.setattr(op, "BLOCK", 16)
    _, _, frames, made, tasks = frames_and_tasks(spark, 60, 5)
    how = Retrieval(candidates=12)
    every = op.all_scores(frames, tasks, how).collect()
    got = op.top_frames(frames, tasks, how, by=by).collect()
    for t in made:
        want = sorted((r for r in every if r["task_id"] == t["id"]), key=lambda r: (-r[by], -r["idx"]))[:12]
        assert [r["idx"] for r in sorted(got, key=lambda r: r["rank"]) if r["task_id"] == t["id"]] == [r["idx"] for r in want]
    with pytest.raises(ValueError, match="ranked by"):
        op.top_frames(frames, tasks, how, by="idx")


def test_written_blocks_need_no_shuffle(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(op, "BLOCK", 16)
    monkeypatch.setattr(op, "TILE", 2)
    _, _, frames, _, tasks = frames_and_tasks(spark, 100, 6, tasks=5)
    op.write_blocks(frames, str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    for neighbours in ("global", "video"):
        how = Retrieval(candidates=30, neighbours=neighbours)
        rows = lambda found: sorted(map(tuple, found.collect()))
        assert rows(op.top_frames(frames, tasks, how, blocks=blocks)) == rows(op.top_frames(frames, tasks, how))
    scored = op.all_scores(frames, tasks, Retrieval(), blocks)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_slices_of_tasks_and_nan(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_TASK_BYTES", 40)
    _, _, frames, _, tasks = frames_and_tasks(spark, 30, 1)
    nan = spark.createDataFrame([("nan", 9, [float("nan")] * 4, [], [], []), ("none", 10, None, [], [], [])], tasks.schema)
    got = op.top_frames(frames, tasks.unionByName(nan), Retrieval(candidates=4)).collect()
    assert {r["task_id"] for r in got} == {"0", "1", "2", "nan"}
    assert [r["idx"] for r in sorted(got, key=lambda r: r["rank"]) if r["task_id"] == "nan"] == [29, 28, 27, 26]


def test_empty_store(spark):
    _, _, frames, _, tasks = frames_and_tasks(spark, 3, 1)
    assert op.top_frames(frames.limit(0), tasks).count() == 0
    assert op.top_frames(frames, tasks.limit(0)).count() == 0


def test_plan_has_no_single_partition_sort(spark):
    _, _, frames, _, tasks = frames_and_tasks(spark, 30, 1)
    plan = op.top_frames(frames, tasks)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("ratios", "score", "final"), [([1.0, 0.75], 0.2, 0.22), ([1.0, 1.0, 1.0], 0.2, 0.24), ([0.90], 0.2, 0.218), ([0.89], 0.2, 0.2), ([1.0], 0.0, 0.0)])
def test_bonus(spark, ratios, score, final):
    got = spark.createDataFrame([(ratios, score)], "r array<double>, s double").select(F.col("s") * (1 + text_bonus(F.col("r")))).collect()
    assert got[0][0] == pytest.approx(final, abs=1e-12)


def test_rerank_paths(spark):
    candidates = spark.createDataFrame([(t, r, f"v{r}", r, 1.0 - r / 10) for t in ("plain", "text", "blind") for r in (1, 2, 3)], "task_id string, rank int, video string, frame long, score double")
    targets = spark.createDataFrame([("plain", []), ("text", ["EXIT"]), ("blind", ["exit"])], "task_id string, ocr_texts array<string>")
    seen = spark.createDataFrame([("v2", 2, ["nothing"]), ("v3", 3, ["the exit sign"])], "video string, frame long, texts array<string>")
    no_image = candidates.filter("task_id <> 'blind'").unionByName(candidates.filter("task_id = 'blind'").withColumn("video", F.lit("x")))
    got = reranked(no_image, targets, seen, 2).orderBy("task_id", "rank").collect()
    assert [(r["task_id"], r["video"]) for r in got] == [("blind", "x"), ("blind", "x"), ("plain", "v1"), ("plain", "v2"), ("text", "v2"), ("text", "v3")]
    assert got[5]["score"] == pytest.approx(0.7 * 1.1)


def test_rerank_against_plain(spark):
    """Scores so close that a bonus decides, and candidates that no bonus can lift; frames that repeat have the least of their texts."""
    from reelscope.config import TextRerank
    from reelscope.functions.text import partial_ratio

    how, rng = TextRerank(), np.random.default_rng(8)
    words = ["exit", "only", "stop", "line nine", "st0p here", "exit sign", "open"]
    shown = {k: [words[j] for j in rng.integers(0, 7, 2)] for k in range(60) if k % 5}
    score = {(t, k): float(np.round(rng.random() ** 3, 3)) for t in "abc" for k in range(60)}
    wanted = {"a": ["exit sign", "Stop"], "b": ["LINE NINE"], "c": []}
    rows, want = [], []
    for t in "abc":
        ranked = sorted(range(60), key=lambda k: (-score[t, k], k))
        rows += [(t, place + 1, "v", k, score[t, k]) for place, k in enumerate(ranked)]
        final = {}
        for place, k in enumerate(ranked):
            if wanted[t] and k not in shown:
                continue
            ratios = [max(partial_ratio(x.lower(), y) for y in shown[k]) / 100 for x in wanted[t]] if wanted[t] else []
            bonus = min(sum(r * how.weight for r in ratios if r >= how.accept), how.most)
            final[k] = (-(score[t, k] * (1 + bonus)) if wanted[t] else 0, place)
        want += [(t, place + 1, k) for place, k in enumerate(sorted(final, key=final.get)[:10])]
    candidates = spark.createDataFrame(rows, "task_id string, rank int, video string, frame long, score double")
    targets = spark.createDataFrame(list(wanted.items()), "task_id string, ocr_texts array<string>")
    seen = spark.createDataFrame([("v", k, x) for k, x in shown.items()] + [("v", 1, ["zzz"])], "video string, frame long, texts array<string>")
    assert sorted((r["task_id"], r["rank"], r["frame"]) for r in reranked(candidates, targets, seen).collect()) == sorted(want)


def test_second_look(spark):
    class Judge:
        def judge(self, queries, images):
            return [float(len(set(q) & set(i.decode()))) for q, i in zip(queries, images, strict=True)]

    results = spark.createDataFrame([("t", r, "v", r, 1.0 / r) for r in (1, 2, 3, 4)], "task_id string, rank int, video string, frame long, score double")
    tasks = spark.createDataFrame([("t", "abc")], "task_id string, description string")
    images = spark.createDataFrame([("v", 2, b"ax"), ("v", 3, b"abc"), ("v", 4, b"bx"), ("v", 4, b"bx")], "video_id string, frame_ms long, content binary")
    got = judged(results, tasks, images, Judge(), batch_size=2).orderBy("rank").collect()
    assert [(r["rank"], r["frame"]) for r in got] == [(1, 3), (2, 2), (3, 4), (4, 1)] and got[3]["score"] == 1.0
    assert judged(results.limit(0), tasks, images, Judge()).count() == 0


def test_variants(spark):
    tasks = spark.createDataFrame([("1", "a"), ("2", "b")], "task_id string, description string")
    more = spark.createDataFrame([("1", ["x", "y"]), ("3", ["z"])], "task_id string, variants array<string>")
    got = sorted(map(tuple, with_variants(tasks, more).collect()))
    assert got == [("1", 0, "a", 2.0), ("1", 1, "x", 1.0), ("1", 2, "y", 1.0), ("2", 0, "b", 2.0)]


def test_submission(spark, tmp_path):
    results = spark.createDataFrame([("b", 1, "v", 40), ("b", 2, "w", 80)], "task_id string, rank int, video string, frame long")
    rows = submission_rows(results, spark.createDataFrame([("a", 1), ("b", 0)], "task_id string, ordinal int"))
    tables.write_submission(rows, str(tmp_path / "out.json"))
    document = json.loads((tmp_path / "out.json").read_text())
    assert [p["task_id"] for p in document["predictions"]] == ["b", "a"]
    assert document["predictions"][1]["results"] == [{"rank": 1, "video_id": "", "frame_ms": 0}]
    assert tables.read_parts(spark, str(tmp_path / "*.json")).count() == 2


def test_fused_ranks(spark):
    lists = spark.createDataFrame([("t", 1, 1, 2.0), ("t", 2, 2, 2.0), ("t", 2, 1, 1.0)], "task_id string, idx long, rank int, weight double")
    got = {r["idx"]: r["score"] for r in fused_ranks(lists).collect()}
    assert got == pytest.approx({1: 2 / 61, 2: 2 / 62 + 1 / 61})


def clustered_frames(spark, n, seed, bad=()):
    """Runs of frames that hardly change, as those of a video, and tasks near some of them; bad: frames with a value that is not finite."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    scenes = unit(rng.normal(size=(n // 40 + 1, 16)))
    vectors = unit(scenes[np.arange(n) // 40] + rng.normal(size=(n, 16)) * 0.03)
    for k, value in bad:
        vectors[k, 3] = value
    frames = spark.createDataFrame([(i, f"v{i // 90}", vectors[i].tolist()) for i in range(n)], "idx long, video_id string, embedding array<double>")
    pick = lambda: unit(scenes[rng.integers(0, len(scenes))] + rng.normal(size=16) * 0.1).tolist()
    rows = [(f"t{k}", pick(), [pick()] if k % 3 else [], [pick()] if k % 2 else []) for k in range(7)]
    return vectors, frames, rows, spark.createDataFrame(rows, "task_id string, main_vec array<double>, before_vecs array<array<double>>, after_vecs array<array<double>>")


@pytest.mark.parametrize(("neighbours", "by", "bad"), [("global", "score", ()), ("video", "score", ()), ("global", "max_before", ()), ("global", "score", ((77, float("nan")), (500, float("inf"))))])
def test_skipped_strips_change_nothing(spark, monkeypatch, tmp_path, neighbours, by, bad):
    monkeypatch.setattr(op, "BLOCK", 128)
    monkeypatch.setattr(op, "STRIP", 16)
    monkeypatch.setattr(op, "TILE", 3)
    vectors, frames, _, tasks = clustered_frames(spark, 1500, 11, bad)
    op.write_blocks(frames, str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    how = Retrieval(candidates=25, neighbours=neighbours)
    scan = op.Scan(spark)
    got = op.top_frames(frames, tasks, how, by, blocks, scan).collect()
    every = op.all_scores(frames, tasks, how, blocks).collect()
    value = lambda r: (1, 0) if r[by] != r[by] else (0, r[by])
    for t in {r["task_id"] for r in every}:
        want = sorted((r for r in every if r["task_id"] == t), key=lambda r: (value(r), r["idx"]), reverse=True)[:25]
        mine = sorted((r for r in got if r["task_id"] == t), key=lambda r: r["rank"])
        assert [r["idx"] for r in mine] == [r["idx"] for r in want]
        assert [r["score"] for r in mine] == pytest.approx([r["score"] for r in want], abs=1e-12, nan_ok=True)
    counts = scan.counts()
    assert counts["multiplied"] + counts["skipped"] == 7 * sum(-(-min(128, 1500 - a) // 16) for a in range(0, 1500, 128))
    assert by != "score" or counts["skipped"] > counts["multiplied"]
    assert counts["rows"] <= 7 * 25 * blocks.rdd.getNumPartitions()


def test_no_value_beyond_its_bound():
    rng = np.random.default_rng(4)
    for spread in (0.01, 0.5, 30.0):
        vectors = rng.normal(size=(10, 8))[np.arange(300) // 30] + rng.normal(size=(300, 8)) * spread
        own = np.arange(6, 294)
        centres, radius, reach = op.summary(vectors, own, 6)
        for how in (Retrieval(), Retrieval(threshold=-0.2, before=-0.3, after=2.0)):
            rows = [{"task_id": str(k), "main_vec": rng.normal(size=8).tolist(), "before": rng.normal(size=8).tolist() if k % 2 else None, "after": rng.normal(size=8).tolist() if k % 3 else None} for k in range(5)]
            for by in op.RANKED_BY:
                tasks = op.Tasks(op.stacked(rows), how, by)
                of = np.arange(5)
                pooled = tasks.pooled(vectors, None, of)
                rank = {"score": op.combined(vectors @ tasks.main.T, *pooled, how), "max_before": pooled[0], "max_after": pooled[1]}[by][own]
                upper = tasks.upper(centres.astype(np.float64), radius, reach, of)
                strips = np.arange(len(own)) // op.STRIP
                assert (rank <= upper[strips]).all()


def test_lists_of_best_rows():
    rng = np.random.default_rng(2)
    best, every = op.BestRows(2, 10, np.full(2, -np.inf)), []
    for k in range(40):
        value, idx = rng.integers(0, 6, 7).astype(float), np.arange(k * 7, k * 7 + 7)
        every += zip(value, idx, strict=True)
        keep = value >= best.bounds[1]
        best.add(1, value[keep], idx[keep], idx[keep] * 2)
        assert best.sizes[1] < 20
    value, idx, twice = best.best(1)
    assert list(zip(value, idx, strict=True)) == sorted(every, reverse=True)[:10] and (twice == 2 * idx).all() and best.best(0) is None


def test_runs_of_rows():
    rows = np.zeros(30, bool)
    rows[[0, 1, 12, 29]] = True
    assert op.runs(rows, 3) == [slice(0, 5), slice(9, 16), slice(26, 30)]
    assert op.runs(rows, 100) == [slice(0, 30)] and op.runs(np.zeros(4, bool), 2) == []


def test_blocks_without_summary(spark, tmp_path):
    _, frames, _, tasks = clustered_frames(spark, 300, 3)
    old = op.packed(frames).drop("centres", "radius", "reach")
    rows = lambda found: sorted((r["task_id"], r["rank"], r["idx"]) for r in found.collect())
    assert rows(op.top_frames(frames, tasks, Retrieval(candidates=9), blocks=old)) == rows(op.top_frames(frames, tasks, Retrieval(candidates=9)))


@pytest.mark.parametrize("sent", [0, 10**6])
def test_texts_of_candidates_alone_are_shuffled(spark, monkeypatch, sent):
    from reelscope.operators import rerank

    monkeypatch.setattr(rerank, "MOST_SENT", sent)
    candidates = spark.createDataFrame([(t, k, f"v{k % 2}", 40 * k, 1.0 / k) for t in ("a", "b", "c") for k in range(1, 9)], "task_id string, rank int, video string, frame long, score double")
    targets = spark.createDataFrame([("a", ["stop"]), ("b", []), ("c", ["go now"])], "task_id string, ocr_texts array<string>")
    seen = spark.createDataFrame([(f"v{k % 2}", 40 * k, ["stop" if k == 7 else f"go now {k}"]) for k in range(1, 300)], "video string, frame long, texts array<string>")
    kept = rerank.of_candidates(seen, candidates, targets, 8)
    assert sorted(r["frame"] for r in kept.collect()) == [40 * k for k in range(1, 9)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and ("strategy=broadcast" in plan) == bool(sent)
    got = {r["task_id"]: r["frame"] for r in rerank.reranked(candidates, targets, seen, 3, most=8).collect() if r["rank"] == 1}
    assert got == {"a": 40, "b": 40, "c": 40}
    best = {(r["task_id"], r["frame"]): r["score"] for r in rerank.reranked(candidates, targets, seen, 8, most=8).collect()}
    assert best["a", 280] == pytest.approx(1 / 7 * 1.1) and best["b", 280] == pytest.approx(1 / 7)
