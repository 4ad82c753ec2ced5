import hashlib
import math
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from reelscope.llm import bpe, quality

sys.path.insert(0, os.path.dirname(__file__))
from test_sharding_mixing import plain_mix  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda n, bad: "\n".join(" ".join(f"w{rng.randrange(400)}{'!!' if bad else ''}" for _ in range(12)) for _ in range(n))
    rows = []
    for k in range(240):
        bad = k % 4 == 0
        own = rows[k - 3][1] if k % 10 == 7 else text(3 + k % 4, bad) + "\nAll rights reserved here."
        rows.append((k, own, "en", f"s{k % 3}", len(own)))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def plain_lines(rows, at_least=10):
    key = lambda x: x.strip(" \t\n\x0b\f\r").lower()
    docs = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    cut = lambda t: "\n".join(x for x in t.split("\n") if docs[key(x)] < at_least)
    return [(i, None if t is None else cut(t), s) for i, t, s in rows]


def plain_groups(rows, size=5):
    """The least id of each row's group, by comparing all pairs; ids are not repeated here."""
    sets = {}
    for i, text, _ in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in sets}


def rows_of(frame):
    return [(r["doc_id"], r["text"], r["source"]) for r in frame.collect()]


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage is given and what it gives, by name."""
    path, docs, seen = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(path / name))
        seen[name] = docs, spark.read.parquet(str(path / name))
        assert name == "tokens" or seen[name][1].columns == docs.columns
        docs = seen[name][1]
    return seen


def test_quality_stage(spark, folder, stages):
    """The rows whose sparse dot product, summed one feature after the other, gives the score; and most of the good ones."""
    given, got = stages["quality"]
    weights = quality.fit_on_labels(spark, given, folder)
    score = {}
    for i, text, _ in rows_of(given):
        total = weights[-1]
        for _, columns, values in quality.text_features(pa.array([text])):
            total += sum(float(np.float32(weights[c])) * v for c, v in zip(columns.tolist(), values.tolist(), strict=True))
        score[i] = 1 / (1 + math.exp(-total))
    kept = {r["doc_id"] for r in got.collect()}
    assert kept == {i for i, x in score.items() if x >= quality.ACCEPTED}
    assert sum(k % 4 == 0 for k in kept) <= 15 and sum(k % 4 > 0 for k in kept) >= 150


def test_line_stage(stages):
    given, got = stages["line_dedup"]
    assert sorted(rows_of(got)) == sorted(plain_lines(rows_of(given)))
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect()) and not any("All rights" in r["text"] for r in got.collect())


def test_near_dup_stage(stages):
    given, got = stages["near_dup"]
    groups = plain_groups(rows_of(given))
    assert sorted(rows_of(got)) == sorted(r for r in rows_of(given) if groups[r[0]] == r[0]) and len(set(groups.values())) < len(groups)


def test_mixing_stage(stages):
    given, got = stages["mixing"]
    want = plain_mix([(i, s, len((t or "").split())) for i, t, s in rows_of(given)])
    assert Counter((i, len((t or "").split())) for i, t, _ in rows_of(got)) == want


def test_token_stage(stages):
    given, got = stages["tokens"]
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((i, s, tuple(other.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, s in rows_of(given))
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in got.collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.collect())


def test_run_is_the_stages(spark, folder, stages):
    rows = lambda frame: sorted((r["doc_id"], r["source"], r["n_tokens"], r["decoded_sha256"]) for r in frame.collect())
    own = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(own))
    ran = corpus_pipeline.run(spark, folder)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(own)) - before] == ["pipeline-mixing"]  # all that the result still reads
    assert rows(ran) == rows(stages["tokens"][1])


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_rows(spark, folder, tmp_path):
    """Null texts pass through every stage or are rejected, rows that repeat become one, and the ids kept are those of the documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20")
    null = docs.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    docs.unionByName(null).unionByName(docs.filter("doc_id < 3")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = corpus_pipeline.quality_stage(spark, given, str(tmp_path))
    weights = quality.fit_on_labels(spark, given, str(tmp_path))
    nulls = accepted.filter("text IS NULL").count()
    assert nulls == (2 if 1 / (1 + math.exp(-weights[-1])) >= quality.ACCEPTED else 0)
    lines = corpus_pipeline.line_stage(spark, given, str(tmp_path))
    assert lines.filter("text IS NULL").count() == 2 and lines.count() == 25
    single = corpus_pipeline.near_dup_stage(spark, given, str(tmp_path))
    assert single.filter("doc_id IS NULL").count() == 2 and single.filter("doc_id IS NOT NULL").select("doc_id").distinct().count() == single.count() - 2
    assert corpus_pipeline.mixing_stage(spark, given, str(tmp_path)).filter("text IS NULL").count() == 0
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids and ids <= set(range(20)) | {None}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "mixing", "tokens"]
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_one_row_of_each_group_stays(spark, folder):
    own = lambda k, n: " ".join(f"v{k}x{j}" for j in range(n))
    rows = [(1, own(1, 60)), (1, own(1, 60)), (None, own(1, 60)), (None, own(1, 60) + " more"), (2, own(2, 60)), (2, own(3, 60)), (None, own(4, 60)), (None, own(4, 60)), (5, own(5, 60)), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dup_stage(spark, docs, folder)
    assert got.columns == docs.columns
    want = [(1, own(1, 60)), (2, own(2, 60)), (2, own(3, 60)), (None, own(4, 60)), (5, own(5, 60)), (6, ""), (6, ""), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
