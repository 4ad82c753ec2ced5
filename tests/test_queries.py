import os
import sys

import pytest

from reelscope.plans.queries import QUERIES, SQL

sys.path.insert(0, os.path.dirname(__file__))
from oracle import FOLDER, connect, same_rows  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="the shared test tables are not here")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, tables, name):
    same_rows(QUERIES[name](spark, FOLDER), tables, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_texts_are_matched_whole(spark, tmp_path):
    from reelscope.plans import queries

    docs = [(k, "frame text " * 20 + f"the target phrase {k} at its end") for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, f"The target phrase {k}") for k in range(6)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vectors = [(k, 0, [1.0 if j == k % 4 else 0.1 for j in range(64)]) for k in range(500)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["doc_id"]: r["ratio"] for r in queries.fuzzy_ratios(spark, str(tmp_path)).collect()} == {k: 100 for k in range(6)}
    targets = {r["task_id"]: r["ocr_texts"] for r in queries._tasks(spark, str(tmp_path)).collect()}
    assert targets["4"] == ["The target phrase 4"] and targets["1"] == []
    results = {r["task_id"]: r["results"] for r in queries.results_with_text(spark, str(tmp_path)).collect()}
    assert '"rank":1,"video_id":"v0","frame_ms":0}' in results["0"]
