import os
import sys

import pytest

from reelscope.llm.queries import QUERIES, SQL

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import FOLDER, connect, same_rows  # noqa: E402


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="the shared test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same_rows(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name])


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows_against_sql(spark, tmp_path, name):
    rows = [(1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, " \n\t", "t"), (4, " \n\t", "t"), (None, "a b c a b c\nx", None), (6, "É é\nx\r\n x", "t"), (7, "w " * 5000 + "\n" + "x", "t")] + [(20 + k, f"x\n{k} own", "s") for k in range(12)]
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = lambda k: [((k * 7 + j * 3) % 11 - 5) / 9 for j in range(64)]
    vectors = [(k, own(k % 23)) for k in range(60)] + [(3, own(3)), (None, own(1)), (None, own(2)), (70, None), (71, []), (72, [0.5] * 63), (73, [0.5] * 63 + [None]), (74, [0.5] * 63 + [float("nan")]), (75, [0.5] * 63 + [float("inf")]), (76, [0.0] * 64), (77, [-3.7] * 64)]
    spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, cluster string, distance int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    same_rows(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), SQL[name])
