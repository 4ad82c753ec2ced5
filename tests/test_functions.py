import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelscope.functions import histograms, text, vectors
from reelscope.operators.thinning import absolute, histogram_distance, image_distance, thin


@pytest.mark.parametrize(
    ("a", "b", "ratio"), [("hello", "say hello world", 100), ("i was told", "1 was told i", 90), ("exit only", "ex1t only", 89), ("stop", "st0p", 75), ("kitten", "sitting", 67), ("abc", "xyz", 0), ("", "", 100), ("", "a", 0)]
)
def test_partial_ratio(a, b, ratio):
    assert text.partial_ratio(a, b) == text.partial_ratio(b, a) == ratio


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=12))
def test_strands_give_every_common_subsequence(a, b):
    start, again = text.strands(text.points(a), [text.points(b), text.points(b[:3] + "xyz" * 5)])
    assert again[: min(3, len(b))].tolist() == start[:3].tolist()
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            assert j - i - int((start[i:j] >= i).sum()) == _subsequence(a, b[i:j])


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=6), st.lists(st.text("abc", max_size=12), max_size=8))
def test_many_at_once(a, others):
    assert text.partial_ratios(a, others) == [text.partial_ratio(a, b) for b in others]


@settings(max_examples=150, deadline=None)
@given(st.text("abcde ", min_size=1, max_size=40), st.text("abcde ", max_size=30), st.text("abcde ", max_size=30), st.integers(0, 5), st.sampled_from([0.5, 0.8, 0.9, 1.0]))
def test_no_target_is_left_out_that_matches(target, before, after, cut, least):
    body = target[:cut] + target[cut + 1 :] if cut % 2 else target[:cut] + "x" + target[cut:]
    found = before + body + after
    if found and text.partial_ratio(target, found) / 100 >= least:
        assert text.Target(target, least).may_match(text.Found(found))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=10))
def test_partial_ratio_against_all_stretches(a, b):
    def best(short, long):
        n = len(short)
        return max(2 * _subsequence(short, p) / (n + len(p)) for i in range(1 - n, len(long)) if (p := long[max(i, 0) : i + n]))

    short, long = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    want = best(short, long) if len(a) != len(b) else max(best(a, b), best(b, a))
    assert text.partial_ratio(a, b) == round(want * 100)


def test_a_long_text_is_not_compared_place_by_place(monkeypatch):
    """Work that grew with both lengths: strands through the whole grid of a target and a text."""
    rng, cells, strands = np.random.default_rng(3), [], text.strands
    prose = lambda n: "".join(rng.choice(["the ", "er", "an", "tion ", "in", "ou", "s ", "e", "l", "d "], n))
    monkeypatch.setattr(text, "strands", lambda a, others: cells.append(len(a) * sum(map(len, others))) or strands(a, others))
    target, others = prose(120), [prose(n) for n in (200, 2000, 8000)]
    others.append(others[1] + target[:90] + "?" + target[90:] + others[0])
    want = [round(text.best_stretch(len(target), strands(text.points(target), [text.points(b)])[0]) * 100) for b in others]
    assert text.partial_ratios(target, others) == want and want[3] > 95
    assert sum(cells) < len(target) * sum(map(len, others)) / 10


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", min_size=1, max_size=50), st.lists(st.tuples(st.text("abcd ñ\U0001f600", max_size=150), st.integers(1, 4)), min_size=1, max_size=4), st.booleans(), st.booleans())
def test_bounds_leave_out_no_best_stretch(a, others, many, few_bits):
    own, others = text.points(a), [text.points(b * times + a[::-1]) for b, times in others]
    want = [round(text.best_stretch(len(own), text.strands(own, [b])[0]) * 100) for b in others]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text, "_MANY", 0 if many else 10**9)
        patch.setattr(text, "_BITS", 64 if few_bits else 1 << 18)
        assert text.stretch_ratios(own, others) == want


def test_names(spark):
    rows = spark.createDataFrame([(8, 30.0, "frame_00012.jpg"), (30, 29.97, "bad"), (60, 23.976, None)], "k int, fps double, f string")
    ms = text.milliseconds(F.col("k"), F.col("fps"))
    got = rows.select(ms.alias("ms"), text.frame_file(ms).alias("file"), text.frame_ms(text.frame_file(ms)).alias("back"), text.legacy_frame(F.col("f")).alias("old")).collect()
    assert [r["ms"] for r in got] == [266, 1001, 2502] == [r["back"] for r in got]
    assert got[0]["file"] == "frame_00000266.webp"
    assert [r["old"] for r in got] == [12, 0, 0]
    hops = spark.createDataFrame([(x,) for x in (29.97, 25.0, 12.5, 13.5, 0.5)], "fps double").select(text.hop(F.col("fps"), 1.0)).collect()
    assert [r[0] for r in hops] == [30, 25, 12, 14, 0]
    chunks = spark.createDataFrame([(x,) for x in (0, 24, 25, 249, 2475)], "k int").select(text.chunk_name(F.col("k"), 25)).collect()
    assert [r[0] for r in chunks] == ["01", "01", "02", "10", "100"]
    long = spark.createDataFrame([(123456789,)], "ms long").select(text.frame_file(F.col("ms"))).collect()
    assert long[0][0] == "frame_123456789.webp"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.dot(F.col("a"), F.col("b")).alias("dot"), vectors.norm(F.col("a")).alias("norm"), vectors.unit(F.col("a")).alias("unit"), vectors.unit(F.col("a"), 1e-12).alias("safe")).collect()
    assert (got[0]["dot"], got[0]["norm"], got[0]["unit"]) == (11.0, 5.0, [0.6, 0.8])
    assert all(math.isnan(x) for x in got[1]["unit"]) and got[1]["safe"] == [0.0, 0.0]
    total = rows.limit(1).select(vectors.weighted_sum(F.array("a", "b"), F.array(F.lit(10.0), F.lit(1.0)))).collect()
    assert total[0][0] == [31.0, 42.0]


CASES = [([4, 0, 0, 4], [4, 0, 0, 4], 0.0), ([4, 0, 0, 4], [0, 4, 0, 4], 0.707106781), ([8, 0, 0, 0], [0, 8, 0, 0], 1.0), ([1, 3, 0, 4], [2, 2, 0, 4], 0.130526192), ([2, 2, 2, 2], [2, 2, 2, 2], 1.0)]


def test_bhattacharyya(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in CASES], "a array<long>, b array<long>")
    got = rows.select(histograms.bhattacharyya(histograms.min_max(F.col("a")), histograms.min_max(F.col("b")))).collect()
    for (a, b, want), r in zip(CASES, got, strict=True):
        assert r[0] == pytest.approx(want, abs=1e-8)
        assert histogram_distance(np.array(a, float), np.array(b, float)) == pytest.approx(want, abs=1e-8)


def test_night(spark):
    rows = spark.createDataFrame([(40.0, 20.0), (39.9, 200.0), (200.0, 19.9)], "v double, s double")
    assert [r[0] for r in rows.select(histograms.is_night(F.col("v"), F.col("s"))).collect()] == [False, True, True]


def test_thin_keeps_state_of_last_kept():
    assert thin(np.array([[0], [12], [13], [25], [26], [38], [51]], float), 12, absolute) == [0, 2, 4, 6]


def test_image_distance():
    rng = np.random.default_rng(3)
    image = tuple(rng.integers(0, n, (128, 128)) for n in (180, 256, 256))
    other = tuple(rng.integers(0, n, (128, 128)) for n in (20, 256, 256))
    assert image_distance(image, image) == pytest.approx(0.0, abs=1e-7)
    assert image_distance(image, other) > 0.12
