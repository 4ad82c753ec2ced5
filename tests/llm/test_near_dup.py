import re
from collections import Counter

import numpy as np
import pytest

from reelscope.llm import near_dup
from reelscope.llm.graph import components
from reelscope.llm.words import shingle_hashes, word_hashes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent=80):
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in parent}


def corpus(seed, groups, copies, edits):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 300))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(int(rng.integers(3, 120)))]
        for _ in range(copies):
            own = [word() if rng.random() < edits else w for w in base]
            rows.append((len(rows), " ".join(own)))
    order = rng.permutation(len(rows))
    return [(int(order[k]), t) for k, t in rows]


@pytest.mark.parametrize(("groups", "copies", "edits", "size"), [(12, 6, 0.03, 4), (1, 90, 0.02, 4), (2, 40, 0.04, 5), (40, 2, 0.01, 5)])
def test_components_against_all_pairs(spark, groups, copies, edits, size):
    rows = corpus(groups * 100 + copies, groups, copies, edits)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()}
    assert got == brute(rows, size)


def test_awkward_rows(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(9, "A b c d e"), (3, "a B C d E"), (4, ""), (5, None), (6, " \n"), (7, ""), (8, "one"), (2, "ONE"), (10, "one two"), (20, long), (21, long + " more"), (30, "x y z q r s"), (30, "x y z q r s"), (None, "one"), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, component int, class string")
    got = near_dup.near_duplicates(docs, size=4).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None}
    assert of == {9: (3, 2), 3: (3, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (2, 1), 2: (2, 1), 10: (10, 1), 20: (20, 29_997), 21: (20, 29_998), 30: (30, 3)}
    assert sorted(r["component_id"] or -1 for r in got if r["doc_id"] is None) == [-1, 2]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 40, 2000):
        common, own = rng.integers(0, 2**63, n * 8, dtype=np.uint64), rng.integers(0, 2**63, n * 2, dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, own[:n]])), np.unique(np.concatenate([common, own[n:]]))
        one, two = near_dup.sketch(a, 288), near_dup.sketch(b, 288)
        assert not (one == np.iinfo(np.uint64).max).any()
        assert abs((one == two).mean() - 0.8) < 0.12
    for n in (1, 2):
        assert not (near_dup.sketch(np.arange(1, n + 1, dtype=np.uint64), 288) == np.iinfo(np.uint64).max).any()


def test_sketch_against_rounds_one_by_one():
    from reelscope.llm.words import mixed

    hashes = np.random.default_rng(1).integers(0, 2**63, 37, dtype=np.uint64)
    t = 50
    bins = [None] * t
    for i in range(2 * t):
        for h in hashes:
            x = int(mixed(np.array([h ^ near_dup._SEEDS[i]]))[0])
            at = ((x >> 32) * t) >> 32 if i < t else i - t
            value = (i << 32) | (x & 0xFFFFFFFF)
            bins[at] = value if bins[at] is None else min(bins[at], value)
        if all(b is not None for b in bins):
            break
    assert near_dup.sketch(hashes, t).tolist() == bins


def test_word_hashes():
    texts = ["", "One two", "  tab\tone\n", "one", "ÉONE"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes, begin = word_hashes(np.frombuffer(data, np.uint8), offsets)
    assert np.diff(begin).tolist() == [0, 2, 2, 1, 1]
    assert hashes[0] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 4
    assert len(shingle_hashes(hashes[:2], 4)) == 1 and len(shingle_hashes(hashes[:0], 4)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_graph(spark, seed):
    rng = np.random.default_rng(seed)
    chain = [(k, k + 1) for k in range(40)]
    edges = chain + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(500, k) for k in range(501, 540)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op4_contract(spark, tmp_path):
    rows = corpus(4, 5, 4, 0.02)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = near_dup.op4_near_dup(spark, str(tmp_path)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert Counter(r["n_shingles"] for r in got) == Counter(len(shingles(t, 4)) for _, t in rows)
