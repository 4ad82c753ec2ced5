import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelscope.llm import alignment, token_count

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = st.text(alphabet=" \n\t\0ab<>s/.,é漢🙂①‍'0\x1c\xa0▁", max_size=40)
TEXTS = ["", None, "Hello  world's\n\n end ", "naïve ça 漢字 🙂🙂 ‍", "a</s><s> <unk><0x41> <|endoftext|>", "x" * 30_000, " " * 3000 + "x", "=" * 5000, "a▁b", "word. Word.\nNext, w\n\nx", " ", "\n", "Hello  world's\n\n end "]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Awkward texts, with columns that clash with those of the operators."""
    folder = tmp_path_factory.mktemp("tokens")
    rows = [*enumerate(TEXTS), (None, "the end."), (None, "the end."), (2, "the end. The end."), *((100 + k, f"row {k % 7} of the list. The end.") for k in range(60))]
    spark.createDataFrame([(i, t, "p", 1, "n") for i, t in rows], "doc_id long, text string, pairs string, row int, n_tokens string").write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def plain_merges(symbols, ranks, glue=""):
    symbols, n = list(symbols), 0
    while found := [(ranks[key], k) for k in range(len(symbols) - 1) if (key := symbols[k] + glue + symbols[k + 1]) in ranks]:
        _, k = min(found)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abc", max_size=30), seed=st.integers(0, 50))
def test_merges_against_rescanning(text, seed):
    words = ["ab", "bc", "aa", "ca", "abc", "aab", "aaaa", "bcab", "cc", "abcc"]
    ranks = {w: (k * 7 + seed) % 5 for k, w in enumerate(words[seed % 4 :])}  # ranks that tie, pieces that nothing makes
    assert token_count.merges(text, ranks) == plain_merges(text, ranks)
    pairs = {"a b": 3, "b c": seed % 6, "ab c": 1, "a bc": 2, "a a": 4, "aa a": 0}
    assert token_count.merges(text, pairs, " ") == plain_merges(text, pairs, " ")


@settings(max_examples=400, deadline=None)
@given(text=ODD | st.text(max_size=60))
def test_counts_as_the_libraries(pieces, coder, text):
    assert token_count.counter(MODEL).count(text) == len(pieces.encode(text))
    assert token_count.counter(JSON, P.PATTERN).count(text) == len(coder.encode(text, add_special_tokens=False).ids)


def test_forgetting(pieces, monkeypatch):
    monkeypatch.setattr(token_count, "KEPT", 3)
    own = token_count.PieceCounter(MODEL)
    for k in range(60):
        text = f"word{k % 9} some {k * 7919} text"
        assert own.count(text) == len(pieces.encode(text))
    assert len(own.words) <= 3


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain"):
        token_count.ByteCounter(P.path("word_bpe_49k.json"), P.PATTERN)


def test_op11_contract(spark, documents, pieces):
    folder, rows = documents
    got = sorted(map(tuple, token_count.op11_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t in rows]
    assert got == sorted(want, key=str) and any(x[3] for x in got)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert token_count.token_counts(docs.limit(0), MODEL).count() == 0
    assert "Exchange" not in token_count.token_counts(docs, MODEL)._jdf.queryExecution().executedPlan().toString()


def plain_alignment(text, coder, pieces):
    """Tokens, groups and links of one text, by its definition."""
    own, empty = alignment.aligner(JSON, MODEL), (0, 0, 0, b"", {})
    if not text:
        return empty
    a, b = coder.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    sides = [[own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return empty
    ends = []
    for side in sides:
        at, out = 0, []
        for t in side:
            out.append(at := at + len(t))
        ends.append(out)
    spelled, linked, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        spelled.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        linked.update((p, q) for p in a[i:x] for q in b[j:y])
        i, j = x, y
    return len(a), len(b), len(spelled), ";".join(spelled).encode(), linked


@pytest.fixture(scope="module")
def plain_coder():
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    return own


def same_alignment(found, want):
    assert found[:4] == want[:4]
    assert {(k // alignment.PAIR, k % alignment.PAIR): n for k, n in zip(found[4].tolist(), found[5].tolist(), strict=True)} == want[4]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD | st.text(max_size=60), min_size=1, max_size=4))
def test_alignment_by_its_definition(plain_coder, pieces, texts):
    for text, found in zip(texts, alignment.aligner(JSON, MODEL).aligned(texts), strict=True):
        same_alignment(found, plain_alignment(text, plain_coder, pieces))


def test_large_groups_and_forgetting(plain_coder, pieces, monkeypatch):
    monkeypatch.setattr(alignment, "MANY", 2)
    monkeypatch.setattr(alignment, "KEPT", 3)
    own = alignment.Aligner(JSON, MODEL)
    for text in [t for t in TEXTS if t] * 2:
        same_alignment(next(own.aligned([text])), plain_alignment(text, plain_coder, pieces))
    assert len(own.kept) <= 3


def test_groups_of_ranges():
    import numpy as np

    a, b = alignment.groups(np.array([3, 1, 2, 2]), np.array([1, 2, 2, 3]))
    assert (a.tolist(), b.tolist()) == ([0, 1, 1, 1], [0, 0, 1, 1])
    first, last = alignment.overlaps(np.array([3, 1, 2, 2]), np.array([1, 2, 2, 3]))
    assert (first.tolist(), last.tolist()) == ([0, 2, 2, 3], [1, 2, 3, 3])


@pytest.mark.parametrize("heavy", [1, 300, 10**6])
def test_op12_contract(spark, documents, plain_coder, pieces, monkeypatch, heavy):
    """Whatever part of the pairs the workers look up themselves, the result is the same."""
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    folder, rows = documents
    every = [(i, plain_alignment(t, plain_coder, pieces)) for i, t in rows]
    n_docs = Counter(p for _, x in every for p in x[4])
    most = defaultdict(int)
    for (a, _), n in n_docs.items():
        most[a] = max(most[a], n)
    want = [
        (i, x[0], x[1], x[2], sum(x[4].values()), sum(n for p, n in x[4].items() if n_docs[p] == most[p[0]]), sum(n * n_docs[p] for p, n in x[4].items()), hashlib.sha256(x[3]).hexdigest() if x[0] else "") for i, x in every
    ]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.op12_cross_tokens(spark, folder).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    digests, pairs = alignment.cross_tokens(docs, JSON, MODEL)
    assert {((r["a"], r["b"]), r["n_docs"], r["best"]) for r in pairs.collect()} == {(p, n, n == most[p[0]]) for p, n in n_docs.items()}
    assert alignment.cross_tokens(docs.limit(0), JSON, MODEL)[0].count() == 0
