"""Token counts without token ids: byte-pair merging with a heap of ranks and a linked list of symbols.

A text's symbols stand in a linked list, its adjacent pairs that the vocabulary can merge in a heap by rank, then by place. The
lowest-rank pair is popped and merged until none is left; what it made and its neighbours are pushed. So a text has as many tokens as
symbols at first less its merges, and no id is ever looked up.

Merging runs over segments, runs of a normalised text that no merge can cross: the marker of a space followed by what stands up to the
next one, cut again between characters that no piece has side by side. That no piece of the vocabulary has a marker behind another
character is checked when it is read; a vocabulary that has one is merged over whole texts. A worker remembers the counts of short
segments, which most of a corpus repeats.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .shared import in_arrow, of_process, table

#: What stands for a space in a piece.
SPACE = "▁"
#: Segments that a worker remembers, at most: the first that it meets, until four times as many were unknown; then it starts anew. Those of more than LONG characters are not remembered.
KEPT = 800_000
LONG = 64
#: Bits of a heap's entry: the rank from _RANK on, then the place, then the length.
_RANK, _SIZE = 40, (1 << 8) - 1
_PLACE = (1 << _RANK - 8) - 1


def merges(text: str, ranks: dict[str, int], glue: str = "") -> int:
    """How many merges the characters of text allow. ranks: of a pair, by its two symbols with glue between; the lowest goes first, of equals the leftmost.

    The linked list is size, a symbol's length and so the way to the next one (0 where a symbol has been merged into one before it), and
    before, the way back. An entry of the heap is a number: rank, place of the left symbol, length of both; it is out of date when the two
    that stand there now have another length.
    """
    n, rank = len(text), ranks.get
    if glue:
        heap = [r << _RANK | k << 8 | 2 for k in range(n - 1) if (r := rank(text[k] + glue + text[k + 1])) is not None]
    else:
        heap = [r << _RANK | k << 8 | 2 for k in range(n - 1) if (r := rank(text[k : k + 2])) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    size, before, done = [1] * n, list(range(-1, n - 1)), 0
    size.append(_SIZE + 1)  # no pair ends behind the text
    while heap:
        entry = pop(heap)
        left, both = entry >> 8 & _PLACE, entry & _SIZE
        right = left + size[left]
        if size[left] + size[right] != both:
            continue
        end = left + both
        size[left], size[right] = both, 0
        done += 1
        if end < n:
            before[end] = left
            last = end + size[end]
            if (r := rank(text[left:end] + glue + text[end:last] if glue else text[left:last])) is not None:
                push(heap, r << _RANK | left << 8 | last - left)
        if (k := before[left]) >= 0 and (r := rank(text[k:left] + glue + text[left:end] if glue else text[k:end])) is not None:
            push(heap, r << _RANK | k << 8 | end - k)
    return done


class _Remembered(dict):
    """Counts of segments by what is looked up, made by count where they are not there."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count, self.missed = count, 0

    def __missing__(self, key: str) -> int:
        found = self.count(key)
        if len(key) <= LONG:
            self.missed += 1
            if self.missed > 4 * KEPT:  # what it knows is of another part of the corpus
                self.clear()
                self.missed = 0
            if len(self) < KEPT:
                self[key] = found
        return found


class PieceCounter:
    """Counts as the sentencepiece library: model is a BPE file with byte fallback.

    A character that is no piece counts as its UTF-8 bytes, which nothing merges with. Special strings in a text are plain text, as the
    library has it.
    """

    def __init__(self, model: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(own.get_piece_size())
        if sum(map(own.is_byte, ids)) != 256 or any(map(own.is_unused, ids)):
            raise ValueError(f"{model} has no byte fallback, or pieces that are out of use")
        score = {own.id_to_piece(i): own.get_score(i) for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.single = {p for p in score if len(p) == 1}
        if not {c for p in score for c in p} <= self.single:
            raise ValueError(f"{model} has pieces of characters that are none")
        self.ranks = {p: place[s] for p, s in score.items() if len(p) > 1}
        self.pairs = {p[k : k + 2] for p in self.ranks for k in range(len(p) - 1)}
        self.normalise = own.normalize
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score)
        self.cut = re.compile(".+" if whole else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL).findall
        self.words = _Remembered(lambda word: self.segment(SPACE + word))
        self.segments = _Remembered(self.segment)
        self.runs = _Remembered(self.run)
        self.by_word = not whole

    def segment(self, text: str) -> int:
        """Tokens of a normalised text: those of its runs, between two characters that no piece has side by side."""
        cuts = [k for k, pair in enumerate(map(str.__add__, text, text[1:]), 1) if pair not in self.pairs]
        return sum(self.runs[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True))

    def run(self, text: str) -> int:
        """Symbols less merges; a character that is no piece is a run of its own."""
        return len(text) - merges(text, self.ranks) if text in self.single or len(text) > 1 else len(text.encode())

    def count(self, text: str) -> int:
        normal = self.normalise(text)
        parts = normal.split(SPACE)
        if self.by_word and not parts[0] and "" not in parts[1:]:  # one marker before each word
            return sum(map(self.words.__getitem__, parts[1:]))
        return sum(map(self.segments.__getitem__, self.cut(normal)))


class ByteCounter:
    """Counts as the tokenizers library: vocabulary is a byte-level BPE .json file, pattern cuts texts as its pre-tokenizer does.

    Added tokens that a text spells out count as one each, as the library has it.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        with open(vocabulary, encoding="utf-8") as file:
            told = json.load(file)
        model, added = told["model"], told["added_tokens"]
        plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and told["normalizer"] is None
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if not plain or odd or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{vocabulary} is no plain byte-level vocabulary")
        self.ranks = {pair if isinstance(pair, str) else " ".join(pair): k for k, pair in enumerate(model["merges"])}
        self.spelled = {b: c for c, b in byte_characters().items()}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in added) or "(?!)")
        self.cut = regex.compile(pattern).findall
        self.pieces = _Remembered(self.piece)

    def piece(self, text: str) -> int:
        symbols = text.encode().decode("latin-1").translate(self.spelled)
        return len(symbols) - merges(symbols, self.ranks, " ")

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.pieces.__getitem__, self.cut(p))) for p in parts)


def counter(vocabulary: str, pattern: str | None = None) -> PieceCounter | ByteCounter:
    """This process's counter of a .model file, or of a .json file and its pattern."""
    return of_process("counter", (vocabulary,) if vocabulary.endswith(".model") else (vocabulary, pattern), PieceCounter if vocabulary.endswith(".model") else ByteCounter)


def counts(texts: Iterable[str | None], vocabulary: str, pattern: str | None = None) -> list[int]:
    """Tokens of each text; a null has none."""
    own = counter(vocabulary, pattern)
    return [own.count(t or "") for t in texts]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for each row of docs (doc_id, text), in one pass without a shuffle.

    A null text is an empty one: no bytes, no tokens. Rows that repeat, and rows of a null id, are rows of their own; an empty table gives
    none; other columns are not read. The file must be where executors find it, as the libraries are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            found = counts((t.as_py() for t in text), vocabulary, pattern)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op11_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens are more than limit. See token_counts for nulls, repeats and empty tables."""
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
