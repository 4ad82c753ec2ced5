"""Byte-level BPE encoding and decoding of Arrow batches with the tokenizers library.

A text is cut at the matches of the public pattern; each distinct match of a batch goes once through the tokenizers library,
whose ids are kept for later batches. A kept match costs a dictionary lookup, which is what most of a corpus is.

Offsets are in code points: a token's bytes may begin or end inside a character, and then its offsets take in the whole
character, so neighbours overlap there. Decoding goes by the byte table, so characters that are split over tokens come back
whole; only whole sequences are decoded as text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, table

#: Matches kept by a worker, at most; the first that it meets, among which the frequent ones are.
KEPT = 300_000
#: Matches longer than this many code points are not kept.
LONG = 64
#: A worker forgets what it keeps when more than a third of so many matches were not among it.
WATCHED = 2_000_000


def byte_characters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes, each with its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Coder:
    """vocabulary: a byte-level BPE file of the tokenizers library; pattern: cuts texts into what is encoded on its own; ranks: a .tiktoken file that must have the same ids."""

    def __init__(self, vocabulary: str, pattern: str, ranks: str | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        back = byte_characters()
        special = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.spelled = [str(i).encode() for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.long = {i: len(b) for i, b in self.bytes_of.items()}
        if ranks is not None and {b: i for i, b in self.bytes_of.items()} != rank_file(ranks):
            raise ValueError(f"{vocabulary} has other ids than the ranks of {ranks}")
        self.bytes_of_spelled = {self.spelled[i]: b for i, b in self.bytes_of.items()} | {b"": b""}
        self.cut = regex.compile(pattern).findall
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.met = self.missed = 0

    def _learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        ids = (x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False))
        found = {p: (b" ".join([self.spelled[i] for i in own]), np.array([self.long[i] for i in own], np.uint16).tobytes()) for p, own in zip(pieces, ids, strict=True)}
        self.missed += len(pieces)
        if self.met > WATCHED:
            if self.missed > self.met // 3:
                self.kept.clear()
            self.met = self.missed = 0
        if len(self.kept) + len(found) <= KEPT:
            self.kept.update((p, x) for p, x in found.items() if len(p) <= LONG)
        return found

    def coded(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids in decimal, joined by one space, and the bytes that each token has."""
        pieces = self.cut(text)
        parts = list(map(self.kept.get, pieces))
        self.met += len(parts)
        if None in parts:
            new = [k for k, x in enumerate(parts) if x is None]
            found = self._learn(list({pieces[k] for k in new}))
            for k in new:
                parts[k] = found[pieces[k]]
        return b" ".join([x for x, _ in parts]), np.frombuffer(b"".join([n for _, n in parts]), np.uint16)

    def spell(self, text: str) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.coded(text)[0]

    def encode_one(self, text: str) -> list[int]:
        return [int(x) for x in self.spell(text).split()]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(t) for t in texts]

    def decode_spelled(self, ids: bytes) -> bytes:
        of = self.bytes_of_spelled
        return b"".join([of[x] for x in ids.split(b" ")])

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that are no whole character (a sequence cut inside one) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """First code point and the one after the last that each token has bytes of."""
        starts, ends, _ = code_points(text.encode(), np.array([self.long[i] for i in ids], np.uint16))
        return list(zip(starts.tolist(), ends.tolist(), strict=True))


def code_points(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of so many bytes that make up data: first code point, the one after the last, and whether a token begins or ends inside a character."""
    if not len(lengths):
        return (np.zeros(0, np.int32),) * 2 + (np.zeros(0, bool),)
    opens = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    point = np.cumsum(opens, dtype=np.int32) - 1
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    return point[starts], point[ends - 1] + 1, ~opens[starts] | ~np.append(opens, True)[ends]


_coders: dict[tuple[str, str, str | None], Coder] = {}


def coder(vocabulary: str, pattern: str, ranks: str | None = None) -> Coder:
    """This worker's coder of the file."""
    key = vocabulary, pattern, ranks
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def public_vocabulary() -> tuple[str, str, str]:
    """The public 50k vocabulary as the tokenizers library reads it, the pattern, and the same vocabulary as ranks, which every worker holds it against."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame, vocabulary: str, pattern: str, ranks: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with offsets: starts and ends array<int> in code points, for each row of docs (doc_id, text).

    A null text is an empty one and has no tokens. The file must be where executors find it, as the libraries are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern, ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = own.encode(texts)
            columns = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if offsets:
                spans = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns |= {"starts": pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())), "ends": pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return in_arrow(docs.select("doc_id", "text"), run, schema)


def decoded(ids: DataFrame, vocabulary: str, pattern: str, ranks: str | None = None) -> DataFrame:
    """doc_id and text for each row of ids (doc_id, ids). Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern, ranks)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([own.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())})

    kind = ids.schema["doc_id"].dataType.simpleString()
    return in_arrow(ids.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, vocabulary: str, pattern: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, n_split: encode and decode in one pass, so that ids need not leave the worker.

    offsets_sha256 is of all tokens' first code points, then of those after their last ones, as 32-bit little-endian numbers; n_split
    counts the tokens that begin or end inside a character.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"]
    sha = lambda body: hashlib.sha256(body).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern, ranks)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                ids, lengths = own.coded(text)
                back = own.decode_spelled(ids)
                starts, ends, split = code_points(back, lengths)
                rows.append((len(lengths), sha(ids), sha(back), sha(starts.astype("<i4").tobytes() + ends.astype("<i4").tobytes()), int(split.sum())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, ranks: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded_sha256 for each row of docs (doc_id, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern, ranks)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                spelled = [own.spell(text.as_py() or "") for text in batch.column("text")]
                ids = [np.array(x.split(), np.int32) for x in spelled]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("source"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([hashlib.sha256(own.decode_spelled(x)).hexdigest() for x in spelled], pa.string()),
                    ],
                    ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "source", "text"), run, f"doc_id {kind}, source string, n_tokens long, ids array<int>, decoded_sha256 string")


def rank_file(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, to hold a vocabulary against."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, of the bytes that they decode to, and of the tokens' offsets.

    A null text is an empty one, without tokens; rows that repeat are rows of their own; an empty table gives no row.
    """
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
