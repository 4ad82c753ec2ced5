"""Alignment of two tokenizers over the same texts, and the links between their ids that a corpus supports most.

A text's tokens of both tokenizers are byte ranges of one string. The B tokens' ranges are a static interval index; each A token stabs it
by bisection and gets the run of B tokens that it overlaps. A gap between B tokens that no run spans is a place where both tokenizers end a
token: there a group ends. Every A token of a group is linked with every B token of it.

Texts are cut into units, a space with what follows it up to the next one, and these again at stops and lines' ends, where neither
tokenizer can have a token across the cut; a worker remembers what it found for short units, which most of a corpus repeats. A unit whose
bytes a tokenizer does not give back makes its text one unit, and if that does not come back either, the text has no tokens.

In how many documents an id pair is linked is counted over the whole corpus. Documents then look their pairs up: the pairs that are more
than one in HEAVY of all, which are fewer than HEAVY whatever the corpus, at the workers, all others by a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .shared import in_arrow, of_process, scratch, table, written

#: A pair of ids as one number: the A id times this, plus the B id.
PAIR = 1 << 31
#: Pairs that more than one in so many (document, pair) rows have are looked up at the workers.
HEAVY = 100_000
#: Bits that a text's number of tokens may have.
FIELD = 40
#: Groups of more links than this are counted by distinct ids, not link by link.
MANY = 1024
#: Units that a worker remembers, at most: the first that it meets, until eight times as many were unknown; and their greatest length.
KEPT = 200_000
LONG = 64

#: A space behind a white-space character of any kind, where units must not be cut.
_odd = re.compile(r"\s ").search
_cuts = re.compile(r"(?<=\S)(?= +[^ ])").split
#: Where the A tokenizer's pre-tokenizer always cuts: before a stop behind a letter, and around a line's end that stands alone.
_stops = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)").split


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of so many bytes that cover the same bytes: the first B token that each A token overlaps, and the last."""
    a_ends, b_ends = np.cumsum(a_sizes, dtype=np.int64), np.cumsum(b_sizes, dtype=np.int64)
    return np.searchsorted(b_ends, a_ends - a_sizes, "right"), np.searchsorted(b_ends, a_ends, "left")


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group (0, 1, ...) of each A token and of each B token: groups end at the gaps between B tokens that no A token spans."""
    first, last = overlaps(a_sizes, b_sizes)
    spans = np.bincount(first, minlength=len(b_sizes) + 1) - np.bincount(last, minlength=len(b_sizes) + 1)
    b_group = np.append(0, np.cumsum(np.cumsum(spans)[: len(b_sizes) - 1] == 0))
    return b_group[first], b_group


def links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and how often it is linked, for ids and their groups; a group may have a pair several times, but no group has more rows than distinct pairs or MANY."""
    n = int(b_group[-1]) + 1
    many_a, many_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    large = many_a * many_b > MANY
    turns = np.where(large, 0, many_b)[a_group]
    of = np.repeat(np.arange(len(a)), turns)
    place = np.arange(len(of)) - np.repeat(np.cumsum(turns) - turns, turns)
    b_from, a_from = np.cumsum(many_b) - many_b, np.cumsum(many_a) - many_a
    rows = [(a_group[of], a[of] * PAIR + b[b_from[a_group[of]] + place], np.ones(len(of), np.int64))]
    for g in np.flatnonzero(large):
        (x, k), (y, m) = (np.unique(ids[start : start + size], return_counts=True) for ids, start, size in ((a, a_from[g], many_a[g]), (b, b_from[g], many_b[g])))
        rows.append((np.full(len(x) * len(y), g), (x[:, None] * PAIR + y).ravel(), (k[:, None] * m).ravel()))
    return tuple(map(np.concatenate, zip(*rows, strict=True)))


class Aligner:
    """a: a byte-level BPE .json file, that gets a space before each text; b: a sentencepiece BPE .model file, that adds one itself."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        back = byte_characters()
        special = {token.content for token in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (self.a.get_vocab_size() + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(back[c] for c in token) if token not in special else b""
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        own = [self.b.id_to_piece(i) for i in ids if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.pairs = {p[k : k + 2] for p in own for k in range(len(p) - 1)}
        #: No piece has a space behind another character, or a line's end.
        self.apart = not any(p[1] == "▁" != p[0] for p in self.pairs) and not any("\n" in p for p in own) and self.b.encode("\n") == [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = [[b"%s%d" % (mark, i) for i in range(most)] for mark in (b"", b",", b"|", b";")]
        self.kept: dict[str, tuple[bytes, bytes, int]] = {}
        self.missed = 0

    def _encoded(self, units: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """For each unit: groups spelled out, pairs each with how often (as 64-bit numbers), numbers of A tokens, B tokens and groups in one number; None where bytes differ."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # what does not begin with the space that the library adds gets a line's end before it, a token of its own
        b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        b = [x if u[0] == " " else x[2:] for u, x in zip(units, b, strict=True)]
        same = [b"".join([self.a_bytes[i] for i in x]) == u.encode() == b"".join([self.b_bytes[i] for i in y]) for u, x, y in zip(units, a, b, strict=True)]
        if not all(same):
            found = iter(self._grouped([x for x, ok in zip(a, same, strict=True) if ok], [x for x, ok in zip(b, same, strict=True) if ok]) if any(same) else ())
            return [next(found) if ok else None for ok in same]
        return self._grouped(a, b)

    def _grouped(self, a: list[list[int]], b: list[list[int]]) -> list[tuple[bytes, bytes, int]]:
        """What _encoded gives of units with these ids, all units at once: they cover the bytes of one long string, and no token spans two of them."""
        n = len(a)
        unit_a, unit_b = (np.repeat(np.arange(n), np.fromiter(map(len, x), np.int64, n)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_group, b_group = groups(self.a_size[a], self.b_size[b])
        group, pairs, times = links(a, b, a_group, b_group)
        unit_of = np.zeros(int(b_group[-1]) + 1, np.int64)
        unit_of[b_group] = unit_b
        order = np.argsort(unit_of[group], kind="stable")
        linked = np.stack([pairs[order], times[order]], 1).tobytes()
        # the tokens of a group, those of A first; what stands before a token tells where groups and sides begin
        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        at = np.lexsort((side, np.concatenate([a_group, b_group])))
        ids, side, own, unit = ids[at], side[at], np.concatenate([a_group, b_group])[at], np.concatenate([unit_a, unit_b])[at]
        begins = lambda x: np.append(True, x[1:] != x[:-1])
        mark = np.select([begins(unit), begins(own), begins(side)], [0, 3, 2], 1)
        words = [self.spelled[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        parts = np.arange(n + 1)
        tokens, rows = np.searchsorted(unit, parts).tolist(), (16 * np.searchsorted(unit_of[group][order], parts)).tolist()
        counts = zip(*(np.bincount(x, minlength=n).tolist() for x in (unit_a, unit_b, unit_of)), strict=True)
        return [(b"".join(words[tokens[k] : tokens[k + 1]]), linked[rows[k] : rows[k + 1]], x << 2 * FIELD | y << FIELD | z) for k, (x, y, z) in enumerate(counts)]

    def _keep(self, found: dict[str, tuple | None]) -> None:
        self.missed += len(found)
        if self.missed > 8 * KEPT:  # what it knows is of another part of the corpus
            self.kept.clear()
            self.missed = 0
        if len(self.kept) < KEPT:
            self.kept.update((u, x) for u, x in islice(found.items(), KEPT - len(self.kept)) if x is not None and len(u) <= LONG)

    def _finer(self, unit: str) -> list[str]:
        """The unit cut before stops behind a letter, and around a line's end, where no piece holds the two characters."""
        parts = _stops(unit)
        if len(parts) == 1 or not any(x[-1] + y[0] in self.pairs for x, y in pairwise(parts)):
            return parts
        out = parts[:1]
        for x in parts[1:]:
            if out[-1][-1] + x[0] in self.pairs:
                out[-1] += x
            else:
                out.append(x)
        return out

    def _learned(self, units: list[str]) -> dict[str, tuple | None]:
        finer = {u: self._finer(u) for u in units}
        known = {p: self.kept.get(p) for parts in finer.values() for p in parts}
        if new := [p for p, x in known.items() if x is None]:
            made = dict(zip(new, self._encoded(new), strict=True))
            self._keep(made)
            known |= made
        made = {u: joined([known[p] for p in parts]) for u, parts in finer.items() if len(parts) > 1}
        self._keep(made)
        return {u: made[u] if u in made else known[u] for u in units}

    def _units(self, text: str) -> list[str]:
        joint = " " + text
        if not self.apart:
            return [joint]
        return [" " + w for w in text.split(" ")] if not _odd(joint) and joint[-1] != " " else _cuts(joint)

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, int, bytes, np.ndarray, np.ndarray]]:
        """For each text: numbers of A tokens, B tokens and groups, the groups spelled out, the distinct pairs ascending and how often each is linked."""
        every = [self._units(t) if t else [] for t in texts]
        parts = [list(map(self.kept.get, units)) for units in every]
        missing = {u: None for units, found in zip(every, parts, strict=True) if None in found for u, x in zip(units, found, strict=True) if x is None}
        learned = self._learned(list(missing)) if missing else {}
        for text, units, found in zip(texts, every, parts, strict=True):
            if None in found:
                found = [learned[u] if x is None else x for u, x in zip(units, found, strict=True)]  # noqa: PLW2901
            if None in found:
                found = self._encoded([" " + text])  # noqa: PLW2901
            if not found or None in found:
                yield 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            spelled, linked, counts = joined(found)
            rows = np.frombuffer(linked, np.int64).reshape(-1, 2)
            order = np.argsort(rows[:, 0])
            pairs, times = rows[order, 0], rows[order, 1]
            starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            yield counts >> 2 * FIELD, counts >> FIELD & (1 << FIELD) - 1, counts & (1 << FIELD) - 1, spelled, pairs[starts], np.add.reduceat(times, starts)


def joined(parts: list[tuple | None]) -> tuple[bytes, bytes, int] | None:
    """What was found for the parts, one after the other; None if a part has none."""
    if None in parts:
        return None
    return b";".join([x[0] for x in parts]), b"".join([x[1] for x in parts]), sum([x[2] for x in parts])


def aligner(a: str, b: str) -> Aligner:
    """This process's aligner of the files."""
    return of_process("aligner", (a, b), Aligner)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int64()))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (arrays: the distinct pairs, how often each is linked) of docs (doc_id, text)."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for big in batches:
            for at in range(0, big.num_rows, 250):
                batch = big.slice(at, 250)
                rows = list(own.aligned([t or "" for t in batch.column("text").to_pylist()]))
                longs = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                hashed = pa.array([hashlib.sha256(r[3]).hexdigest() if r[2] else "" for r in rows], pa.string())
                linked = pa.array([int(r[5].sum()) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, linked, hashed, lists([r[4] for r in rows]), lists([r[5] for r in rows])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n_docs (documents that hold it linked), best (none of its A id's pairs has more) of alignments().

    Counted per pair with a partial sum before the shuffle. The A ids' highest counts are as many rows as the A vocabulary at most, and go to
    the workers.
    """
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = written(counted.withColumn("a", F.floor(F.col("pair") / PAIR).cast("int")).withColumn("b", (F.col("pair") % PAIR).cast("int")), "pairs")
    highest = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(highest), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def with_support(aligned: DataFrame, counted: DataFrame) -> DataFrame:
    """aligned (with row, a number of its own for each) with n_best (its links whose pair is best) and count_sum (of n_docs over its links)."""
    spark = aligned.sparkSession
    every = counted.agg(F.sum("n_docs")).collect()[0][0] or 0
    heavy = F.col("n_docs") * HEAVY > every
    known = counted.filter(heavy).select("pair", "n_docs", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n_docs", "best")))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """For all pairs of a batch: pair, how often, row in the batch, place among the known ones, whether it is one of them."""
        pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        of = np.repeat(np.arange(batch.num_rows), batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False))
        keys = shared.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return pairs, times, of, at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n_docs, best = shared.value
        for batch in batches:
            _, times, of, at, is_known = looked_up(batch)
            at, of, times = at[is_known], of[is_known], times[is_known]
            out = [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)]
            np.add.at(out[0], of, times * best[at])
            np.add.at(out[1], of, times * n_docs[at])
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, out)], ["row", "known_best", "known_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, of, _, is_known = looked_up(batch)
            rows = batch.column("row").to_numpy()[of[~is_known]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs[~is_known]), pa.array(times[~is_known])], ["row", "pair", "times"])

    held = aligned.select("row", "pairs", "times")
    near = in_arrow(held, sums, "row long, known_best long, known_sum long")
    far = in_arrow(held, others, "row long, pair long, times long").join(counted.filter(~heavy).select("pair", "n_docs", "best"), "pair")
    far = far.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best"), F.sum(F.col("times") * F.col("n_docs")).alias("far_sum"))
    total = lambda name: (F.col(f"known_{name}") + F.coalesce(F.col(f"far_{name}"), F.lit(0))).cast("long")
    return aligned.drop("pairs", "times").join(near, "row").join(far, "row", "left").withColumns({"n_best": total("best"), "count_sum": total("sum")}).drop("known_best", "known_sum", "far_best", "far_sum")


def cross_tokens(docs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The documents' digests (see op12_cross_tokens) and the links between the vocabularies: a, b, n_docs, best."""
    with scratch() as kept:
        aligned = written(alignments(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "aligned")
        counted = written(pair_counts(aligned), "counted")
        kept += [aligned, counted]
    digests = with_support(aligned, counted).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return digests, counted.select("a", "b", "n_docs", "best")


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of both public tokenizers, groups, links, links of the best pair of their A id, sum of the pairs' counts, digest of the groups.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros, and an empty digest. Rows that
    repeat, and rows of a null id, are documents of their own and count as such; an empty table gives no row; other columns are not read.
    """
    import public_tokenizers as P

    return cross_tokens(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))[0]
