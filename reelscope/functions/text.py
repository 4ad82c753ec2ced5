"""Expressions over names, paths and texts, and the fuzzy match of short strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slots(df: DataFrame) -> int:
    """Partitions for rows that are few bytes and much work: the session's shuffle partitions, or two a core if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to that many partitions if it is read from fewer files."""
    return df if len(df.inputFiles()) >= slots(df) else df.repartition(slots(df))


def frame_file(ms: Column) -> Column:
    return F.format_string("frame_%08d.webp", ms)


def frame_ms(file: Column) -> Column:
    """The number between the first underscore and the next underscore or dot."""
    return F.regexp_extract(file, r"^[^_]*_([^_.]*)", 1).try_cast("bigint")


def legacy_frame(file: Column) -> Column:
    """The number in frame_<n>.jpg; 0 where there is none."""
    return F.coalesce(F.replace(F.replace(file, F.lit("frame_")), F.lit(".jpg")).try_cast("bigint"), F.lit(0).cast("bigint"))


def video_name(dataset: Column, folder: Column) -> Column:
    return F.concat_ws("_", F.lower(dataset), folder)


def chunk_name(ordinal: Column, size: int) -> Column:
    return F.format_string("%02d", F.floor(ordinal / size).cast("int") + 1)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def quoted(text: Column) -> Column:
    """What stands in double quotes, straight or curly."""
    return F.regexp_extract_all(text, F.lit('["“]([^"”]+)["”]'), F.lit(1))


def hop(fps: Column, interval: float) -> Column:
    """Frames between samples, rounded half to even."""
    return F.bround(fps * interval).cast("int")


def milliseconds(index: Column, fps: Column) -> Column:
    return (index / fps * 1000).cast("bigint")


def strands(a: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
    """For each place of each other string b, where the strand that ends there starts in b; negative: in a.

    Strands run through the grid of a (down) and b (across), turn where characters are equal, and cross no other one twice. The
    longest common subsequence of a and b[i:j] then is j - i less the strands that start at i or later and end before j. One step
    takes a whole diagonal of all grids; shorter strings are filled up with what equals nothing, which changes nothing to its left.
    """
    m, n = len(a), max(map(len, others))
    grid = np.full((n, len(others)), -1, np.int32)
    for k, b in enumerate(others):
        grid[: len(b), k] = b
    across = np.repeat(np.arange(m, dtype=np.int32)[:, None], len(others), axis=1)
    down = np.repeat(np.arange(m, m + n, dtype=np.int32)[:, None], len(others), axis=1)
    turned = a[::-1].astype(np.int32)[:, None]
    for d in range(m + n - 1):
        first, last = max(0, d - m + 1), min(n, d + 1)
        rows = slice(first + m - 1 - d, last + m - 1 - d)
        h, v = across[rows], down[first:last]
        out = np.where(turned[rows] == grid[first:last], v, np.minimum(h, v))
        h += v
        np.subtract(h, out, out=v)
        across[rows] = out
    return [down[: len(b), k] - m for k, b in enumerate(others)]


def best_stretch(m: int, start: np.ndarray) -> float:
    """The best 2 * common subsequence / both lengths of a string of m characters and a stretch of its length of another one, or a shorter one at either end, by the strands of the two; the other is no shorter."""
    n = len(start)
    inside = np.flatnonzero(start >= 0)
    end = np.full(n, n)
    end[start[inside]] = inside
    places = np.arange(n - m + 1)
    # strands within b[i:i + m], from one stretch to the next: less the one that starts at i, more the one that ends at i + m
    within = np.cumsum(np.concatenate([[(start[:m] >= 0).sum()], (start[m:] > places[:-1]).astype(np.int64) - (end[: n - m] < places[:-1] + m)]))
    best = 2 * (m - within.min()) / (2 * m)
    short = np.arange(1, m)
    head = short - np.cumsum(start[: m - 1] >= 0)
    tail = short - np.cumsum(end[: n - m : -1] < n)
    for common in (head, tail) if m > 1 else ():
        best = max(best, float((2 * common / (m + short)).max()))
    return float(best)


#: Strings that are matched at once, and characters of them at most.
_AT_ONCE, _CHARACTERS = 32, 1_000_000

#: Bits of the rows that are compared at once. Stretches of a string, as a share of its length by the target's, beyond which strands are less work.
_BITS, _MANY = 1 << 18, 32


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def common(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row, the longest common subsequence of a and the row's first k places, for k from 0 up to all; 0 is a place that equals nothing.

    All rows are one number: a bit stays set at each place where the subsequence does not grow, one character of a after the other
    (Hyyrö's recurrence). The gap behind each row takes its carry.
    """
    n, width = rows.shape
    held = np.zeros((n, width + 1), rows.dtype)
    held[:, :width] = rows
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    at = {c: number(held == c) for c in np.unique(a).tolist()}
    held[:, :width], held[:, width] = 1, 0
    keep = same = number(held)
    for c in a.tolist():
        equal = same & at[c]
        if equal:
            same = (same + equal) & keep | same ^ equal
    bits = np.unpackbits(np.frombuffer(same.to_bytes(n * (width + 1) // 8 + 1, "little"), np.uint8), count=n * (width + 1), bitorder="little")
    out = np.zeros((n, width + 1), np.int32)
    np.cumsum(1 - bits.reshape(n, width + 1)[:, :width], axis=1, out=out[:, 1:])
    return out


def stretch_ratios(a: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """round(best_stretch * 100) of a and each of the others, none of which is shorter.

    Each other one is cut into rows that hold the stretches of m / 3 starts. With i0 <= i, j <= j0 and L(i, j) for the common
    subsequence with b[i:j], L(i, j) <= L(i0, j) + L(i, j0) - L(i0, j0), as the paths from i0 to j0 and from i to j cross. What stands on
    the right comes of comparing the rows once forward and once backward. So does each stretch at either end of a row or of b, and only
    those whose bound rounds to more than the best one known are compared by themselves, the highest bounds first.
    """
    m = len(a)
    starts_in = max(m // 3, 1)
    width, lengths = m + starts_in - 1, np.array([len(b) for b in others])
    letters = np.unique(a)
    code = np.zeros(0x110000, np.min_scalar_type(len(letters)))
    code[letters] = np.arange(1, len(letters) + 1)
    begin = np.cumsum(lengths + starts_in) - lengths - starts_in
    flat = np.zeros(int((lengths + starts_in).sum()), code.dtype)
    for i, b in zip(begin.tolist(), others, strict=True):
        flat[i : i + len(b)] = code[b]
    a = code[a]
    n_rows = (lengths - m) // starts_in + 1
    of = np.repeat(np.arange(len(others)), n_rows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)
    start = begin[of] + nth * starts_in
    last = begin + lengths - m
    rated = np.rint(2 * np.arange(m + 1) / (2 * m) * 100).astype(np.int64)
    best, short, inside = np.zeros(len(others), np.int64), np.arange(1, m), np.arange(starts_in)
    rows, whole = (np.lib.stride_tricks.sliding_window_view(flat, x) for x in (width, m))
    open_of, open_at, bounds = [], [], []
    step = max(1, _BITS // (width + 1))
    for k in range(0, len(of), step):
        own, at = of[k : k + step], start[k : k + step]
        part = rows[at]
        ahead, back = common(a, part), common(a[::-1], part[:, ::-1])
        bound = np.minimum(ahead[:, m:] + back[:, : m - 1 : -1] - ahead[:, -1:], m)
        bound[at[:, None] + inside > last[own, None]] = 0
        np.maximum.at(best, own, rated[np.maximum(bound[:, 0], bound[:, -1])])
        if m > 1:
            ends = np.flatnonzero(nth[k : k + step] == 0)
            np.maximum.at(best, own[ends], _ends(ahead[ends, 1:m], short, m))
            ends = np.flatnonzero(nth[k : k + step] == n_rows[own] - 1)
            filled = at[ends] + width - begin[own[ends]] - lengths[own[ends]]
            np.maximum.at(best, own[ends], _ends(back[ends[:, None], filled[:, None] + short], short, m))
        row, place = np.nonzero(rated[bound] > best[own, None])
        open_of.append(own[row])
        open_at.append(at[row] + place)
        bounds.append(bound[row, place])
    t, at, bound = (np.concatenate(x) for x in (open_of, open_at, bounds))
    order = np.lexsort((-bound, t))
    t, at, bound = t[order], at[order], bound[order]
    take, step = 8, max(1, _BITS // (m + 1))
    while True:
        left = rated[bound] > best[t]
        t, at, bound = t[left], at[left], bound[left]
        many = np.bincount(t, minlength=len(others)) * m > _MANY * lengths if take > 8 else np.zeros(len(others), bool)
        for k in np.flatnonzero(many).tolist():
            best[k] = round(best_stretch(m, strands(a, [code[others[k]]])[0]) * 100)
        now = ~many[t] & (np.arange(len(t)) - np.searchsorted(t, t) < take)
        for k in range(0, int(now.sum()), step):
            part = slice(k, k + step)
            np.maximum.at(best, t[now][part], rated[common(a, whole[at[now][part]])[:, -1]])
        left = ~many[t] & ~now
        if not left.any():
            return best.tolist()
        t, at, bound, take = t[left], at[left], bound[left], 2 * take


def _ends(found: np.ndarray, short: np.ndarray, m: int) -> np.ndarray:
    """The best ratio of each row of common subsequences with stretches of those lengths, shorter than m."""
    return np.rint((2 * found / (m + short)).max(axis=1, initial=0) * 100).astype(np.int64)


def partial_ratio(a: str, b: str) -> int:
    """0 to 100: how well the shorter string matches the best stretch of the longer one of at most its length.

    A stretch scores 2 * common subsequence / both lengths. Two empty strings give 100, one empty string 0.
    """
    return partial_ratios(a, [b])[0]


def partial_ratios(a: str, others: list[str]) -> list[int]:
    """partial_ratio(a, b) for each b of others."""
    out, longer = [0] * len(others), []
    own = points(a)
    for k, b in enumerate(others):
        if not a or not b:
            out[k] = 100 if a == b else 0
        elif a in b or b in a:
            out[k] = 100
        elif len(b) > len(a):
            longer.append((k, b))
        else:
            other = points(b)
            out[k] = max(stretch_ratios(other, [own]) + (stretch_ratios(own, [other]) if len(a) == len(b) else []))
    while longer:
        size, n = 0, 0
        while size < len(longer) and (size == 0 or n + len(longer[size][1]) <= _CHARACTERS):
            n += len(longer[size][1])
            size += 1
        part, longer = longer[:size], longer[size:]
        for (k, _), ratio in zip(part, stretch_ratios(own, [points(b) for _, b in part]), strict=True):
            out[k] = ratio
    return out


#: Characters of a gram, by the length of the string that is looked for, at least.
_GRAMS = ((24, 3), (8, 2), (0, 1))


def grams(text: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of so many code points."""
    out = np.zeros(max(len(text) - size + 1, 0), np.int64)
    for k in range(size):
        out = out << 21 | text[k : k + len(out)]
    return out


class Target:
    """A string that is looked for in many others, where only ratios of `least` (0 to 1) and more count.

    Strings of m characters that differ by d insertions and deletions share m + 1 - q - q * d grams of q characters at least. A
    stretch with the ratio differs by (1 - ratio) * 2 * m at most, so a text none of whose stretches has grams enough is left out
    before anything is compared. The ratio is rounded to hundredths, so half of one is allowed for.
    """

    def __init__(self, text: str, least: float):
        self.text, self.points = text, points(text)
        m = len(text)
        self.size = next(q for n, q in _GRAMS if m >= n)
        self.wanted = m + 1 - self.size - self.size * (1 - least + 0.0051) * 2 * m if least > 0 else 0.0
        self.grams = np.unique(grams(self.points, self.size))

    def may_match(self, other: Found) -> bool:
        if self.wanted <= 0 or len(other.points) < len(self.points):
            return True
        held = np.concatenate([[0], np.cumsum(np.isin(other.grams(self.size), self.grams))])
        width = min(len(self.points) - self.size + 1, len(held) - 1)
        return bool((held[width:] - held[: len(held) - width]).max() >= self.wanted)


class Found:
    """A text that is looked into by many targets."""

    def __init__(self, text: str):
        self.text, self.points = text, points(text)
        self._grams: dict[int, np.ndarray] = {}

    def grams(self, size: int) -> np.ndarray:
        if size not in self._grams:
            self._grams[size] = grams(self.points, size)
        return self._grams[size]


def _all_ratios(pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """The ratio of every pair, those of one first string at once."""
    of: dict[str, list[str]] = {}
    for a, b in pairs:
        of.setdefault(a, []).append(b)
    return {(a, b): r for a, others in of.items() for b, r in zip(others, partial_ratios(a, others), strict=True)}


@F.pandas_udf(T.IntegerType())
def partial_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b, strict=True)]
    found = _all_ratios({p for p in pairs if p})
    return pd.Series([found[p] if p else 0 for p in pairs])


def best_ratios(targets: Column, found: Column, least: float = 0.0) -> Column:
    """For each target its best ratio over the found texts, 0 to 1; case does not count; without found texts 0.

    least: ratios below it may be given as 0.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ratios(targets: pd.Series, found: pd.Series) -> pd.Series:
        rows = [tuple([] if x is None else [y.lower() for y in x if y is not None] for x in r) for r in zip(targets, found, strict=True)]
        pairs = {(t, f) for ts, fs in rows for t in ts for f in fs}
        if least > 0:
            of_target, of_found = ({x: make(x) for x in {p[k] for p in pairs}} for k, make in ((0, lambda t: Target(t, least)), (1, Found)))
            pairs = {(t, f) for t, f in pairs if not t or not f or t in f or of_target[t].may_match(of_found[f])}
        known = _all_ratios(pairs)
        return pd.Series([[max((known.get((t, f), 0) for f in fs), default=0) / 100 for t in ts] for ts, fs in rows])

    return ratios(targets, found)
