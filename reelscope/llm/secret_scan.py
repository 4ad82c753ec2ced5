"""Secret scans, in DataFrame functions only: fixed rules, and a character model that tells random strings from identifiers.

Two first-order Markov models over the same characters, one learned from random strings and one from ordinary identifiers, give a
token the log-likelihood ratio of its character pairs. A token of the right characters and length whose ratio is high enough,
in sum and per pair, is a span of kind `random`, unless it touches a span of the fixed rules; those stay as they are.

A rule's matches and the text between them, both from the regular expression engine, give all positions in code points by running
sums, which double their reach with each step, so a text of very many matches costs little more than its length.
The models are at most 2 * 65 * 65 counts, which reach the driver and come back as one array literal.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .host_rules import bound
from .shared import table

KINDS = ("assign", "access", "hex", "random")
#: Either case of each letter, written out.
_KEYWORDS = "|".join(("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short for a rule has no long enough part either, so the least length may stand in the expression itself.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Tokens that the character models look at.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least sum, and least mean by character pair, of the log-likelihood ratio.
LEAST_SUM, LEAST_MEAN = 40.0, 2.5
#: Weight of the shares of all followers in those of one character, in pairs.
SMOOTH = 30.0
#: Random strings made, for each of three alphabets, by default.
SAMPLE_RANDOM = 3000
#: Words of which identifiers are made, and identifiers as they stand in texts: words and camel case with short numbers, joined.
PLAIN = "^[A-Za-z]{2,14}$"
_PART = "(?>[A-Za-z]{2,14}(?![A-Za-z])|[A-Z]?[a-z]{2,14}(?:[A-Z][a-z]{2,14})+(?![A-Za-z]))[0-9]{0,4}"
IDENTIFIER = f"^{_PART}(?:[_/=+-](?:{_PART}|[0-9]{{1,4}}))*$"
#: The longest identifier that is looked at.
LONGEST = 100

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _span(start: F.Column, kind: F.Column, end: F.Column) -> F.Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


def running(values: F.Column, combine) -> F.Column:
    """The running combination (an associative one) of an array of int, in n * log(n) steps: each doubles the reach of every place."""
    reach = lambda k: F.call_function("shiftleft", F.lit(1), k)

    def step(acc: F.Column, k: F.Column) -> F.Column:
        return F.transform(acc, lambda x, i: F.when(i >= reach(k), combine(x, acc[i - reach(k)])).otherwise(x))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    return F.when(F.size(values) > 1, F.aggregate(steps, values, step)).otherwise(values)


def _matches(text: F.Column, pattern: str, of_matches) -> F.Column:
    """of_matches(found, ends) of all matches in order: the strings found and the places after them; null where nothing matches."""

    def placed(parts: F.Column, found: F.Column) -> F.Column:
        steps = F.transform(found, lambda f, i: F.length(parts[i]) + F.length(f))
        return bound(running(steps, lambda x, y: x + y), lambda ends: of_matches(found, ends))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(F.split(text, pattern, -1), lambda parts: bound(whole, lambda found: placed(parts, found))))


def _spans(text: F.Column, pattern: str, kind: int, least: int = 0) -> F.Column:
    """Spans of all matches; least: those whose second group has fewer characters are dropped."""

    def spans(found: F.Column, ends: F.Column) -> F.Column:
        every = F.transform(found, lambda f, i: _span(ends[i] - F.length(f), F.lit(kind), ends[i]))
        if not least:
            return every
        return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda groups: F.filter(every, lambda _, i: F.length(groups[i]) >= least))

    return F.coalesce(_matches(text, pattern, spans), F.array().cast(_SPANS))


def _apart(candidates: F.Column, base: F.Column) -> F.Column:
    """The candidates that touch no base span. Sorted together by start, one does if a base span before it ends behind its start, or one after it starts before its end."""

    def from_sorted(every: F.Column) -> F.Column:
        is_base = lambda x: x["kind"] < len(KINDS) - 1
        ends = running(F.transform(every, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0))), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(is_base(x), x["start"]).otherwise(F.lit(2**31 - 1)))), F.least))
        free = lambda e, s: F.filter(every, lambda x, i: ~is_base(x) & (e[i] <= x["start"]) & (s[i] >= x["end"]))
        return bound(ends, lambda e: bound(starts, lambda s: free(e, s)))

    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), candidates).otherwise(bound(F.sort_array(F.concat(base, candidates)), from_sorted))


def samples(docs: DataFrame, random: int = SAMPLE_RANDOM) -> DataFrame:
    """Labelled strings (text, label, n: how often each counts): 1 random ones in three alphabets, 0 the identifiers of all documents.

    The identifiers of texts count once. Words count as in all runs of three that are joined by _, by /, as camel case, and of two
    that are joined by _ in capitals; as only pairs of characters are counted, pieces of one word and the pairs between two words
    stand for the runs, so distinct words are all that is shuffled.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("random/"), F.col("id").cast("string")).cast("binary"), 256)
    plain = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    made = spark.range(random).select(F.explode(F.array(digest, plain, F.upper(F.regexp_replace(plain, "[+/]", "")))).alias("text"), F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))
    spaces = r"[\x20\x09-\x0D]+"
    texts = docs.select("text").filter("text is not null")
    found = texts.select(F.explode(F.split("text", spaces)).alias("w")).filter((F.length("w") <= LONGEST) & F.col("w").rlike(IDENTIFIER)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    w, n = F.col("w"), F.col("n")
    piece = lambda text, times: F.struct(text.alias("text"), F.lit(0).alias("label"), (n * times).alias("n"))
    framed = lambda sign, text: F.concat(F.lit(sign), text, F.lit(sign))
    joined = F.array(piece(w, 3), piece(F.initcap(w), 2), piece(framed("_", w), 2), piece(framed("/", w), 2), piece(F.upper(w), 1), piece(framed("_", F.upper(w)), 1))
    words = found.select(F.explode(F.when(w.rlike(PLAIN), joined).otherwise(F.array(piece(w, 1)))).alias("p")).select("p.*")
    ends = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z]{spaces}[A-Za-z]"), F.lit(0))).alias("e"))
    ends = ends.groupBy(F.substring("e", 1, 1).alias("a"), F.upper(F.substring("e", -1, 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    humps = ends.select(F.explode(F.array(piece(F.concat("a", "b"), 1), piece(F.concat(F.lower("a"), F.col("b")), 1))).alias("p")).select("p.*")
    return made.unionByName(words).unionByName(humps)


def train(labelled: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) for each pair of characters of ALPHABET, by labelled (text, label) strings.

    Where there is a column n, a string counts n times. A character's followers are smoothed by SMOOTH times the shares of all
    followers, these by one half each. Characters outside ALPHABET break a string. Without samples all ratios are 0.
    """
    size = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2))))
    times = F.col("n") if "n" in labelled.columns else F.lit(1)
    pairs = labelled.filter(F.length("text") >= 2).select("label", times.alias("n"), pair.alias("pair")).filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    counts = pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    of = {label: [[0.0] * size for _ in range(size)] for label in (0, 1)}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for r in counts:
        a, b = r["pair"]
        if a in place and b in place:
            of[r["label"]][place[a]][place[b]] += r["n"]

    def logs(n: list[list[float]]) -> list[float]:
        every = [sum(row[b] for row in n) + 0.5 for b in range(size)]
        share = [x / sum(every) for x in every]
        return [math.log((row[b] + SMOOTH * share[b]) / (sum(row) + SMOOTH)) for row in n for b in range(size)]

    return [x - y for x, y in zip(logs(of[1]), logs(of[0]), strict=True)]


def _ratio(token: F.Column, table_: F.Column) -> F.Column:
    """Sum of the log-likelihood ratios of a token's character pairs; all its characters are in ALPHABET."""
    of_code = F.split(F.lit(",".join(str(max(ALPHABET.find(chr(c)), 0)) for c in range(128))), ",").cast("array<int>")
    places = bound(of_code, lambda codes: F.transform(F.split(token, ""), lambda c: codes[F.ascii(c)]))
    return bound(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 2), F.lit(0.0), lambda acc, i: acc + table_[p[i] * len(ALPHABET) + p[i + 1]]))


def _random(text: F.Column, ratios: F.Column) -> F.Column:
    """Spans of the tokens that are likelier random strings than identifiers."""

    def spans(found: F.Column, ends: F.Column) -> F.Column:
        judged = lambda f: bound(_ratio(f, ratios), lambda x: (x >= LEAST_SUM) & (x >= LEAST_MEAN * (F.length(f) - 1)))
        every = F.transform(found, lambda f, i: F.struct(judged(f).alias("random"), _span(ends[i] - F.length(f), F.lit(len(KINDS) - 1), ends[i]).alias("span")))
        return F.transform(F.filter(every, lambda x: x["random"]), lambda x: x["span"])

    return F.coalesce(_matches(text, TOKEN, spans), F.array().cast(_SPANS))


def _joined(spans: F.Column, names: tuple[str, ...] = KINDS) -> F.Column:
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in names)), k + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id and base and added spans (arrays of start, kind, end in code points) for each row of docs (doc_id, text).

    A null text is an empty one and has no span. Rows that repeat are scanned again. The work grows with a text's length and with
    n * log(n) for n matches. An empty table gives an empty result; other columns are not looked at.
    """
    literal = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(F.col("text"), ASSIGN, 0, 12), _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", base.alias("base"), bound(literal, lambda t: _random(F.col("text"), t)).alias("random"))
    return found.select("doc_id", "base", _apart(F.col("random"), F.col("base")).alias("added"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by fixed rules and the spans that the character models, trained on all documents, add.

    A null text has no span; rows that repeat are rows of their own; an empty table gives no row.
    """
    docs = table(spark, sf_dir, "documents")
    found = scanned(docs, train(samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
