"""Quality rules by host, in DataFrame functions only.

Each document is measured once, and the measures are written without the text. Every rule's failures are summed by host (the
documents' source). A host's failure rate is shrunk towards that of all hosts by a beta prior, whose strength comes from how much
hosts differ beyond what chance makes of their numbers of documents (method of moments), so a host of few documents is not
judged by them alone. The posterior of a rate gives the verdicts, which are joined back to the documents:

- a host is `condemned`, with all its documents, when its rate under some rule, or under any of them, is surely beyond a bound that
  comes from the prior: odds of `odds` times those of all hosts, and half of its documents at least;
- a host is `suspect` under a soft rule (symbols, repeated lines) when its rate is surely beyond `suspect` times that of all hosts; a
  document that fails a soft rule goes at such a host and stays at any other. So where no host tells anything, the base rules decide.

Surely: by `sure` standard deviations of the posterior.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, WORD, table, written

#: Bounds of the prior's strength, in documents.
STRENGTH = (2.0, 1000.0)
#: What the verdicts are taken by (see above).
SURE, ODDS, SUSPECT = 3.0, 4.0, 1.5
SYMBOLS = "#*$%&|<>"
#: Rules by name, as SQL over the measures; a document that fails a base rule goes at every host.
BASE = {"short": "n_words < 50", "repeated": "100 * n_repeat_words > 50 * n_words"}
SOFT = {"symbols": "10 * n_symbols > 5 * n_words", "lines": "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines"}
RULES = BASE | SOFT
ANY = "ruined"


def bound(value: F.Column, body) -> F.Column:
    """body(value) with value evaluated once, also where lambdas within use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: F.Column) -> F.Column:
    """Words of an array that lie in a window of three words found twice or more; windows are told apart by a 64-bit hash."""

    def covered(windows: F.Column) -> F.Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def from_sorted(s: F.Column) -> F.Column:
            last = F.size(s) - 1
            same = lambda k, j: s[k]["h"] == s[j]["h"]
            twice = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, same(k, k - 1)).otherwise(False) | F.when(k < last, same(k, k + 1)).otherwise(False))
            places = F.flatten(F.transform(twice, lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: s[k]["i"] + d)))
            return F.size(F.array_distinct(places))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bound(ordered, from_sorted))

    def from_words(w: F.Column) -> F.Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(bound(windows, covered))

    return bound(words, from_words)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words for each row of docs (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = "".join(WHITE)
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, spaces, "") != "")
    base = docs.select(F.col("doc_id"), F.col("source").alias("host"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return base.select(
        "doc_id",
        "host",
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("of_words"),
        F.length(F.translate("text", spaces, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("of_lines"),
    ).select("doc_id", "host", "of_words.n_words", "word_chars", "n_symbols", "of_lines.n_lines", "of_lines.n_dup_lines", "of_words.n_repeat_words")


def prior(n: int, squares: int, hosts: int, failed: int, spread: float) -> tuple[float, float]:
    """Mean and strength of the beta prior of a rule's rate.

    n: documents, squares: sum over hosts of their documents squared, spread: sum over hosts of failed * failed / documents. What
    rates of `hosts` equal hosts would spread by chance is taken off; hosts that spread no more get the greatest strength.
    """
    if not n:
        return 0.5, STRENGTH[1]
    mean = failed / n
    chance = mean * (1 - mean)
    apart = 1 - squares / (n * n)
    between = (spread / n - mean * mean - chance * (hosts - 1) / n) / apart if apart > 1e-12 else 0.0
    return mean, min(STRENGTH[1], max(STRENGTH[0], chance / between - 1)) if between > 1e-12 else STRENGTH[1]


def host_verdicts(measured: DataFrame, sure: float = SURE, odds: float = ODDS, suspect: float = SUSPECT) -> DataFrame:
    """host, n_docs, a shrunk rate for each rule and for ANY, condemned, and suspect_<rule> for soft rules, for every host of measured.

    measured: host and a boolean for each rule. Documents of a null host are one host. The driver sees one row of sums.
    """
    rules = [*RULES, ANY]
    measured = measured.withColumn(ANY, reduce(Column.__or__, (F.col(r) for r in RULES)))
    hosts = written(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules)), "hosts")
    n = F.col("n_docs")
    found = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum((n * n).cast("double")).alias("squares"), F.count(F.lit(1)).alias("hosts"), *(F.sum(r).alias(r) for r in rules), *(F.sum(F.col(r) * F.col(r) / n).alias(f"spread_{r}") for r in rules)
    ).collect()[0]
    condemned, shrunk, suspects = F.lit(False), [], []
    for r in rules:
        mean, strength = prior(found["n"] or 0, found["squares"] or 0, found["hosts"], found[r] or 0, found[f"spread_{r}"] or 0.0)
        rate = (F.col(r) + mean * strength) / (n + strength)
        margin = F.sqrt(rate * (1 - rate) / (n + strength + 1)) * sure
        bound_ = max(0.5, odds * mean / (1 - mean + odds * mean))
        condemned = condemned | (rate - margin > bound_)
        shrunk.append(rate.alias(f"rate_{r}"))
        if r in SOFT:
            suspects.append((rate - margin > suspect * mean).alias(f"suspect_{r}"))
    return hosts.select("host", "n_docs", *shrunk, condemned.alias("condemned"), *suspects)


def judged(docs: DataFrame, sure: float = SURE, odds: float = ODDS, suspect: float = SUSPECT) -> DataFrame:
    """The measures of each row of docs, a boolean for each rule, base_failed, the host's verdicts, and kept.

    A null text has no words and fails. Repeated rows count again. An empty table gives an empty result; other columns are not
    looked at.
    """
    measured = written(measures(docs), "measures").select("*", *(F.expr(sql).alias(r) for r, sql in RULES.items()))
    hosts = host_verdicts(measured, sure, odds, suspect).drop("n_docs").withColumnRenamed("host", "of_host")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    joined = joined.withColumn("base_failed", reduce(Column.__or__, (F.col(r) for r in BASE)))
    soft = reduce(Column.__or__, (F.col(r) & F.col(f"suspect_{r}") for r in SOFT))
    return joined.withColumn("kept", ~(F.col("base_failed") | F.col("condemned") | soft))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every document, and kept: it fails no base rule, its host is not condemned, and it fails no soft rule that its host is suspect under.

    A null text has no words, so it fails; rows that repeat are rows of their own; an empty table gives no row.
    """
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rules = RULES | {ANY: " OR ".join(f"({x})" for x in RULES.values())}
    sums = ", ".join(f"count(*) FILTER (WHERE {x}) AS {r}" for r, x in rules.items())
    moments = ", ".join(f"sum({r})::DOUBLE / sum(n) AS m_{r}, sum(({r} * {r})::DOUBLE / n) / sum(n) AS s_{r}" for r in rules)
    between = ", ".join(f"CASE WHEN 1 - q > 1e-12 THEN (s_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * (k - 1) / n) / (1 - q) ELSE 0 END AS b_{r}" for r in rules)
    low, high = STRENGTH
    strength = ", ".join(f"CASE WHEN b_{r} > 1e-12 THEN least({high}::DOUBLE, greatest({low}::DOUBLE, m_{r} * (1 - m_{r}) / b_{r} - 1)) ELSE {high}::DOUBLE END AS t_{r}" for r in rules)
    rates = ", ".join(f"({r} + m_{r} * t_{r}) / (n + t_{r}) AS r_{r}" for r in rules)
    margins = ", ".join(f"{SURE}::DOUBLE * sqrt(r_{r} * (1 - r_{r}) / (n + t_{r} + 1)) AS e_{r}" for r in rules)
    condemned = " OR ".join(f"r_{r} - e_{r} > greatest(0.5::DOUBLE, {ODDS}::DOUBLE * m_{r} / (1 - m_{r} + {ODDS}::DOUBLE * m_{r}))" for r in rules)
    suspects = ", ".join(f"r_{r} - e_{r} > {SUSPECT}::DOUBLE * m_{r} AS suspect_{r}" for r in SOFT)
    soft = " OR ".join(f"({x}) AND suspect_{r}" for r, x in SOFT.items())
    return _MEASURES + f"""b AS (SELECT *, {" OR ".join(BASE.values())} AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, {sums} FROM b GROUP BY source),
p AS (SELECT sum(n) AS n, count(*) AS k, sum((n * n)::DOUBLE) / (sum(n)::DOUBLE * sum(n)) AS q, {moments} FROM h),
v AS (SELECT *, {between} FROM p),
w AS (SELECT * EXCLUDE (n), {strength} FROM v),
g AS (SELECT h.*, w.*, {rates} FROM h, w),
j AS (SELECT *, {margins} FROM g),
x AS (SELECT source, {condemned} AS condemned, {suspects} FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR condemned OR {soft}) AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""


_MEASURES = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM c),
tri AS (SELECT r, k, [word, lead(word) OVER p, lead(word, 2) OVER p] AS g, lead(word, 2) OVER p AS third FROM u WINDOW p AS (PARTITION BY r ORDER BY k)),
rep AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM tri WHERE third IS NOT NULL) WHERE c >= 2),
cov AS (SELECT r, count(DISTINCT k + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, CAST(len(c.w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(d.t) - length(translate(d.t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_lines,
             CAST(coalesce(dl.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN c USING (r) LEFT JOIN dl USING (r) LEFT JOIN cov USING (r)),
"""
OP6_SQL = _sql()
