"""Quality rules with host-level verdicts.

Each document is measured by column expressions alone (no shuffle, no Python).  Failures of each rule are then summed
by host; a beta prior fitted to all hosts by moments shrinks a host's failure rate towards the common one, so that a
host with few documents is judged by the corpus rather than by chance; and the verdict on the host is joined back to its
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, cut, table, text_of, words_of

#: Words in the windows that are compared inside a text.
WINDOW = 5
#: A document with fewer words fails.
MIN_WORDS = 10
#: A document with a larger part (per cent) of its words in repeated windows fails.
MAX_REPEAT_PERCENT = 20
#: Further rules, counted for hosts only: symbols per 100 characters of words, duplicate lines per 100 lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines")
#: A host is rejected when its shrunk failure rate of any rule is beyond so many deviations of the rates of hosts (the prior's)
#: and so many times their mean, or above one half.
DEVIATIONS, TIMES, MAX_HOST_RATE = 4.0, 2.0, 0.5
#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 1e6)


def _windows() -> Column:
    """Hashes of the 5-word windows of ``words``, by start."""
    n = F.size("words")
    at = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(-1, WINDOW - 1)]))
    return F.when(n >= WINDOW, at).otherwise(F.array().cast("array<bigint>"))


def _covered(sorted_windows: Column) -> Column:
    """Words that lie in a window found twice or more, from (hash, start) in order."""
    def starts(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, zero, lambda a, i: F.struct((a["n"] + (i + WINDOW - F.greatest(i, a["end"]))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    # the one-element arrays bind the sorted array to a name, so that it is made once a row and not once an element
    return F.get(F.transform(F.transform(F.array(sorted_windows), starts), total), 0)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(F.col(text_col)).alias("text"))
    with_words = text.select("doc_id", "host", words_of(F.col("text")).alias("words"),
                             F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
                             (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                             F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"))
    hashed = with_words.select("doc_id", "host", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), _windows().alias("windows"),
                               F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return hashed.withColumn("n_repeat_words", F.when(twice, _covered(pairs)).otherwise(F.lit(0)).cast("long")).drop("windows")


def failures(measured: DataFrame) -> DataFrame:
    """Adds a boolean per rule and ``base_failed``."""
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return measured.select("*", short.alias("short"), repeats.alias("repeats"), (short | repeats).alias("base_failed"),
                           (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")).alias("symbols"),
                           (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")).alias("dup_lines"))


def host_rates(failed: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host -> documents and, per rule, failures, the shrunk rate and the limit that it is held against.

    The prior of a rule has the mean rate m of all documents and the strength s = m(1-m)/v - 1, where v is the variance
    between hosts beyond what chance gives (document-weighted moments).  No variance beyond chance means that hosts are
    alike: the strength is then large and every rate is close to m.  The limit is m and ``DEVIATIONS`` of the prior's standard
    deviations, ``TIMES`` m at least and ``max_rate`` at most.
    """
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    hosts = cut(hosts, "rules-hosts")
    n = F.col("docs")
    # one row of sums; the rest is arithmetic on them
    one = hosts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * n).alias("nn"), *[F.sum(r).alias(r) for r in RULES],
                    *[F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_squares") for r in RULES]).first()
    total = one["n"] or 1
    rates = []
    for r in RULES:
        mean = (one[r] or 0) / total
        chance = mean * (1 - mean)
        spread = (one[f"{r}_squares"] or 0.0) - total * mean * mean
        between = max(0.0, spread - (one["k"] - 1) * chance) / max(1.0, total - (one["nn"] or 0) / total)
        strength = min(STRENGTH[1], max(STRENGTH[0], chance / max(between, 1e-9) - 1))
        limit = min(max_rate, max(TIMES * mean, mean + DEVIATIONS * (chance / (strength + 1)) ** 0.5))
        rates.append(F.lit(float(limit)).alias(f"{r}_limit"))
        rates.append(((F.col(r) + F.lit(strength * mean)) / (n + F.lit(strength))).alias(f"{r}_rate"))
    return hosts.select("host", "docs", *RULES, *rates)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document with its measures, ``base_failed``, the host's highest shrunk rate, whether the host fails, and ``kept``.

    A null text has no words and fails as too short.  A null host is a host of its own.  Repeated rows are judged row by
    row; an empty table gives an empty result; other columns are not read.
    """
    failed = cut(failures(measure(docs, id_col, text_col, host_col)), "rules-docs")
    above = F.lit(False)
    for r in RULES:
        above = above | (F.col(f"{r}_rate") > F.col(f"{r}_limit"))
    rates = host_rates(failed, max_rate).select(F.col("host").alias("_host"), F.greatest(*[f"{r}_rate" for r in RULES]).alias("host_rate"), above.alias("host_failed"))
    rates = cut(rates, "rules-rates")
    joined = failed.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_failed",
                         (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "host_rate", "host_failed")
