"""Document quality by hierarchical empirical Bayes.

A classifier of single documents (words, stems and the shape of the text, scored and calibrated on labelled ones) gives each document a log
likelihood ratio of being bad: of low quality or toxic.  Sites differ, so the prior that this evidence meets is the
document's site: grouped sums give the bad share of every path (site and language) and host, and each is shrunk towards
the level above (path to host, host to the corpus) by a beta prior whose strength is fitted to the spread between
sites.  A path with few documents is thus judged by its host, a new host by the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, cut, lean, table

#: The classifier is fitted on at most so many labelled documents, drawn by the hash of their ids: features on three quarters
#: of them, the evidence of a score on the others.
FIT_ROWS = 20_000
#: A feature counts if so many distinct texts have it, its share differs between good and bad by so many standard
#: errors, and it speaks for bad at least so strongly (log ratio); the evidence of one feature is bounded.
MIN_DOCS, MIN_Z, LEAST_EVIDENCE, MOST_EVIDENCE = 6, 4.2, 2.5, 6.0
#: A text's score adds up its strongest words or stems; chance hits grow with the length, so from so many words on the
#: logarithm of the length is taken off.
STRONGEST, LONG = 3, 500
#: Scores are calibrated by class: up to each of these edges, and above the last.
EDGES = (0.0, 3.0, 6.0, 9.0, 12.0, 18.0)
#: A document is rejected when it is bad with more than this probability.
REJECT = 0.5
SYMBOLS = b"#*$%&|<>"
END_MARKS = ".,;:!?"


class Model(NamedTuple):
    weights: dict[str, float]
    #: Log likelihood ratio of bad by class of score.
    evidence: list[float]


def shape_features(data: bytes, words: list[str], distinct: int) -> list[str]:
    """Buckets of the text's shape; names begin with a space, which no word does."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    n, lines = len(words), data.split(b"\n")
    same = sum(map(eq, words, words[1:]))
    ten = lambda a, b: int(10 * a / b) if b else 0
    return [f" upper {ten(counts[65:91].sum(), letters)}", f" symbols {ten(sum(int(counts[b]) for b in SYMBOLS), n)}", f" marks {ten(int(counts[33]), n)}",
            f" pipes {ten(int(counts[124]), n)}", f" again {ten(same, n)}", f" lines {ten(len(lines) - len(set(lines)), len(lines))}",
            f" distinct {min(12, n.bit_length())} {ten(distinct, n)}", f" words {min(3, n // 5) if n < 20 else 4}"]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[str], set[str]]]:
    for i, text in enumerate(batch.column("text")):
        text = text.as_py() or ""
        words = text.lower().split()
        yield i, text.encode(), words, set(words)


def word_features(distinct: set[str]) -> set[str]:
    """Words without the marks behind them, and the stems of four and five letters that longer words begin with."""
    words = {w.rstrip(END_MARKS) for w in distinct} - {""}
    return words | {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}


def score(data: bytes, words: list[str], distinct: set[str], weights: dict[str, float]) -> float:
    """Evidence of the shape and of the strongest words or stems."""
    get = weights.get
    shape = sum(get(f, 0.0) for f in shape_features(data, words, len(distinct)))
    found = weights.keys() & word_features(distinct)
    chance = math.log(max(1.0, len(words) / LONG))
    return shape + max(0.0, sum(sorted((weights[f] for f in found), reverse=True)[:STRONGEST]) - chance)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each feature, bad and all, within a task."""
    for batch in batches:
        bad, every = Counter(), Counter()
        labels = batch.column("bad").to_pylist()
        for i, data, words, distinct in _texts(batch):
            features = word_features(distinct)
            features.update(shape_features(data, words, len(distinct)))
            every.update(features)
            if labels[i]:
                bad.update(features)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())],
                                         names=["feature", "bad", "docs"])


def _scores(weights: dict[str, float], keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if keep_text or c != "text"]
            out = [score(data, words, distinct, weights) for _, data, words, distinct in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.float64())], names=[*kept, "score"])
    return run


def _class(column: Column) -> Column:
    """0 for a score up to the first edge, and so on."""
    return sum((F.when(column > e, 1).otherwise(0) for e in EDGES), F.lit(0))


def _log_ratio(bad: int, good: int, all_bad: int, all_good: int) -> float:
    return math.log((bad + 0.5) / (all_bad + 1)) - math.log((good + 0.5) / (all_good + 1))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Weights of the features that speak for bad, and the evidence of each class of score.

    At most ``fit_rows`` labelled documents (columns doc_id and bad) are read, by a broadcast of 16 bytes each; the
    features of the model are bounded by them too, as each is in ``MIN_DOCS`` of their texts.  Equal texts count once.
    """
    sample = labels.where("bad is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    half = F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0, 1).otherwise(0)  # one quarter calibrates
    joined = docs.join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text").alias("_text")).agg(
        F.max_by(F.struct("text", half.alias("half")), "doc_id").alias("one"), F.max(F.col("bad").cast("long")).alias("bad")).select("one.text", "one.half", "bad")
    joined = cut(joined, "quality-sample")
    sizes = {r["half"]: (r["bad"], r["n"] - r["bad"]) for r in joined.groupBy("half").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2 or not all(b and g for b, g in sizes.values()):
        return Model({}, [0.0] * (len(EDGES) + 1))
    n_bad, n_good = sizes[0]
    share, n = n_bad / (n_bad + n_good), F.col("docs").cast("double")
    z = (F.col("bad") - n * share) / F.sqrt(n * share * (1 - share))
    counted = joined.where("half = 0").select("text", "bad").mapInArrow(lean(_count_features), "feature string, bad long, docs long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs"))
    weights = {}
    for row in counted.where((F.col("docs") >= MIN_DOCS) & (z >= MIN_Z)).collect():
        evidence = _log_ratio(row["bad"], row["docs"] - row["bad"], n_bad, n_good)
        if evidence >= LEAST_EVIDENCE:
            weights[row["feature"]] = min(MOST_EVIDENCE, evidence)
    other = joined.where("half = 1").select("text", "bad").mapInArrow(lean(_scores(weights)), "bad long, score double")
    by_class = {r["c"]: (r["bad"], r["n"] - r["bad"]) for r in other.groupBy(_class(F.col("score")).alias("c")).agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    evidence = [_log_ratio(*by_class.get(c, (0, 0)), *sizes[1]) if c in by_class else -math.inf for c in range(len(EDGES) + 1)]
    return Model(weights, [max(evidence[:c + 1]) if max(evidence[:c + 1]) > -math.inf else 0.0 for c in range(len(evidence))])  # a higher score is never less evidence


def _strength(groups: DataFrame, mean: Column) -> float:
    """Strength of the beta prior around ``mean`` (the level above) from the spread of the groups' rates beyond chance."""
    chance = mean * (1 - mean)
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(chance).alias("noise"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)).alias("spread"),
                     F.sum(F.col("n") * chance).alias("chance")).first()
    if not row["n"]:
        return 1.0
    between = max(0.0, row["spread"] - row["noise"]) / row["n"]
    return min(1e6, max(1.0, row["chance"] / row["n"] / max(between, 1e-9) - 1))


def _path_of(columns: list[str], of: str = "") -> Column:
    """The path of a document: the first part of its URL's path where there is a ``url`` column, else its language."""
    if "url" in columns:
        url = F.col(f"{of}url").cast("string")
        return F.when(url.isNotNull(), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^/?#]*)", 1))
    return F.col(f"{of}lang").cast("string")


def classify(docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, reject: float = REJECT, fit_rows: int = FIT_ROWS,
             model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_rate, path_rate, p_bad, kept.

    ``docs`` has doc_id, text and, unless given, source (the host) and url or lang (with the host, the path).  ``labels`` has
    doc_id, quality and toxic: a document is bad if its quality is 0 or toxic is 1; nulls in both are no label, and of
    several labels the worst counts.  A null text is empty; null hosts and paths are sites of their own; repeated rows
    count each; an empty table gives an empty result, and without labels of both kinds there is no evidence and every
    site has the same rate.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    host = F.col("source").cast("string") if host is None else host
    path = _path_of(docs.columns) if path is None else path
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.alias("host"), path.alias("path"))
    known = known_labels(labels)
    model = fit(slim, known, fit_rows) if model is None else model
    scored = cut(_evidence(slim.select("doc_id", "host", "path", "text"), model, False), "quality-evidence")
    return _judged(scored, site_rates(scored, known)).withColumn("kept", F.col("p_bad") <= reject).drop("score")


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id -> bad (1, 0 or null), the worst of several labels."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))


def _evidence(rows: DataFrame, model: Model, keep_text: bool) -> DataFrame:
    """Rows with a text -> + score and evidence."""
    kind = StructType([f for f in rows.schema.fields if keep_text or f.name != "text"]).add("score", "double")
    scored = rows.mapInArrow(lean(_scores(model.weights, keep_text)), kind)
    return scored.withColumn("evidence", F.element_at(F.array(*map(F.lit, model.evidence)), _class(F.col("score")) + 1))


def site_rates(scored: DataFrame, known: DataFrame) -> DataFrame:
    """host, path -> host_rate, path_rate: bad shares shrunk level by level.

    Every document counts for its site: by its label, or else by its own evidence.
    """
    all_known = scored.join(known, "doc_id").agg(F.sum("bad").alias("bad"), F.count("bad").alias("n")).first()
    start = ((all_known["bad"] or 0) + 1) / ((all_known["n"] or 0) + 2)
    own = 1 / (1 + F.exp(-(F.col("evidence") + math.log(start / (1 - start)))))
    paths = cut(scored.join(known, "doc_id", "left").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("bad").cast("double"), own)).alias("bad")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = F.lit((total["bad"] or 0.0) / (total["n"] or 1))
    above = _strength(hosts, mean)
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("bad") + above * mean) / (F.col("n") + above)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    within = _strength(paths, F.col("host_rate"))
    return cut(paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate",
                            ((F.col("bad") + within * F.col("host_rate")) / (F.col("n") + within)).alias("path_rate")), "quality-rates")


def _judged(scored: DataFrame, rates: DataFrame) -> DataFrame:
    prior = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("path_rate")))
    joined = scored.join(rates, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))).drop("_host", "_path")
    return joined.withColumn("p_bad", 1 / (1 + F.exp(-(F.col("evidence") + F.log(prior / (1 - prior))))))


def good_documents(docs: DataFrame, labels: DataFrame, reject: float = REJECT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` (with doc_id, text, source and url or lang) without those that ``classify`` rejects.  No text is shuffled: texts are scored where they lie."""
    bounded_batches(docs.sparkSession)
    columns, known = docs.columns, known_labels(labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).select(
        "_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").cast("string").alias("text"), F.col("_row.source").cast("string").alias("host"), _path_of(columns, "_row.").alias("path"))
    model = fit(rows.select("doc_id", "text"), known, fit_rows)
    scored = cut(_evidence(rows.select("doc_id", "host", "path", "text"), model, False), "quality-evidence")
    again = _evidence(rows.select("_row", "host", "path", "text"), model, False)
    return _judged(again, site_rates(scored, known)).where(F.col("p_bad") <= reject).select(*[F.col(f"_row.`{c}`") for c in columns])


def op2_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
