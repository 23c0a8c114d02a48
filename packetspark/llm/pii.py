"""Personal data by weak supervision.

Four kinds have fixed patterns and checks: e-mail and IP addresses, card and phone numbers.  Their matches are final.
Beside them, long runs of letters and digits, and whatever is assigned to a name of the gazetteer, are candidates for secrets
(keys, tokens, passwords).  Labelers of three kinds vote on each: patterns, a gazetteer of words before it, and its context and make-up.  Expectation-maximisation over
the table of vote patterns estimates how often each labeler is right without any labels, and the posteriors of the patterns
train the final classifier over features of the spans, which decides.

Everything about a text is a column expression of that text: matches with their places come from the pieces between
them, so no text is shuffled and no row leaves the JVM.  Only the counts of vote patterns (at most 3 to the power of the number of
labelers) and of span features (a few buckets each) are gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

#: The patterns of the base kinds.  Possessive repeats and the start at a run's first character (or where
#: the last match ended) find the same leftmost matches in linear time, on runs of any length.
_LOCAL, _DIGIT = r"[A-Za-z0-9._%+-]", "[0-9]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = rf"(?:(?<!{_DIGIT})|\G){_DIGIT}++(?:\.{_DIGIT}++)(?:\.{_DIGIT}++)(?:\.{_DIGIT}++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Words that go before a secret, looked for in so many characters.
GAZETTEER = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api", "key", "auth", "credential", "bearer", "login")
#: Candidates: what follows a gazetteer word and an assignment sign, of any length from four characters up; and runs of at
#: least fourteen characters of names, base64 or hex, with the parts that dots join to them.  Long words are among the runs;
#: they show the labelers and the classifier what is no secret.
NAME = rf"(?<![A-Za-z0-9_])[A-Za-z0-9_.-]{{0,40}}?(?i:{'|'.join(GAZETTEER)})[A-Za-z0-9_]{{0,8}}+[\"']?[ \t]{{0,2}}+[=:]{{1,2}}+[ \t]{{0,2}}+[\"']?+"
VALUE = r"[^\s\"',;<>()\[\]{}]{4,}(?<![.:])"
RUN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{14,}+(?:\.[A-Za-z0-9_+/=-]{4,}+)*+"
#: Whether a text has any: looked for behind the signs, which are few.
NAMED = rf"[=:](?<=(?i:{'|'.join(GAZETTEER)})[A-Za-z0-9_]{{0,8}}[\"']?[ \t]{{0,2}}[=:])"
BEFORE = 24
#: Steps of expectation-maximisation, and the probability from which a span is taken.
STEPS, ACCEPT = 30, 0.5
LABELERS = ("pattern", "gazetteer", "context", "mixture", "prose")
FEATURES = ("length", "digits", "capitals", "sign", "after", "named", "known")


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all leftmost matches, in code points; the pattern never matches the empty string.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(between.alias("gap"), found.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.when(x["value"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], one).alias("out")))
    return F.aggregate(pairs, empty, step, lambda a: a["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _keep_ip(x: Column) -> Column:
    plain = F.transform(F.split(x["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def _keep_card(x: Column) -> Column:
    digits = _digits(x["value"])
    return F.length(digits).between(13, 19) & _luhn(digits)


def _keep_phone(x: Column) -> Column:
    return F.length(_digits(x["value"])).between(9, 15)


def _spans(text: Column) -> dict[str, Column]:
    """Base kinds: arrays of (start, end, value).  Texts that cannot hold a kind are passed over by a plain look."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    has_digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.when(has_digit & F.contains(text, F.lit(".")), F.filter(matches(text, IP), _keep_ip)).otherwise(none),
        "card": F.when(has_digit, F.filter(matches(text, CARD), _keep_card)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), _keep_phone)).otherwise(none),
    }


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for a secret, -1 against it, 0 for no opinion."""
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0)).cast("tinyint")


def _described(text: Column) -> Column:
    """Candidates with the labelers' votes and the classifier's features."""
    def value(x: Column) -> Column:
        # the name and the sign are no part of the span
        name = F.length(F.regexp_extract(x["value"], f"^{NAME}", 0))
        return F.struct((x["start"] + name).alias("start"), x["end"].alias("end"), F.substr(x["value"], name + 1).alias("value"), (name > 0).alias("named"))

    def describe(x: Column) -> Column:
        v, n, named = x["value"], F.length(x["value"]), x["named"]
        digits, capitals = F.length(_digits(v)), F.length(F.regexp_replace(v, "[^A-Z]", ""))
        letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
        lead = F.least(F.lit(BEFORE), x["start"])
        before = F.lower(F.substr(x["near"], F.lit(1), lead))
        last = F.substr(x["near"], lead, F.lit(1))
        after = F.substr(x["near"], lead + (x["end"] - x["start"]) + 1, F.lit(1))
        sign = F.when(x["start"] == 0, 0).when(named | last.rlike(r"[=:\"'/]"), 2).otherwise(1)
        known = v.rlike("^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])[0-9a-f]{16,}+|sk-[A-Za-z0-9]{16,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\\.[A-Za-z0-9_-]{8,}+)++)$")
        votes = (
            _vote(known, ~named & ((n < 16) | (letters == 0))),
            _vote(named | reduce(lambda a, b: a | b, [F.contains(before, F.lit(w)) for w in GAZETTEER])),
            _vote(sign == 2, last.rlike(r"[.,@]")),
            _vote((digits >= 3) & (letters >= 2), ~named & (letters == 0)),
            _vote(F.lit(False), letters * 10 > n * 9),
        )
        features = (F.least(F.lit(10), F.floor(n / 4)).cast("int"), F.floor(10 * digits / n).cast("int"), F.floor(5 * capitals / n).cast("int"), sign,
                    F.when(after.rlike(r"[\"';]"), 1).otherwise(0), named.cast("int"), known.cast("int"))
        return F.struct(x["start"], x["end"], F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    def near(x: Column) -> Column:
        # the span with what is before and after it, taken from the text once
        lead = F.least(F.lit(BEFORE), x["start"])
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "value", "named")], F.substr(text, x["start"] - lead + 1, lead + (x["end"] - x["start"]) + 1).alias("near"))
    found = F.when(text.rlike(NAMED), F.transform(matches(text, f"{NAME}{VALUE}|{RUN}"), value)).otherwise(F.transform(matches(text, RUN), value))
    return F.transform(F.transform(found, near), describe)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, an array (start, end) per base kind, the described candidates outside them, and the columns to ``keep``."""
    text = text_of(F.col("_text"))
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    places = named.select("*", *[F.transform(spans, lambda x: F.struct(x["start"], x["end"])).alias(f"_{kind}") for kind, spans in _spans(text).items()], _described(text).alias("_all"))
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    return places.withColumn("_base", base).withColumn("_candidates", F.filter("_all", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))).drop("_all", "_base")


def reliabilities(patterns: dict[tuple[int, ...], int], steps: int = STEPS) -> tuple[float, dict[tuple[int, ...], float]]:
    """Prior and posterior of each vote pattern by expectation-maximisation over their counts.

    Labelers are taken as independent given the truth.  Each has a table of votes for either truth, smoothed, and starts
    as right more often than wrong.
    """
    n = sum(patterns.values())
    k = len(next(iter(patterns), ()))
    prior, table = 0.5, [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}} for _ in range(k)]
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(steps):
        for p in patterns:
            yes, no = (math.log(q) + sum(math.log(table[j][t][v]) for j, v in enumerate(p)) for t, q in ((1, prior), (0, 1 - prior)))
            posterior[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
        mass = sum(c * posterior[p] for p, c in patterns.items())
        prior = (mass + 1) / (n + 2)
        for j in range(k):
            for t in (1, 0):
                counts = {v: 1.0 for v in (1, 0, -1)}
                for p, c in patterns.items():
                    counts[p[j]] += c * (posterior[p] if t else 1 - posterior[p])
                total = sum(counts.values())
                table[j][t] = {v: x / total for v, x in counts.items()}
    return prior, posterior


def train(found: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """Log odds of a secret and the evidence of each feature's values, from the candidates' posteriors.

    What is gathered is a row per vote pattern (3 ^ 5 at most) and feature values (11 x 11 x 6 x 3 x 2 x 2 x 2), at any size.
    """
    spans = found.select(F.explode("_candidates").alias("c")).select("c.votes", "c.features")
    counts = spans.groupBy("votes", "features").count()  # both from a few values each
    rows = [(tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counts.collect()]
    patterns: dict[tuple[int, ...], int] = {}
    for votes, _, n in rows:
        patterns[votes] = patterns.get(votes, 0) + n
    prior, posterior = reliabilities(patterns)
    tables: list[dict[int, float]] = []
    for j in range(len(FEATURES)):
        yes, no = {}, {}
        for votes, features, n in rows:
            p = posterior[votes]
            yes[features[j]] = yes.get(features[j], 0.0) + n * p
            no[features[j]] = no.get(features[j], 0.0) + n * (1 - p)
        a, b = sum(yes.values()) + len(yes), sum(no.values()) + len(no)
        tables.append({v: math.log((yes[v] + 1) / a) - math.log((no[v] + 1) / b) for v in yes})
    return math.log(prior / (1 - prior)), tables


def _accepted(model: tuple[float, list[dict[int, float]]], accept: float = ACCEPT) -> Column:
    odds, tables = model

    def score(features: Column) -> Column:
        total = F.lit(odds)
        for j, weights in enumerate(tables):
            if weights:
                pairs = [x for v, w in sorted(weights.items()) for x in (F.lit(v), F.lit(w))]
                total = total + F.coalesce(F.element_at(F.create_map(*pairs), F.get(features, j)), F.lit(0.0))
        return total
    return F.filter("_candidates", lambda c: score(c["features"]) > math.log(accept / (1 - accept)))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans.

    Spans are in code points, end exclusive.  A null text is empty and has none; repeated rows are answered row by row;
    an empty table gives an empty result, and without candidates no span is added; other columns are not read.
    """
    found = cut(find(docs, id_col, text_col).drop("_text", "_kept"), "pii-spans")
    secrets = found.withColumn("_secret", _accepted(train(found)))
    base = F.concat_ws(",", F.concat(*[_named(F.col(f"_{k}"), k) for k in KINDS]))
    every = F.concat_ws(",", F.concat(*[_named(F.col(f"_{k}"), k) for k in (*KINDS, SECRET)]))
    return secrets.select(F.col("_id").alias("doc_id"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, SECRET)], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the first takes the place, at equal starts the longer.
    """
    # looked through once: the spans are written beside their documents
    written = cut(find(docs, id_col, text_col, tuple(docs.columns)).drop("_text"), "pii-candidates")
    found = written.withColumns({"_text": F.col(f"_kept.`{text_col}`").cast("string"), "_secret": _accepted(train(written))})

    def of_kind(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(kind.upper()).alias("kind")))
    spans = F.concat(*map(of_kind, (*KINDS, SECRET)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(F.col("_text"), a["at"] + 1, x["start"] - a["at"])
        return F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], gap, F.lit("["), x["kind"], F.lit("]")).alias("out"), (-x["back"]).alias("at")))
    rest = F.aggregate(F.sort_array(spans), start, step, lambda a: F.concat(a["out"], F.substr(F.col("_text"), a["at"] + 1, F.length("_text"))))
    clean = F.when(F.size(spans) == 0, F.col("_text")).otherwise(rest)
    return found.select(*[(clean if c == text_col else F.col(f"_kept.`{c}`")).alias(c) for c in docs.columns])


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
