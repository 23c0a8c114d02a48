"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies.  Its whole part is certain; for the fraction the document takes
part in a Pareto sample: a uniform draw ``u`` that depends on the document alone gives the order variable
``u/(1-u) * (1-p)/p`` with inclusion probability ``p``, and the documents with the smallest values are taken.  The
sample has a fixed size in words: the cut lies where the running number of words comes nearest to what the source's
target leaves beside the certain copies, so a source misses its target by half a document at most.

Expected copies within a source are proportional to a document's length class (longer documents get larger odds), at
most ``cap``, and scaled so that they sum to the target.  A size's class is its number of binary digits, so a
source has at most 64 of them and their share is solved on a small grouped table.

The order of a source is never sorted in one task.  The order variable is cut into ``BUCKETS`` monotone buckets; sums by
(source, bucket) give the running words at each bucket's edge, and only the one bucket per source in which the target
lies is sorted row by row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unit_draw, words_of

#: Buckets of the order variable in each source.
BUCKETS = 4096
SEED = 20240229
#: Weights by the rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: The mix takes this share of all words.
SHARE = 1.5
#: No document is taken more often.
CAP = 2


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> + target: weighted shares of ``share`` x all words, at most ``cap`` x the source's size.

    The excess of capped sources is shared out again by weight until none is above.  That is a water level: sources in
    ascending order of cap/weight are full one after the other, and the level of those left is what remains divided
    by their weights.  Names are ranked by code point, null last.  The table has a row per source; it is the only one
    ordered as a whole.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (sources.withColumn("rank", F.row_number().over(names)).withColumn("weight", pick)
              .withColumn("full", (F.col("source_size") * cap).cast("long"))
              .withColumn("ratio", F.col("full") / F.col("weight")))
    order = Window.orderBy("ratio", "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
              .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.col("rest")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    return levels.withColumn("water", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("full").cast("double"), F.col("water") * F.col("weight")), F.col("full").cast("double")).alias("target"))


def _class_rates(classes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source, class, words) -> (source, class, copies, target): expected copies min(cap, c * class) with words summing to the target."""
    c = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "t.target")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    before, whole = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    full = F.coalesce(F.sum("words").over(before), F.lit(0)) * cap
    mass = F.col("words") * F.col("class")
    rest = F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(before), F.lit(0))
    scaled = c.withColumn("scale", F.when(rest > 0, (F.col("target") - full) / rest))
    # longest classes are full first; the scale counts from the first class that it leaves below the cap
    fits = F.max(F.when(F.col("scale") * F.col("class") < cap, F.struct("class", "scale"))).over(whole)["scale"]
    return scaled.withColumn("fits", fits).select(
        "source", "class", "target", F.when(F.col("fits").isNull(), F.lit(float(cap))).otherwise(
            F.least(F.lit(float(cap)), F.greatest(F.col("fits"), F.lit(0.0)) * F.col("class"))).alias("copies"))


class Plan(NamedTuple):
    """What decides over documents: a row per (source, class) with the expected copies, and a row per source with the cut."""
    rates: DataFrame
    cuts: DataFrame


def _class() -> Column:
    return F.length(F.bin("size"))


def _drawn(sized: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id, source and size -> + certain copies, the order variable q of the rest and its bucket."""
    r = rates.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "copies")
    part = F.col("copies") - F.col("certain")
    q = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("p")) / F.col("p")
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS)).cast("int")
    return (sized.join(r, F.col("source").eqNullSafe(F.col("_source")) & (_class() == F.col("_class"))).drop("_source", "_class")
            .withColumn("certain", F.floor("copies").cast("long")).withColumn("p", F.when(part > 1e-12, part)).drop("copies")
            .withColumn("_u", F.when(F.col("p").isNotNull(), unit_draw(seed, F.col("doc_id"), F.col("size")))).withColumn("q", q)
            .withColumn("bucket", F.when(F.col("p").isNotNull(), bucket)).drop("_u"))


def plan(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> Plan:
    """From (doc_id, source, size) of all documents, a written table that is read a few times."""
    classes = cut(slim.groupBy("source", _class().alias("class")).agg(F.sum("size").alias("words")), "mix-classes")
    targets = cut(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), "mix-targets")
    rates = cut(_class_rates(classes, targets, cap), "mix-rates")
    drawn = _drawn(slim, rates, seed)
    buckets = drawn.groupBy("source", "bucket").agg(F.sum(F.when(F.col("p").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("size") * F.col("certain")).alias("whole"))
    t = targets.select(F.col("source").alias("_source"), "target")
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (buckets.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("left", F.col("target") - F.sum("whole").over(Window.partitionBy("source")))
             .where("bucket is not null").withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))))
    # the last bucket that begins before the words left run out: those below are taken whole, those above not at all
    last = cut(edges.groupBy("source").agg(F.max(F.when(F.col("before") < F.col("left"), F.struct("bucket", "before", "left"))).alias("e")).where("e is not null").select(
        F.col("source").alias("_source"), F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"), F.col("e.left").alias("left")), "mix-edges")
    inside = drawn.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("edge")))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("left")
    final = inside.withColumn("taken", taken).where("taken").groupBy("source").agg(F.max(F.struct("q", "doc_id", "size")).alias("last")).withColumnRenamed("source", "_inner")
    cuts = targets.join(last.drop("before", "left"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").join(
        final, F.col("source").eqNullSafe(F.col("_inner")), "left").drop("_inner")
    return Plan(rates, cut(cuts, "mix-cuts"))


def draw(sized: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """Rows with doc_id, source and size, and any other columns -> + source_size, target, copies.  Nothing is shuffled but the plan."""
    c = plan.cuts.select(F.col("source").alias("_source"), "source_size", "target", "edge", "last")
    here = F.struct("q", "doc_id", "size") <= F.col("last")
    extra = F.coalesce((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & here), F.lit(False)).cast("long")
    return _drawn(sized, plan.rates, seed).join(c, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", F.col("certain") + extra).drop(
        "_source", "certain", "p", "q", "bucket", "edge", "last")


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       (F.size(words_of(F.col(text_col))).cast("long") if size is None else size.cast("long")).alias("size"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, cap: int = CAP, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size``: words of the text unless another size is given; a null text has 0 words, and a document without words
    takes 0 words whatever its copies.  A null source is a source of its own, last by name.  Repeated rows are separate
    documents; rows alike in id, size and source are taken alike, which moves the cut by no more than their words.  An empty
    table gives an empty result; other columns are not read.  Reruns agree: draws depend on ids and sizes alone.
    """
    slim = cut(sizes_of(docs, id_col, text_col, source_col, size), "mix-sizes")
    return draw(slim, plan(slim, weights, share, cap, seed), seed).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (with doc_id, text and source) with every row as often as the mix takes it.  No text is shuffled."""
    columns = docs.columns
    slim = cut(sizes_of(docs), "mix-sizes")
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")).select(
        "_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.source").cast("string").alias("source"), F.size(words_of(F.col("_row.text"))).cast("long").alias("size"))
    taken = draw(one, plan(slim, seed=seed), seed).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"_row.`{c}`") for c in columns])


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
