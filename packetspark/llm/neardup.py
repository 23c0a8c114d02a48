"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct 4-word shingles.  Instead of hashing each of L tables with its own minhashes, a few
small collections of minhashes are drawn once and a table's key joins the keys of two collections: with m collections
there are m(m-1)/2 tables for the work of m, so the number of minhash evaluations falls to about a square root.  Two
documents meet when they agree in two collections or more.

Equal sets are one node from the start, so exact copies cost nothing further.  A collection key that only one node has
cannot be part of a shared table key; such keys go before the pairs are formed.  In a bucket every node is first compared
with one centre, on full sets, and links make components: a group of near copies, however large, is settled by as many comparisons as it has members.
Buckets whose nodes are then in one component need nothing more.  In the others, nodes of different components are
compared pair by pair, a block of rows at a time inside a task, by the smallest hashes of their sets; only pairs that these
leave possible become rows and are compared on full sets.  For sets that are no larger than that sketch it is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, cut, lean, table, words_of
from .components import components

#: Fixed values of the registered query: words in a shingle and the least similarity in per cent.
SHINGLE, SIMILARITY = 4, 80
#: Collections and minhashes in each: at similarity 0.8 two documents miss each other in all tables with probability 5e-5.
COLLECTIONS, HASHES = 18, 3
#: Members that are compared with one copy of a centre's set; a centre with more is copied.
MEMBERS = 2_000
#: Rows of a bucket that are compared with each other in one task; larger buckets are cut into pairs of blocks.
BLOCK = 512
#: Smallest shingle hashes that stand for a set, and the standard deviations that an estimate from them may fall below
#: the least similarity (passed over: 3 in 100,000 at that similarity).
SKETCH = 512
DEVIATIONS = 4.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(words: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of word hashes; fewer than ``k`` words make one shingle, none make none."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    weight = _odd(7, k + 1)
    n = len(flat)
    if n >= k:
        rolled = sum(flat[i:n - k + 1 + i] * weight[i] for i in range(k))
        rolled = _finish(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64) * weight[k] + sum(flat[a + i:a + i + 1] * weight[i] for i in range(b - a))
            out.append(_finish(short + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def collection_keys(sets: list[np.ndarray], collections: int = COLLECTIONS, hashes: int = HASHES) -> np.ndarray:
    """(sets, collections) keys; every set has an element."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    factors, mix = _odd(11, collections * hashes), _odd(13, hashes)
    keys = np.empty((len(sets), collections), np.uint64)
    for c in range(collections):
        key = np.full(len(sets), np.uint64(c + 1))
        for h in range(hashes):
            least = np.minimum.reduceat(flat * factors[c * hashes + h], starts)
            key = _finish(key * mix[h] + least)
        keys[:, c] = key
    return keys


def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))


def _set_key(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def _sketch(shingle: int, collections: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("words"), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, key in zip(full, collection_keys([sets[i] for i in full], collections, hashes)):
                        keys[i] = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_set_key(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "keys"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("words"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()),
                                                  pa.array([(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())], names=["node", "set_key", "elements", "sketch"])
    return run


def _compare(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for c, node, data in zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist(), batch.column("elements")):
                elements = np.frombuffer(data.as_buffer(), np.uint64)
                if node is None:  # the centre's own row comes before its members
                    centre, own = c, elements
                    continue
                if c != centre:
                    raise ValueError("a member came before its centre")
                at = np.searchsorted(own, elements)
                both = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == elements))
                if 100 * both >= similarity * (len(own) + len(elements) - both):
                    a.append(c)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def possible(sketches: list[np.ndarray], sizes: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Matrix of the pairs of sets that may be similar: exact where both sketches are whole sets, else an estimate with room below.

    Up to the smaller of two sketches' largest elements both are complete; the share of common elements there estimates
    the similarity.
    """
    n, lengths = len(sketches), np.array([len(x) for x in sketches])
    values, rows = np.concatenate(sketches), np.repeat(np.arange(n), lengths)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    twice = np.cumsum(count > 1) - 1  # elements of one set alone are in no intersection
    rows, column = rows[count[column] > 1], twice[column[count[column] > 1]]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        here = (column >= at) & (column < at + 4096)
        incidence = np.zeros((n, 4096), np.float32)
        incidence[rows[here], column[here] - at] = 1
        both += incidence @ incidence.T
    whole = sizes <= lengths
    top = np.where(whole, np.uint64(1) << np.uint64(32), np.array([x[-1] for x in sketches], np.uint64))
    upto = np.stack([np.searchsorted(x, top, "right") for x in sketches]) if not whole.all() else np.repeat(lengths[:, None], n, 1)
    own = np.minimum(lengths[:, None], upto)  # [i, j]: elements of i up to j's largest
    union = own + own.T - both
    share = similarity / 100
    exact = whole[:, None] & whole[None, :]
    least = np.where(exact, share * union - 1e-3, share * union - DEVIATIONS * np.sqrt(share * (1 - share) * union))
    return both >= least


def _agreeing(similarity: int):
    """Rows of one cell of a bucket side by side -> pairs of different labels that may be similar."""
    def pairs(rows: pa.Table) -> tuple[list, list]:
        node, label, size, side = (rows.column(c).to_numpy() for c in ("node", "label", "size", "block"))
        may = label[:, None] != label[None, :]
        if rows.column("low")[0].as_py() != rows.column("high")[0].as_py():  # within a block is another cell's work
            may &= side[:, None] != side[None, :]
        if not may.any():
            return [], []
        may &= possible([np.frombuffer(x, "<u4") for x in rows.column("sketch").to_pylist()], size, similarity)
        a, b = np.nonzero(np.triu(may, 1))
        return np.minimum(node[a], node[b]).tolist(), np.maximum(node[a], node[b]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            cell = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
            turns = np.flatnonzero((cell[0][1:] != cell[0][:-1]) | (cell[1][1:] != cell[1][:-1]) | (cell[2][1:] != cell[2][:-1])) + 1
            for start, end in zip([0, *turns.tolist()], turns.tolist()):
                yield out(*pairs(rows.slice(start, end - start)))
            held = rows.slice(int(turns[-1]) if len(turns) else 0).to_batches()  # its cell may go on
        if held:
            yield out(*pairs(pa.Table.from_batches(held)))

    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["centre", "node"])
    return run


def agreeing(rows: DataFrame, similarity: int) -> DataFrame:
    """Open rows (bucket, node, label, size, sketch) -> distinct pairs (centre, node) that may be similar.

    A bucket of more than ``BLOCK`` rows is cut into blocks, and each pair of blocks is a cell of its own.
    """
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "size", "sketch")
    ordered = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return ordered.mapInArrow(lean(_agreeing(similarity)), "centre long, node long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(centre, node) pairs -> edges (a, b) whose full sets are similar enough.

    Members travel to their centres.  A centre's set is repeated once per ``MEMBERS`` members, and the rows of a
    (centre, share) are streamed with the centre first, so no task holds more than one set beside the row it reads.
    """
    shares = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("shares"))
    heads = shares.join(sets.select("node", "elements"), F.col("centre") == F.col("node")).select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("node"), "elements")
    members = pairs.join(shares, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node").join(sets.select("node", "elements"), "node").select(
        "centre", "share", "node", "elements")
    rows = heads.unionByName(members).repartition("centre", "share").sortWithinPartitions("centre", "share", F.col("node").asc_nulls_first())
    return rows.select("centre", "node", "elements").mapInArrow(lean(_compare(similarity)), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY,
                    collections: int = COLLECTIONS, hashes: int = HASHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    A null or empty text, or one without words, has no shingles and is linked with nothing.  Rows with equal ids are one
    document, whatever their texts.  A null id is linked with nothing, has a null component and is kept.  Copies are one
    node; equal links repeat nothing.  An empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    ided = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = cut(ided.select("doc_id", _word_hashes(F.col("text")).alias("words")).mapInArrow(
        lean(_sketch(shingle, collections, hashes)), "doc_id long, n_shingles long, set_key binary, keys array<long>"), "near-sketches")
    # a node is a distinct set; its number is a hash of it, its documents come back by it in the end
    named = sketched.where("doc_id is not null and set_key is not null").withColumn("node", F.xxhash64("set_key"))
    nodes = cut(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size")), "near-nodes")
    # the collection keys that two nodes share
    keyed = named.join(nodes, "node").where(F.col("doc_id") == F.col("least")).select("node", "size", F.explode("keys").alias("key")).distinct()
    keyed = cut(keyed, "near-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    lists = keyed.join(shared, "key").groupBy("node").agg(F.max("size").alias("size"), F.sort_array(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1)
    pairs_of = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice(F.col("keys"), i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    tables = lists.select("node", "size", F.explode(pairs_of).alias("bucket"))
    tables = cut(tables, "near-tables")
    full = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    open_rows = cut(tables.join(full, "bucket"), "near-buckets")
    meeting = open_rows.select("node").distinct()
    # one text of each set that meets another: that of its least document (rows of one id may have other texts, so by set too)
    wanted = meeting.join(nodes, "node").select("node", F.col("least").alias("_id"))
    texts = ided.join(wanted, F.col("doc_id") == F.col("_id")).select("node", _word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    sets = texts.mapInArrow(lean(_sets(shingle)), "node long, set_key binary, elements binary, sketch binary").where(F.xxhash64("set_key") == F.col("node"))
    sets = cut(sets.drop("set_key").dropDuplicates(["node"]), "near-sets")
    # first every node with its bucket's centre
    centres = open_rows.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("c"))
    near = 100 * F.least("size", "c.size") >= similarity * F.greatest("size", "c.size")
    pairs = open_rows.join(centres, "bucket").where((F.col("node") != F.col("c.node")) & near).select(F.col("c.node").alias("centre"), "node").distinct()
    edges = cut(verified(cut(pairs, "near-pairs"), sets, similarity), "near-edges")
    labels = components(edges)
    # then what that left in different components
    rest = open_rows.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("label"))
    rest = cut(rest, "near-labels")
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rest = rest.join(mixed, "bucket").join(sets.select("node", "sketch"), "node")
    more = cut(verified(cut(agreeing(rest, similarity), "near-pairs"), sets, similarity), "near-edges")
    # the sets of one id are one document, and a component has the smallest id of its documents
    ids = cut(named.select("doc_id", "node").distinct(), "near-ids")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    same = several.join(ids, "doc_id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    labels = components(edges.unionByName(more).unionByName(same))
    of = ids.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("c"))
    least = of.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    found = of.join(least, "c").select(F.col("doc_id").alias("_id"), "component_id")
    joined = sketched.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, *, shingle: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` (with doc_id and text) with one document of each near-duplicate group: that with the smallest id.

    Of rows with equal ids one stays, that with the smallest hash of its text; rows without an id stay.
    """
    kept = near_duplicates(docs, shingle=shingle, similarity=similarity).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    chosen = docs.join(kept, F.col("doc_id") == F.col("_id"), "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min_by(F.struct(*columns), F.xxhash64("text")).alias("_row")).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
    return chosen.unionByName(docs.where("doc_id is null"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
