"""Repeated word windows found on the compacted de Bruijn graph of a corpus.

Every window of ``K`` words is an edge between two nodes of K - 1 words.  Runs of consecutive edges that share a minimizer
(the least hash of ``GRAIN`` words inside the window) travel as one: equal text cuts into equal runs wherever it occurs, but
for the ends of what is equal.

1. Minimizers that occur once belong to edges that occur once.  A bitmap of fixed size drops those before any shuffle.
2. Equal runs are counted, with their first place (the source), what follows and what precedes them.  A minimizer with one
   run does not branch.  Runs of minimizers that branch are opened, and their edges compared one by one.
3. Neighbouring runs that do not branch, each always followed and preceded by the other, lie on a nonbranching path.  All of
   a path occurs wherever its first run does, so it is compacted along its source and judged once, by that run.
4. The places where a path's first run or an opened edge occurs in a later document are joined to the texts by document.

Words, edges and runs are equal where their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_shared, table, write_shared

#: Words of a window, words of a minimizer.
K, GRAIN = 13, 7
#: Bytes of text that are cut into words at once, words whose windows are hashed at once.
BYTES, WORDS = 1 << 19, 1 << 17
#: Bits of the bitmaps that go to all tasks.
BITS = 1 << 27
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOW = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, WORDS + 64), _powers(pow(_BASE, -1, 1 << 64), WORDS + 64)
#: Powers for places in a word, by the low and the high part of the place.
_NEAR, _FAR = _powers(_BASE, 1 << 12), _powers(pow(_BASE, 1 << 12, 1 << 64), 1 << 20)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word, texts side by side."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, sizes = edge[::2], np.diff(edge)[::2]
    inside = np.flatnonzero(~white)
    place = inside - np.repeat(starts, sizes)
    value = _TABLE[data[inside]] * _NEAR[place & 4095]
    if int(sizes.max()) > 4096:
        value = value * _FAR[(place >> 12) & ((1 << 20) - 1)]
    first = np.cumsum(sizes) - sizes
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _mix(np.add.reduceat(value, first) + sizes.astype(np.uint64)), np.searchsorted(ends, starts, side="right")


class Runs(NamedTuple):
    """Runs of edges with one minimizer: text, first window there, number of windows, hashes; and hashes of all edges."""
    text: np.ndarray
    at: np.ndarray
    n: np.ndarray
    core: np.ndarray
    run: np.ndarray
    follows: np.ndarray      # hash of the next run of the text, 0 for none
    precedes: np.ndarray
    edge_of: np.ndarray      # first edge of each run in ``edges``
    edges: np.ndarray


def runs_of(texts: list[bytes]) -> Iterator[Runs]:
    words, text = word_hashes(texts)
    counts = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    for low in range(0, max(1, len(words) - K + 1), WORDS):
        w, t = words[low:low + WORDS + K - 1], text[low:low + WORDS + K - 1]
        if len(w) < K:
            return
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * _UP[:len(w)], out=sums[1:])
        i = np.arange(len(w) - GRAIN + 1)
        grain = _mix((sums[i + GRAIN] - sums[i]) * _DOWN[i])
        least = grain >> np.uint64(24) << np.uint64(24) | (_LOW - i.astype(np.uint64))  # of equal ones the last
        wide, span = 1, K - GRAIN + 1
        while 2 * wide <= span:
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        if span > wide:
            least = np.minimum(least[:len(least) - (span - wide)], least[span - wide:])
        i = np.arange(len(w) - K + 1)
        edges = _mix((sums[i + K] - sums[i]) * _DOWN[i] + np.uint64(1))
        there = t[:len(i)] == t[K - 1:]
        at = (_LOW - (least & _LOW)).astype(np.int64)
        v = np.flatnonzero(there)
        if not len(v):
            continue
        new = np.concatenate([[True], (v[1:] != v[:-1] + 1) | (at[v[1:]] != at[v[:-1]])])
        first = v[new]
        n = np.diff(np.append(np.flatnonzero(new), len(v)))
        end = first + n - 1 + K
        core = grain[at[first]]
        run = _mix((sums[end] - sums[first]) * _DOWN[first] + (at[first] - first).astype(np.uint64) * np.uint64(_BASE) + n.astype(np.uint64)) | np.uint64(1)
        joined = first[1:] == first[:-1] + n[:-1]
        follows, precedes = np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
        follows[:-1][joined], precedes[1:][joined] = run[1:][joined], run[:-1][joined]
        yield Runs(t[first], first + low - begin[t[first]], n, core, run, follows, precedes, first, edges)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Runs]]:
    """Runs of the rows, some MB of text at a time; the batch holds the rows that ``Runs.text`` counts."""
    for batch in batches:
        group = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            for runs in runs_of(part.column("text").to_pylist()):
                yield part, runs
        pa.default_memory_pool().release_unused()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """30 bits of each run's minimizer, and whether a group of texts has it twice."""
    for _, runs in _groups(batches):
        bits, n = np.unique((runs.core >> np.uint64(34)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(np.minimum(n, 2).astype(np.int8))], names=["x", "n"])


def _in(bits: np.ndarray, core: np.ndarray) -> np.ndarray:
    x = (core >> np.uint64(34)).astype(np.int64) & (BITS - 1)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(numbers: DataFrame) -> np.ndarray:
    """Bitmap of non-negative numbers below ``BITS``; its size is fixed."""
    x = F.col(numbers.columns[0]) + 1
    bits = np.zeros(BITS // 8, np.uint8)
    for row in numbers.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        bits[(row["bucket"] - 1) * len(part):row["bucket"] * len(part)] = part
    return bits


def _number(core: str) -> Column:
    """The bits of a minimizer's hash that bitmaps hold."""
    return F.shiftrightunsigned(core, 34).bitwiseAND(BITS - 1)


def _likely(shared):
    """Runs whose minimizer may occur twice."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for rows, r in _groups(batches):
            ok = np.flatnonzero(_in(bits, r.core))
            doc, key = rows.column("doc").to_numpy(), rows.column("key").to_numpy()
            t = r.text[ok]
            yield pa.RecordBatch.from_arrays(
                [_signed(r.core[ok]), _signed(r.run[ok]), pa.array(doc[t]), pa.array(key[t]), pa.array(r.at[ok], pa.int32()), pa.array(r.n[ok], pa.int32()), _signed(r.follows[ok]), _signed(r.precedes[ok])],
                names=["core", "run", "doc", "key", "at", "n", "follows", "precedes"])
    return go


def _places(heads, branching):
    """Where paths begin, and the edges of runs that branch (with run 0)."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, r in _groups(batches):
            doc, key = rows.column("doc").to_numpy(), rows.column("key").to_numpy()
            head, opened = np.flatnonzero(_in(heads.value, r.run)), np.flatnonzero(_in(branching.value, r.core))
            n = r.n[opened]
            one = np.repeat(opened, n)
            step = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            t, at = np.concatenate([r.text[head], r.text[one]]), np.concatenate([r.at[head], r.at[one] + step])
            hashes = np.concatenate([r.run[head], r.edges[r.edge_of[one] + step]])
            kind = np.concatenate([np.ones(len(head), bool), np.zeros(len(one), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), _signed(hashes), pa.array(doc[t]), pa.array(key[t]), pa.array(at, pa.int32())], names=["path", "hash", "doc", "key", "at"])
    return go


def paths(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compacted nonbranching paths (core, run, doc, key, at, n, occurrences) by their first run, and cores that branch.

    ``doc``, ``key`` and ``at`` are the source: the path's first place in the least document that has it.
    """
    runs = cut(found.groupBy("core", "run").agg(
        F.min(F.struct("doc", "key", "at")).alias("source"), F.max("n").alias("n"), F.count(F.lit(1)).alias("occurrences"),
        F.min("follows").alias("f"), F.max("follows").alias("f2"), F.min("precedes").alias("p"), F.max("precedes").alias("p2")), "debruijn-runs")
    kinds = runs.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
    branching = cut(kinds.where("kinds > 1").select("core"), "debruijn-branching")
    alone = runs.where("occurrences > 1").join(branching, "core", "left_anti").select(
        "core", "run", "source.*", "n", "occurrences", F.when(F.col("f") == F.col("f2"), F.col("f")).otherwise(0).alias("f"), F.when(F.col("p") == F.col("p2"), F.col("p")).otherwise(0).alias("p"))
    along = Window.partitionBy("doc", "key").orderBy("at")
    before = {c: F.lag(c).over(along) for c in ("run", "f", "at", "n")}
    # the run before goes on only here, this one comes only from there, and both lie side by side in the source
    goes_on = (before["f"] == F.col("run")) & (F.col("p") == before["run"]) & (before["at"] + before["n"] == F.col("at"))
    marked = alone.withColumn("head", ~F.coalesce(goes_on, F.lit(False)))
    marked = marked.withColumn("path", F.sum(F.col("head").cast("int")).over(along))
    return (marked.groupBy("doc", "key", "path").agg(F.min_by(F.struct("core", "run"), "at").alias("first"), F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min("occurrences").alias("occurrences"))
            .select("first.*", "doc", "key", "at", "n", "occurrences"), branching)


def _key(doc: Column, text: Column) -> Column:
    """Rows alike in id and text are one: they lose the same words."""
    return F.xxhash64(doc, text)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, at, n): runs of n windows from window ``at`` of a document that also start in a document of a smaller id."""
    spark = docs.sparkSession
    bounded_batches(spark, 8 << 20)
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), _key(doc, text).alias("key"), text.cast("binary").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= 2 * K - 1))
    share = spark.sparkContext.broadcast
    seen = rows.select("text").mapInArrow(_cores, "x int, n byte").groupBy("x").agg(F.sum("n").alias("n")).where("n > 1")
    likely = share(bitmap(seen.select((F.col("x").cast("long") % BITS).alias("x"))))
    found = rows.mapInArrow(_likely(likely), "core long, run long, doc long, key long, at int, n int, follows long, precedes long")
    path, branching = paths(found)
    path = cut(path, "debruijn-paths")
    # a run that starts no path has no place to look for; bitmaps keep most others from being written
    heads, opened = share(bitmap(path.select(_number("run")))), share(bitmap(branching.select(_number("core"))))
    held = write_shared(rows.mapInArrow(_places(heads, opened), "path boolean, hash long, doc long, key long, at int"), "debruijn-places")
    places = spark.read.parquet(held)
    whole = places.where("path").join(path.select(F.col("run").alias("hash"), F.col("doc").alias("source"), "n"), "hash").where("doc > source").select("key", "at", "n")
    edges = places.where("not path")
    least = edges.groupBy("hash").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("last > source").drop("last")
    single = edges.join(least, "hash").where("doc > source").select("key", "at", F.lit(1).alias("n"))
    out = cut(whole.unionByName(single).distinct(), "debruijn-spans")
    drop_shared(spark, held)
    return out


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _kept(doc: int | None, text: bytes, asked: list, texts: bool) -> tuple:
    words = text.split()  # bytes: white space is exactly that of the contract
    gone = 0
    if asked:
        steps = np.zeros(len(words) + 1, np.int64)
        at, n = np.array([a["at"] for a in asked]), np.array([a["n"] for a in asked])
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n + K - 1, -1)
        covered = np.cumsum(steps[:-1]) > 0
        gone = int(covered.sum())
        kept = b" ".join(w for w, g in zip(words, covered.tolist()) if not g)
    else:
        kept = b" ".join(words)
    return doc, len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in found], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _touched(shared, batch: pa.RecordBatch) -> np.ndarray:
    return _in(shared.value, batch.column("key").to_numpy().view(np.uint64))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless ``texts``).

    A null text is empty.  A null id is smaller or greater than none: such a document keeps its words, and none loses words
    for it.  Documents of one id are no copies of each other, whatever their texts; repeated rows are returned each.  An
    empty table gives an empty result; other columns are not read.
    """
    found = spans(docs, id_col, text_col)
    per = found.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans"))  # bounded by the document's words
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), _key(doc, text).alias("key"), text.cast("binary").alias("text"))
    keys = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(_number("key")).distinct()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = batch.filter(pa.array(~_touched(keys, batch)))
            yield _rows([_kept(d, t, [], texts) for d, t in zip(clean.column("doc").to_pylist(), clean.column("text").to_pylist())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_touched(keys, batch)))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([_kept(d, t, s, texts) for d, t, s in zip(*[batch.column(c).to_pylist() for c in ("doc", "text", "spans")])])
    # texts that lost no words stay where they are; only the others are joined
    lost = rows.mapInArrow(dealt, "doc long, key long, text binary").join(per, "key", "left").select("doc", "text", "spans")
    return rows.mapInArrow(whole, KEPT).unionByName(lost.mapInArrow(cut_up, KEPT))


def op12_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
