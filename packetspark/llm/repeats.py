"""Repeated passages: every byte covered by a 200-byte string that also starts somewhere else.

Sorting all suffixes of a corpus moves many times its size, so only a sample of them takes part, chosen by content as
induced sorting chooses its own: a position is sampled if the hash of the 16 bytes there is the least around it.  Whatever
200 bytes one looks at, the same place in their middle part is sampled in every copy, with 50 bytes or more on both
sides.  What holds for the sampled suffixes is then carried over to the positions around them.

1. Samples whose surroundings (the core) occur once are dropped; a bitmap of fixed size does that before any shuffle.
2. Samples are grouped by core and by the whole context that the windows belonging to them can reach.  Where a context
   occurs twice, all of it is repeated.
3. The others with a shared core are sorted by it on disk, and the windows of a core, 85 for each context, are compared
   through rolling hashes, a run of cores at a time.  A core with very many contexts has its windows grouped as rows.
4. What is covered is joined to the texts, which move once, and only those with a finding.

Equality of strings is that of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

#: Fixed value: bytes of a string that may not repeat.
LENGTH = 200
#: Bytes of a sample, least bytes of a window on either side of its sample's start and end, places a sample is chosen from.
GRAIN, SIDE = 16, 50
RANGE = LENGTH - 2 * SIDE - GRAIN + 1
#: Farthest that windows reach before and after their sample.
BEFORE, AFTER = LENGTH - SIDE - GRAIN, LENGTH - SIDE
#: Bytes of text that are hashed at once; longer texts are cut into such segments.
SEGMENT = 1 << 20
#: Bits of the bitmaps that go to all tasks.
BITS = 1 << 27
#: Contexts of a core that are compared in one task.
CONTEXTS = 50_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SEGMENT + 4096), _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 4096)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of some bytes, from the prefix sums of one polynomial."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _UP[:len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * _DOWN[a])


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid side by side: bytes, and per text its index, begin and end there, first place in the text, window starts to do."""
    held, size = [], 0

    def out():
        data = np.frombuffer(b"".join(h[1] for h in held), np.uint8)
        ends = np.cumsum([len(h[1]) for h in held])
        return (data, np.array([h[0] for h in held]), ends - [len(h[1]) for h in held], ends, np.array([h[2] for h in held]), np.array([h[3:] for h in held]).reshape(-1, 2))
    for i, text in enumerate(texts):
        last = len(text) - LENGTH + 1  # window starts before this
        for a in range(0, max(0, last), SEGMENT):
            b = min(a + SEGMENT, last)
            low, high = max(0, a - 2 * LENGTH), min(len(text), b + 3 * LENGTH)
            if held and size + high - low > SEGMENT:
                yield out()
                held, size = [], 0
            held.append((i, text[low:high], low, a, b))
            size += high - low
    if held:
        yield out()


def samples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, core, context) of every sample that a window of its text belongs to."""
    texts_out, places, cores, contexts = [], [], [], []
    last: dict[int, int] = {}
    for data, index, begin, end, shift, todo in _segments(texts):
        h, n = Hashes(data), len(data)
        i = np.arange(n - GRAIN + 1)
        least = h.of(i, i + GRAIN) >> np.uint64(24) << np.uint64(24) | (_LOW - i.astype(np.uint64))  # of equal ones the last
        width = 1
        while 2 * width <= RANGE:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = RANGE - width
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        for d, b, e, s, (first, stop) in zip(index.tolist(), begin.tolist(), end.tolist(), shift.tolist(), todo.tolist()):
            at = (_LOW - (least[b - s + first + SIDE:b - s + stop + SIDE] & _LOW)).astype(np.int64)
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if first and last.get(d) == at[0] - b + s:  # the segment before has it
                at = at[1:]
            if not len(at):
                continue
            last[d] = int(at[-1]) - b + s
            low, high = np.maximum(b, at - BEFORE), np.minimum(e, at + AFTER)
            texts_out.append(np.full(len(at), d))
            places.append(at - b + s)
            cores.append(h.of(at - SIDE, at + SIDE + GRAIN))
            contexts.append(_mix(h.of(low, high) + ((at - low) * 1009 + (high - at)).astype(np.uint64)))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(texts_out), np.concatenate(places), np.concatenate(cores), np.concatenate(contexts)


def _bitmap(numbers: DataFrame) -> np.ndarray:
    """Bitmap of non-negative numbers below ``BITS``; its size is fixed."""
    x = F.col(numbers.columns[0]) + 1
    bits = np.zeros(BITS // 8, np.uint8)
    for row in numbers.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        bits[(row["bucket"] - 1) * len(part):row["bucket"] * len(part)] = part
    return bits


def _in(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").to_pylist()]


def _pieces(batch: pa.RecordBatch, size: int = 1_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """30 bits of each sample's core."""
    for batch in batches:
        for part in _pieces(batch):
            core = samples(_texts(part))[2]
            yield pa.RecordBatch.from_arrays([pa.array((core >> np.uint64(34)).astype(np.int32))], names=["x"])


def _samples(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in _pieces(batch):
                text, place, core, context = samples(_texts(part))
                fine = _in(bits, (core >> np.uint64(34)).astype(np.int64) & (BITS - 1))
                keys = part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(core[fine].view(np.int64)), pa.array(context[fine].view(np.int64)), pa.array(keys[text[fine]]), pa.array(place[fine])],
                                                 names=["core", "context", "key", "place"])
    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the samples that are asked for."""
    for batch in batches:
        out: list[tuple] = []
        for key, text, asked in zip(batch.column("key").to_pylist(), _texts(batch), batch.column("asked").to_pylist()):
            for a in asked or []:
                p = a["place"]
                low = max(0, p - BEFORE)
                out.append((a["core"], a["hot"], 2 if a["solid"] else 1, key, p, p - low, text[low:p + AFTER]))
        kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["core", "hot", "weight", "key", "place", "left", "bytes"])


def _windows(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each context's windows by the places before the sample (SIDE to BEFORE), and which of them exist.

    Core and places are part of the hash: a window may also hold samples of other cores, or this one's core twice.
    """
    core = rows.column("core").to_numpy().view(np.uint64)
    left = rows.column("left").to_numpy().astype(np.int64)
    data = rows.column("bytes").to_pylist()
    sizes = np.array([len(d) for d in data], np.int64)
    hashes, there = np.zeros((len(data), RANGE), np.uint64), np.zeros((len(data), RANGE), bool)
    before = np.arange(SIDE, BEFORE + 1)
    step = SEGMENT // (BEFORE + AFTER)
    for at in range(0, len(data), step):
        h = Hashes(np.frombuffer(b"".join(data[at:at + step]), np.uint8))
        begin = np.cumsum(sizes[at:at + step]) - sizes[at:at + step]
        start = left[at:at + step, None] - before[None, :]
        fine = (start >= 0) & (start + LENGTH <= sizes[at:at + step, None])
        a = np.where(fine, begin[:, None] + start, 0)
        same = core[at:at + step, None] * np.uint64(_BASE) + before.astype(np.uint64)[None, :] * _TABLE[1]
        hashes[at:at + step], there[at:at + step] = _mix(h.of(a, np.where(fine, a + LENGTH, 0)) + same), fine
    return hashes, there


def _runs(again: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
    """Covered spans of texts from the repeated windows of their contexts, a span per run of windows."""
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (r, first), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    place = rows.column("place").to_numpy()[r]
    return pa.RecordBatch.from_arrays([pa.array(rows.column("key").to_numpy()[r]), pa.array(place - (SIDE + stop - 1)), pa.array(place - (SIDE + first) + LENGTH)], names=["key", "begin", "end"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their cores -> spans of windows that two contexts of a core have."""
    def spans(rows: pa.Table) -> pa.RecordBatch:
        hashes, there = _windows(rows)
        weight = np.where(there, rows.column("weight").to_numpy()[:, None], 0)
        _, place = np.unique(hashes[there], return_inverse=True)
        again = np.zeros_like(there)
        again[there] = np.bincount(place, weight[there])[place] > 1 if len(place) else False
        again &= (rows.column("weight").to_numpy() == 1)[:, None]  # a solid context is covered anyway
        return _runs(again, rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in _pieces(batch, 20_000):
            held.append(part)
            rows = pa.Table.from_batches(held)
            core = rows.column("core").to_numpy()
            stop = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0  # the last core may go on
            if stop >= 5_000:
                yield spans(rows.slice(0, stop))
                held = rows.slice(stop).to_batches()
    if held:
        yield spans(pa.Table.from_batches(held))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _pieces(batch):
            hashes, there = _windows(part)
            r, c = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[there].view(np.int64)), pa.array(part.column("weight").to_numpy()[r]), pa.array(part.column("key").to_numpy()[r]),
                                              pa.array(part.column("place").to_numpy()[r] - (SIDE + c))], names=["window", "weight", "key", "begin"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered bytes."""
    for batch in batches:
        out: list[tuple] = []
        for key, text, solid, spans in zip(batch.column("key").to_pylist(), _texts(batch), batch.column("solid").to_pylist(), batch.column("spans").to_pylist()):
            n = len(text)
            steps = np.zeros(n + 1, np.int64)
            if solid:
                p = np.array(solid, np.int64)
                np.add.at(steps, np.maximum(0, p - BEFORE), 1)
                np.add.at(steps, np.minimum(n, p + AFTER), -1)
            if spans:
                np.add.at(steps, [s["begin"] for s in spans], 1)
                np.add.at(steps, [s["end"] for s in spans], -1)
            gone = np.cumsum(steps[:n]) > 0
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (n > 0 and bool(gone[0])))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((key, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _key(id_col: Column, text: Column) -> Column:
    """Rows alike in id and text are one: their texts end alike."""
    return F.xxhash64(id_col, text)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) of the texts with a repeated passage; ``key`` hashes id and text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(_key(F.col(id_col), text).alias("key"), text.cast("binary").alias("text"))
    long = rows.where(F.length("text") >= LENGTH)
    seen = long.select("text").mapInArrow(_cores, "x int").groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select((F.col("x").cast("long") % BITS).alias("x"))
    likely = spark.sparkContext.broadcast(_bitmap(seen))
    found = cut(long.mapInArrow(_samples(likely), "core long, context long, key long, place long"), "repeats-samples")
    contexts = cut(found.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("first")), "repeats-contexts")
    kinds = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").withColumnRenamed("core", "_core")
    told = contexts.join(kinds, F.col("core") == F.col("_core"), "left").select("core", "context", (F.col("n") > 1).alias("solid"), F.coalesce("kinds", F.lit(1)).alias("kinds"), "first").where("solid or kinds > 1")
    # each sample: covered whole, or asked for its bytes; of a repeated context one sample is asked for all
    asks = (F.col("kinds") > 1) & (~F.col("solid") | (F.col("first") == F.struct("key", "place")))
    per_text = found.join(told, ["core", "context"]).groupBy("key").agg(
        F.collect_list(F.when(F.col("solid"), F.col("place"))).alias("solid"),
        F.collect_list(F.when(asks, F.struct("core", (F.col("kinds") > CONTEXTS).alias("hot"), "solid", "place"))).alias("asked"))
    per_text = cut(per_text, "repeats-places")
    wanted = spark.sparkContext.broadcast(_bitmap(per_text.select(F.pmod("key", F.lit(BITS)).alias("x"))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            yield batch.filter(pa.array(_in(bits, batch.column("key").to_numpy() % BITS)))
    held = cut(long.mapInArrow(chosen, "key long, text binary").join(per_text, "key").dropDuplicates(["key"]), "repeats-texts")
    around = held.where(F.size("asked") > 0).select("key", "text", "asked").mapInArrow(_contexts, "core long, hot boolean, weight int, key long, place long, left int, bytes binary")
    around = cut(around, "repeats-around")
    spans = around.where("not hot").repartition("core").sortWithinPartitions("core").mapInArrow(_repeated, "key long, begin long, end long")
    windows = around.where("hot").mapInArrow(_window_rows, "window long, weight int, key long, begin long")
    again = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    spans = spans.unionByName(windows.join(again, "window").select("key", "begin", (F.col("begin") + LENGTH).alias("end")))
    per_key = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return held.join(per_key, "key", "left").where((F.size("solid") > 0) | F.col("spans").isNotNull()).select("key", "text", "solid", "spans").mapInArrow(
        _remove, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty.  Repeated rows, ids and all, are copies of each other like any others.  An empty table gives an empty result; other
    columns are not read; ids may be null.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), _key(F.col(id_col), text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
                           F.sha2(text.cast("binary"), 256).alias("whole")), "repeats-documents")
    found = cut(removed(docs, id_col, text_col).drop("kept"), "repeats-removed")
    return slim.join(found, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                                                  F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
