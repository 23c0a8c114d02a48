"""Token ids of a corpus as wavelet matrices, one compressed file per shard.

A wavelet matrix keeps a sequence as one bit-plane per bit of its ids, from the highest: each plane holds that bit of
every element, after which the elements with 0 move, in order, before those with 1.  With counts of ones per block it
answers access, rank (how often an id occurs before a place), counting and select (where it occurs the k-th time) from
the planes alone.  A shard is a row of a zstd-compressed Parquet file: Spark's writer commits files whole, on any store,
and a task that is repeated leaves no second copy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, table
from .tokens import encoder, vocabulary

#: Fixed value: the id that ends a document.
END_ID = 2
#: A shard is closed at the first document's end after so many ids.
SHARD_IDS = 1 << 20
#: Bits between stored counts of ones.
BLOCK = 512
FORMAT = "part int, shard int, n long, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids array<long>, ends array<long>"


class WaveletMatrix:
    """Succinct sequence of unsigned integers below 2**len(planes)."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, bits = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (x >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), BLOCK // 8)) if n else np.zeros(0, np.uint32)
            z = n - int(ones.sum())
            planes.append(packed.tobytes())
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            zeros.append(z)
            moved = np.empty_like(x)
            moved[:z], moved[z:] = np.compress(~one, x), np.compress(one, x)
            x = moved
        return cls(n, zeros, planes, ranks)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        if i == self.n and i % BLOCK == 0:
            return self.n - self.zeros[level]
        first, last = block * BLOCK // 8, i // 8
        n = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + (int(plane[last]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value, i = value << 1 | bit, z + ones if bit else i - ones
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level, z in enumerate(self.zeros):
            low, high = self._rank1(level, a), self._rank1(level, b)
            a, b = (z + low, z + high) if value >> (len(self.zeros) - 1 - level) & 1 else (a - low, b - high)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of an id in places a to b."""
        if value >> len(self.zeros):
            return 0
        low, high = self._range(value, a, self.n if b is None else b)
        return high - low

    def _select_in(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:  # the first prefix that holds k + 1 of them
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            low, high = (low, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, high)
        return low

    def select(self, value: int, k: int) -> int:
        """Place of an id's k-th occurrence, from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select_in(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids: the moves of each plane undone from the last to the first."""
        bits = len(self.planes)
        x = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, back = self.zeros[level], np.empty_like(x)
            back[np.flatnonzero(~one)] = x[:z]
            back[np.flatnonzero(one)] = x[z:] | x.dtype.type(1 << bits - 1 - level)
            x = back
        return x.astype("<u4")


def _encode_shards(path: str, end_id: int, shard_ids: int):
    end = np.array([end_id], np.uint32)

    def close(parts: list[np.ndarray], doc_ids: list, ends: list[int], shard: int) -> pa.RecordBatch:
        m = WaveletMatrix.build(np.concatenate(parts))
        row = {"part": TaskContext.get().partitionId(), "shard": shard, "n": m.n, "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes],
               "ranks": [r.tobytes() for r in m.ranks], "doc_ids": doc_ids, "ends": ends}
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, False)
        parts, doc_ids, ends, n, shard = [], [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = code.encode(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                parts += [ids[a:b], end]
                n += b - a + 1
                doc_ids.append(doc)
                ends.append(n)
                if n >= shard_ids:
                    yield close(parts, doc_ids, ends, shard)
                    parts, doc_ids, ends, n, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield close(parts, doc_ids, ends, shard)
    return run


def write_corpus(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every document and write the shards below ``out``, documents in ascending id order.

    The ranges of ids are Spark's range partitioning (null ids first); a part writes its shards in order, so (part, shard)
    orders the corpus.  A null text is empty and leaves its end id; documents with equal ids follow each other in the
    order of their texts' hashes; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    parts = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = parts.mapInArrow(_encode_shards(path or vocabulary("word_bpe_49k.json"), end_id, shard_ids), FORMAT)
    shards.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(out)


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of every document.

    ``start`` adds up in two steps, shards within their part and parts among each other, from the shards' lengths alone.
    """
    shards = spark.read.schema(FORMAT).parquet(out)
    sizes = shards.groupBy("part", "shard").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, F.col("part") == F.col("_part")).select(
        F.col("part").alias("_part"), F.col("shard").alias("_shard"), (F.col("part_start") + F.col("shard_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["n"], row["zeros"], row["planes"], row["ranks"]).decode()
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                k = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                                                  pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                                                 names=["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(run, "part int, shard int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(starts, (F.col("part") == F.col("_part")) & (F.col("shard") == F.col("_shard"))).select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op3_wavelet_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "wavelet")
    write_corpus(table(spark, sf_dir, "documents"), out)
    return read_documents(spark, out)
