"""Best-fit packing of documents into sequences by hierarchical residual packing.

Every task packs the items that it holds by best fit, longest first.  Bins that are nearly full are final.  The others,
with what they hold, become items of the next round: they are dealt to fewer groups and packed by best fit again, and
so on up a tree.  A group holds a bounded number of items, so a round never meets in one task however many bins are
left; the rounds end when one group held everything, or when a round no longer joins bins.  A bin that no round can
fill stays as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table
from .tokens import encoder, vocabulary

#: Tokens in a sequence, and the id that ends a document.
LENGTH, END_ID = 2048, 0
#: A bin with at most this much room left is final.
SLACK = 16
#: Items that are packed together: in a task's first round, and in a group of a later round.
TOGETHER, GROUP = 200_000, 8_000
#: A round that leaves more than this part of its bins ends the rounds.
PROGRESS = 0.98
#: The number of a round is part of a sequence's id; bins that are still open after so many rounds are final too.
MOST_ROUNDS = 60
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, its offset there, fill of each bin).  Ties go by the items' order."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits and n:
            r = (fits & -fits).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := r - n:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _named(bins: np.ndarray, turn: int) -> np.ndarray:
    """Ids of bins that no other task of the round gives."""
    return (np.int64(TaskContext.get().partitionId()) << 36) + (np.int64(turn) << 20) + bins


def _pack_pieces(capacity: int, together: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, turn = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= together:
                yield _packed(pd.concat(held), turn)
                held, n, turn = [], 0, turn + 1
        if n:
            yield _packed(pd.concat(held), turn)

    def _packed(items: pd.DataFrame, turn: int) -> pd.DataFrame:
        bins, offsets, fill = best_fit(items["length"].to_numpy(), capacity)
        return items.assign(bin=_named(bins, turn), at=offsets, fill=fill[bins])
    return run


def pack(items: DataFrame, capacity: int = LENGTH, slack: int = SLACK, together: int = TOGETHER, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to items with a ``length`` (long, 1 to ``capacity``) in columns of any kind.

    Items of the same sequence lie side by side from 0, never over ``capacity``.  ``items`` should be a written table:
    it is read once.  An empty table gives an empty result; equal rows are separate items.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    first = cut(items.mapInPandas(_pack_pieces(capacity, together), f"{types}, bin long, at long, fill long"), "pack-0")
    open_bins = first.where((F.col("at") == 0) & (F.col("fill") < capacity - slack)).select("bin", F.col("fill").alias("length"))
    rounds, left = [], open_bins.count()
    while left > 1 and len(rounds) < MOST_ROUNDS:
        groups = -(-left // group)
        dealt = open_bins.repartition(groups, F.xxhash64("bin"))
        done = cut(dealt.withColumnRenamed("bin", "child").mapInPandas(_pack_pieces(capacity, 4 * group), "child long, length long, bin long, at long, fill long"),
                   f"pack-{len(rounds) + 1}")
        rounds.append(done)
        after = done.where("at = 0")
        open_bins = after.where(F.col("fill") < capacity - slack).select("bin", F.col("fill").alias("length"))
        bins, still = after.count(), open_bins.count()
        if groups == 1 or bins > PROGRESS * left:
            break
        left = still
    # from the last round down: where each bin of a round's input finally lies
    final = None
    for k, done in reversed(list(enumerate(rounds, 1))):
        own = done.select("child", (F.lit(k << 57) + F.col("bin")).alias("sequence"), F.col("bin"), "at")
        if final is not None:
            own = own.alias("o").join(final.alias("f"), F.col("o.bin") == F.col("f.child"), "left").select(
                "o.child", F.coalesce("f.sequence", "o.sequence").alias("sequence"), "o.bin", (F.col("o.at") + F.coalesce("f.at", F.lit(0))).alias("at"))
        final = cut(own.select("child", "sequence", "bin", "at"), f"pack-map-{k}")
    placed = first.withColumn("sequence", F.col("bin"))
    if final is not None:
        placed = placed.alias("p").join(final.alias("f"), F.col("p.bin") == F.col("f.child"), "left").select(
            *[F.col(f"p.`{f.name}`").alias(f.name) for f in items.schema.fields], F.coalesce("f.sequence", "p.sequence").alias("sequence"),
            (F.col("p.at") + F.coalesce("f.at", F.lit(0))).alias("at"))
    return placed.select(*[F.col(f"`{f.name}`") for f in items.schema.fields], F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Documents as token pieces of at most ``length``: the first one takes what whole pieces leave over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, True)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = code.encode(batch.column("text"))
            doc, piece, start, size, crc = [], [], [], [], []
            end = np.array([end_id], "<u4").tobytes()
            for d, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                data = ids[a:b].tobytes() + end
                n = len(data) // 4
                at, step = 0, n % length or length
                while at < n:
                    doc.append(d)
                    piece.append(0 if not at else piece[-1] + 1)
                    start.append(at)
                    size.append(step)
                    crc.append(zlib.crc32(data[4 * at:4 * (at + step)]))
                    at, step = at + step, length
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives a piece with the end id alone; a null id stays null; rows with the same id are
    separate documents; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    pieces = cut(pieces_of(docs, path or vocabulary("byte_bpe_50k.json"), id_col, text_col), "pack-pieces")
    return pack(pieces)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
