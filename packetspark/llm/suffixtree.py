"""Language-model scores by a probabilistic suffix tree.

Words are counted over the training documents.  Words seen ``LEAST`` times or more and the end of a document are the
tree's symbols, frequent ones with small numbers; rarer words share one symbol, are no contexts and are told apart by their
own frequency.  Contexts are grown level by level from grouped counts of all that follows them: one that is seen ``LEAST``
times or more stays in the tree if the symbols that follow it diverge from those that follow its longest kept suffix by
more than the description of its distribution costs.  Longer contexts are tried until ``PATIENCE`` lengths in a row fail
that test; no length ends the growth by itself.  A symbol's probability comes from the longest kept suffix of what
precedes it, smoothed with that of the next shorter one, down to the frequencies of words.

The documents lie in chunks.  Their words are counted by packed messages between chunks and buckets.  Each place whose
context is seen fewer than ``HOT`` times goes to the bucket of that context with the ``BLOCK`` symbols of context next
to it.  A bucket has all places of its contexts, so it grows ``BLOCK`` lengths of the subtree below each one by itself,
and answers with the change of each document's score and the places that may grow further, which are sent again with
the symbols that follow.  A place is sent once for ``BLOCK`` lengths, so the bytes grow with the corpus alone.

The few contexts seen ``HOT`` times or more have too many places for a bucket.  They are grown level by level in two
rounds in both directions.  First each chunk sends its distinct (context, symbol) pairs with their counts to buckets by
context and symbol, which add them up and answer in the order of the question.  Then each chunk sends its share of every
context's count, kinds and divergence, and the buckets answer which contexts stay.  A round's table is removed once the
next one is written; nothing is gathered or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, drop_shared, freed_shuffles, give_back, shared_path, table, words_of, write_shared

#: Least occurrences of a word that is a symbol and of a context.
LEAST = 10
#: A branch of the tree ends where so many lengths in a row are not kept.
PATIENCE = 3
#: Added to each word's count.
ADD = 0.1
#: Tokens in a chunk of documents, and behind a bucket of messages.
CHUNK, BUCKET = 1_000_000, 2_000_000
#: A context with so many occurrences has its continuations spread over buckets.
HOT = 300_000
#: Lengths of context that a bucket grows at a time.
BLOCK = 4
#: Chunks and buckets are shuffled in so many parts, one after the other, where there are WAVE tokens for each.
WAVES, WAVE = 4, 8_000_000
END, RARE = 0, 1
#: Documents whose id's checksum leaves this rest modulo ten are held out.
HELD_OUT, FOLDS = 0, 10
#: Bits of a probability's fraction that are not kept: 28 stay.
DROPPED = np.uint64((1 << 24) - 1)
MESSAGE = "chunk long, bucket int, a binary, b binary, c binary, d binary"
TOLD_WORDS = "chunk long, bucket int, a binary, b binary, sums array<long>"
#: Places of a chunk by context, and what became of them.
PLACES = ("chunk long, bucket int, names binary, due binary, missed binary, ctx binary, sym binary, far binary, p binary, at binary, "
          "docs binary, sizes binary, held binary")
GROWN = "chunk long, docs binary, change binary, left_at binary, left_due binary, left_missed binary, left_p binary"
#: The places that are to be sent: where, the length of their context, one more than the lengths not kept, probabilities.
COLD = ("left_at", "left_due", "left_missed", "left_p")
#: A row is a chunk (bucket null) or a message of a chunk to a bucket.
STATE = (MESSAGE + ", tokens binary, alive binary, p binary, hot binary, left_at binary, left_due binary, left_missed binary, "
         "left_p binary, doc_id array<long>, held_out array<boolean>, "
         "n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
          "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in ddl.split(", ")])


def _rows(ddl: str, rows: list[dict]) -> pa.Table:
    """Rows with the given columns, null in all others."""
    schema = _schema(ddl)
    return pa.table([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _pack(values: np.ndarray) -> bytes:
    """The array, first bytes of all numbers first, compressed behind its size."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Words(NamedTuple):
    """Totals over the words of the training documents."""
    ends: int
    total: int
    distinct: int
    symbols: int  # words that are symbols
    symbol_total: int  # their occurrences

    def rare_mass(self) -> float:
        """Tokens behind the rare symbol, with what is added to each word and to an unknown one."""
        return self.total - self.ends - self.symbol_total + ADD * (self.distinct - self.symbols - (self.ends > 0) + 1)

    def mass(self) -> float:
        return self.total + ADD * (self.distinct + 1)


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out and the hashes of the words; two words share a 64-bit hash with negligible probability."""
    doc_id = F.col(id_col).cast("long")
    words: Column = F.transform(words_of(ascii_lower(F.col(text_col).cast("string"))), lambda w: F.xxhash64(w))
    out = (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT
    return docs.select(doc_id.alias("doc_id"), out.alias("held_out"), words.alias("words"))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Contexts with one more symbol."""
    return _mix(ctx * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(1))


def _short(p: np.ndarray) -> np.ndarray:
    return (p.view(np.uint64) & ~DROPPED).view(np.float64)


def _dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets of some hashes, each with the places of its own."""
    bucket = (_mix(key) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(places):
            yield int(bucket[places[0]]), places


def _words_dealt(words: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    for bucket, places in _dealt(words, buckets):
        yield bucket, places[np.argsort(words[places])]


def _ask_words(buckets: int):
    """Each chunk's words with their counts in its training documents, to the buckets of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = _unpack(row["a"], np.uint64), _unpack(row["b"], np.int32)
                yield from _rows(MESSAGE, [{"chunk": row["chunk"], "bucket": bucket, "a": _pack(np.diff(words[at], prepend=np.uint64(0))), "b": _pack(n[at])}
                                           for bucket, at in _words_dealt(words, buckets)]).to_batches()
    return run


def _add_words(buckets: int):
    """Answers with each word's count and symbol; a row without a chunk has the bucket's totals."""
    def run(messages: pa.Table) -> pa.Table:
        rows = messages.sort_by("chunk").to_pylist()
        parts = [np.cumsum(_unpack(r["a"], np.uint64), dtype=np.uint64) for r in rows]
        distinct, of = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(of, np.concatenate([_unpack(r["b"], np.int32) for r in rows]), len(distinct)).astype(np.int64)
        often = np.flatnonzero(n >= LEAST)
        symbol = np.full(len(distinct), RARE, np.int32)  # numbers of the buckets by turns, frequent words first
        symbol[often[np.argsort(-n[often], kind="stable")]] = RARE + 1 + np.arange(len(often)) * buckets + rows[0]["bucket"]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return _rows(TOLD_WORDS, [{"chunk": r["chunk"], "bucket": r["bucket"], "a": _pack(a), "b": _pack(b)} for r, a, b in zip(rows, np.split(n[of], cuts), np.split(symbol[of], cuts))]
                     + [{"bucket": rows[0]["bucket"], "sums": [n.sum(), (n > 0).sum(), n[often].sum(), len(often)]}])
    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks: the hashes of a chunk's distinct words, frequent ones first, and its tokens as places in them."""
    flats, sizes, ids, out, n, turn = [], [], [], [], 0, 0
    name = TaskContext.get().partitionId() << 32

    def whole() -> Iterator[pa.RecordBatch]:
        size = np.concatenate(sizes)
        unique, place, count = np.unique(np.concatenate(flats), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        tokens = np.insert(rank[place], np.cumsum(size), 0).astype(np.int32)
        trained = np.bincount(place, np.repeat(~np.asarray(out, bool), size), len(unique))[order].astype(np.int32)
        yield from _rows(STATE, [{"chunk": name + turn, "a": _pack(unique[order].astype(np.int64)), "b": _pack(trained), "tokens": _pack(tokens),
                                  "doc_id": ids, "held_out": out, "n_tokens": size + 1}]).to_batches()
    for batch in batches:
        flat, offsets = _flat(batch, "words")
        flats.append(flat)
        sizes.append(np.diff(offsets))
        ids += batch.column("doc_id").to_pylist()
        out += batch.column("held_out").to_pylist()
        n += len(flat)
        if n >= CHUNK:
            yield from whole()
            flats, sizes, ids, out, n, turn = [], [], [], [], 0, turn + 1
    if ids:
        yield from whole()


class Chunk:
    """A chunk's documents in order and its tokens; after ``look`` also the contexts of one length at the living places."""

    def __init__(self, rows: pa.Table):
        give_back()
        self.row = rows.to_pylist()[0]
        self.tokens = _unpack(self.row["tokens"], np.int32)
        self.ends = np.cumsum(np.asarray(self.row["n_tokens"], np.int64))

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def sums(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner(at), values, len(self.ends))

    def before(self) -> np.ndarray:
        """The symbol before each place; before a document that is an end."""
        return np.concatenate([np.array([END], np.int32), self.tokens])

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - np.concatenate([[0], self.ends])[self.owner(at)]

    def by_symbol(self, p: np.ndarray) -> np.ndarray:
        """Probabilities by symbol, of the symbols in the chunk."""
        known = np.zeros(int(self.tokens.max()) + 1)
        known[self.tokens] = p
        return known[known > 0]

    def blocks(self, buckets: int, wave: int = 0, waves: int = 1) -> Iterator[dict]:
        """The places to be sent, in order, to the buckets of their contexts; those of a wave."""
        at = np.cumsum(_unpack(self.row["left_at"], np.int32))
        due, missed = _unpack(self.row["left_due"], np.int32).astype(np.int64), _unpack(self.row["left_missed"], np.uint8)
        p = _unpack(self.row["left_p"], np.float64) if self.row["left_p"] else None
        if p is None:  # so far the probability depends on the symbol alone
            root = np.zeros(int(self.tokens.max()) + 1)
            root[np.flatnonzero(np.bincount(self.tokens))] = _unpack(self.row["p"], np.float64)
        before, held = self.before(), np.asarray(self.row["held_out"], bool)
        ctx = np.zeros(len(at), np.uint64)
        for j in range(int(due.max())):
            on = np.flatnonzero(due > j)
            ctx[on] = _longer(ctx[on], before[at[on] - j])
        if waves > 1:
            now = np.flatnonzero(_mix(ctx) % np.uint64(buckets) % np.uint64(waves) == wave)
            at, due, missed, ctx, p = at[now], due[now], missed[now], ctx[now], p if p is None else p[now]
        owner = self.owner(at)
        place = at - np.concatenate([[0], self.ends])[owner]
        for bucket, of in _dealt(ctx, buckets):
            names, first, which = np.unique(ctx[of], return_index=True, return_inverse=True)
            docs, sizes = np.unique(owner[of], return_counts=True)
            here, sym = at[of], self.tokens[at[of]]
            far = np.concatenate([np.where(place[of] >= n, before[np.maximum(here - n, 0)], RARE) for n in (due[of] + k for k in range(BLOCK - 1))])
            yield {"chunk": self.row["chunk"], "bucket": bucket, "names": _pack(names), "due": _pack(due[of][first].astype(np.int32)),
                   "missed": _pack(missed[of][first]), "ctx": _pack(which.astype(np.int32)), "sym": _pack(sym), "far": _pack(far.astype(np.int32)),
                   "p": _pack(root[np.unique(sym)] if p is None else p[of]), "at": _pack(np.diff(here, prepend=0).astype(np.int32)),
                   "docs": _pack(np.diff(docs, prepend=0).astype(np.int32)), "sizes": _pack(sizes.astype(np.int32)), "held": _pack(held[docs])}

    def grown(self, told: pa.Table, score: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The scores after the buckets' answers, and the places that may grow further."""
        left = {c: [] for c in COLD}
        for r in told.to_pylist():
            np.add.at(score, np.cumsum(_unpack(r["docs"], np.int32)), _unpack(r["change"], np.float64))
            for c, kind in zip(COLD, (np.int32, np.int32, np.uint8, np.float64)):
                left[c].append(_unpack(r[c], kind))
        left = {c: np.concatenate(v) if v else np.zeros(0) for c, v in left.items()}
        at, due = left["left_at"].astype(np.int64), left["left_due"].astype(np.int64)
        go = np.flatnonzero((self.place(at) >= due - 1) & (self.before()[np.maximum(at - due + 1, 0)] != RARE))
        return score, {c: v[go] for c, v in left.items()}

    def look(self, alive: np.ndarray, depth: int) -> None:
        """Distinct contexts of the tokens at the living places, and pairs with the symbol there, sorted by both."""
        self.at = np.flatnonzero(alive)
        before = self.before()
        last = before[self.at]
        if depth == 1:
            seen = np.bincount(last) > 0
            self.ctx, self.of_ctx = _longer(np.zeros(seen.sum(), np.uint64), np.flatnonzero(seen)), (np.cumsum(seen) - 1)[last]
        else:
            ctx = np.zeros(len(self.at), np.uint64)
            for j in range(depth):
                ctx = _longer(ctx, before[self.at - j])
            self.ctx, self.of_ctx = np.unique(ctx, return_inverse=True)
            del ctx
        key, self.of_pair = np.unique((self.of_ctx.astype(np.int64) << 32) | self.tokens[self.at], return_inverse=True)
        self.pair_ctx, self.sym = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
        self.of_ctx, self.of_pair = self.of_ctx.astype(np.int32), self.of_pair.astype(np.int32)

    def own(self) -> np.ndarray:
        """Count of each pair in the chunk's training documents."""
        training = ~np.asarray(self.row["held_out"], bool)[self.owner(self.at)]
        return np.bincount(self.of_pair, training, len(self.sym)).astype(np.int64)

    def pairs_dealt(self, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        return _dealt(self.ctx[self.pair_ctx] + np.where(hot[self.pair_ctx], self.sym + 1, 0).astype(np.uint64), buckets)

    def answers(self, told: pa.Table, dealt: Iterator[tuple[int, np.ndarray]], size: int, column: str, kind: type = np.int64) -> np.ndarray:
        found = dict(zip(told["bucket"].to_pylist(), told[column].to_pylist()))
        out = np.zeros(size, kind)
        for bucket, places in dealt:
            out[places] = _unpack(found[bucket], kind)
        return out

    def after(self, messages: list[dict], **columns) -> pa.Table:
        """The chunk with new values in some columns, and its messages."""
        kept = {c: v for c, v in self.row.items() if c not in ("a", "b", "c", "d", "alive", "p", "hot", *COLD)}
        return _rows(STATE, [{**kept, **columns}] + [{"chunk": self.row["chunk"], **m} for m in messages])

    def ask(self, depth: int, alive: np.ndarray, p: np.ndarray, often: np.ndarray, buckets: int, left: dict[str, np.ndarray] | None = None, **columns) -> pa.Table:
        """The chunk with the places to be sent, and its question for the pairs of ``depth`` symbols and the next in hot contexts.

        ``alive`` is 0 where a token has no such context, else one more than the lengths in a row that were not kept;
        ``often`` is the count of that context where it may be hot; ``p`` are the probabilities so far; ``left`` are
        further places to be sent, with contexts of their own length.
        """
        cold = np.flatnonzero((alive > 0) & (often < HOT))
        send = {"left_at": cold, "left_due": np.full(len(cold), depth), "left_missed": alive[cold], "left_p": p[cold]}
        if left is not None:
            send = {c: np.concatenate([v, left[c]]) for c, v in send.items()}
            order = np.argsort(send["left_at"], kind="stable")
            send = {c: v[order] for c, v in send.items()}
        alive = np.where(often < HOT, 0, alive).astype(np.uint8)
        if len(send["left_at"]):
            columns |= {"left_at": _pack(np.diff(send["left_at"], prepend=0).astype(np.int32)), "left_due": _pack(send["left_due"].astype(np.int32)),
                        "left_missed": _pack(send["left_missed"].astype(np.uint8)), "left_p": None if depth == 1 else _pack(send["left_p"])}
        elif not alive.any():  # without a place to look at, tokens are not needed again
            return self.after([], **{**columns, "tokens": _pack(self.tokens[:0])})
        if depth == 1:  # the probability depends on the symbol alone
            columns["p"] = _pack(self.by_symbol(p))
        if not alive.any():
            return self.after([], **columns)
        self.look(alive, depth)
        hot = np.zeros(len(self.ctx), bool)
        hot[self.of_ctx] = often[self.at] >= HOT
        messages, own = [], self.own().astype(np.int32)
        for bucket, places in self.pairs_dealt(hot, buckets):
            of, count = np.unique(self.pair_ctx[places], return_counts=True)
            messages.append({"bucket": bucket, "a": _pack(self.ctx[of]), "b": _pack(count.astype(np.int32)),
                             "c": _pack(np.diff(self.sym[places], prepend=np.int32(0))), "d": _pack(own[places])})
        if depth > 1:
            known = np.empty(len(self.sym))
            known[self.of_pair] = p[self.at]
            columns["p"] = _pack(known)
        return self.after(messages, alive=_pack(alive), hot=_pack(hot), **columns)

    def known(self, depth: int) -> np.ndarray:
        """Probabilities so far of the pairs."""
        p = _unpack(self.row["p"], np.float64)
        return p[(np.cumsum(np.bincount(self.tokens) > 0) - 1)[self.sym]] if depth == 1 else p


def _begin(ends: int, mass: float, rare_mass: float, buckets: int):
    """Scores from the frequencies of words; asks for the contexts of one symbol."""
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        words = _unpack(chunk.row["a"], np.uint64)
        n, symbol = np.zeros(len(words) + 1), np.full(len(words) + 1, RARE, np.int32)
        n[0], symbol[0] = ends, END
        n[1:] = chunk.answers(found, _words_dealt(words, buckets), len(words), "a")
        symbol[1:] = chunk.answers(found, _words_dealt(words, buckets), len(words), "b", np.int32)
        rare = symbol == RARE
        p = np.where(rare, rare_mass, n + ADD) / mass
        every, x = np.arange(len(chunk.tokens)), chunk.tokens
        base = chunk.sums(every, np.log10((n + ADD) / mass)[x])
        tree = chunk.sums(every, (np.log10(p) + np.where(rare, np.log10((n + ADD) / rare_mass), 0.0))[x])
        context = (n >= LEAST) & ~rare
        last = np.concatenate([[0], x[:-1]])
        chunk.tokens = symbol[x]
        return chunk.ask(1, context[last].astype(np.uint8), p[x], n[last], buckets, tokens=_pack(chunk.tokens),
                         n_known=chunk.sums(every, (n > 0)[x]).astype(np.int64), base_score=base, score=tree)
    return run


def _add_pairs(messages: pa.Table) -> pa.Table:
    """Answers a bucket's chunks with each pair's count, doubled, and one more in the first chunk that holds the pair in training."""
    rows = messages.sort_by("chunk").to_pylist()
    keys, own = [], []
    for r in rows:
        ctx = np.repeat(_unpack(r["a"], np.uint64), _unpack(r["b"], np.int32))
        sym = np.cumsum(_unpack(r["c"], np.int32), dtype=np.int64).astype(np.uint64)
        keys.append(_mix(ctx * np.uint64(0xD6E8FEB86659FD93) + sym))
        own.append(_unpack(r["d"], np.int32))
    cuts, own = np.cumsum([len(k) for k in keys])[:-1], np.concatenate(own)
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")  # equal pairs by chunk
    keys, own = keys[order], own[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    pair, held = np.cumsum(new) - 1, np.flatnonzero(own > 0)
    answer = 2 * np.add.reduceat(own, np.flatnonzero(new), dtype=np.int64)[pair]
    answer[held[np.diff(pair[held], prepend=-1) > 0]] += 1
    told = np.empty_like(answer)
    told[order] = answer
    return _rows(MESSAGE, [{"chunk": r["chunk"], "bucket": r["bucket"], "a": _pack(part)} for r, part in zip(rows, np.split(told, cuts))])


def _gather(depth: int, buckets: int):
    """Takes the counts of the pairs; sends the chunk's share of each context's count, kinds and divergence, and keeps the counts."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        if chunk.row["alive"] is None:
            return _rows(MESSAGE, [])
        chunk.look(_unpack(chunk.row["alive"], np.uint8), depth)
        answer = chunk.answers(told, chunk.pairs_dealt(_unpack(chunk.row["hot"], bool), buckets), len(chunk.sym), "a")
        n, own, size = answer >> 1, chunk.own(), len(chunk.ctx)
        gain = np.bincount(chunk.pair_ctx, own * (np.log(np.maximum(n, 1)) - np.log(chunk.known(depth))), size)
        count = np.bincount(chunk.pair_ctx, own, size).astype(np.int64)
        kinds = np.bincount(chunk.pair_ctx, answer & 1, size).astype(np.int64)
        name = chunk.row["chunk"]
        return _rows(MESSAGE, [{"chunk": name, "a": _pack(n)}] + [{"chunk": name, "bucket": bucket, "a": _pack(chunk.ctx[at]), "b": _pack(count[at]), "c": _pack(kinds[at]), "d": _pack(gain[at])}
                            for bucket, at in _dealt(chunk.ctx, buckets)])
    return run


def _add_contexts(messages: pa.Table) -> pa.Table:
    """Answers a bucket's chunks with each context's count, doubled, and one more if it stays; and its kinds."""
    rows = messages.sort_by("chunk").to_pylist()
    parts = [_unpack(r["a"], np.uint64) for r in rows]
    distinct, of = np.unique(np.concatenate(parts), return_inverse=True)
    n, kinds, gain = (np.bincount(of, np.concatenate([_unpack(r[c], kind) for r in rows]), len(distinct)) for c, kind in (("b", np.int64), ("c", np.int64), ("d", np.float64)))
    total = np.log(np.maximum(n, 2))
    kept = (n >= LEAST) & (gain - n * np.log(np.maximum(n, 1)) > 0.5 * kinds * total)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    told, kinds = 2 * n[of].astype(np.int64) + kept[of], kinds[of].astype(np.int64)
    return _rows(MESSAGE, [{"chunk": r["chunk"], "bucket": r["bucket"], "a": _pack(a), "b": _pack(b)} for r, a, b in zip(rows, np.split(told, cuts), np.split(kinds, cuts))])


def _send(buckets: int, wave: int, waves: int):
    """The messages of each chunk's places to the buckets of a wave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from _rows(PLACES, list(Chunk(pa.Table.from_batches([batch.slice(i, 1)])).blocks(buckets, wave, waves))).to_batches()
    return run


def _subtree(messages: pa.Table) -> pa.Table:
    """Grows the subtrees below a bucket's contexts by ``BLOCK`` lengths; answers each chunk with the changes of its documents'
    scores and the places that may grow further."""
    give_back()
    rows = messages.sort_by("chunk").to_pylist()

    def column(name: str, kind: type) -> list[np.ndarray]:
        return [_unpack(r.pop(name), kind) for r in rows]
    names, sym, docs, sizes = column("names", np.uint64), column("sym", np.int32), [np.cumsum(d) for d in column("docs", np.int32)], column("sizes", np.int32)
    known, of = np.unique(np.concatenate(names), return_inverse=True)
    due, missed = np.zeros(len(known), np.int64), np.zeros(len(known), np.uint8)
    due[of], missed[of] = np.concatenate(column("due", np.int32)), np.concatenate(column("missed", np.uint8)) - 1
    begin = np.concatenate([group[which] for group, which in zip(np.split(of, np.cumsum([len(n) for n in names])[:-1]), column("ctx", np.int32))])
    cuts = np.cumsum([len(x) for x in sym])[:-1]
    # probabilities by symbol while they depend on it alone
    p = np.concatenate([q[np.unique(x, return_inverse=True)[1]] if len(q) < len(x) else q for q, x in zip(column("p", np.float64), sym)])
    far = np.concatenate([x.reshape(BLOCK - 1, -1) for x in column("far", np.int32)], axis=1)
    own = ~np.concatenate([np.repeat(held, n) for held, n in zip(column("held", bool), sizes)])
    sym, group, change, left = np.concatenate(sym), begin, -np.log10(p), np.zeros(len(own), np.uint8)
    on = np.arange(len(own))
    for k in range(BLOCK):
        pair, of = np.unique((group.astype(np.int64) << 32) | sym[on], return_inverse=True)
        n, ctx, before = np.bincount(of, own[on], len(pair)), pair >> 32, np.empty(len(pair))
        before[of] = p[on]
        total, kinds = np.bincount(ctx, n, len(missed)), np.bincount(ctx, n > 0, len(missed))
        gain = np.bincount(ctx, n * (np.log(np.maximum(n, 1)) - np.log(before)), len(missed))
        kept = (total >= LEAST) & (gain - total * np.log(np.maximum(total, 1)) > 0.5 * kinds * np.log(np.maximum(total, 2)))
        share = 1 / np.maximum(total + kinds, 1)
        p[on] = _short(np.where(kept[ctx], n * share[ctx] + (kinds * share)[ctx] * before, before))[of]
        missed = np.where(kept, 0, missed + 1).astype(np.uint8)
        go = ((total >= LEAST) & (missed < PATIENCE))[group]
        if k == BLOCK - 1:
            left[on[go]] = missed[group[go]] + 1
            break
        go &= far[k, on] != RARE
        on, group = on[go], group[go]
        if not len(on):
            break
        longer, group = np.unique((group.astype(np.int64) << 32) | far[k, on], return_inverse=True)
        missed = missed[longer >> 32]
    change += np.log10(p)
    out = []
    for r, at, d, size, which, c, m, q in zip(rows, column("at", np.int32), docs, sizes, *(np.split(x, cuts) for x in (begin, change, left, p))):
        go = np.flatnonzero(m)
        out.append({"chunk": r["chunk"], "docs": _pack(np.diff(d, prepend=0).astype(np.int32)), "change": _pack(np.add.reduceat(c, np.cumsum(size) - size)),
                    "left_at": _pack(np.cumsum(at, dtype=np.int64)[go].astype(np.int32)), "left_due": _pack((due[which[go]] + BLOCK).astype(np.int32)),
                    "left_missed": _pack(m[go]), "left_p": _pack(q[go])})
    return _rows(GROWN, out)


def _deepen(depth: int, buckets: int):
    """Scores with the contexts that stay, of ``depth`` symbols where they are hot; asks for longer ones."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        if not len(chunk.tokens):
            return chunk.after([])
        size = len(chunk.tokens)
        grown = pa.compute.is_valid(told["docs"])
        tree, left = chunk.grown(told.filter(grown), np.array(chunk.row["score"], float))
        told = told.filter(pa.compute.invert(grown))
        alive, full, often = np.zeros(size, np.uint8), np.ones(size), np.zeros(size + 1, np.int64)
        if chunk.row["alive"] is None:
            return chunk.ask(depth + 1, alive, full, often[:-1], buckets, left, score=tree)
        before = _unpack(chunk.row["alive"], np.uint8)
        chunk.look(before, depth)
        at = chunk.at
        answer, kinds = (chunk.answers(told, _dealt(chunk.ctx, buckets), len(chunk.ctx), c) for c in "ab")
        total, use = answer >> 1, (answer & 1 > 0)[chunk.of_ctx]
        n, p = _unpack(told.filter(told["bucket"].is_null())["a"][0].as_py(), np.int64)[chunk.of_pair], chunk.known(depth)[chunk.of_pair]
        share = 1 / np.maximum(total + kinds, 1)
        better = _short(np.where(use, n * share[chunk.of_ctx] + (kinds * share)[chunk.of_ctx] * p, p))
        tree = tree + chunk.sums(at, np.log10(better) - np.log10(p))
        # a longer context is what the context one place before saw follow it; where that one is not hot, the
        # longer one is not either, and its bucket finds whether it is frequent
        frequent = np.ones(size + 1, bool)
        frequent[at + 1], often[at + 1] = n >= LEAST, n
        place = chunk.place(at)
        far = chunk.before()[np.maximum(at - depth, 0)]
        last = chunk.tokens[np.maximum(at - 1, 0)]
        missed = np.where(use, 0, before[at])
        alive[at] = np.where(frequent[at] & (place >= depth) & (far != RARE) & (last != RARE) & (missed < PATIENCE), missed + 1, 0)
        full[at] = better
        return chunk.ask(depth + 1, alive, full, often[:-1], buckets, left, score=tree)
    return run


def _write(parts: Iterable[DataFrame], spark: SparkSession) -> str:
    """The path of chunks and messages in folders of their own, so that messages can go once they were answered.  The shuffle
    of a part is removed before that of the next begins."""
    path = shared_path(spark, "pst-level")
    for df in parts:
        df.withColumn("message", F.col("bucket").isNotNull()).write.mode("append").option("compression", "zstd").partitionBy("message").parquet(path)
    return path


def _read(spark: SparkSession, path: str, schema: str, message: bool) -> DataFrame:
    return spark.read.schema(f"{schema}, message boolean").parquet(path).where(F.col("message") == message).drop("message")


def _answered(own: DataFrame, told: DataFrame, run, schema: str, waves: int) -> str:
    """Chunks with what was told them; some chunks after the other."""
    def of(df: DataFrame, wave: int) -> DataFrame:
        return df if waves == 1 else df.where(F.pmod(F.xxhash64("chunk"), F.lit(waves)) == wave)
    return _write((of(own, w).groupBy("chunk").cogroup(of(told, w).groupBy("chunk")).applyInArrow(run, schema) for w in range(waves)), own.sparkSession)


def _grown(places: DataFrame, buckets: int, waves: int) -> str:
    """The path of the answers to the places that chunks send; some buckets after the other."""
    spark, path = places.sparkSession, shared_path(places.sparkSession, "pst-grown")
    for w in range(waves):
        sent = places.mapInArrow(_send(buckets, w, waves), PLACES)
        sent.groupBy("bucket").applyInArrow(_subtree, GROWN).write.mode("append").option("compression", "zstd").parquet(path)
    return path


def grow(spark: SparkSession, state: str, buckets: int, waves: int) -> str:
    """Grows the tree while a chunk has places to be sent or asks for longer contexts; ``state`` is the path of the chunks that
    begin with contexts of one symbol, the result that of the chunks with their last scores."""
    depth = 1
    while True:
        asked, own = _read(spark, state, MESSAGE, True), _read(spark, state, STATE, False)
        hot, places = not asked.isEmpty(), own.where(F.col("left_at").isNotNull())
        if not hot and places.isEmpty():
            return state
        grown = _grown(places.select("chunk", "tokens", "p", *COLD, "held_out", "n_tokens"), 2 * buckets, waves)
        own = own.drop(*COLD)
        answers, used = spark.read.schema(GROWN).parquet(grown), [state, grown]
        if hot:
            def told(messages: DataFrame, add) -> DataFrame:
                used.append(write_shared(messages.groupBy("bucket").applyInArrow(add, MESSAGE), "pst-told"))
                return spark.read.schema(MESSAGE).parquet(used[-1])
            counted = told(asked, _add_pairs)
            drop_shared(spark, f"{state}/message=true")
            own = _read(spark, state, STATE, False).drop(*COLD)
            used.append(shares := _answered(own, counted, _gather(depth, buckets), MESSAGE, waves))
            kept = told(_read(spark, shares, MESSAGE, True), _add_contexts).unionAll(_read(spark, shares, MESSAGE, False))
            answers = answers.unionByName(kept, allowMissingColumns=True)
        after = _answered(own, answers, _deepen(depth, buckets), STATE, waves)
        for path in used:
            drop_shared(spark, path)
        state, depth = after, depth + 1


def _scored(rows: DataFrame) -> tuple[DataFrame, int]:
    """The documents with their scores, as ``doc``, and the number of training tokens."""
    spark = rows.sparkSession
    chunks = write_shared(rows.mapInArrow(_chunks, STATE), "pst-chunks")
    whole = spark.read.schema(STATE).parquet(chunks)
    ends = int(whole.agg(F.sum(F.size(F.filter("held_out", lambda out: ~out)))).first()[0] or 0)
    tokens = int(whole.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0)
    buckets, waves = 1 + tokens // BUCKET, max(1, min(WAVES, tokens // WAVE))
    asked = whole.select("chunk", "a", "b").mapInArrow(_ask_words(buckets), MESSAGE)
    listed = write_shared(asked.groupBy("bucket").applyInArrow(_add_words(buckets), TOLD_WORDS), "pst-words")
    told = spark.read.schema(TOLD_WORDS).parquet(listed)
    total, distinct, shown, symbols = (int(x or 0) for x in told.where("chunk is null").agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).first())
    words = Words(ends, total + ends, distinct + (ends > 0), symbols, shown)
    found = told.where("chunk is not null").drop("sums")
    state = _answered(whole, found, _begin(ends, words.mass(), words.rare_mass(), buckets), STATE, waves)
    drop_shared(spark, chunks)
    drop_shared(spark, listed)
    of = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    return _read(spark, grow(spark, state, buckets, waves), STATE, False).select(F.explode(F.arrays_zip(*of)).alias("doc")), words.total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has the end token alone.  A null id counts as an empty one for holding out.  Repeated rows are
    counted and scored each; an empty table gives an empty result; without training documents no token is known and both
    scores are 0.  Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with freed_shuffles(spark):
        last, total = _scored(hashed(docs, id_col, text_col))
    plain = F.lit(total > 0)
    return last.select("doc.doc_id", "doc.held_out", "doc.n_tokens", "doc.n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                       F.when(plain, F.col("doc.base_score")).otherwise(0.0).alias("base_score"), F.when(plain, F.col("doc.score")).otherwise(0.0).alias("score"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
