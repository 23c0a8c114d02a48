"""Token ids of whole texts with a public tokenizer, fast on prose.

A tokenizer of the ``tokenizers`` library costs many microseconds per word, and prose repeats its words.  Neither kind of
vocabulary used here joins characters across a single space, so a batch of texts is cut at spaces, the distinct
pieces are looked up in a bounded table that the Python worker keeps (by a hash, then compared letter by letter), and
the ids are put together by numpy.  Pieces that the table lacks go to the library: plain words to its model, anything else through its whole pipeline.  The ids are exactly those
of the library for the whole text.
"""

from __future__ import annotations

import ctypes
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a Python worker remembers, some 80 bytes each; when it is full it starts again.
REMEMBERED = 2_200_000
#: Bytes of text that are encoded together.
TOGETHER = 4 << 20
#: A word of Latin letters, and the marks behind it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _hashes(pieces: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of a large-string array."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    letters = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    letters = (letters ^ (letters >> np.uint64(31))) * powers[np.arange(len(data)) - np.repeat(starts, sizes)]
    out = sizes.astype(np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] += np.add.reduceat(letters, starts[full])
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _runs(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of a pool, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """``keeps_space``: the vocabulary codes white space (byte-level BPE); else white space only separates words and case does not count.

    A special token's name in a text is that token, as the library has it, or plain text with ``names_as_text``.
    """

    def __init__(self, path: str, keeps_space: bool, names_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.names_as_text = names_as_text
        self.names = [] if names_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.keeps_space = keeps_space
        self.letters = byte_letters()
        self._forget()
        self.marks: dict[str, bytes] = {"": b""}

    def _forget(self) -> None:
        """The table: pieces, where their ids begin in the pool, how many they are, and the pool."""
        self.known, self.pool = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the hashes

    def _find(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each piece in the table, -1 where it is not."""
        if not len(self.hashes):
            return np.full(len(pieces), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.where(self.hashes[at] == hashes, self.places[at], -1)
        here = np.flatnonzero(place >= 0)
        same = pc.equal(self.known.take(pa.array(place[here])), pieces.take(pa.array(here))).to_numpy(zero_copy_only=False)
        place[here[~same]] = -1
        return place

    def _remember(self, pieces: pa.Array, ids: list[bytes], hashes: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, (len(self.known) + order).astype(np.int32))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.known = pa.concat_arrays([self.known, pieces])

    def _library(self, texts: list[str], names_as_text: bool = True) -> list[bytes]:
        self.tokenizer.encode_special_tokens = names_as_text
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words by the model alone: what the pipeline before it does to them is done here at once."""
        text = "\n".join(words)
        letters = (text if self.keeps_space else text.lower()).encode().decode("latin-1").translate(self.letters)
        tokenize, flat, ends = self.model.tokenize, [], [0]
        for word in letters.split(self.letters[10]):
            flat.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(flat))
        data = np.array(flat, "<u4").tobytes()
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def _learn(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces, each behind ``lead``: a space or nothing."""
        lead = lead if self.keeps_space else ""
        plain, marks, other = [], [], []
        for i, piece in enumerate(pieces):
            if m := PLAIN.fullmatch(piece):
                plain.append((i, lead + m[1]))
                marks.append(m[2])
            else:
                other.append(i)
        out = [b""] * len(pieces)
        for mark in set(marks).difference(self.marks):
            self.marks[mark], = self._library([mark])
        if plain:
            for (i, _), mark, ids in zip(plain, marks, self._words([w for _, w in plain])):
                out[i] = ids + self.marks[mark]
        for i, ids in zip(other, self._library([lead + pieces[i] for i in other])):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as unsigned 32-bit integers, offsets of the texts); a null text is empty; no special tokens."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cuts = [0]
        while cuts[-1] < len(texts):  # some megabytes of text at a time
            cuts.append(cuts[-1] + max(1, int(np.searchsorted(np.cumsum(pc.binary_length(texts.slice(cuts[-1])).to_numpy()), TOGETHER, "right"))))
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            parts.append(self._encode(texts.slice(a, b - a)))
            pa.default_memory_pool().release_unused()  # else Arrow keeps several times the table's size
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # and the C library what learning took for a while
            trim(0)
        if len(parts) == 1:
            return parts[0]
        flat = np.concatenate([np.zeros(0, "<u4"), *[p[0] for p in parts]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(p[1]) for p in parts]])
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, whole = len(texts), texts
        odd = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False).copy() if self.keeps_space else np.zeros(n, bool)
        for name in self.names:
            odd |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not self.keeps_space:  # line ends and capitals make no difference: fewer distinct pieces
            texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))  # in this order: ascii_lower needs offsets from 0
        pieces = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = pieces.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        hashes = _hashes(words)
        place = self._find(words, hashes)
        if (place < 0).any():
            missing = np.flatnonzero(place < 0)
            if len(self.known) + len(missing) > REMEMBERED:
                self._forget()
                missing = np.arange(len(words))
                place = np.full(len(words), -1)
            new = words.take(pa.array(missing))
            place[missing] = len(self.known) + np.arange(len(missing))
            self._remember(new, self._learn(new.to_pylist(), " "), hashes[missing])
        sizes = self.sizes[place].astype(np.int64)
        pool = _runs(self.pool, self.starts[place], sizes)
        if self.keeps_space and n:  # a text's first piece has no space before it
            heads = pc.dictionary_encode(pieces.flatten().take(pa.array(offsets[:-1])))
            codes[offsets[:-1]] = heads.indices.to_numpy() + len(sizes)
            first = self._learn(heads.dictionary.to_pylist(), "")
            sizes = np.concatenate([sizes, np.fromiter(map(len, first), np.int64, len(first)) // 4])
            pool = np.concatenate([pool, np.frombuffer(b"".join(first), "<u4")])
        starts, each = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(each)
        flat = _runs(pool, starts[codes], each)
        bounds = np.concatenate([[0], ends])[offsets]
        if odd.any():  # runs of spaces and names of special tokens are tokens of their own: such texts go to the library whole
            own = {i: np.frombuffer(x, "<u4") for i, x in zip(np.flatnonzero(odd).tolist(), self._library(whole.filter(pa.array(odd)).to_pylist(), self.names_as_text))}
            parts = [own[i] if i in own else flat[bounds[i]:bounds[i + 1]] for i in range(n)]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            flat = np.concatenate(parts)
        return flat, bounds


@cache
def encoder(path: str, keeps_space: bool, names_as_text: bool = False) -> Encoder:
    """One encoder per Python worker; tasks that follow in the worker reuse what it has learned."""
    return Encoder(path, keeps_space, names_as_text)
