import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from packetspark.llm import packing, wavelet
from packetspark.llm.common import shared_path
from packetspark.llm.tokens import Encoder, vocabulary


@pytest.mark.parametrize("name,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(name, keeps, small, monkeypatch):
    from packetspark.llm import tokens
    rnd = random.Random(1)
    parts = ["a", "The", "é", " ", "  ", "\n", "\t", " \n", "\r", " ", "　", "'s", "0", "12", "!", "<|endoftext|>", "́", "Σ", "日本", "\x1c", "😀", ".", " b", "cd.\nEf"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [r.text or "" for r in small.select("text").collect()]
    encoder = Encoder(vocabulary(name), keeps)
    want = [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "TOGETHER", 20_000)
    monkeypatch.setattr(tokens, "REMEMBERED", 3_000)
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    ids, bounds = encoder.encode(pa.array([None, ""], pa.string()))
    assert len(ids) == 0 and bounds.tolist() == [0, 0, 0]


@pytest.mark.parametrize("n", [1, 7, 8, 511, 512, 513, 1024, 3000])
def test_wavelet_matrix(n):
    rnd = random.Random(n)
    a = np.array([rnd.choice([0, 3, 5, 5, 9, 1000, 49407]) for _ in range(n)], np.uint32)
    w = wavelet.WaveletMatrix.build(a)
    assert (w.decode() == a).all() and [w.access(i) for i in range(0, n, 13)] == a[::13].tolist()
    for v in (0, 5, 49407, 7, 70000):
        assert w.count(v) == int((a == v).sum()) and w.count(v, n // 3, n // 2) == int((a[n // 3:n // 2] == v).sum())
    assert w.occurrences(9) == np.flatnonzero(a == 9).tolist()
    with pytest.raises(IndexError):
        w.select(7, 0)


def ids_of(name, text, end):
    t = Tokenizer.from_file(vocabulary(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name, keeps, want", [("word_bpe_49k.json", False, [320, 49407, 321]), ("byte_bpe_50k.json", True, [64, 220, 50256, 275])])
def test_names_of_special_tokens(name, keeps, want):
    """The library's default: a name in a text is the token; an option keeps it as text."""
    texts = ["a <|endoftext|> b", "plain text", "A<|endoftext|><|startoftext|>\n x", "<|ENDOFTEXT|>", "  <|endoftext|>"]
    flat, at = Encoder(vocabulary(name), keeps).encode(pa.array(texts))
    library = Tokenizer.from_file(vocabulary(name))
    assert flat[:at[1]].tolist() == want
    assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    library.encode_special_tokens = True
    flat, at = Encoder(vocabulary(name), keeps, names_as_text=True).encode(pa.array(texts))
    assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_corpus_files_round_trip(spark, odd, odd_clashing, empty):
    out = shared_path(spark, "wavelet")
    wavelet.write_corpus(odd_clashing, out, shard_ids=500)
    rows = sorted(wavelet.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in rows] == sorted((r.doc_id or 0 for r in odd.collect()))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    want = Counter((r.doc_id, len(x := ids_of("word_bpe_49k.json", r.text, 2)), zlib.crc32(x.tobytes())) for r in odd.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert spark.read.parquet(out).count() > 1  # several shards
    nothing = shared_path(spark, "wavelet")
    wavelet.write_corpus(empty, nothing)
    assert wavelet.read_documents(spark, nothing).count() == 0


def packed_well(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_documents(odd, odd_clashing, empty):
    rows = packing.pack_documents(odd_clashing).collect()
    packed_well(rows, 2048)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for d in odd.collect():
        x, at, k = ids_of("byte_bpe_50k.json", d.text, 0), 0, 0
        while at < len(x):
            n = len(x) % 2048 or 2048 if not at else 2048
            want[d.doc_id, k, at, n, zlib.crc32(x[at:at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert pieces == want and packing.pack_documents(empty).count() == 0


def test_rounds_of_packing(spark):
    rnd = random.Random(2)
    items = [(i, rnd.randint(1, 100)) for i in range(3000)]
    df = spark.createDataFrame(items, "id long, length long").repartition(12)
    rows = packing.pack(df, 100, 0, together=40, group=50).collect()
    assert sorted((r.id, r.length) for r in rows) == items
    total = sum(n for _, n in items)
    assert packed_well(rows, 100) <= 1.05 * total / 100
    odd = packing.pack(spark.createDataFrame([(i, 60) for i in range(500)], "id long, length long").repartition(7), 100, 0, 20, 30)
    assert packed_well(odd.collect(), 100) == 500  # nothing fits together, and the rounds end
