import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import packing as K


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéüßÑ") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ",", ".", "...", "'s", "!?", "42", "ﬁ", "İ", "é"])
    rows = [" ".join(word() for _ in range(int(rng.paretovariate(0.8) * 4) % 9000)) for _ in range(200)]
    return [*rows, None, "", "  \n", "<|endoftext|> x", "a\x1cb", "a b c　d", "'Tis we're I'LL", "x́ ́y", "Σας ΟΔΟΣ", "日本語 テスト", rows[0], "word " * 20000]


def test_ids_equal_the_tokenizers_and_pieces_are_right(spark):
    t = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
    rows = list(enumerate(texts()))
    got = {}
    for r in K.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows)
    seqs = {}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        ps = sorted(got[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in ps] == list(range(len(ps)))
        assert np.frombuffer(b"".join(r["ids"] for r in ps), "<u4").tolist() == ids
        assert [r["start"] for r in ps] == list(range(0, len(ids), K.CAPACITY)) and all(r["length"] == K.CAPACITY for r in ps[:-1])
        assert ps[0]["ids_crc32"] == zlib.crc32(ps[0]["ids"]) == zlib.crc32(np.array(ids[: K.CAPACITY], "<u4").tobytes())
        for r in ps:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= K.CAPACITY
        total += at
    assert len(seqs) <= -(-total // K.CAPACITY) + 2


def test_groups_are_near_the_bound():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 4097, 5000), rng.integers(600, 2100, 5000), np.full(300, 1500), np.array([4096, 1]), rng.integers(1, 50, 2000), np.minimum(4096, (rng.pareto(1.0, 8000) * 200 + 1)).astype(int)):
        lengths = np.sort(lengths)[::-1]
        seq, offset = K.pack_lengths(lengths)
        load = np.bincount(seq, lengths)
        assert load.max() <= K.CAPACITY and (seq >= 0).all()
        for s in range(0, len(load), 97):
            m = np.flatnonzero(seq == s)
            m = m[np.argsort(offset[m])]
            assert (offset[m] == np.cumsum(lengths[m]) - lengths[m]).all()
        big = int((lengths > K.CAPACITY / 2).sum())
        bound = max(-(-int(lengths.sum()) // K.CAPACITY), big, -(-len(lengths) // 2) if lengths.min() == 1500 else 0)
        assert len(load) <= bound * 1.06 + 1


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id bigint, text string")
    rows = K.pack_documents(df).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 2] and len({r["sequence_id"] for r in rows}) == 1
    assert K.pack_documents(df.where("false")).collect() == []
