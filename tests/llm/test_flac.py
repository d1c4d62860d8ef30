import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import flac as A


def texts():
    rng = random.Random(6)
    rows = ["".join(chr(rng.randrange(32, 500)) for _ in range(rng.randrange(3000))) for _ in range(60)]
    return [*rows, None, "", "a", "x" * 5000, "\x00ÿ" * 900, "the cat sat on the mat " * 4000, rows[0]]


def test_round_trip_and_seeking(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("media", F.lit("clash"))
    media = A.encode_texts(df, ["doc_id"])
    got = {r["doc_id"]: r for r in A.decode_media(media, ["doc_id", "n_bytes", "media"]).collect()}
    for i, t in rows:
        want, n = A.payload(t)
        r = got[i]
        assert r["n_bytes"] == n and len(want) % A.BLOCK == 0 and len(want) >= A.BLOCK
        assert b"".join(b["pcm"] for b in r["blocks"]) == want
        assert [b["sample_offset"] for b in r["blocks"]] == list(range(0, len(want), A.BLOCK))
        assert r["features"] == A.describe(want) and len(r["features"]) == len(A.FEATURES)
        last = r["blocks"][-1]  # one frame alone, by its byte offset
        x, _ = A.decode_frames(np.frombuffer(bytes(r["media"]), np.uint8), np.array([last["byte_offset"]]), np.array([len(r["blocks"]) - 1]))
        assert bytes((x[0] + 128).astype(np.uint8)) == last["pcm"]
    assert got[0]["media"] == got[len(rows) - 1]["media"]
    assert A.decode_media(media.where("false"), ["doc_id"]).collect() == []


def test_stream_layout():
    p, _ = A.payload("words and words " * 200)
    s = A.encode([p])[0]
    assert s[:4] == b"fLaC" and s[4] == 0 and int.from_bytes(s[8:10], "big") == A.BLOCK
    assert int.from_bytes(s[18:26], "big") & ((1 << 36) - 1) == len(p)
    assert s[26:42] == hashlib.md5(bytes(b ^ 0x80 for b in p)).digest()


def test_damage_is_found():
    p, _ = A.payload("words and words " * 200)
    s = bytearray(A.encode([p])[0])
    s[-40] ^= 1
    with pytest.raises(ValueError):
        A.decode([bytes(s)])


def test_long_codes_and_lookalike_headers():
    rng = np.random.default_rng(1)
    spikes = np.full((3, A.BLOCK), 128, np.uint8)
    spikes[:, 100] = 0  # one large residual among zeros: a very long unary code
    noise = rng.integers(0, 256, (3, A.BLOCK), np.uint8)
    fake = noise.copy()
    fake[0, 10 : 10 + len(A.head(1))] = np.frombuffer(A.head(1), np.uint8) ^ 0x80  # verbatim bytes that look like the next header
    for x in (spikes, noise, fake):
        p = x.tobytes()
        assert A.decode(A.encode([p]))[0][0] == p


def test_crc_tables():
    data = np.frombuffer(b"123456789", np.uint8)
    assert A.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8  # CRC-16/BUYPASS


def test_features_are_of_the_samples():
    assert A.describe(b"aZ0 ") == [sum((x - 128) ** 2 for x in b"aZ0 ") / 4, 0.0, 0.5, 0.25, 0.25, 0.0]
    assert A.describe(bytes([0, 255, 0, 255]))[1:] == [1.0, 0.0, 0.0, 0.0, 0.5]


def slow_decode(s):
    """Another decoder, a bit at a time, straight from the format's description."""
    bits = "".join(f"{b:08b}" for b in s)
    at = 32
    while True:  # metadata blocks
        last, size = bits[at] == "1", int(bits[at + 8 : at + 32], 2)
        at += 32 + 8 * size
        if last:
            break
    out = []

    def take(n, signed=False):
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    while at < len(bits):
        assert take(14) == 0b11111111111110
        take(2)
        size, rate, _, depth, _ = take(4), take(4), take(4), take(3), take(1)
        ones = 0
        while take(1):
            ones += 1
        take(7 - ones)  # the rest of the first byte of the coded number
        for _ in range(ones - 1):
            take(8)
        n = {1: 192, 6: lambda: take(8) + 1, 7: lambda: take(16) + 1}.get(size, 576 << (size - 2) if 2 <= size <= 5 else 256 << (size - 8))
        n = n() if callable(n) else n
        take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        assert depth in (0, 1)
        take(8)
        take(1)
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [take(8, True) for _ in range(order)]
            if kind < 32:
                c, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                p, shift = take(4) + 1, take(5, True)
                c = [take(p, True) for _ in range(order)]
            width = 4 + take(2)
            parts = 1 << take(4)
            for k in range(parts):
                m, count = take(width), n // parts - (order if k == 0 else 0)
                raw = take(5) if m == (1 << width) - 1 else None
                for _ in range(count):
                    if raw is not None:
                        r = take(raw, True)
                    else:
                        q = 0
                        while not take(1):
                            q += 1
                        u = (q << m) | take(m)
                        r = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
                    x.append(r + (sum(a * b for a, b in zip(c, reversed(x), strict=False)) >> shift))
        at += -at % 8 + 16
        out += x
    return bytes(v + 128 for v in out)


def test_another_decoder_reads_the_streams():
    rng = np.random.default_rng(2)
    for p in [A.payload(t)[0] for t in texts()[:12] + texts()[60:64]] + [rng.integers(0, 256, 3 * A.BLOCK, np.uint8).tobytes(), b"".join(bytes([128 + int(90 * np.sin(i / 9))]) for i in range(A.BLOCK))]:
        assert slow_decode(A.encode([p])[0]) == p
