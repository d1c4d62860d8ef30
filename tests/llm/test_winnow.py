import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from quillspark.llm import winnow as W


def plain(text, k=W.K, window=W.WINDOW):
    """(hash, position) of the minima of all windows, rightmost ties."""
    w = [x for x in (text or "").split(" ") if x]
    h = [int.from_bytes(xxhash.xxh64(x.encode(), seed=42).digest(), "big", signed=True) % W.PRIME for x in w]
    if not w:
        return []
    if len(w) < k:
        g = [int.from_bytes(xxhash.xxh64(" ".join(w).encode(), seed=42).digest(), "big", signed=True) % W.PRIME]
    else:
        g = []
        for i in range(len(h) - k + 1):
            v = 0
            for x in h[i : i + k]:
                v = (v * W.BASE + x) % W.PRIME
            g.append(v)
    out = []
    for i in range(max(1, len(g) - window + 1)):
        part = g[i : i + window]
        j = i + max(p for p, v in enumerate(part) if v == min(part))
        if (g[j], j) not in out:
            out.append((g[j], j))
    return out


def texts():
    rng = random.Random(4)
    rows = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 15, 16, 17, 40, 300)]
    return [*rows, "a a a a a a a a a a a a a a a a a a a a a a", "ü " * 30, "x" * 5000]


def test_fingerprints_equal_plain_version(spark):
    rows = [(i, t) for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp_words", F.lit(1))
    for k, window in ((W.K, W.WINDOW), (1, 1), (3, 4), (8, 16)):
        got = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in W.fingerprint_documents(df, k=k, window=window).collect()}
        for i, t in rows:
            assert got[i] == plain(t, k, window), (k, window, i)


def test_match_guarantee(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    shared = [word() for _ in range(W.WINDOW + W.K - 1)]
    rows = [(i, " ".join([*(word() for _ in range(rng.randrange(50))), *shared, *(word() for _ in range(rng.randrange(50)))])) for i in range(20)]
    sets = [set(x["hash"] for x in r["fingerprint"]) for r in W.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert set.intersection(*sets)


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_edits_against_plain_version(spark):
    rows = sorted(zip(random.Random(1).sample(range(-50, 1000), len(texts())), texts(), strict=True))
    df = spark.createDataFrame([*rows, rows[3]], "doc_id bigint, text string")
    got = {}
    for r in W.compare_with_edits(df).collect():
        assert got.setdefault(r["doc_id"], r) == r
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(plain(t), plain(edited))) < 1e-12
        assert abs(r["near_next"] - jaccard(plain(t), plain(nxt))) < 1e-12


def test_edit_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "c"), (1, "c")], "doc_id bigint, text string")
    rows = W.compare_with_edits(df).collect()
    assert len(rows) == 4
    one = W.compare_with_edits(df.limit(1)).collect()
    assert one[0]["near_next"] == 1.0
    assert W.compare_with_edits(df.where("false")).collect() == []
