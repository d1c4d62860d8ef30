import random

import numpy as np
import xxhash

from quillspark.llm import simhash as S


def plain_fp(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    out = 0
    for b in range(64):
        ones = sum(xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1 for s in sh)
        out |= (2 * ones > len(sh)) << b
    return out


def components(ids, fps, bits):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(x[i] ^ x) <= bits)
        for j in near:
            up[root(int(j))] = root(i)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6)))
    rows = []
    for _ in range(120):
        w = [word() for _ in range(rng.randrange(1, 160))]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            rows.append(" ".join(v))
    return [*rows, None, "", " \t\n ", "One", "one", "One two", "x " * 5000, "É é"]


def test_contract_against_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: (r["fps"][0] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], 3, 3).collect()}
    fps = [plain_fp(t) for _, t in rows]
    assert [got[i][0] for i, _ in rows] == fps
    assert [got[i][1] for i, _ in rows] == components([i for i, _ in rows], fps, 3)


def cluster(rng, n, weak):
    base = rng.getrandbits(64)
    spots = rng.sample(range(64), weak)
    return {base ^ sum(1 << b for b in rng.sample(spots, rng.randrange(6))) for _ in range(n)}


def check_links(spark, bits, monkeypatch=None, small=None, large=None):
    rng = random.Random(bits)
    fps = sorted(cluster(rng, 400, 24) | cluster(rng, 60, 40) | {rng.getrandbits(64) for _ in range(300)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    if small is not None:
        monkeypatch.setattr(S, "SMALL", small)
        monkeypatch.setattr(S, "LARGE", large)
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(signed)], "table int, node bigint, fp bigint")
    comp = {r["node"]: r["component"] for r in S.connected_components(S.fingerprint_links(df, bits)).collect()}
    want = components(list(range(len(fps))), fps, bits)
    assert [comp.get(i, i) for i in range(len(fps))] == want


def test_links_are_exact(spark):
    check_links(spark, 3)


def test_links_of_five_bits_are_exact(spark):
    check_links(spark, 5)


def test_crowded_signatures_give_the_same_components(spark, monkeypatch):
    check_links(spark, 3, monkeypatch, 4, 100_000)


def test_very_crowded_signatures_give_the_same_components(spark, monkeypatch):
    check_links(spark, 3, monkeypatch, 4, 30)


def test_drop_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "a b c d e f", "y"), (9, "quite another text it is here", None), (None, None, None), (None, "", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fps string")
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == [(-1, ""), (3, "a b c d e f"), (9, "quite another text it is here")]
    assert S.drop_near_duplicates(df.where("false")).collect() == []
