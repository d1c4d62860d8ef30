"""The registered queries over a whole small table, column by column against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from quillspark.llm import queries as Q
from tests_plain import pii_spans, targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return {r["doc_id"]: (r["text"] or "", r["source"]) for r in rows}


def run(spark, name, types):
    df = Q.QUERIES[name](spark, SF)
    assert [(c, t) for c, t in df.dtypes if c in dict(types)] == types and df.dtypes[: len(types)] == types
    return df.collect()


def test_op2_fingerprints_and_components(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op2_simhash", [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")])}
    fp = {}
    for i, (t, _) in docs.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: f"{v:016x}" for i, v in fp.items()} == {i: r["fingerprint"] for i, r in got.items()}
    up = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            low = min(up[b] for b in fp if (fp[a] ^ fp[b]).bit_count() <= 3)
            changed |= low < up[a]
            up[a] = min(up[a], low)
    assert up == {i: r["component_id"] for i, r in got.items()}


def test_op3_takes_systematically(spark, docs):
    got = run(spark, "op3_mix", [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")])
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in docs.items()}
    per, rows = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and (r["taken"] == 0 or r["taken"] % r["size"] == 0) and r["taken"] <= 2 * r["size"]
        per[docs[r["doc_id"]][1]] += r["size"]
        rows[docs[r["doc_id"]][1]].append(r)
    want = targets(per)
    for s, rs in rows.items():
        assert {r["source_size"] for r in rs} == {per[s]} and all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in rs)
        # one offset explains how many copies the k smallest documents have, for every k that ends a run of equal sizes
        low, high, step, copies = 0.0, 1.0, want[s] / per[s], 0
        rs.sort(key=lambda r: r["size"])
        for k, r in enumerate(rs, 1):
            copies += r["taken"] // r["size"] if r["size"] else 0
            if r["size"] and (k == len(rs) or rs[k]["size"] != r["size"]) and rs[0]["size"]:
                low, high = max(low, copies - k * step), min(high, copies + 1 - k * step)
        assert low <= high + 1e-5


def test_op5_rows_are_even(spark, docs):
    got = run(spark, "op5_shard", [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")])
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        b = docs[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    at = defaultdict(set)
    for r in got:
        at[docs[r["doc_id"]][0]].add(r["shard"])
    assert sum(len(v) > 1 for v in at.values()) <= 7  # equal texts are together but where a quota cuts


def test_op6_base_and_strings(spark, docs):
    got = run(spark, "op6_pii", [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")])
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = pii_spans(docs[r["doc_id"]][0])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(text.split(",") if text else []) <= set(spans)
        order = [("email", "ip", "card", "phone").index(s.split(":")[0]) * 10**9 + int(s.split(":")[1]) for s in spans]
        assert order == sorted(order)


def test_op7_payload_and_media(spark, docs):
    types = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    got = run(spark, "op7_flac", types)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        b = docs[r["doc_id"]][0].encode()
        p = b + b"\xff" * ((-len(b) % 576) if b else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["media_bytes"] > 42 and len(r["media_sha256"]) == 64
        letters = sum(65 <= x <= 90 or 97 <= x <= 122 for x in p) / len(p)
        assert abs(float(r["feature"].split(":")[2]) - letters) < 1e-6


def test_op8_pieces_and_sequences(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op8_pack", [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")])
    want, seqs = {}, defaultdict(list)
    for i, (text, _) in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k): (k * 4096, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 4096
    assert len(seqs) <= 1.03 * -(-sum(n for v in seqs.values() for _, n in v) // 4096) + 1


def test_op10_edits_and_likeness(spark, docs):
    types = [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    got = {r["doc_id"]: r for r in run(spark, "op10_winnow", types)}
    ids = sorted(docs)
    assert sorted(got) == ids
    by_text = defaultdict(set)
    for k, i in enumerate(ids):
        t, after = docs[i][0], docs[ids[(k + 1) % len(ids)]][0]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        if t == after:
            assert r["near_next"] == 1
        if len(t.split()) > 300 and t != after:
            assert r["near_edited"] > 0.1
    assert all(len(v) == 1 for v in by_text.values())
