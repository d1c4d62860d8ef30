import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import lexical as X

DOCS = "doc_id bigint, text string, n string, score int, term int"


def terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(X.TERM, low)


def plain(docs, questions, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total, df = len(tf), sum(sum(c.values()) for _, c in tf), Counter(w for _, c in tf for w in c)
    out = []
    for q, t in questions:
        asked, found = Counter(terms(t)), []
        for i, c in tf:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(q, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    stock = [f"w{k}" for k in range(300)] + ["Straße", "ΑΒ", "漢字", "don't", "Wörter"]
    pick = lambda n: " ".join(stock[min(int(rng.paretovariate(0.6)), len(stock)) - 1] for _ in range(n))
    docs = [(k, pick(rng.choice([1, 3, 20, 100, 400]))) for k in range(300)]
    docs += [(None, docs[5][1]), (400, None), (401, ""), (402, "... --"), (7, docs[7][1]), (7, docs[7][1]), (7, pick(40)), (403, "w1 " * 30_000), (404, "\x00w1\x7fW2_w3")]
    docs += [(500 + k, "tie tie other") for k in range(60)]
    return rng, docs, pick


def collect(df):
    return sorted((tuple(r) for r in df.select("qid", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_equals_plain_version(spark, k):
    rng, docs, pick = corpus()
    questions = [(q, pick(rng.choice([1, 4, 30]))) for q in range(25)] + [(30, "tie"), (31, "tie TIE w1 w1"), (32, "absent words"), (33, None), (34, ""), (35, "w1"), (36, pick(3000)), (-1, "漢字 Straße αβ ΑΒ")]
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in docs], DOCS).repartition(4)
    q = spark.createDataFrame(questions, "qid bigint, text string")
    assert collect(X.lexical_topk(df, q, k)) == plain(docs, questions, k)


def test_question_blocks_and_narrow_signatures_change_nothing(spark, monkeypatch):
    """Many blocks of questions, blocks of few documents, signatures so full that bounds exclude little."""
    rng, docs, pick = corpus()
    questions = [(q, pick(rng.choice([2, 10]))) for q in range(30)]
    for name, value in (("QUESTION_TERMS", 20), ("BLOCK", 1 << 11), ("BITS", 1)):
        monkeypatch.setattr(X, name, value)
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in docs], DOCS).repartition(2)
    assert collect(X.lexical_topk(df, spark.createDataFrame(questions, "qid bigint, text string"), 5)) == plain(docs, questions, 5)


def test_bounds_hold_and_exclude(spark):
    """No document's bound is below its score, and at the k-th score nearly all documents fall out unread."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").selectExpr("item_id qid", "text")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = X.signature_index(df)
    asked = [(r["qid"], r["text"]) for r in items.collect()]
    best = plain(docs, asked, 20)
    least = {q: s for q, r, _, s in best if r == 20}
    tf = {i: Counter(terms(t)) for i, t in docs}
    n, total, freq = sum(bool(c) for c in tf.values()), sum(sum(c.values()) for c in tf.values()), Counter(w for c in tf.values() for w in c)
    weighted = [(q, w.encode(), times, math.floor(1000 * math.log((2 * n + 2) / (2 * freq[w] + 1))), least.get(q, 1)) for q, t in asked for w, times in Counter(terms(t)).items() if freq[w]]
    blocks = X._question_blocks(spark.createDataFrame(weighted, "qid bigint, term binary, qtf bigint, w bigint, least bigint"), 10**6)
    left = X._bounds(index, blocks, None).collect()
    bound = {(r["qid"], r["id"]): r["bound"] for r in left}
    assert all(bound[q, i] >= s for q, _, i, s in best)
    assert len(left) < 0.2 * len(docs) * len(asked)
    assert len(left) >= len(best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    q = spark.createDataFrame([(1, "w1")], "qid bigint, text string")
    assert X.lexical_topk(none, q).collect() == []
    some = spark.createDataFrame([(1, "w1", "n", 1, 2)], DOCS)
    assert X.lexical_topk(some, q.where("qid = 0")).collect() == []
    assert len(X.lexical_topk(some, q).collect()) == 1
