import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import crosstok as C

DOCS = "doc_id bigint, text string, links int, part string"
ODD = ["<|endoftext|> a<|endoftext|>b", "a ▁ b", " lead  two\n\n x \n y", "\x00\x1c a\x1cb", "don't I'll　x y", "é" * 5 + " 😀", "<s> </s> <unk> <0x41>", "\n", " ", "a b", "tail \n", "  ", "ﬁ ℌ x", "x" * 3000, "αβγ 漢字 и так"]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(texts, tokenizers):
    """Both whole texts' tokens, all overlapping pairs by their byte ranges, groups by common ends, counts over all texts."""
    first, second = tokenizers
    shown = {chr(b) if 33 <= b < 127 or 161 <= b < 173 or b > 173 else None: b for b in range(256)}
    spare = iter(range(256, 512))
    shown |= {chr(next(spare)): b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)}
    out = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        a_raw = [bytes(shown[c] for c in first.id_to_token(i)) for i in a]
        piece = [second.id_to_piece(i) for i in b]
        b_raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in piece]
        if not t or b"".join(a_raw) != (" " + t).encode() or b"".join(b_raw) != (" " + t).encode():
            out.append(([], [], [], []))
            continue
        span = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))]
        sa, sb = span(a_raw), span(b_raw)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([x for x, (_, e) in zip(a, sa, strict=True) if lo < e <= hi], [x for x, (_, e) in zip(b, sb, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, (p, q) in zip(a, sa, strict=True) for y, (r, s) in zip(b, sb, strict=True) if p < s and r < q]
        out.append((a, b, groups, links))
    held = Counter(p for *_, links in out for p in set(links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [(len(a), len(b), len(g), len(ln), sum(held[p] == top[p[0]] for p in ln), sum(held[p] for p in ln), hashlib.sha256(text(g).encode()).hexdigest() if g else "", text(g)) for a, b, g, ln in out]


def corpus(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(60).collect()]
    return [*texts, *ODD, None, "", texts[0], texts[0]]


def test_equals_plain_version_with_edges(spark, tokenizers):
    texts = corpus(spark)
    rows = [(None if k == 3 else 7 if k == 4 else k, t, k, "p") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = sorted(((i, *w[:7]) for (i, *_), w in zip(rows, plain(texts, tokenizers), strict=True)), key=str)
    for part_links in (1, 500, C.PART_LINKS):  # parts of a document, of some, of all
        got = C.score_alignments(df, ["doc_id"], part_links=part_links).select("doc_id", *cols).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    full = {r["links"]: r for r in C.align_texts(df.withColumnRenamed("links", "k"), ["k"]).withColumnRenamed("links", "found").withColumnRenamed("k", "links").collect()}
    for k, w in enumerate(plain(texts, tokenizers)):
        assert (len(full[k]["a_ids"]), len(full[k]["b_ids"]), full[k]["n_groups"], len(full[k]["found"]), full[k]["groups"]) == (*w[:4], w[7])


def test_long_texts_go_in_pieces(monkeypatch, tokenizers):
    rng = random.Random(1)
    text = "".join(rng.choice(["the ", "x", "\n", " y ", "zebra", "é "]) for _ in range(3000))
    pair = C._pair(None, None)
    whole = next(C.aligned(pair, [text]))
    monkeypatch.setattr(C, "PIECE", 64)
    cut = next(C.aligned(pair, [text]))
    assert len(C._pieces(text)) > 50 and b"".join(cut.groups) == b"".join(whole.groups) and (cut.links == whole.links).all() and cut.n_groups == whole.n_groups
    assert whole.a.tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids and whole.b.tolist() == tokenizers[1].encode(text)
    assert C._sha256(cut.groups) == hashlib.sha256(b"".join(whole.groups)[:-1]).hexdigest()


def test_diagonal_runs():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 60)
        ea, eb = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(1, n + 1))}) for _ in range(2))
        la, lb = C.align(ea, eb)
        spans = lambda e: list(zip([0, *e], e, strict=False))
        assert list(zip(la, lb, strict=True)) == [(i, j) for i, (p, q) in enumerate(spans(ea)) for j, (r, s) in enumerate(spans(eb)) if p < s and r < q]
    assert C.align(list(range(1, 1000)), list(range(1, 1000))) == (list(range(999)), list(range(999)))


def test_empty_table_and_absent_ids(spark):
    assert C.score_alignments(spark.createDataFrame([], DOCS), ["doc_id"]).collect() == []
    got = C.score_alignments(spark.createDataFrame([(None, None, 1, "a"), (None, None, 1, "a")], DOCS), ["doc_id", "part"]).collect()
    assert [(r["doc_id"], r["part"], r["n_links"], r["groups_sha256"]) for r in got] == [(None, "a", 0, "")] * 2
    assert C.align_texts(spark.createDataFrame([], DOCS), ["doc_id"]).where(F.col("n_groups") > 0).collect() == []
