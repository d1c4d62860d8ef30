import random

import xxhash
from pyspark.sql import functions as F

from quillspark.llm import linededup as L

DOCS = "doc_id bigint, text string, source string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def plain(rows):
    """The documented rule in plain Python: chunks, first occurrence, byte comparison, extension, removal."""
    h64 = lambda s: int.from_bytes(xxhash.xxh64(s.encode(), seed=42).digest(), "big", signed=True)
    docs = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        n = [len(x.replace("\t", " ").split(" ")) if x else 1 for x in lines]
        hh = [h64(x) % L.PRIME for x in lines]
        starts = []
        for k in range(len(lines)):
            if k == 0:
                starts.append(k)
                continue
            r = hh[k - 1] + ((hh[k - 2] if k >= 2 else 0) * L.BASE) % L.PRIME
            b = int.from_bytes(xxhash.xxh64(r.to_bytes(8, "little"), seed=42).digest(), "big", signed=True)
            if n[k] >= L.LONG_LINE or n[k - 1] >= L.LONG_LINE or b % L.DIVISOR == 0:
                starts.append(k)
        ends = [*starts[1:], len(lines)]
        docs[(i, h64(t or ""))] = (lines, list(zip(starts, ends, strict=True)), n)
    where = {}
    for d in sorted(docs):
        lines, chunks, n = docs[d]
        for a, b in chunks:
            if b - a > 1 or n[a] >= L.LONG_LINE:
                where.setdefault("\n".join(lines[a:b]), []).append((d, a, b))
    gone = {d: set() for d in docs}
    for places in where.values():
        d0, a0, b0 = places[0]
        l0, c0, _ = docs[d0]
        for d, a, b in places[1:]:
            ls, cs, _ = docs[d]
            side = lambda chunks, at, down: next(((x, y) for x, y in chunks if (x == at if down else y == at)), (0, 0))
            up, up0 = side(cs, a, False), side(c0, a0, False)
            dn, dn0 = side(cs, b, True), side(c0, b0, True)
            n_up = n_dn = 0
            for x, y in zip(reversed(ls[up[0] : up[1]]), reversed(l0[up0[0] : up0[1]]), strict=False):
                if x != y:
                    break
                n_up += 1
            for x, y in zip(ls[dn[0] : dn[1]], l0[dn0[0] : dn0[1]], strict=False):
                if x != y:
                    break
                n_dn += 1
            gone[d] |= set(range(a - n_up, b + n_dn))
    return {d[0]: "\n".join(x for k, x in enumerate(docs[d][0]) if k not in gone[d]) for d in docs}


def corpus():
    rng = random.Random(5)
    passage = "\n".join(words(rng, 12) for _ in range(6))
    one_line = words(rng, 60)
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randrange(3, 18)) for _ in range(rng.randrange(2, 9))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), one_line)
        rows.append((i, "\n".join(lines)))
    return rows, passage, one_line


def test_equals_plain_version_and_catches_passages(spark):
    rows, passage, one_line = corpus()
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, rows[1][1]), (74, rows[1][1])]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)).collect()}
    want = plain(rows)
    assert got.pop(70) is None
    want.pop(70)
    assert got == want
    assert sum(one_line in (t or "") for t in got.values()) == 1
    assert sum(passage in (t or "") for t in got.values()) == 1
    clean = [i for i, t in rows if t and passage not in t and one_line not in t and i not in (1, 73, 74)]
    assert all(got[i] == dict(rows)[i] for i in clean)


def test_edges(spark):
    empty = L.dedup_lines(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "source", "n_removed"]
    long = "\n".join(f"{i} " * 25 for i in range(3000))
    df = spark.createDataFrame([(None, long, "a"), (1, long, "b"), (1, long, "b"), (2, long + "\nend", None)], DOCS).withColumn("n_removed", F.lit(9)).withColumn("lines", F.lit("x"))
    got = {(r["doc_id"], r["n_removed"], r["lines"]) for r in L.dedup_lines(df).collect()}
    assert got == {(1, 0, "x"), (2, 3000, "x"), (None, 3000, "x")}


def test_passages_of_short_lines_go_from_end_to_end(spark, tmp_path):
    """Passages of over 50 words in lines of under 20, among foreign short lines: the first copy stays, no line of another does."""
    from quillspark.llm.queries import QUERIES

    rng = random.Random(17)
    rows, passages, foreign = [], [], []
    for n_lines, n_words in [(3, 18), (4, 14), (5, 12), (6, 10), (8, 8), (10, 6)] * 10:
        passage = [words(rng, n_words) for _ in range(n_lines)]
        passages.append(passage)
        for _ in range(3):
            head, tail = ([words(rng, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 5))] for _ in range(2))
            foreign.append((len(rows), head + tail))
            rows.append((len(rows), "\n".join(head + passage + tail), "s"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_line_dedup"](spark, f"file://{tmp_path}").collect()}
    left = {i: r["text"].split("\n") for i, r in got.items()}
    for p, passage in enumerate(passages):
        assert "\n".join(passage) in got[3 * p]["text"]
    assert [(i, got[i]["n_removed"], left[i]) for i, _ in foreign if i % 3] == [(i, len(passages[i // 3]), own) for i, own in foreign if i % 3]


def test_whole_runs_equal_a_plain_search(spark):
    """Few different lines, so that runs overlap, repeat within a document and end anywhere."""
    rng = random.Random(23)
    stock = [words(rng, n) for n in (1, 2, 4, 7, 11, 15, 19, 20, 26)] + [""]
    docs = {i: [rng.choice(stock) if rng.random() < 0.8 else words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 25))] for i in range(80)}
    runs = {}
    for i in sorted(docs):
        for a in range(len(docs[i])):
            for b in range(a + 1, len(docs[i]) + 1):
                if sum(len(x.split(" ")) for x in docs[i][a:b]) >= L.LONG_LINE:
                    runs.setdefault(tuple(docs[i][a:b]), []).append((i, a, b))
    must = {(i, k) for places in runs.values() for i, a, b in places[1:] for k in range(a, b)}
    df = spark.createDataFrame([(i, "\n".join(x), "s") for i, x in docs.items()], DOCS)
    got = {(r["line_id"], k) for r in L.repeated_passages(df).collect() for s in r["drops"] for k in range(s["start"], s["start"] + s["n"])}
    assert must <= got
    first = {}
    for i in sorted(docs):
        for k, x in enumerate(docs[i]):
            first.setdefault(x, (i, k))
    assert not got & set(first.values())


def test_edges_of_whole_runs(spark):
    """What the registered query uses: nulls, equal rows, no rows, columns of the same names, many short lines."""
    rng = random.Random(29)
    run = lambda df: L.dedup_lines(df, whole=True)
    assert run(spark.createDataFrame([], DOCS)).collect() == []
    passage = "\n".join(words(rng, 9) for _ in range(4))
    long = "\n".join(f"w{i}" for i in range(3000))
    rows = [(None, passage, "a"), (1, passage, "b"), (1, passage, "b"), (2, f"own line\n{passage}", None), (3, None, "c"), (4, "", "d"), (5, long, "e"), (6, "first\n" + long, "f")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"lines": F.lit("x"), "line_id": F.lit(1), "n_removed": F.lit(7)})
    out = run(df)
    assert out.columns == ["doc_id", "text", "source", "lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"], r["lines"]) for r in out.collect()), key=str)
    assert got == sorted([(None, "", 4, "x"), (1, passage, 0, "x"), (1, passage, 0, "x"), (2, "own line", 4, "x"), (3, None, 0, "x"), (4, "", 0, "x"), (5, long, 0, "x"), (6, "first", 3000, "x")], key=str)
