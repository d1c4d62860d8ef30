import random

import corpus_pipeline as C

from quillspark.llm import nearcopies as N

DOCS = "doc_id bigint, text string, source string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(5))


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = word(rng)
    return " ".join(w)


def test_the_stage_finds_copies_by_band_and_no_others(spark):
    rng = random.Random(31)
    rows, bands = [], {0.6: [], 0.8: [], 0.9: []}
    for _ in range(500):
        base = " ".join(word(rng) for _ in range(rng.randrange(120, 400)))
        copy = edited(rng, base, rng.randrange(1, 1 + len(base.split()) // 25))
        j = jaccard(base, copy)
        i = len(rows)
        rows += [(i, base, "s"), (i + 1, copy, "s")]
        bands[0.9 if j >= 0.9 else 0.8 if j >= 0.8 else 0.6].append(i + 1)
    assert all(len(x) >= 50 for x in bands.values())
    left = {r["doc_id"] for r in C.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    gone = {b: sum(i not in left for i in x) / len(x) for b, x in bands.items()}
    assert gone[0.9] >= 0.99 and gone[0.8] >= 0.98 and gone[0.6] == 0
    assert all(i in left for i in range(0, len(rows), 2))


def test_groups_equal_brute_force_also_when_crowded(spark, monkeypatch):
    rng = random.Random(37)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(6):
        t = " ".join(word(rng) for _ in range(90))
        for _ in range(25):  # a walk away from the first text
            texts.append(t)
            t = edited(rng, t, 1)
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard((a or "").lower(), (texts[j] or "").lower()) >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = {root(i) for i in range(len(texts))}
    df = spark.createDataFrame([(i, t, "s", "mine", -1) for i, t in enumerate(texts)], DOCS + ", SIM_ID string, node int")
    for small in (64, 3):
        monkeypatch.setattr(N, "SMALL", small)
        got = N.drop_near_copies(df, tables=8).collect()
        assert {r["doc_id"] for r in got} == want and all((r["SIM_ID"], r["node"], r["text"]) == ("mine", -1, texts[r["doc_id"]]) for r in got)
    same = spark.createDataFrame([(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (None, "a b c d e f", "z")], DOCS)
    assert [r["doc_id"] for r in N.drop_near_copies(same).collect()] == [3]
    assert N.drop_near_copies(df.where("false")).collect() == []


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Sets that share one key: a few similar pairs among many that share a long passage and are not similar."""
    rng = random.Random(41)
    passage = " ".join(word(rng) for _ in range(100))
    texts = [f"{passage} {' '.join(word(rng) for _ in range(40))}" for _ in range(60)]
    texts += [edited(rng, t, 1) for t in texts[::7]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node bigint, text string")
    sets = N.stage_table(N._sets(docs, 5))
    members = sets.selectExpr("1L key", "node", "size(hashes) size")
    monkeypatch.setattr(N, "SMALL", 4)
    got = {(r["a"], r["b"]) for r in N.set_links(members, sets, 0.8).collect()}
    assert {(min(p), max(p)) for p in got} == {(a, b) for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8}


def test_random_texts_make_few_candidates(spark):
    """Chance pairs must not grow with the square of the documents: no unrelated text is compared at all here."""
    rng = random.Random(43)
    rows = [(i, " ".join(word(rng) for _ in range(rng.randrange(20, 200)))) for i in range(3000)]
    prints = spark.createDataFrame([(i, 1, N.word_prints(t, N.TABLES)) for i, t in rows], "node bigint, size int, fps array<bigint>").selectExpr("node", "size", "posexplode(fps) as (table, fp)")
    assert N.shared_only(N.signatures(prints, 3)).count() <= 30


def test_rare_shingles_equal_a_plain_order(spark):
    """Keys and places in the order by (number of sets, hash), those of one set alone first, of all but the last 0.8 of a set."""
    rng = random.Random(47)
    held = {i: sorted(rng.sample(range(60), rng.randrange(1, 25)) + [1000 + i]) for i in range(20)}
    sets = spark.createDataFrame(list(held.items()), "node bigint, hashes array<bigint>")
    nodes = sets.selectExpr("node", "array(node) bits")
    n = {h: sum(h in s for s in held.values()) for s in held.values() for h in s}
    want = set()
    for node, s in held.items():
        last = len(s) - -(-len(s) * 4 // 5) + 1
        want |= {(h, at, node, len(s)) for at, h in enumerate(sorted(s, key=lambda h: (n[h], h))[:last]) if n[h] > 1}
    assert {(r["key"], r["pos"], r["node"], r["size"]) for r in N.rare_shingles(nodes, sets, 0.8).collect()} == want


def test_hubs_are_met_once_for_each_set(spark, monkeypatch):
    """Sets that share many keys: a row for each set and not for each of its keys, and no link is lost."""
    rng = random.Random(53)
    texts = []
    for _ in range(8):
        t = " ".join(word(rng) for _ in range(90))
        for _ in range(5):
            texts.append(t)
            t = edited(rng, t, 2)
    sets = N.stage_table(N._sets(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 5))
    members = sets.selectExpr("explode(sequence(1L, 12L)) key", "node", "size(hashes) size")
    met, real = [], N._hub_links
    monkeypatch.setattr(N, "_hub_links", lambda m, *a: met.append(m.count()) or real(m, *a))
    for small in (64, 4):
        monkeypatch.setattr(N, "SMALL", small)
        met.clear()
        links = {tuple(sorted((r["a"], r["b"]))) for r in N.set_links(members, sets, 0.8).collect()}
        assert met[0] == len(texts)
        assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
        part = list(range(len(texts)))
        for a, b in sorted(links) * len(texts):
            part[a] = part[b] = min(part[a], part[b])
        assert all(part[a] == part[b] for b in range(len(texts)) for a in range(b) if jaccard(texts[a], texts[b]) >= 0.8)


def test_shingles_are_ordered_within_their_row(spark):
    sets = spark.createDataFrame([(i, list(range(i, i + 20))) for i in range(20)], "node bigint, hashes array<bigint>")
    out = N.rare_shingles(sets.selectExpr("node", "array(node) bits"), sets, 0.8)
    assert "Join [key" not in out._jdf.queryExecution().executedPlan().toString()
