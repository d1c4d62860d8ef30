import random

from quillspark.llm import mixing as M


def targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Plain water filling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= set(over)


def rows(seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(3000):
        s = rng.choice(["hot"] * 6 + ["a", "b", "ä", None, "z"])
        out.append((i, s, " ".join(["w"] * int(rng.paretovariate(1.2) * 5))))
    return [*out, (4000, "a", None), (4001, "a", ""), (4002, "only empty", " \t"), (4000, "a", None)]


def test_targets_and_words_taken(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, source string, text string")
    text = {i: t for i, _, t in rows()}
    got = M.plan_mix(df).collect()
    size, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = r["source"]
        assert r["size"] == len((text[r["doc_id"]] or "").split()) and r["copies"] in (0, 1, 2)
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s], largest[s] = r["target"], max(largest.get(s, 0), r["size"])
    assert len(got) == 3004
    want = targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    again = {(r["doc_id"], r["copies"]) for r in M.plan_mix(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_mix_emits_copies_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "x y", 7), (2, "b", "x", 8)], "doc_id bigint, source string, text string, size int").withColumnRenamed("size", "mix_rank")
    out = M.mix_sources(df)
    assert out.columns == df.columns
    plan = {r["doc_id"]: r["copies"] for r in M.plan_mix(df).collect()}
    assert out.count() == sum(plan.values())
    assert M.mix_sources(df.where("false")).collect() == []


def test_the_mix_is_the_plan_also_for_equal_rows(spark):
    """Rows that are wholly equal share their copies; whatever column tells rows apart, reruns agree."""
    data = [(i % 7, "a" if i % 3 else None, "x " * (i % 4), float(i % 2), {"k": i % 2}) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, text string, w double, mix_copy map<string,int>")
    count = lambda d: sorted((r["doc_id"], r["source"] or "", r["text"], r["w"], str(r["mix_copy"])) for r in d.collect())
    got = count(M.mix_sources(df))
    assert got == count(M.mix_sources(df.repartition(5)))
    plan = M.plan_mix(df)
    assert "text" not in plan.columns and plan.count() == 400 and len(got) == plan.agg({"copies": "sum"}).first()[0]
    words = sum(len(r[2].split()) for r in got)
    assert abs(words - 1.5 * sum(len(t.split()) for _, _, t, _, _ in data)) <= 2 * 2 * 3
