import random

from pyspark.sql import functions as F

from quillspark.operators import bm25


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    stock = [a + b for a in ("alpha", "beta", "gamma", "delta", "zeta") for b in ("one", "two", "red", "sky", "sea", "ion", "oak", "elm")]
    pick = lambda n: " ".join(stock[min(int(rng.paretovariate(0.4)) - 1, len(stock) - 1)] + ("" if rng.random() < 0.8 else rng.choice("abcdefgh") * 3) for _ in range(n))
    return [(i, pick(rng.choice([3, 30, 90]))) for i in range(n)], pick


def counts(store):
    return {(r["term"], r["df"]) for r in store.table("counts").collect()}


def posts(store):
    return {(r["term"], p["key"], p["tf"], p["dl"]) for r in store.index().blocks.collect() for p in r["posts"]}


def test_changes_equal_a_rebuild(spark, tmp_path):
    """Inserts, replacements, deletions, a text without terms, a key that isn't there."""
    rows, pick = corpus(spark, 120)
    frame = lambda rs: spark.createDataFrame(rs, "key bigint, text string")
    now, store = dict(rows), bm25.build_store(frame(rows), f"file://{tmp_path}/0")
    store.index()
    rng = random.Random(4)
    for step in range(1, 4):
        gone = rng.sample(sorted(now), 9)
        come = [(500 + step * 10 + k, pick(20)) for k in range(5)] + [(k, pick(10)) for k in gone[:3]] + [(900 + step, None)]
        store = bm25.change_store(store, spark.createDataFrame([(k,) for k in [*gone, -1]], "key bigint"), frame(come), f"file://{tmp_path}/{step}")
        now = {k: t for k, t in now.items() if k not in gone} | dict(come)
    fresh = bm25.build_store(frame(sorted(now.items())), f"file://{tmp_path}/fresh")
    assert store.table("totals").select("n", "tokens").first() == fresh.table("totals").select("n", "tokens").first()
    assert counts(store) == counts(fresh) and posts(store) == posts(fresh)
    q = frame([(1, pick(6)), (2, pick(2))]).withColumnRenamed("key", "query_id")
    top = lambda s: sorted((r["query_id"], r["key"], r["rank"], round(r["score"], 9)) for r in bm25.bm25_topk(q, s.index(), 10).collect())
    assert top(store) == top(fresh)


def test_the_store_of_a_state_is_shared(spark):
    rows, _ = corpus(spark, 50, 9)
    a = spark.createDataFrame(rows, "key bigint, text string")
    first, again = bm25.open_store(a), bm25.open_store(a.orderBy(F.desc("key")))
    changed = bm25.open_store(a.withColumn("text", F.when(F.col("key") == 7, F.reverse("text")).otherwise(F.col("text"))))  # same lengths and keys
    assert first.path == again.path != changed.path and first.has("counts") and changed.has("counts")


def test_pruned_topk_equals_all_scores_and_reads_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "SEED", 2)
    monkeypatch.setattr(bm25, "BUCKET", 64)
    share = []
    for n in (300, 3000):
        rows, pick = corpus(spark, n, 21)
        index = bm25.build_store(spark.createDataFrame(rows, "key bigint, text string"), f"file://{tmp_path}/{n}").index()
        questions = [(q, pick(8) + " alphaonehhh") for q in range(12)] + [(20, ""), (21, None), (22, "unknownword"), (23, "alphaone alphaone")]
        q = spark.createDataFrame(questions, "query_id bigint, text string")
        top = lambda df: sorted((r["query_id"], r["key"], r["rank"], round(r["score"], 6)) for r in df.collect())  # noqa: B023, E731
        assert top(bm25.bm25_topk(q, index, 5)) == top(bm25._top(bm25.bm25_scores(q, index), 5))
        scope = spark.createDataFrame([(i, k) for i, _ in questions for k in range(0, n, 3)], "query_id bigint, key bigint")
        assert top(bm25.bm25_topk(q, index, 5, scope)) == top(bm25._top(bm25.bm25_scores(q, index).join(scope, ["query_id", "key"], "left_semi"), 5))
        r = bm25.bm25_read_share(q, index, 5).agg(F.sum("n_read") / F.sum("n_postings")).first()[0]
        share.append(r)
    assert max(share) < 0.7


def test_scores_in_small_blocks(spark, tmp_path, monkeypatch):
    """Many blocks of sections and questions, few pairs at a time, string keys; building blocks moves no row for a posting."""
    for name, n in (("BUCKET", 16), ("SECTIONS", 50), ("PAIRS", 300), ("QUESTION_TERMS", 40)):
        monkeypatch.setattr(bm25, name, n)
    rows, pick = corpus(spark, 400, 5)
    store = bm25.build_store(spark.createDataFrame([(f"é{k}", t) for k, t in rows], "key string, text string"), f"file://{tmp_path}/s")
    assert "Generate" not in bm25._blocks(store.table("forward"))._jdf.queryExecution().toString()
    q = spark.createDataFrame([(i, pick(9)) for i in range(25)], "query_id bigint, text string")
    top = lambda df: sorted((r["query_id"], r["key"], r["rank"], round(r["score"], 6)) for r in df.collect())
    assert top(bm25.bm25_topk(q, store.index(), 7)) == top(bm25._top(bm25.bm25_scores(q, store.index()), 7))


def test_questions_that_find_nothing_in_a_block(spark, tmp_path, monkeypatch):
    """Each question is scored alone, and most blocks have none of its terms."""
    for name, n in (("BUCKET", 1), ("SECTIONS", 1), ("PAIRS", 1)):
        monkeypatch.setattr(bm25, name, n)
    words = ["alpha", "beta", "gamma", "delta", "zeta", "theta"]
    index = bm25.build_store(spark.createDataFrame([(i, f"{w} word") for i, w in enumerate(words)], "key bigint, text string"), f"file://{tmp_path}/s").index()
    q = spark.createDataFrame(list(enumerate(words)), "query_id bigint, text string")
    assert sorted((r["query_id"], r["key"], r["rank"]) for r in bm25.bm25_topk(q, index, 3).collect()) == [(i, i, 1) for i in range(6)]


def test_blocks_give_back_only_what_can_be_among_the_best(spark, tmp_path, monkeypatch):
    """not k sections of every block for every question."""
    for name, n in (("BUCKET", 8), ("SECTIONS", 25)):
        monkeypatch.setattr(bm25, name, n)
    rows, pick = corpus(spark, 600, 3)
    index = bm25.build_store(spark.createDataFrame(rows, "key bigint, text string"), f"file://{tmp_path}/s").index()
    q = spark.createDataFrame([(i, pick(9)) for i in range(20)], "query_id bigint, text string")
    assert bm25._pruned(q, index, 5, None).count() <= 3 * 20 * 5
