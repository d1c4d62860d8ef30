import random

from pyspark.sql import functions as F

from quillspark.llm import toxicity as T


def corpus(n=2500, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "sh", "re", "le"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(10, 200))]
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "lostra", "Scum"]) + rng.choice(["", "an", "ing", "é"])
        if low:
            w += ["&&&junk", "###junk"]
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels[:1500], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("tox_p", F.lit("x"))
    out = T.score_documents(df, known)
    assert out.columns == ["doc_id", "text", "tox_p", "p_quality", "p_toxic", "is_toxic"]
    got = {r["doc_id"]: (r["is_toxic"], r["p_quality"]) for r in out.collect()}
    test = labels[1500:]
    hit = sum(got[i][0] for i, _, t in test if t)
    false = sum(got[i][0] for i, _, t in test if not t)
    assert hit >= 0.95 * sum(t for *_, t in test) and false <= 0.01 * len(test)
    assert sum((got[i][1] > 0.5) == bool(q) for i, q, _ in test) >= 0.97 * len(test)
    again = {r["doc_id"]: r["p_quality"] for r in T.score_documents(df.repartition(3), known.repartition(2)).collect()}
    assert all(abs(again[i] - got[i][1]) < 1e-6 for i in again)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "p"), (None, "", "q"), (1, "a", "r"), (1, "a", "r")], "doc_id bigint, text string, is_toxic string")
    none = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = T.score_documents(docs, none).collect()
    assert len(out) == 4 and not any(r["is_toxic"] for r in out)
    rows, labels = corpus(400)
    known = spark.createDataFrame([*labels, labels[0], (10**9, 1, 1)], "doc_id bigint, quality int, toxic int")
    train = spark.createDataFrame([*rows, (None, "", ), (5, "x " * 30000)], "doc_id bigint, text string")
    chain = T.fit_chain(train, known, fit_rows=300)
    assert chain is not None and T.score_documents(docs.where("false"), none).collect() == []
    assert all(r["p_toxic"] is not None for r in chain.score(docs.drop("is_toxic")).collect())
