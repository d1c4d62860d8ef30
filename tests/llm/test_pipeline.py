import random
import sys

import corpus_pipeline as C

from quillspark.llm.simhash import word_shingles


def shingles(text):
    return set(word_shingles(text, 5))


def make(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "on", "sh", "re"]) for _ in range(rng.randrange(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(400):
        lines = [" ".join(word() for _ in range(rng.randrange(4, 15))) for _ in range(rng.randrange(2, 8))]
        toxic = i % 8 == 0
        if toxic:
            lines[0] += " idiot scum moron idiots"
        elif i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        rows.append([i, "\n".join(lines), "en", f"src{i % 4}", 0])
        labels.append((i, 1 - (i % 9 == 0), int(toxic)))
    rows += [[1000 + k, rows[k * 2 + 1][1], "en", "src0", 0] for k in range(10)]
    for r in rows:
        r[4] = len(r[1])
    spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, labels, passage


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows, labels, passage = make(spark, f"file://{tmp_path}")
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, seen[-1], f"file://{tmp_path}")
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    toxic = {i for i, _, t in labels if t}
    assert {r["doc_id"] for r in seen[1].collect()} == set(text) - toxic
    lines = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert sum(passage in t for t in lines.values()) == 1
    copies = {text[i] for i in range(1000, 1010)}
    assert all(lines[i] == text[i] for i in lines if passage not in text[i] and text[i] not in copies)
    kept = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    sets = {i: shingles(t) for i, t in lines.items()}
    alike = lambda a, b: not (sets[a] or sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert set(kept) <= set(lines) and not any(alike(a, b) for a in kept for b in kept if a < b)
    assert all(any(alike(i, k) for k in kept if k <= i) for i in lines)
    mixed = seen[4].groupBy("doc_id").count().collect()
    assert {r["count"] for r in mixed} <= {1, 2} and {r["doc_id"] for r in mixed} <= set(kept)
    packed = seen[5].groupBy("doc_id").count().count()
    assert packed == len(mixed)
    assert C.run(spark, f"file://{tmp_path}").count() == seen[5].count()


def test_imports_stay_apart():
    import subprocess

    code = "import quillspark.plans, sys; assert not [m for m in sys.modules if m.startswith('quillspark.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)
