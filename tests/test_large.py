"""What grows with the input: rows that move between tasks, sides that are broadcast, rows that Python holds at once."""

import numpy as np

from quillspark.operators import catalog, convert, split
from quillspark.operators import vectors as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vector_searches_move_no_pairs(spark):
    x = np.random.default_rng(2).standard_normal((300, 64))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key bigint, embedding array<float>")
    q = v.where("key % 50 = 0").withColumnRenamed("key", "query_id")
    assert "Join" not in plan(V.lsh_topk(q, v, 5))
    more, _ = V._probes(q, V.inverted_lists(v), 5, 2, 1.0, 6)
    assert more.count() == q.count()


def test_pages_are_joined_without_broadcasts_and_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(convert, "TOKENS", 3)
    html = "<body><article><p>One text of more than thirty characters, {}</p><ol><li>a<li>b</ol></article></body>"
    pages = spark.createDataFrame([(i, f"u{i}", html.format(i)) for i in range(7)] + [(7, "u7", None)], "page_id bigint, url string, html string").coalesce(1)
    out = convert.html_to_text(pages)
    assert "BroadcastHashJoin" not in plan(out)
    found = {r["page_id"]: r["text"] for r in out.collect()}
    assert found[7] == "" and all(f"characters, {i}" in found[i] and "2. b" in found[i] for i in range(7))


def test_python_takes_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(convert, "CHARS", 5)
    monkeypatch.setattr(split, "ROWS", 2)
    texts = ["1.2 heading here\nline", None, "", "abc\n12\n", "x" * 900]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    out = convert.structure_pdf_text(d)
    assert "MapInArrow" in plan(out) and "MapInArrow" in plan(split.index_documents(d))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: convert.structure_pdf_lines(t) for i, t in enumerate(texts)}
    assert [(r["doc_id"], r["chunk_id"], len(r["chunk"] or "")) for r in split.index_documents(d).orderBy("doc_id", "chunk_id").collect()] == [(0, 0, 21), (1, 0, 0), (2, 0, 0), (3, 0, 7), (4, 0, 500), (4, 1, 450)]


def test_no_task_has_all_pairs_of_a_question(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "none")], "query_id bigint, text string")
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha"), (3, "gamma")], "doc_id bigint, name string")
    out = catalog.match_docs(q, d)
    assert "Window" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3), (2, 1, 2), (2, 2, 2)]


def test_a_page_moves_once_and_is_not_stored(spark, monkeypatch):
    """Tables, code, lists, line breaks and hidden parts come from expressions, not from joins of a page's tokens."""
    monkeypatch.setattr(convert, "stage_table", None, raising=False)
    html = "<body><nav>gone</nav><article role=main><h1>One heading of more than thirty characters</h1><ol><li>a<li>b <i>c<br>d</i></ol><table><tr><th>k<th>v<tr><td>1<tr></table><pre>x\n y</pre></article></body>"
    out = convert.html_to_text(spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string"))
    assert plan(out).count("Exchange hashpartitioning") <= 4 and plan(out).count("Join") == 1
    assert out.first()["text"] == "# One heading of more than thirty characters\n\n1. a\n\n2. b c\nd\n\n| k | v |\n| --- | --- |\n| 1 |  |\n\n```\nx\ny\n```"
