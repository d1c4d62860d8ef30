import json

from pyspark.sql import functions as F

from quillspark.operators import bm25, catalog, chatlog, convert, fusion, graph, quality, split, vectors
from quillspark.sources import files


def test_sections_and_chunks():
    body = "text " * 30
    doc = f"# Sys\n## Mod\n{body}\n### One\n{body}\n#### Sub\n{body}\n## Next\nshallow\n### Two\nshort"
    s = split.sections_of(doc, 3)
    assert [t for t, _ in s] == ["引言", "Sys > Mod > One"] and "shallow" in s[1][1]
    assert split.sections_of("tiny", 3) == [("全文", "tiny")] and split.sections_of(" tiny ", 3) == [("全文", " tiny ")]
    parts = split.sections_of("y" * 25_000, 3)
    assert [len(b) for _, b in parts] == [10_000, 10_000, 5_400] and parts[2][0] == "引言 (第 3 部分)"
    assert [len(c) for c in split.chunks_of("z" * 950)] == [500, 500, 50] and len(split.chunks_of("z" * 950, drop_contained_tail=True)) == 2
    assert [len(c) for c in split.chunks_of("z" * 501)] == [500, 51] and split.chunks_of("") == []
    text = "a" * 300 + "。" + "b" * 400
    assert split.chunks_of(text)[0] == "a" * 300 + "。"
    four = "\n".join(f"#### h{i}\n" + "\n".join(f"line {i} {j} " + "w" * 30 for j in range(6)) for i in range(3))
    out = split.chunks_of(four)
    assert out[0].startswith("#### h0") and all(f"line {i} 3" in "".join(out) for i in range(3))


def test_index_documents(spark):
    df = spark.createDataFrame([(1, "w " * 400), (2, None)], "doc_id bigint, text string")
    x = split.index_documents(df)
    assert split.sections(x).count() == 2
    assert [r["chunk_id"] for r in split.chunks(x).orderBy("chunk_id").collect()] == [0, 1]


PAGE = """<html><head><title> A &amp; B </title></head><body><nav>no</nav><article><h1>Head</h1><p><b>bold<br>next<p>second <a href="/x">link</a> tail</p>
<ul><li>one<ul><li>inner</li></ul></li></ul><ol><li>first<li>second</ol><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>
<pre>code
x</pre><img alt="pic"><div class="has-results">gone</div></article><footer>no</footer></body></html>"""


def test_html(spark):
    pages = [PAGE, None, "<body><article>x</article><p>body text that is longer than thirty characters</p></body>", "<div>" * 5000 + "deep", "<p>a<b>b<br></b>c<i>d<br>e</i></p>", "<body><ol><li>x<ul><li>y</ul><li>z</ol><table><tr><td>a<tr><td>b</table>", "<span role='main'>thirty characters and more of text</span>"]
    got = [r["text"] for r in convert.html_to_text(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")).orderBy("page_id").collect()]
    t = got[0]
    for want in ("# Head", "second link tail", "- one", "- inner", "1. first", "2. second", "| a | b |", "| 1 |  |", "```\ncode\nx\n```", "[图: pic]"):
        assert want in t, want
    assert "no" not in t.split() and "gone" not in t
    assert got[1] == "" and "body text" in got[2]
    assert got[3].strip() == "deep"
    assert got[4].strip() == "a b c d\ne"
    assert got[5].split() == "1. x - y 2. z | a | | --- | | b |".split()
    assert got[6].strip() == ""
    r = convert.html_to_text(spark.createDataFrame([(1, "u", PAGE)], "page_id bigint, url string, html string")).first()
    assert r["title"] == "A & B"
    assert convert.html_to_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_pdf():
    text = "POST /v3/query\n1\n5.5 Title here\n1. 中文标题内容\n1.1.1 Deep title\n123456\nabcdefghijkl\n{\n\"a\": 1,\n\"b\": 2\n}\nend"
    got = convert.structure_pdf_lines(text).split("\n")
    assert got == ["POST /v3/query1", "### 5.5 Title here", "## 1. 中文标题内容", "#### 1.1.1 Deep title", "```", "{", '"a": 1,', '"b": 2', "}", "```", "end"]


def test_blocks(spark):
    el = "array<struct<text_run:struct<content:string,text_element_style:struct<link:struct<url:string>>>,mention_doc:struct<url:string,token:string>>>"
    run = lambda t, u=None: {"text_run": {"content": t, "text_element_style": {"link": {"url": u}}}, "mention_doc": None}
    rows = [("d", "T", 0, 1, [run("skip")]), ("d", "T", 1, 3, [run("H")]), ("d", "T", 2, 12, [run("b"), run("c", "https%3A%2F%2Fx%2Fwiki%2Fkid")]), ("d", "T", 3, 14, [run("k")]), ("d", "T", 4, 2, [{"text_run": None, "mention_doc": {"url": "", "token": "lost"}}]), ("kid", "K", 0, 2, [run("child")])]
    b = spark.createDataFrame(rows, f"doc_token string, title string, pos int, block_type int, elements {el}")
    docs = convert.blocks_to_markdown(b)
    text = {r["doc_token"]: r["text"] for r in convert.merge_children(docs, convert.block_links(b)).collect()}
    assert text["d"] == "# H\n\n- bc\n\n```\nk\n```\n\n# K\n\nchild" and text["kid"] == "child"


def test_rrf_last_rank_and_missing_side(spark):
    vec = spark.createDataFrame([(1, "a", 0, 0.1), (1, "a", 3, 0.3), (1, "b", 1, 0.2)], "query_id int, key string, rank int, distance double")
    key = spark.createDataFrame([(1, "b", 0), (1, "c", 1)], "query_id int, key string, rank int")
    got = {r["key"]: (round(r["rrf_score"], 9), r["distance"], r["rank"]) for r in fusion.rrf_fuse(vec, key).collect()}
    assert got["a"] == (round(1 / 63, 9), 0.3, 3) and got["b"] == (round(1 / 61 + 1 / 60, 9), 0.2, 1) and got["c"][1] == 0.5


def test_hybrid_fallbacks(spark):
    s = spark.createDataFrame([("1:0", 1, 0, "t", "error 12345 happens"), *[(f"{i}:0", i, 0, "t", f"other words {w}") for i, w in enumerate(("one", "two", "three", "four"), 2)]], "key string, doc_id bigint, section_id int, title string, text string")
    v = spark.createDataFrame([], "key string, embedding array<float>")
    q = spark.createDataFrame([(1, "what is 12345", [1.0]), (2, "nothing", [1.0])], "query_id bigint, text string, embedding array<float>")
    docs = spark.createDataFrame([(1, "n")], "doc_id bigint, name string")
    got = fusion.hybrid_retrieve(q, bm25.bm25_stats(s), v, s, docs).collect()
    assert [(r["query_id"], r["doc_id"], r["distance"], r["doc_name"]) for r in got] == [(1, 1, 0.0, None)]
    assert bm25.bm25_topk(q, bm25.bm25_stats(s.where("false"))).collect() == []


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 64))
    rows = [(i, (base[i % 40] + 0.3 * rng.standard_normal(64)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "key bigint, embedding array<double>")
    q = v.where("key % 20 = 0").withColumnRenamed("key", "query_id")
    exact = {(r["query_id"], r["key"]) for r in vectors.vector_topk(q, v, 10).collect()}
    found = {(r["query_id"], r["key"]) for r in vectors.lsh_topk(q, v, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_trace(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "d"), ("x", "x")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",), ("none",), ("d",), ("alone",)], "start string")
    services = spark.createDataFrame([("alone",), ("a",)], "name string")
    got = sorted((r["start"], ">".join(r["path"]), r["is_cycle"]) for r in graph.trace(e, starts, services=services).collect())
    assert got == [("a", "a>b>c>a(环)", True), ("a", "a>d", False), ("a", "a>d", False), ("alone", "alone", False), ("d", "d", False), ("x", "x>x(环)", True)]
    assert [(r["start"], r["depth"]) for r in graph.trace(e, starts.where("start = 'd'")).collect()] == [("d", 0)]
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string")
    assert [r["depth"] for r in graph.trace(chain, spark.createDataFrame([("0",)], "start string")).collect()] == [6]


def test_trace_joins_each_level_once(spark):
    """What a level has found is read back: the result's plan joins nothing, so edges are not made again for each level."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string").distinct()
    out = graph.trace(e, e.select(e.src.alias("start")))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(">".join(r["path"]) for r in out.collect()) == ["a>b>c>a(环)", "a>b>d", "b>c>a>b(环)", "b>d", "c>a>b>c(环)", "c>a>b>d"]


def test_crawl(spark):
    link = lambda *hs: "".join(f'<a href="{h}">' for h in hs)
    rows = [
        ("https://h.org/docs/", link("a", "/docs/b#x", "/docs/b/", "/other", "https://else.org/docs/c", "mailto:x", "f.pdf"), "root"),
        ("https://h.org/docs/a", link("/docs/d", "/docs/"), "A"), ("https://h.org/docs/b", link("e/../../z"), ""), ("https://h.org/docs/d", "", "D"), ("https://h.org/other", "", "O"), ("https://else.org/docs/c", "", "C"),
    ]
    p = spark.createDataFrame([(u, h, t, t) for u, h, t in rows], "url string, html string, text string, title string")
    seeds = spark.createDataFrame([("https://h.org/docs/",)], "seed string")
    kept = graph.crawl(p, seeds)
    assert [(r["url"], r["depth"]) for r in kept.orderBy("ordinal").collect()] == [("https://h.org/docs", 0), ("https://h.org/docs/a", 1), ("https://h.org/docs/d", 2)]
    assert [r["url"] for r in graph.crawl(p, seeds, max_depth=0).collect()] == ["https://h.org/docs"]
    assert graph.crawl(p, seeds, max_pages=2).count() == 2
    doc = graph.crawl_documents(p, kept).first()
    assert doc["n_pages"] == 3 and doc["text"] == "# root\nroot\n\n# A\nA\n\n# D\nD"


def test_sync_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "ready"), (2, "ready"), (3, "failed"), (4, "indexing")], "doc_id bigint, status string")
    texts = spark.createDataFrame([(i, "text") for i in range(5)], "doc_id bigint, text string")
    chunks = spark.createDataFrame([(1, 0), (9, 0)], "doc_id bigint, chunk_id int")
    backup = spark.createDataFrame([(1, 0, "s"), (2, 0, "s")], "doc_id bigint, section_id int, text string")
    out = catalog.sync_index(docs, texts, chunks, backup.where("false"), backup)
    assert out["report"].first().asDict() == {"removed": 1, "reindexed": 2, "fixed": 1, "total": 4}
    again = catalog.sync_index(docs, texts, out["chunks"].unionByName(out["to_index"].select("doc_id", F.lit(0).alias("chunk_id"))), out["sections"].unionByName(backup.where("doc_id = 2")), backup)
    assert again["report"].first().asDict() == {"removed": 0, "reindexed": 0, "fixed": 0, "total": 4}
    assert catalog.sync_index(docs, texts, chunks, backup, backup, force=True)["to_index"].count() == 3
    status = {r["doc_id"]: r["status"] for r in out["docs"].collect()}
    assert status == {1: "ready", 2: "ready", 3: "failed", 4: "ready"} and sorted(r["doc_id"] for r in out["chunks"].collect()) == [1, 2, 4]
    assert sorted((r["doc_id"], r["text"]) for r in out["sections"].collect()) == [(1, "s"), (2, "text"), (4, "text")]
    anew = catalog.sync_index(out["docs"], texts, out["chunks"], out["sections"], backup)
    assert anew["report"].first().asDict() == {"removed": 0, "reindexed": 0, "fixed": 0, "total": 4}
    forced = catalog.sync_index(out["docs"], texts, out["chunks"], out["sections"], backup, force=True)
    assert sorted(r["doc_id"] for r in forced["chunks"].collect()) == [1, 2, 4] and forced["sections"].count() == 3


def test_hybrid_keeps_chunk_order_without_words_and_routes_by_name(spark):
    s = spark.createDataFrame([(f"{i}:{j}", i, j, "t", f"words of part {w}") for i, j, w in ((1, 0, "red"), (1, 1, "green"), (2, 0, "blue"), (3, 0, "red"))], "key string, doc_id bigint, section_id int, title string, text string")
    v = spark.createDataFrame([("1:0", [1.0, 0.1]), ("2:0", [1.0, 0.2]), ("1:0", [1.0, 0.3]), ("3:0", [1.0, 0.9])], "key string, embedding array<float>")
    q = spark.createDataFrame([(1, "?", [1.0, 0.0]), (2, "red of manual alpha", [1.0, 0.0])], "query_id bigint, text string, embedding array<float>")
    docs = spark.createDataFrame([(1, "other"), (2, "blue"), (3, "manual alpha")], "doc_id bigint, name string")
    got = fusion.hybrid_retrieve(q, bm25.bm25_stats(s), v, s, docs, k=1).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["section_id"], r["rank"]) for r in got] == [(1, 1, 0, 1), (1, 2, 0, 2), (1, 3, 0, 3), (2, 3, 0, 1)]
    assert got[0]["distance"] < 0.01 and got[3]["doc_name"] == "manual alpha"


def test_answers(spark):
    raw = "event: token\ndata: {\"text\": \"he\"}\n\nevent: token\ndata: {\"text\": \"llo \"}\n\nevent: x\ndata: {bad\n\nevent: done\ndata: {}\n\n"
    sse = files.parse_sse(spark.createDataFrame([("r", raw), ("e", raw + 'event: error\ndata: {"message": "no"}\n\n'), ("n", "event: done\ndata: {}")], "request_id string, raw string"))
    got = {r["request_id"]: r["answer"] for r in chatlog.assemble_answers(sse).collect()}
    assert got["r"] == "hello" and got["e"] == "no" and got["n"] == chatlog.NO_ANSWER


def test_policies(spark):
    cols = "thread_id string, turn int, kb_retrieve_done boolean, kb_has_coverage boolean, web_used boolean, answer string"
    rows = [("a", 1, True, False, False, "Java 21"), ("b", 1, True, True, False, "no cite"), ("c", 1, False, False, True, "plain"), ("d", 1, True, True, False, "see doc_id: 4"), ("e", 1, True, True, True, None), ("f", 1, True, True, True, "")]
    got = {(r["thread_id"], r["policy"]) for r in quality.audit_answers(spark.createDataFrame(rows, cols), quality.default_policies(2026), "low").collect()}
    assert got == {("a", "unsupported_claim"), ("b", "missing_doc_cite"), ("c", "missing_url_cite"), ("c", "web_before_kb"), ("e", "web_before_kb"), ("f", "web_before_kb")}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b" ok \xff\n")
    (tmp_path / "in/b.exe").write_bytes(b"x")
    got = {r["ext"]: (r["text"], r["status"]) for r in files.read_sources(spark, f"file://{tmp_path}/in").collect()}
    assert got == {".txt": ("ok �", "ready"), ".exe": (None, "failed")}
    (tmp_path / "t.json").write_text(json.dumps({"services": ["s", {"name": "n", "desc": "d", "type": "db"}], "edges": [], "links": [{"source": "s", "callee": "n", "protocol": "grpc"}, {"from": "s", "to": ""}]}))
    services, edges = files.read_topology(spark, f"file://{tmp_path}/t.json")
    assert {(r["name"], r["description"]) for r in services.collect()} == {("s", ""), ("n", "d")}
    assert [(r["src"], r["dst"], r["attrs"]["protocol"]) for r in edges.collect()] == [("s", "n", "grpc")]
    df = spark.createDataFrame([("{\"a\": {\"k\": 1, \"b\": [{\"k\": 2}]}}",), ("{bad",), (None,)], "j string")
    assert [r["j"] for r in files.strip_json_key(df, "j", "k").collect()] == ['{"a": {"b": [{}]}}', "{bad", None]
