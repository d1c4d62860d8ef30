"""Documents and pages: fields, sections, catalog and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, convert, graph, ingest, split
from ..sources import files
from ..sources.staging import shared_dir, stage_table
from .registry import query, read


@query("""SELECT doc_id, sha256(text) AS content_hash, substr(text, 1, 200) AS snippet, length(text) BETWEEN 20 AND 100000 AS fits, length(text) > 50000 AS big,
  md5(CASE WHEN length(text) >= 100 THEN trim(regexp_replace(text, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) ELSE text END) AS collapsed_md5,
  regexp_matches(text, '\\d{4,}') OR contains(text, '/') OR regexp_matches(text, '(?i)(code|错误码|error)\\s*[=:：]?\\s*\\d') AS exact_id,
  regexp_replace(substr(text, 1, 150), '[^A-Za-z0-9_-]', '_', 'g')[:100] AS thread FROM documents""")
def text_fields(spark, sf_dir):
    """SC3, SC4, SC5, SC7, SC10, SC14 over documents."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", X.content_hash(t).alias("content_hash"), X.snippet(t).alias("snippet"), X.length_gate(t).alias("fits"), X.needs_summary(F.length(t)).alias("big"),
        F.md5(X.collapse_blank_lines(t).cast("binary")).alias("collapsed_md5"), X.has_exact_id(t).alias("exact_id"), X.sanitize_thread(F.substring(t, 1, 150)).alias("thread"),
    )


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(ltrim(trim(x, ' ' || chr(9) || chr(13)), '#'), ' ' || chr(9) || chr(13))), lambda x: x <> '')[1] AS first FROM documents)
SELECT doc_id, coalesce(CASE WHEN length(first) > 30 THEN substr(first, 1, 30) || '...' ELSE first END, 'untitled') || '.md' AS title FROM l""")
def titles(spark, sf_dir):
    """SC6."""
    return read(spark, sf_dir, "documents").select("doc_id", X.title_from_text(F.col("text"), F.lit("untitled")).alias("title"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
n AS (SELECT doc_id, count(*) FILTER (length(x) % 5 = 0) AS n2, count(*) FILTER (length(x) % 5 = 1) AS n3, count(*) FILTER (length(x) % 5 = 2) AS n4, count(*) FILTER (length(x) % 5 = 3) AS n5 FROM l GROUP BY doc_id),
a AS (SELECT *, CASE WHEN n2 >= 3 AND n2 >= 0.5 * n3 THEN 2 ELSE 3 END AS b2 FROM n),
b AS (SELECT *, CASE WHEN n3 >= 3 AND n3 >= 0.5 * CASE b2 WHEN 2 THEN n2 ELSE n3 END THEN 3 ELSE b2 END AS b3 FROM a),
c AS (SELECT *, CASE WHEN n4 >= 3 AND n4 >= 0.5 * CASE b3 WHEN 2 THEN n2 ELSE n3 END THEN 4 ELSE b3 END AS b4 FROM b)
SELECT doc_id, CASE WHEN n5 >= 3 AND n5 >= 0.5 * CASE b4 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END THEN 5 ELSE b4 END AS level FROM c""")
def heading_level(spark, sf_dir):
    """SC8 over documents whose lines are made headings of levels 2 to 6, by their length."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.repeat(F.lit("#"), F.length(x) % 5 + 2), F.lit(" "), x))
    return read(spark, sf_dir, "documents").select("doc_id", X.detect_heading_level(F.array_join(lines, "\n")).alias("level"))


@query("""WITH w AS (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
s AS (SELECT doc_id, length(text) AS chars FROM w WHERE length(t) < 80
  UNION ALL SELECT doc_id, length(t) FROM w WHERE length(t) BETWEEN 80 AND 10000
  UNION ALL SELECT doc_id, length(substr(t, i + 1, 10000)) FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 9800)) AS i FROM w WHERE length(t) > 10000) WHERE trim(substr(t, i + 1, 10000), ' ' || chr(10)) <> '')
SELECT doc_id, count(*) AS n_sections, sum(chars) AS chars FROM s GROUP BY doc_id""")
def section_directory(spark, sf_dir):
    """TX8, AG6: documents without headings are one section, or slices of it."""
    s = split.sections(split.index_documents(read(spark, sf_dir, "documents").repartition("doc_id")))
    return catalog.section_directory(s).select("doc_id", "n_sections", "chars")


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _last(sep: str) -> str:
    """SQL: where the last sep of the window begins, below 0 if nowhere."""
    find = f"instr(reverse(win), reverse({sep}))"
    return f"CASE WHEN {find} = 0 THEN -1 ELSE length(win) - {find} + 1 - length({sep}) END"


_SEPS = ["chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'. '", "'! '", "'? '"]
_STOP = "CASE WHEN pos + 500 >= length(body) THEN pos + 500 " + " ".join(f"WHEN {_last(f'({x})')} > 200 THEN pos + {_last(f'({x})')} + length({x})" for x in _SEPS) + " ELSE pos + 500 END"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, text, trim(text, {_SPACES}) AS t FROM documents),
s AS (SELECT doc_id, 0 AS section_id, '全文' AS section_title, text AS body FROM w WHERE length(t) < 80
  UNION ALL SELECT doc_id, 0, '引言', t FROM w WHERE length(t) BETWEEN 80 AND 10000
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1, '引言 (第 ' || (i // 9800 + 1) || ' 部分)', substr(t, i + 1, 10000)
    FROM (SELECT doc_id, t, unnest(generate_series(0, length(t) - 1, 9800)) AS i FROM w WHERE length(t) > 10000) WHERE trim(substr(t, i + 1, 10000), {_SPACES}) <> ''),
c AS (SELECT doc_id, section_id, section_title, body, pos, {_STOP} AS stop FROM (SELECT *, 0 AS pos, substr(body, 1, 500) AS win FROM s WHERE length(body) > 500)
  UNION ALL SELECT doc_id, section_id, section_title, body, pos, {_STOP} FROM (SELECT doc_id, section_id, section_title, body, stop - 50 AS pos, substr(body, (stop - 49)::BIGINT, 500) AS win FROM c WHERE stop - 50 < length(body))),
p AS (SELECT doc_id, section_id, section_title, pos, trim(substr(body, (pos + 1)::BIGINT, (stop - pos)::BIGINT), {_SPACES}) AS text FROM c
  UNION ALL SELECT doc_id, section_id, section_title, 0, body FROM s WHERE length(body) BETWEEN 1 AND 500)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, pos) - 1 AS chunk_id, section_id, section_title, '' AS source, text FROM p WHERE text <> ''""")
def chunks(spark, sf_dir):
    """TX9, TX10."""
    return split.chunks(split.index_documents(read(spark, sf_dir, "documents").repartition("doc_id")))


@query("SELECT doc_id, i::INT AS page, md5(substr(text, i * 8000 + 1, 8000)) AS md5 FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 8000)) AS i FROM documents WHERE text <> '')")
def page_text(spark, sf_dir):
    """TX11."""
    return split.pages(read(spark, sf_dir, "documents")).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), k AS (SELECT h, min(doc_id) AS k FROM d WHERE lang = 'en' GROUP BY h), f AS (SELECT h, min(doc_id) AS f FROM d WHERE lang <> 'en' GROUP BY h)
SELECT doc_id, coalesce(k, f) AS survivor_id FROM d LEFT JOIN k USING (h) LEFT JOIN f USING (h) WHERE lang <> 'en'""")
def content_dedup(spark, sf_dir):
    """JN9: English documents are known, the others come in."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", X.content_hash(F.col("text")).alias("content_hash"))
    return catalog.dedup_by_hash(d.where("lang <> 'en'"), d.where("lang = 'en'").withColumn("status", F.lit("ready")))


@query("""WITH o AS (SELECT doc_id, source AS name, sha256(text) AS h FROM documents WHERE lang <> 'es'),
n AS (SELECT doc_id, source AS name, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'keep' WHEN o.h = n.h AND o.name = n.name THEN 'skip' ELSE 'replace' END AS action FROM o FULL JOIN n USING (doc_id)""")
def upsert_plan(spark, sf_dir):
    """JN10: Spanish documents are new, German ones changed, French ones not in the batch."""
    d = read(spark, sf_dir, "documents").withColumnRenamed("source", "name")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where("lang <> 'es'").select("doc_id", "name", X.content_hash(F.col("text")).alias("content_hash"))
    return catalog.upsert_plan(old, d.where("lang <> 'fr'").select("doc_id", "name", X.content_hash(text).alias("content_hash")))


@query("SELECT DISTINCT vec_id * 3 AS doc_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)")
def orphan_vectors(spark, sf_dir):
    """JN6, ST2: vectors of documents that are not there."""
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    return catalog.orphans(e, read(spark, sf_dir, "documents"))


@query("SELECT doc_id, length(text) AS char_count FROM documents WHERE lang <> 'fr' AND text <> '' AND doc_id NOT IN (SELECT vec_id * 3 FROM embeddings)")
def missing_index(spark, sf_dir):
    """JN7: documents without vectors; French ones have failed."""
    d = read(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "fr", "failed").otherwise("ready"))
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"))
    return catalog.missing(e, d, d.select("doc_id", "text"))


@query("SELECT doc_id, count(*) AS n FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE d.lang = 'en' AND c.conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY doc_id")
def section_gaps(spark, sf_dir):
    """JN8: turns as backup sections of English documents; conversations with a system turn have their sections."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "ready").otherwise("failed").alias("status"))
    c = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    return catalog.section_gaps(d, c, c.where("role = 'system'"), c).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(nullif(source, 'src0'), '未分类') AS folder, count(*) AS n_docs, sum(n_chars) AS n_chars FROM documents GROUP BY 1")
def folder_catalog(spark, sf_dir):
    """AG5: sources as folders, one of them unfiled."""
    d = read(spark, sf_dir, "documents").select(F.nullif("source", F.lit("src0")).alias("folder"), F.col("n_chars").alias("char_count"))
    return catalog.catalog_by_folder(d)


@query("""WITH m AS (SELECT CASE WHEN source = 'src1' THEN 'moved' ELSE source END AS folder FROM documents), f AS (SELECT DISTINCT source AS folder FROM documents WHERE source NOT IN ('src0', 'src1') UNION SELECT 'moved' UNION SELECT 'empty')
SELECT folder, (SELECT count(*) FROM m WHERE m.folder = f.folder) AS doc_count FROM f UNION ALL SELECT '', count(*) FROM m WHERE folder NOT IN (SELECT folder FROM f)""")
def folder_tree(spark, sf_dir):
    """JN12, JN13: one folder renamed, one empty, one unknown."""
    mapping = spark.createDataFrame([("src1", "moved")], "old string, new string")
    d = catalog.refolder(read(spark, sf_dir, "documents").select(F.col("source").alias("folder")), mapping)
    names = read(spark, sf_dir, "documents").where("source <> 'src0'").select(F.col("source").alias("name")).distinct()
    folders = catalog.refolder(names.unionByName(spark.createDataFrame([("empty",)], "name string")), mapping, "name")
    return catalog.folder_tree(d, folders)


@query("SELECT doc_id FROM documents WHERE source || '/' || lang = 'src2/en' OR starts_with(source || '/' || lang, 'src2/en/') UNION ALL SELECT doc_id FROM documents WHERE starts_with(source || '/' || lang, 'src3/')")
def folder_scope(spark, sf_dir):
    """JN2: a folder itself, and one with folders below it."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("folder"))
    return catalog.scope_by_folder(d, "src2/en").unionByName(catalog.scope_by_folder(d, "src3"))


@query("""WITH r AS (SELECT *, CASE WHEN source = 'src5' THEN '' ELSE text END AS t FROM documents), h AS (SELECT doc_id, sha256(t) AS h, t FROM r), f AS (SELECT h, min(doc_id) AS f FROM h GROUP BY h)
SELECT CASE WHEN t = '' THEN 'failed' WHEN doc_id <> f THEN 'duplicate' ELSE 'ready' END AS status, count(*) AS n FROM h JOIN f USING (h) GROUP BY 1""")
def ingest_status(spark, sf_dir):
    """CJ4: a batch of all documents, those of one source empty."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.when(F.col("source") == "src5", "").otherwise(F.col("text")).alias("text"))
    known = d.where(F.lit(False)).select("doc_id", F.lit("").alias("content_hash"), F.lit("ready").alias("status"))
    return ingest.ingest(d, known)["catalog"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13)) AS title, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url_key FROM pages""")
def page_titles(spark, sf_dir):
    """SC21, SC24."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", X.html_title(F.col("html"), F.col("url")).alias("title"), X.normalize_url(F.col("url")).alias("url_key"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)', 1)) AS href FROM pages) WHERE href <> '' GROUP BY ALL""")
def page_links(spark, sf_dir):
    """TX3, IO3."""
    p = files.read_pages(spark, f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.explode(X.extract_links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def _plain(html: str, end: str = ";?") -> str:
    """SQL: html without tags, a line for each br, the usual entities resolved, also without their semicolon."""
    text = rf"regexp_replace(regexp_replace({html}, '(?i)<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name}{end}', '{sign}', 'g')"
    return text


@query(rf"""WITH a AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS rest, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad FROM pages),
p AS (SELECT page_id, list_filter(list_transform(string_split(rest, '<p>'), lambda x: trim({_plain("x")}, ' ' || chr(10))), lambda x: x <> '') AS ps, length(trim({_plain("h1 || rest")}, ' ' || chr(10))) <= 30 AS is_short FROM a)
SELECT page_id, url, coalesce(nullif(trim({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", ";")}, ' ' || chr(10)), ''), url) AS title,
  CASE WHEN is_short THEN {_plain("ad")} || chr(10) || chr(10) ELSE '' END || '# ' || trim({_plain("h1")}, ' ' || chr(10)) || coalesce(chr(10) || chr(10) || nullif(array_to_string(ps, chr(10) || chr(10)), ''), '') AS text
FROM a JOIN p USING (page_id)""")
def page_texts(spark, sf_dir):
    """TX1, TX2."""
    return convert.html_to_text(read(spark, sf_dir, "pages").repartition("page_id"))


@query("""SELECT c_custkey AS page_id, '# ' || c_name || chr(10) || chr(10) || 'Account of a customer in segment ' || c_mktsegment || chr(10) || chr(10) || '- ' || c_nationkey || chr(10) || chr(10) || '- second' || chr(10) || chr(10)
  || '1. first' || chr(10) || chr(10) || '2. of ' || c_mktsegment || chr(10) || chr(10) || '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' |' || chr(10) || '| alone |  |' || chr(10) || chr(10)
  || '```' || chr(10) || 'x = ' || c_custkey || chr(10) || 'y' || chr(10) || '```' AS text FROM customer""")
def page_structures(spark, sf_dir):
    """TX1: pages made of customers: a heading, lists, a table and code, with paragraphs, items, rows and cells left open. Clean-up takes the indent of lines."""
    c = F.col
    html = F.concat(
        F.lit("<body><div>menu</div><nav>skip</nav><article><h1>"), "c_name", F.lit("</h1><p>Account of a <b>customer</b> in <a href='x'>segment <i>"), "c_mktsegment", F.lit("</i></a><ul><li>"), c("c_nationkey").cast("string"),
        F.lit("<li>second</ul><ol><li>first<li>of "), "c_mktsegment", F.lit("</ol><table><tr><th>key<th>value<tr><td>"), c("c_custkey").cast("string"), F.lit("<td>"), "c_name", F.lit("<tr><td>alone</table><pre>x = "), c("c_custkey").cast("string"), F.lit("\n  y\n</pre><script>gone</script></article>"),
    )
    pages = read(spark, sf_dir, "customer").select(c("c_custkey").alias("page_id"), "c_name", html.alias("html")).withColumnRenamed("c_name", "url")
    return convert.html_to_text(pages).select("page_id", "text")



@query(r"""WITH l AS (SELECT doc_id, i, CASE length(y) % 6 WHEN 0 THEN ' ' || length(y) WHEN 1 THEN (length(y) % 10) || '.' || (length(y) % 7) || ' ' || y WHEN 2 THEN 'pagefooter' WHEN 3 THEN '3. 中文 ' || y ELSE y END AS x
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS y FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
g AS (SELECT *, sum(CASE WHEN digits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (SELECT *, regexp_full_match(trim(x), '\d{1,4}') AS digits FROM l)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, digits ORDER BY i) AS k, max(CASE WHEN NOT digits THEN (trim(x) <> '')::INT END) OVER (PARTITION BY doc_id, grp) AS opened FROM g),
m AS (SELECT *, digits AND k % 2 = coalesce(opened, 0) AS glued FROM k),
n AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM m),
o AS (SELECT doc_id, line, max(CASE WHEN NOT glued THEN x END) AS a, max(CASE WHEN glued THEN trim(x) END) AS b FROM n GROUP BY doc_id, line),
p AS (SELECT doc_id, line, CASE WHEN b IS NULL THEN a ELSE rtrim(a) || b END AS x FROM o),
q AS (SELECT *, trim(x) AS s, coalesce(nullif(regexp_extract(trim(x), '^(\d{1,2}(?:\.\d{1,2})+)(?:\s|[一-鿿])', 1), ''), nullif(regexp_extract(trim(x), '^(\d{1,2})(?:\.[\s一-鿿]|\s+[一-鿿])', 1), '')) AS num
  FROM p WHERE NOT regexp_full_match(trim(x), '\d{1,6}|[a-z]{10,}')),
r AS (SELECT doc_id, string_agg(CASE WHEN num IS NOT NULL AND length(s) > 5 THEN repeat('#', least(length(num) - length(replace(num, '.', '')) + 2, 4)) || ' ' || s ELSE x END, chr(10) ORDER BY line) AS text FROM q GROUP BY doc_id)
SELECT doc_id, coalesce(r.text, '') AS text FROM documents LEFT JOIN r USING (doc_id)""")
def pdf_structure(spark, sf_dir):
    """TX4, TX5: documents whose lines are made page numbers, numbered headings and footers, by their length."""
    n = F.length
    made = lambda y: F.when(n(y) % 6 == 0, F.concat(F.lit(" "), n(y))).when(n(y) % 6 == 1, F.concat(n(y) % 10, F.lit("."), n(y) % 7, F.lit(" "), y)).when(n(y) % 6 == 2, "page\x00footer").when(n(y) % 6 == 3, F.concat(F.lit("3.\t中文­"), y)).otherwise(y)
    d = read(spark, sf_dir, "documents")
    return convert.structure_pdf_text(d.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), made), "\n")).repartition("doc_id"))


@query("""WITH e AS (SELECT doc_id, text, substr(text, 1, 12) AS old FROM documents), c AS (SELECT *, CASE WHEN old = '' THEN 0 ELSE (length(text) - length(replace(text, old, ''))) / length(old) END AS n FROM e)
SELECT doc_id, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, md5(CASE WHEN n = 1 THEN replace(text, old, '[edit]') ELSE text END) AS md5 FROM c""")
def literal_edits(spark, sf_dir):
    """SC26: each document's beginning is replaced where it occurs once."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = files.apply_edits(d, d.select("doc_id", F.substring("text", 1, 12).alias("old"), F.lit("[edit]").alias("new")))
    return out.select("doc_id", "status", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""WITH n AS (SELECT lang AS dir, source || '.txt' AS name, source, row_number() OVER (PARTITION BY lang, source) - 1 + CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS k FROM documents)
SELECT dir, name, CASE WHEN k = 0 THEN name ELSE source || '_' || k || '.txt' END AS stored_name FROM n""")
def stored_names(spark, sf_dir):
    """IO9: all documents of a source and language want the same name; in one folder it is taken."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("dir"), F.concat("source", F.lit(".txt")).alias("name"))
    return files.unique_names(d, d.where("dir = 'en'").distinct())


@query("""SELECT coalesce(nullif(l.l_returnflag, ''), '') AS session, count(*) AS n_files, sum(l_linenumber) AS bytes, max(l_shipdate) AS latest FROM lineitem l GROUP BY 1""")
def workspace_sessions(spark, sf_dir):
    """IO12, WN11: line items as files of a workspace by return flag."""
    li = read(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.lit("file:/ws"), "l_returnflag", F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").cast("long").alias("length"), F.col("l_shipdate").alias("modificationTime"))
    return files.workspace_inventory(li, "/ws").select("session", "n_files", "bytes", "latest")


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || (l_partkey % 100) AS dst FROM lineitem UNION ALL SELECT 'p' || n_nationkey, 'p' || ((7 * n_nationkey + 3) % 25) FROM nation)"


def _edges(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("part")).distinct()
    li = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "part").alias("dst"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("src"), F.concat(F.lit("p"), (F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return li.unionByName(n)


@query(f"""WITH RECURSIVE {_EDGES},
st AS (SELECT src AS x FROM e WHERE starts_with(src, 's') UNION SELECT dst FROM e WHERE dst NOT IN (SELECT src FROM e)),
w(start, node, path, depth, cyc) AS (
  SELECT x, x, [x], 0, false FROM st
  UNION ALL SELECT start, e.dst, list_append(path, CASE WHEN list_contains(path, e.dst) THEN e.dst || '(环)' ELSE e.dst END), depth + 1, list_contains(path, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT cyc AND depth < 6)
SELECT start, array_to_string(path, '>') AS path, depth, cyc AS is_cycle FROM w WHERE cyc OR depth = 6 OR node NOT IN (SELECT src FROM e)""")
def chain_trace(spark, sf_dir):
    """GR1: all chains from every supplier over parts; parts that lead nowhere are starts as well, and one that isn't there."""
    e = stage_table(_edges(spark, sf_dir), "edges")
    leaves = e.select(F.col("dst").alias("start")).distinct().join(e.select(F.col("src").alias("start")), "start", "left_anti")
    starts = e.where(F.startswith("src", F.lit("s"))).select(F.col("src").alias("start")).unionByName(leaves).unionByName(spark.range(1).select(F.lit("nowhere").alias("start")))
    return graph.trace(e, starts).select("start", F.array_join("path", ">").alias("path"), "depth", "is_cycle")


@query(f"WITH {_EDGES}, s AS (SELECT 's' || s_suppkey AS name FROM supplier UNION SELECT src FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM s) AS services, (SELECT count(*) FROM e) AS edges")
def graph_overview(spark, sf_dir):
    """AG14, ST4: suppliers are declared, parts only named by edges."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.col("s_name").alias("description"))
    return graph.graph_overview(s, _edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT 'up' AS direction, src AS node FROM e WHERE dst = 'p3' UNION ALL SELECT 'down', dst FROM e WHERE src = 'p3'")
def graph_neighbours(spark, sf_dir):
    """JN14."""
    e = _edges(spark, sf_dir)
    return graph.neighbours(e, "p3", "up").select(F.lit("up").alias("direction"), "node").unionByName(graph.neighbours(e, "p3").select(F.lit("down").alias("direction"), "node"))


@query(r"""WITH p AS (SELECT regexp_extract(url, '^(https?://[^/]*)', 1) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS u, regexp_extract(html, '<h1>([^<]*)', 1) AS t FROM pages),
o AS (SELECT DISTINCT host, host AS u, 0 AS depth FROM p UNION ALL SELECT DISTINCT host, u, 1 FROM p WHERE t <> '' AND u <> host)
SELECT host || '/' AS seed, u AS url, depth, row_number() OVER (PARTITION BY host ORDER BY depth, u) AS ordinal FROM o QUALIFY ordinal <= 50""")
def site_crawl(spark, sf_dir):
    """GR2: crawls from every host's root, which links to all pages of the host; pages have links of their own."""
    p = read(spark, sf_dir, "pages").select("url", "html", F.regexp_extract("html", "<h1>([^<]*)", 1).alias("text"))
    root = F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), F.lit("/"))
    seeds = p.select(root.alias("seed")).distinct()
    roots = seeds.select(F.col("seed").alias("url"), F.lit("").alias("html"), F.lit("home").alias("text"))
    return graph.crawl(p.unionByName(roots), seeds, links=p.select(root.alias("url"), F.lit(0).alias("pos"), F.col("url").alias("target")))


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN 'failed' ELSE 'ready' END AS status FROM documents),
e AS (SELECT DISTINCT vec_id * 3 AS doc_id FROM embeddings), t AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), y AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE role = 'system')
SELECT (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS removed,
       (SELECT count(*) FROM d WHERE status = 'ready' AND text <> '' AND doc_id NOT IN (SELECT doc_id FROM e)) AS reindexed,
       (SELECT count(*) FROM d WHERE status = 'ready' AND doc_id IN (SELECT doc_id FROM e) AND doc_id IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM y)) AS fixed,
       (SELECT count(*) FROM d) AS total""")
def sync_report(spark, sf_dir):
    """SS5, CJ3, JN11: the consistency check over stored tables: vectors of every third document, turns as sections."""
    d = read(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "fr", "failed").otherwise("ready"))
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_id"), "role", "text")
    base = shared_dir(spark)
    stored = {"docs": d.select("doc_id", "status"), "texts": d.select("doc_id", "text"), "chunks": read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"), "label"), "sections": turns.where("role = 'system'"), "backup": turns}
    for name, df in stored.items():
        df.write.parquet(f"{base}/{name}")
    return catalog.sync_job(spark, base, f"{base}/out")


@query("""WITH d AS (SELECT doc_id, text, CASE lang WHEN 'fr' THEN 'failed' WHEN 'de' THEN 'indexing' ELSE 'ready' END AS status FROM documents),
e AS (SELECT DISTINCT vec_id * 3 AS doc_id FROM embeddings WHERE vec_id * 3 IN (SELECT doc_id FROM documents)), t AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), y AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE role = 'system'),
m AS (SELECT doc_id FROM d WHERE status <> 'failed' AND text <> '' AND doc_id NOT IN (SELECT doc_id FROM e)),
x AS (SELECT doc_id FROM e UNION SELECT doc_id FROM m)
SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT doc_id FROM m) THEN 'ready' ELSE status END AS status, d.doc_id IN (SELECT doc_id FROM x) AS has_chunks,
  d.doc_id IN (SELECT doc_id FROM m) OR d.doc_id IN (SELECT doc_id FROM y) OR d.doc_id IN (SELECT doc_id FROM t) AND status = 'ready' AND d.doc_id IN (SELECT doc_id FROM e) AS has_sections,
  CASE WHEN length(text) <= 10000 AND d.doc_id IN (SELECT doc_id FROM m) THEN md5(text) END AS text_md5, 0 AS again_removed, 0 AS again_reindexed, 0 AS again_fixed FROM d""")
def sync_tables(spark, sf_dir):
    """SS5, CJ3, JN7, JN11: what a run of the consistency job makes of the tables, and what a second run over them finds."""
    d = read(spark, sf_dir, "documents").withColumn("status", F.when(F.col("lang") == "fr", "failed").when(F.col("lang") == "de", "indexing").otherwise("ready"))
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("section_id"), F.lit("").alias("title"), "role", "text")
    base = shared_dir(spark)
    vectors = read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 3).alias("doc_id"), F.col("vec_id").cast("int").alias("chunk_id"), F.lit("old").alias("text"))
    stored = {"docs": d.select("doc_id", "status"), "texts": d.select("doc_id", "text"), "chunks": vectors, "sections": turns.where("role = 'system'").drop("role"), "backup": turns.drop("role")}
    for name, df in stored.items():
        df.write.parquet(f"{base}/{name}")
    catalog.sync_job(spark, base, f"{base}/out")
    again = catalog.sync_job(spark, base, f"{base}/out2", state=f"{base}/out").select(*[F.col(c).cast("int").alias(f"again_{c}") for c in ("removed", "reindexed", "fixed")])
    table = lambda name: spark.read.parquet(f"{base}/out/{name}")
    has = lambda name: table(name).select("doc_id", F.lit(True).alias(f"has_{name}")).distinct()
    fresh = table("to_index").select("doc_id").join(table("sections"), "doc_id").groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.md5(F.first("text").cast("binary"))).alias("text_md5"))
    out = table("docs").join(has("chunks"), "doc_id", "left").join(has("sections"), "doc_id", "left").join(fresh, "doc_id", "left").join(F.broadcast(again), F.lit(True))  # one row
    return out.select("doc_id", "status", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_chunks", "has_sections")], "text_md5", "again_removed", "again_reindexed", "again_fixed")
