"""Keyword, vector and fused retrieval over documents, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import coverage_class, relevance_pct
from ..operators import bm25, catalog, fusion, vectors
from ..sources.staging import stage_table
from .registry import query, read

_TOKENS = r"""
tok AS (
  SELECT id, unnest(
    regexp_extract_all(t, '/[a-zA-Z0-9/_]+')
    || flatten(list_transform(regexp_extract_all(t, '/[a-zA-Z0-9/_]+'), lambda p: regexp_extract_all(p, '[a-zA-Z0-9]+')))
    || list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: regexp_full_match(x, 'v\d+'))
    || regexp_extract_all(t, '\d+')
    || list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS term
  FROM (SELECT doc_id AS id, lower(text) AS t FROM documents)),
qtok AS (
  SELECT id, unnest(
    regexp_extract_all(t, '/[a-zA-Z0-9/_]+')
    || flatten(list_transform(regexp_extract_all(t, '/[a-zA-Z0-9/_]+'), lambda p: regexp_extract_all(p, '[a-zA-Z0-9]+')))
    || list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: regexp_full_match(x, 'v\d+'))
    || regexp_extract_all(t, '\d+')
    || list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS term
  FROM (SELECT item_id AS id, lower(text) AS t FROM benchmark)),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id),
n AS (SELECT count(*) AS n, (SELECT count(*) FROM tok) / count(*) AS avgdl FROM documents),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, n GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT id AS query_id, term, count(*) AS qtf FROM qtok GROUP BY id, term),
score AS (
  SELECT query_id, post.id AS doc_id,
         round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN dl ON dl.id = post.id, n
  GROUP BY query_id, post.id HAVING sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.bm25_stats(read(spark, sf_dir, "documents"), "doc_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question is scoped to one source."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    return q.join(read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("key")), "source").select("query_id", "key")


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("key").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_RANKED = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM {0}"


@query(f"WITH {_TOKENS}, r AS ({_RANKED.format('score')}) SELECT * FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    """TK1: the 20 best documents of each benchmark passage."""
    return _hits(bm25.bm25_topk(_questions(spark, sf_dir), _index(spark, sf_dir), 20))


_SCOPED = "SELECT s.* FROM score s JOIN documents d USING (doc_id) WHERE d.source = 'src' || (s.query_id % 20)"


@query(f"WITH {_TOKENS}, c AS ({_SCOPED}), r AS ({_RANKED.format('c')}) SELECT * FROM r WHERE rank <= 17")
def bm25_scope_then_cut(spark, sf_dir):
    """TK5: the scope first, then the cut."""
    return _hits(bm25.bm25_topk(_questions(spark, sf_dir), _index(spark, sf_dir), 17, _scope(spark, sf_dir)))


@query(f"WITH {_TOKENS}, r AS ({_RANKED.format('score')}) SELECT r.* FROM r JOIN documents d USING (doc_id) WHERE rank <= 20 AND d.source = 'src' || (r.query_id % 20)")
def bm25_cut_then_scope(spark, sf_dir):
    """TK2: the global cut first, then the scope."""
    return _hits(bm25.bm25_topk(_questions(spark, sf_dir), _index(spark, sf_dir), 20, _scope(spark, sf_dir), scope_first=False))


@query(f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_terms(spark, sf_dir):
    """AG1: document frequency and idf of every term."""
    terms, _ = bm25.open_store(read(spark, sf_dir, "documents"), "doc_id").terms()
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query()
def bm25_read_share(spark, sf_dir):
    """TK1: how many postings of its terms each benchmark passage has, and how many the two passes read."""
    return bm25.bm25_read_share(_questions(spark, sf_dir), _index(spark, sf_dir), 20)


@query("SELECT count(*) AS n, sum(length(text)) AS chars FROM documents")
def corpus_signature(spark, sf_dir):
    """AG3."""
    return bm25.corpus_signature(read(spark, sf_dir, "documents"), "doc_id").select("n", "chars")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", "label")


def _seekers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf_dir).where("key % 20 = 0").withColumnRenamed("key", "query_id")


_NEAR = """
near AS (
  SELECT q.vec_id AS query_id, v.vec_id AS key, q.label AS q_label, v.label,
         round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {_NEAR} SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, distance FROM near) WHERE rank <= 12")
def vector_topk(spark, sf_dir):
    """TK3: exact nearest neighbours in blocks."""
    return vectors.vector_topk(_seekers(spark, sf_dir), _vectors(spark, sf_dir), 12)


@query(f"WITH {_NEAR} SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, distance FROM near WHERE label = q_label) WHERE rank <= 12")
def vector_topk_scoped(spark, sf_dir):
    """TK3 with a scope: vectors of the query's label."""
    return vectors.vector_topk(_seekers(spark, sf_dir), _vectors(spark, sf_dir), 12, same="label")


@query(f"WITH {_NEAR} SELECT * FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank, distance FROM near) WHERE rank <= 12")
def vector_ivf_exact(spark, sf_dir):
    """TK4: the inverted file, searched as far as any nearer vector could be."""
    return vectors.ivf_topk(_seekers(spark, sf_dir), vectors.inverted_lists(_vectors(spark, sf_dir)), 12, reach=1.0)


@query()
def vector_ivf(spark, sf_dir):
    """TK4: the inverted file, searched within 0.4 of the distance found first; recall and share read are tested."""
    return vectors.ivf_topk(_seekers(spark, sf_dir), vectors.inverted_lists(_vectors(spark, sf_dir)), 12)


@query()
def vector_lsh(spark, sf_dir):
    """TK4: approximate neighbours by hyperplane tables; recall is tested against vector_topk."""
    return vectors.lsh_topk(_seekers(spark, sf_dir), _vectors(spark, sf_dir), 12)


@query(f"WITH {_NEAR}, best AS (SELECT query_id, min(distance) AS d FROM near WHERE key <> query_id GROUP BY query_id) SELECT query_id, d AS best_distance, CASE WHEN d > 0.4 THEN 'low' ELSE 'covered' END AS coverage, CAST(greatest(0, least(100, round((1 - d / 2) * 100))) AS INT) AS relevance FROM best")
def coverage(spark, sf_dir):
    """WN7, SC11, SC12: how near the nearest other vector is, and what that means."""
    q = _seekers(spark, sf_dir)
    hits = vectors.vector_topk(q, _vectors(spark, sf_dir), 12).where("key <> query_id")
    best = fusion.best_distance(q, hits)
    return best.select("query_id", "best_distance", coverage_class(F.col("best_distance")).alias("coverage"), relevance_pct(F.col("best_distance")).alias("relevance"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each seeker asks: the first twelve words of the document with its id."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+", 13), 1, 12), " ").alias("text"))
    return d.where("query_id % 20 = 0")


def _vector_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seeker the nearest vectors, as chunks of 50 sections; ranks from 0."""
    return vectors.vector_topk(_seekers(spark, sf_dir), _vectors(spark, sf_dir), 40).select("query_id", (F.col("key") % 50).alias("key"), F.col("key").alias("doc_id"), (F.col("rank") - 1).alias("rank"), "distance")


def _keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seeker the best documents for its question, as chunks of 50 sections; ranks from 0."""
    return bm25.bm25_topk(_asked(spark, sf_dir), _index(spark, sf_dir), 30).select("query_id", (F.col("key") % 50).alias("key"), F.col("key").alias("doc_id"), (F.col("rank") - 1).alias("rank"))


_ASKED_TOKENS = _TOKENS.replace("SELECT item_id AS id, lower(text) AS t FROM benchmark", r"SELECT doc_id AS id, lower(array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 12), ' ')) AS t FROM documents WHERE doc_id % 20 = 0")

_VEC_RANKS = f"""{_NEAR},
v AS (SELECT query_id, key % 50 AS key, key AS doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) - 1 AS rank FROM near QUALIFY rank < 40)"""

_RANKINGS = f"""{_ASKED_TOKENS}, {_VEC_RANKS},
b AS (SELECT query_id, doc_id % 50 AS key, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM score QUALIFY rank < 30)"""


@query(f"""WITH {_RANKINGS},
v1 AS (SELECT query_id, key, max(rank) AS r, arg_max(distance, rank) AS distance FROM v GROUP BY ALL),
b1 AS (SELECT query_id, key, max(rank) AS r FROM b GROUP BY ALL),
f AS (SELECT coalesce(v1.query_id, b1.query_id) AS query_id, coalesce(v1.key, b1.key) AS key, coalesce(1.0 / (60 + v1.r), 0) + coalesce(1.0 / (60 + b1.r), 0) AS s, coalesce(distance, 0.5) AS distance
      FROM v1 FULL JOIN b1 ON v1.query_id = b1.query_id AND v1.key = b1.key)
SELECT query_id, key, round(s, 6) AS rrf_score, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS rank FROM f""")
def rrf_fusion(spark, sf_dir):
    """WN1, JN5, ST1: ranks from 0, the worst chunk of a section counts."""
    return fusion.rrf_fuse(_vector_ranking(spark, sf_dir), _keyword_ranking(spark, sf_dir)).select("query_id", "key", F.round("rrf_score", 6).alias("rrf_score"), F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_VEC_RANKS}, d AS (SELECT query_id, key, min(rank) AS rank FROM v GROUP BY ALL) SELECT query_id, string_agg(key::VARCHAR, ',' ORDER BY rank) AS sections, count(*) AS n FROM d GROUP BY query_id")
def hit_doc_order(spark, sf_dir):
    """WN3: distinct sections by first position."""
    vec = _vector_ranking(spark, sf_dir)
    return fusion.hit_docs(vec.select("query_id", F.col("key").alias("doc_id"), "rank")).select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("sections"), F.size("doc_ids").cast("long").alias("n"))


@query(f"WITH {_VEC_RANKS} SELECT query_id, key, doc_id, rank FROM v QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY rank) = 1")
def section_dedup(spark, sf_dir):
    """WN2: the first hit of each section."""
    vec = _vector_ranking(spark, sf_dir)
    hits = vec.select("query_id", F.col("key").alias("doc_id"), F.lit(0).alias("section_id"), F.col("doc_id").alias("chunk"), "rank")
    return fusion.dedup_sections(hits).select("query_id", F.col("doc_id").alias("key"), F.col("chunk").alias("doc_id"), "rank")


@query("""WITH h AS (SELECT source AS query_id, doc_id, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
p AS (SELECT *, '[片段 ' || i || ': 《' || lang || '》 > ' || query_id || ']' || chr(10) AS header FROM h WHERE text <> ''),
l AS (SELECT *, 3000 - coalesce(sum(length(header) + length(text)) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(header) - 20 AS room FROM p),
m AS (SELECT *, min(room) OVER (PARTITION BY query_id ORDER BY i) AS least FROM l)
SELECT query_id, md5(string_agg(header || CASE WHEN length(text) > room THEN substr(text, 1, room::BIGINT) || '...' ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS context_md5, count(*) AS n_parts
FROM m WHERE least > 0 GROUP BY query_id""")
def context_budget(spark, sf_dir):
    """WN4: each source's documents, in order, up to 3000 characters."""
    d = read(spark, sf_dir, "documents")
    hits = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("doc_name"), F.col("source").alias("title"), "text")
    out = fusion.build_context(hits, 3000)
    return out.select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), "n_parts")


@query("""WITH h AS (SELECT conv_id AS request_id, turn, text, 1600 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations)
SELECT request_id, md5(coalesce(string_agg(CASE WHEN room <= 0 THEN NULL WHEN length(text) > room THEN substr(text, 1, room::BIGINT) || '…' ELSE text END, chr(10) || chr(10) ORDER BY turn), '')) AS text_md5,
       coalesce(string_agg(CASE WHEN room <= 0 OR length(text) > room THEN turn::VARCHAR END, ',' ORDER BY turn), '') AS truncated
FROM h GROUP BY request_id""")
def read_budget(spark, sf_dir):
    """WN5, JN16: a conversation's turns as the sections of a document, read up to 1600 characters."""
    c = read(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_id"), F.col("role").alias("title"), "text")
    ask = s.groupBy("doc_id").agg(F.array_sort(F.collect_list("section_id")).alias("section_ids")).select(F.col("doc_id").alias("request_id"), "doc_id", "section_ids")
    out = fusion.read_sections(ask, s, 1600)
    return out.select("request_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join(F.transform("truncated_ids", lambda x: x.cast("string")), ",").alias("truncated"))


#: SQL: of names and questions t (side, id, x) the pairs with the most shared name tokens, two at least.
_NAMES = r"""
n_w AS (SELECT side, id, unnest(regexp_extract_all(x, '[a-z0-9]{3,}')) AS token FROM t),
n_r AS (SELECT side, id, generate_subscripts(rs, 1) AS r, unnest(rs) AS run FROM (SELECT side, id, regexp_extract_all(x, '[a-z0-9.]+') AS rs FROM t)),
n_s AS (SELECT side, id, r, generate_subscripts(ss, 1) AS i, unnest(ss) AS seg FROM (SELECT side, id, r, string_split(run, '.') AS ss FROM n_r)),
n_f AS (SELECT *, regexp_full_match(seg, 'v?\d+') AS fits, coalesce(regexp_full_match(lag(seg) OVER (PARTITION BY side, id, r ORDER BY i), 'v?\d+'), false) AS after FROM n_s),
n_c AS (SELECT *, sum(CASE WHEN fits AND NOT (after AND regexp_full_match(seg, '\d+')) THEN 1 ELSE 0 END) OVER (PARTITION BY side, id, r ORDER BY i) AS chain FROM n_f),
n_v AS (SELECT side, id, string_agg(seg, '.' ORDER BY i) AS v FROM n_c WHERE fits GROUP BY side, id, r, chain),
n_k AS (SELECT DISTINCT * FROM (SELECT * FROM n_w UNION ALL SELECT * FROM n_v UNION ALL SELECT side, id, regexp_replace(v, '^v+', '') FROM n_v UNION ALL SELECT side, id, string_split(v, '.')[1] FROM n_v WHERE contains(v, '.'))),
n_n AS (SELECT q.id AS query_id, d.id AS doc_id, count(*) AS overlap FROM n_k q JOIN n_k d ON q.token = d.token AND q.side = 'q' AND d.side = 'd' GROUP BY ALL HAVING count(*) >= 2),
named AS (SELECT query_id, doc_id, overlap FROM n_n QUALIFY overlap = max(overlap) OVER (PARTITION BY query_id))"""

_HYBRID = f"""{_ASKED_TOKENS}, {_NEAR},
v AS (SELECT query_id, key, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) - 1 AS r FROM near WHERE query_id IN (SELECT doc_id FROM documents) QUALIFY r < 17),
b AS (SELECT query_id, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS r FROM score WHERE query_id IN (SELECT query_id FROM v) QUALIFY r < 17),
f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.key, b.key) AS key, coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS s, coalesce(distance, 0.5) AS distance
      FROM v FULL JOIN b ON v.query_id = b.query_id AND v.key = b.key),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS rank FROM f),
h AS (SELECT query_id, rank, d.doc_id, d.lang AS doc_name, d.source AS title, d.text, round(distance, 6) AS distance FROM r JOIN documents d ON d.doc_id = r.key WHERE rank <= 17)"""


def _hybrid(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("key"), "doc_id", F.lit(0).alias("section_id"), F.col("source").alias("title"), "text")
    q = _asked(spark, sf_dir).join(_seekers(spark, sf_dir).select("query_id", "embedding"), "query_id")
    return fusion.hybrid_retrieve(q, _index(spark, sf_dir), _vectors(spark, sf_dir), s, d.select("doc_id", F.col("lang").alias("name")))


@query(f"WITH {_HYBRID} SELECT query_id, rank, doc_id, doc_name, title, substr(text, 1, 200) AS snippet, distance FROM h")
def hybrid_retrieve(spark, sf_dir):
    """CJ1: documents as sections; the vectors of documents are those of the same id."""
    return _hybrid(spark, sf_dir).select("query_id", "rank", "doc_id", "doc_name", "title", "snippet", F.round("distance", 6).alias("distance"))


@query(rf"""WITH {_HYBRID},
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM h),
c AS (SELECT *, '[片段 ' || i || ': 《' || doc_name || '》 > ' || title || ']' || chr(10) AS header FROM p WHERE text <> ''),
l AS (SELECT *, 4000 - coalesce(sum(length(header) + length(text)) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(header) - 20 AS room FROM c),
m AS (SELECT *, min(room) OVER (PARTITION BY query_id ORDER BY i) AS least FROM l),
x AS (SELECT query_id, string_agg(header || CASE WHEN length(text) > room THEN substr(text, 1, room::BIGINT) || '...' ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM m WHERE least > 0 GROUP BY query_id),
a AS (SELECT doc_id AS query_id, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 12), ' ') AS text FROM documents WHERE doc_id % 20 = 0)
SELECT query_id, md5(CASE WHEN context IS NULL THEN a.text ELSE '参考资料：' || chr(10) || context || chr(10) || chr(10) || '问题：' || a.text END) AS prompt_md5, context IS NOT NULL AS has_context FROM a LEFT JOIN x USING (query_id)""")
def question_prompts(spark, sf_dir):
    """CJ2, WN4: the context of each question's hits, up to 4000 characters, in its prompt; questions without hits stay plain."""
    hits = _hybrid(spark, sf_dir).select("query_id", "rank", "doc_name", "title", "text")
    context = stage_table(fusion.build_context(hits, 4000), "contexts")
    out = fusion.build_prompt(_asked(spark, sf_dir), context).join(context.select("query_id", F.lit(True).alias("has")), "query_id", "left")
    return out.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.coalesce("has", F.lit(False)).alias("has_context"))


_ROUTED_TOKENS = _TOKENS.replace("SELECT item_id AS id, lower(text) AS t FROM benchmark", "SELECT id, lower(x) AS t FROM a")


@query(rf"""WITH a AS (SELECT doc_id AS id, CASE doc_id % 60 WHEN 0 THEN f WHEN 20 THEN '?' ELSE reverse(f) || ' code 1234' END AS x
  FROM (SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 12), ' ') AS f FROM documents WHERE doc_id % 20 = 0) WHERE doc_id IN (SELECT vec_id FROM embeddings)),
{_ROUTED_TOKENS}, {_NEAR},
names AS (SELECT doc_id // 4 AS doc, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 4), ' ') AS name FROM documents WHERE doc_id % 4 = 0),
t AS (SELECT 'd' AS side, doc AS id, lower(name) AS x FROM names UNION ALL SELECT 'q', id, lower(x) FROM a),
{_NAMES},
ok AS (SELECT a.id AS query_id, d.doc FROM a, (SELECT doc_id // 4 AS doc FROM documents UNION SELECT vec_id // 8 FROM embeddings) d WHERE a.id NOT IN (SELECT query_id FROM named) OR EXISTS (SELECT 1 FROM named n WHERE n.query_id = a.id AND n.doc_id = d.doc)),
v AS (SELECT near.query_id, key // 2 AS key, distance, row_number() OVER (PARTITION BY near.query_id ORDER BY distance, key // 2) - 1 AS r FROM near JOIN ok ON ok.query_id = near.query_id AND ok.doc = key // 8 QUALIFY r < 17),
b AS (SELECT s.query_id, doc_id AS key, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) - 1 AS r FROM score s JOIN ok ON ok.query_id = s.query_id AND ok.doc = doc_id // 4 WHERE s.query_id IN (SELECT query_id FROM v) QUALIFY r < 17),
v1 AS (SELECT query_id, key, max(r) AS r, arg_max(distance, r) AS distance FROM v WHERE query_id IN (SELECT query_id FROM b) GROUP BY ALL),
f AS (SELECT coalesce(v1.query_id, b.query_id) AS query_id, coalesce(v1.key, b.key) AS key, coalesce(1.0 / (60 + v1.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS s, coalesce(distance, 0.5) AS distance
      FROM v1 FULL JOIN b ON v1.query_id = b.query_id AND v1.key = b.key),
h AS (
  SELECT query_id, key, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS rank, true AS has_name FROM f QUALIFY rank <= 17
  UNION ALL SELECT query_id, key, arg_min(distance, r), row_number() OVER (PARTITION BY query_id ORDER BY min(r)), true FROM v WHERE query_id NOT IN (SELECT query_id FROM b) GROUP BY query_id, key
  UNION ALL SELECT s.query_id, doc_id, 0.0, 1, false FROM score s JOIN a ON a.id = s.query_id WHERE s.query_id NOT IN (SELECT query_id FROM v) AND regexp_matches(x, '\d{{4,}}|/|(?i)(code|错误码|error)\s*[=:：]?\s*\d') QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) = 1)
SELECT query_id, rank, key // 4 AS doc_id, key % 4 AS section_id, CASE WHEN has_name THEN name END AS doc_name, round(distance, 6) AS distance FROM h LEFT JOIN names ON names.doc = key // 4 WHERE key IN (SELECT doc_id FROM documents)""")
def hybrid_routed(spark, sf_dir):
    """CJ1, JN1: four texts are a document, two vectors the chunks of a section; some questions name documents, some have no words."""
    d = read(spark, sf_dir, "documents")
    lead = lambda n: F.array_join(F.slice(F.split("text", r"\s+", n + 1), 1, n), " ")
    s = d.select(F.col("doc_id").alias("key"), F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).alias("section_id"), F.col("source").alias("title"), "text")
    names = d.where("doc_id % 4 = 0").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), lead(4).alias("name"))
    kind = F.col("query_id") % 60
    asked = _asked(spark, sf_dir).withColumn("text", F.when(kind == 0, F.col("text")).when(kind == 20, "?").otherwise(F.concat(F.reverse("text"), F.lit(" code 1234"))))
    q = asked.join(_seekers(spark, sf_dir).select("query_id", "embedding"), "query_id")
    chunks = _vectors(spark, sf_dir).select(F.floor(F.col("key") / 2).alias("key"), "embedding")
    out = fusion.hybrid_retrieve(q, _index(spark, sf_dir), chunks, s, names)
    return out.select("query_id", "rank", "doc_id", "section_id", "doc_name", F.round("distance", 6).alias("distance"))


@query("""SELECT e.vec_id AS chunk_id, d.doc_id, coalesce(nullif(d.source, 'src0'), 'chunk ' || e.vec_id) AS section_title, md5(coalesce(nullif(d.text, ''), 'label ' || e.label)) AS section_md5, d.lang AS doc_name
FROM (SELECT *, vec_id % 700 AS doc_id FROM embeddings) e LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NOT NULL
UNION ALL SELECT e.vec_id, e.doc_id, 'chunk ' || e.vec_id, md5('label ' || e.label), NULL FROM (SELECT *, vec_id % 700 AS doc_id FROM embeddings) e WHERE e.doc_id NOT IN (SELECT doc_id FROM documents)""")
def chunk_sections(spark, sf_dir):
    """JN3, JN4: vectors as chunks of documents; some sections have no title, some chunks no section."""
    d = read(spark, sf_dir, "documents")
    chunks = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 700).alias("doc_id"), F.lit(0).alias("section_id"), F.concat(F.lit("chunk "), "vec_id").alias("title"), F.concat(F.lit("label "), "label").alias("text"))
    s = d.select("doc_id", F.lit(0).alias("section_id"), F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("title"), "text")
    out = fusion.attach_names(fusion.attach_sections(chunks, s), d.select("doc_id", F.col("lang").alias("name")))
    return out.select("chunk_id", "doc_id", "section_title", F.md5(F.col("section_text").cast("binary")).alias("section_md5"), "doc_name")


@query(f"""WITH t AS (SELECT 'd' AS side, doc_id AS id, lower(string_split(text, chr(10))[1]) AS x FROM documents UNION ALL SELECT 'q', item_id, lower(text) FROM benchmark),
{_NAMES} SELECT query_id, doc_id, overlap FROM named""")
def name_routing(spark, sf_dir):
    """JN1: documents named by their first line, asked for by benchmark passages."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", 2)[0].alias("name"))
    return catalog.match_docs(_questions(spark, sf_dir), d)


@query("SELECT label AS model, count(*) AS chunks, count(DISTINCT vec_id % 100) AS sections, false AS need_reindex FROM embeddings GROUP BY label UNION ALL SELECT -1, 0, 0, true")
def collection_stats(spark, sf_dir):
    """AG4: vectors by label as collections, with one that is empty."""
    e = read(spark, sf_dir, "embeddings")
    models = e.select(F.col("label").alias("model")).distinct().unionByName(spark.range(1).select(F.lit(-1).alias("model")))
    rows = e.select(F.col("label").alias("model"), F.lit(0).alias("doc_id"), (F.col("vec_id") % 100).alias("section_id"))
    return catalog.collection_stats(rows, models)
