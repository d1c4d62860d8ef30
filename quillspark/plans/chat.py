"""Conversations and events: replay, compaction, turn states, audits, evaluation, streams as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chatlog, quality
from ..streaming import events as S
from .registry import query, read

_SUMMARY = "s AS (SELECT conv_id, 2 AS c, substr(arg_min(text, turn), 1, 20) AS summary FROM conversations GROUP BY conv_id HAVING count(*) >= 4)"


def _threads(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", F.col("text").alias("content"))
    s = c.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.substring(F.min_by("content", "turn"), 1, 20).alias("summary")).where("n >= 4")
    return c, s.select("thread_id", F.lit(2).alias("compacted_count"), "summary")


@query(f"""WITH {_SUMMARY}, m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
k AS (SELECT m.conv_id, m.n, m.role, m.text FROM m LEFT JOIN s USING (conv_id) WHERE n > coalesce(c, 0) AND (role = 'user' OR (role = 'assistant' AND text <> '')))
SELECT conv_id AS thread_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS pos, role, md5(text) AS md5 FROM k UNION ALL SELECT conv_id, 0, 'system', md5(summary) FROM s""")
def message_replay(spark, sf_dir):
    """WN8."""
    c, s = _threads(spark, sf_dir)
    return chatlog.replay(c, s).select("thread_id", "pos", "role", F.md5(F.col("content").cast("binary")).alias("md5"))


@query(f"""WITH {_SUMMARY}, m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
k AS (SELECT m.*, coalesce(c, 0) AS c, summary, n >= coalesce(c, 0) AND role IN ('user', 'assistant') AS live, greatest(total - 4, coalesce(c, 0)) AS t FROM m LEFT JOIN s USING (conv_id)),
g AS (SELECT conv_id, floor((coalesce(sum(length(text)) FILTER (live), 0) + coalesce(max(length(summary)), 0)) * 0.6) AS tokens, max(c) AS c, max(t) AS t,
      md5(coalesce(string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY n) FILTER (live AND n < t), '')) AS md5 FROM k GROUP BY conv_id)
SELECT conv_id AS thread_id, c AS from_n, t AS to_n, t AS new_count, md5 FROM g WHERE tokens >= 300 AND t > c""")
def compaction_plan(spark, sf_dir):
    """WN9, SC20: threads of 300 tokens or more keep their last two turns."""
    c, s = _threads(spark, sf_dir)
    return chatlog.compaction_plan(c, s, 300, 2).select("thread_id", "from_n", "to_n", "new_count", F.md5(F.col("old_text").cast("binary")).alias("md5"))


@query("""SELECT o_orderkey AS thread_id, o_orderdate::DATE AS day, CASE WHEN o_orderdate::DATE = DATE '1998-07-01' THEN 'today' WHEN o_orderdate::DATE >= DATE '1998-07-01' - 30 THEN '30 days' ELSE strftime(o_orderdate, '%Y-%m') END AS bucket
FROM orders WHERE contains(lower(o_orderpriority), 'urgent')""")
def recency_buckets(spark, sf_dir):
    """WN10: orders as conversations, searched by title."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thread_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at"))
    return chatlog.recent_conversations(o, "1998-07-01", "URGENT").select("thread_id", F.to_date("updated_at").alias("day"), "bucket")


_TOOL = "CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'web_search' ELSE event_type END"


def _calls(spark, sf_dir):
    tool = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "grep").when(F.col("event_type") == "purchase", "web_search").otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.dayofmonth("ts").alias("turn"), F.col("event_id").alias("seq"), tool.alias("tool"), (F.col("value") > 50).alias("has_result"), "value")


_TURN = f"""t AS (SELECT user_id AS thread_id, day(ts)::INT AS turn, bool_or(event_type = 'view') AS r, bool_or(event_type = 'click') AS g, coalesce(bool_or(value > 50), false) AS c, bool_or(event_type = 'purchase') AS w,
  string_agg({_TOOL}, ',' ORDER BY event_id) AS tools FROM events GROUP BY ALL)"""


@query(f"WITH {_TURN} SELECT thread_id, turn, r AS kb_retrieve_done, g AS kb_grep_done, c AS kb_has_coverage, w AS web_used, tools AS tools_called FROM t")
def turn_state(spark, sf_dir):
    """AG10: a user's events of a day as the tool calls of a turn."""
    return chatlog.turn_state(_calls(spark, sf_dir)).withColumn("tools_called", F.array_join("tools_called", ","))


_RISK = r"""regexp_matches(a, '(?i)((v|版本|version)\s*[\d.]+[a-zA-Z0-9.-]*|(Java|Python|Node|Go|Ruby|PHP|\.NET|Spring|Django|React|Vue)\s+\d+(\.\d+)*|\b\d+\.\d+(\.\d+)?(\.\d+)?[a-zA-Z0-9-]*\b)')"""


@query(f"""WITH {_TURN}, j AS (SELECT *, coalesce({_RISK}, false) AS risk, coalesce(a, '') <> '' AS said FROM (SELECT t.*, CASE turn % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE d.text END AS a FROM t JOIN documents d ON d.doc_id = t.thread_id)),
p AS (SELECT thread_id, turn, 'unsupported_claim' AS policy, 'high' AS severity FROM j WHERE r AND NOT c AND NOT w AND risk
UNION ALL SELECT thread_id, turn, 'missing_doc_cite', 'medium' FROM j WHERE said AND c AND NOT regexp_matches(a, 'doc_id[=:]\\s*\\d+')
UNION ALL SELECT thread_id, turn, 'missing_url_cite', 'medium' FROM j WHERE said AND w AND NOT (regexp_matches(a, 'https?://') OR contains(a, '联网搜索'))
UNION ALL SELECT thread_id, turn, 'web_before_kb', 'blocked' FROM j WHERE w AND (NOT r OR c))
SELECT * FROM p""")
def answer_audit(spark, sf_dir):
    """CJ5, SC18: turns of users with a document of the same number as answer; some turns have none or an empty one."""
    t = chatlog.turn_state(_calls(spark, sf_dir)).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("thread_id"), F.col("text").alias("answer")), "thread_id")
    t = t.withColumn("answer", F.when(F.col("turn") % 7 == 1, "").when(F.col("turn") % 7 != 0, F.col("answer")))
    return quality.audit_answers(t, quality.default_policies(2026), "medium").select("thread_id", "turn", "policy", "severity")


_CLAIMS = f"""WITH x AS (SELECT doc_id, text, regexp_extract_all(text, '{X.VERSION}') AS v, list_filter(regexp_extract_all(text, '{X.DATE}'), lambda d: regexp_matches(d, '202[1-7]')) AS d,
  list_filter({X.LATEST!r}::VARCHAR[], lambda k: contains(lower(text), k)) AS k FROM documents)
SELECT doc_id, len(v) > 0 OR len(d) > 0 AS has_risk, CASE WHEN len(v) > 0 OR len(d) > 0 THEN 'high' ELSE 'low' END AS confidence,
  concat_ws(',', CASE WHEN len(v) > 0 THEN 'version' END, CASE WHEN len(d) > 0 THEN 'recent_date' END, CASE WHEN len(v) > 0 AND len(k) > 0 THEN 'latest_keyword' END) AS signals,
  coalesce(array_to_string(list_slice(list_slice(v, 1, 2) || list_slice(d, 1, 2) || CASE WHEN len(v) > 0 AND len(k) > 0 THEN ['关键词: ' || k[1]] ELSE [] END, 1, 3), '|'), '') AS examples FROM x"""


@query(_CLAIMS)
def claims_scan(spark, sf_dir):
    """SC17: the claims of documents that age, the year pinned."""
    c = read(spark, sf_dir, "documents").select("doc_id", X.time_sensitive_claims(F.col("text"), 2026).alias("c"))
    return c.select("doc_id", "c.has_risk", "c.confidence", F.array_join("c.signals", ",").alias("signals"), F.array_join("c.examples", "|").alias("examples"))


@query("""SELECT doc_id, md5(CASE WHEN contains(text, 'All rights reserved.') THEN trim(replace(replace(text, 'All rights reserved.', ''), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(13)) ELSE text END) AS md5, contains(text, 'All rights reserved.') AS hit FROM documents""")
def warning_scrub(spark, sf_dir):
    """SC16: a boilerplate line taken out."""
    t, w = F.col("text"), "All rights reserved."
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.scrub_warning(t, w).cast("binary")).alias("md5"), F.contains(t, F.lit(w)).alias("hit"))


@query(f"""SELECT {_TOOL} AS name, count(*) AS n_calls, count(*) FILTER (value IS NULL OR value >= 10) AS n_ok FROM events WHERE event_type <> 'signup' GROUP BY 1""")
def tool_outcomes(spark, sf_dir):
    """AG13: small values are errors; calls without a name go."""
    c = _calls(spark, sf_dir).select(F.col("seq").cast("string").alias("id"), F.when(F.col("tool") != "signup", F.col("tool")).alias("name"), F.when(F.col("value") < 10, "Tool execution error: x").otherwise("fine").alias("result"))
    return chatlog.tool_outcomes(c)


@query("""WITH g AS (SELECT user_id, string_agg(event_type, '' ORDER BY event_id) FILTER (event_type <> 'error') AS t, arg_max(CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'error') AS err FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS request_id, coalesce(err, t, '抱歉，未能生成回答。') AS answer, err AS error FROM g""")
def answer_assembly(spark, sf_dir):
    """AG11: a user's events as the tokens of an answer; the last error wins."""
    e = read(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    data = F.when(err, F.to_json(F.struct(F.col("event_id").cast("string").alias("message")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("text"))))
    return chatlog.assemble_answers(e.select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), F.when(err, "error").otherwise("token").alias("event"), data.alias("data")))


@query("""WITH e AS (SELECT conv_id, turn, text, role = 'system' OR turn = 3 AS made FROM conversations), k AS (SELECT *, max(CASE WHEN made THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS m, max(CASE WHEN made THEN turn END) OVER (PARTITION BY conv_id) AS newest FROM e)
SELECT conv_id AS artifact_id, md5(string_agg(text, '' ORDER BY turn) FILTER (m = newest)) AS md5, count(*) FILTER (m IS NULL) AS rejected FROM k WHERE newest IS NOT NULL GROUP BY conv_id""")
def artifact_fold(spark, sf_dir):
    """AG12: system turns and fourth turns create, the others append."""
    c = read(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("artifact_id"), F.col("turn").alias("seq"), F.when((F.col("role") == "system") | (F.col("turn") == 3), "create").otherwise("append").alias("op"), "text")
    return chatlog.fold_appends(e).select("artifact_id", F.md5(F.col("content").cast("binary")).alias("md5"), "rejected")


@query("""WITH h AS (SELECT user_id AS thread_id, day(ts)::INT AS turn, event_id AS seq, event_type AS doc_id, round(value, 3) AS distance FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY thread_id, turn, doc_id ORDER BY distance NULLS FIRST, seq) AS k, min(seq) OVER (PARTITION BY thread_id, turn, doc_id) AS seen FROM h)
SELECT thread_id, turn, doc_id, seq, distance, row_number() OVER (PARTITION BY thread_id, turn ORDER BY seen) AS pos FROM k WHERE k = 1""")
def citation_merge(spark, sf_dir):
    """WN6: events as hits, kinds as documents."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.dayofmonth("ts").alias("turn"), F.col("event_id").alias("seq"), F.col("event_type").alias("doc_id"), F.lit(0).alias("section_id"), F.round("value", 3).alias("distance"))
    return chatlog.merge_citations(e).drop("section_id")


@query("""WITH a AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 3000 AS doc FROM conversations)
SELECT conv_id AS thread_id, turn, doc AS doc_id, CASE WHEN doc NOT IN (SELECT doc_id FROM documents) THEN 'no such document' ELSE 'not retrieved' END AS reason FROM a WHERE doc NOT IN (SELECT doc_id FROM documents) OR doc % 2 = 1""")
def dangling_citations(spark, sf_dir):
    """JN15, SC19: citations made up for every turn; even documents were retrieved."""
    doc = (F.col("conv_id") * 7 + F.col("turn")) % 3000
    a = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", F.concat("text", F.lit("《x》[doc_id:"), doc.cast("string"), F.lit("]")).alias("answer"), doc.alias("doc_id"))
    return quality.dangling_citations(a, read(spark, sf_dir, "documents"), a.where("doc_id % 2 = 0"))


_EVAL = r"""w AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS ws FROM benchmark),
k AS (SELECT item_id, list_slice(list_sort(list_transform(ws, lambda x: {'n': -length(x), 'w': x})), 1, 4) AS ks FROM w),
e AS (SELECT k.item_id AS id, d.lang AS category, list_filter(list_transform(ks, lambda x: x.w), lambda x: contains(d.text, x)) AS m, len(ks) AS n FROM k JOIN documents d ON d.doc_id = k.item_id),
sc AS (SELECT id, category, CASE WHEN n > 0 THEN round(len(m) / n, 6) END AS score, array_to_string(m, ',') AS matched, n AS total_keywords FROM e)"""


def _scores(spark, sf_dir):
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0)))
    longest = F.slice(F.array_sort(F.transform(tokens, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), 1, 4)
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.transform(longest, lambda x: x["w"]).alias("expected_answer_keywords"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("answer"))
    return quality.evaluate(q.join(d.select("id", "category"), "id"), d)


@query(f"WITH {_EVAL} SELECT * FROM sc")
def keyword_eval(spark, sf_dir):
    """AG7: the four longest words of a passage, looked for in the document of the same number."""
    s, _ = _scores(spark, sf_dir)
    return s.select("id", "category", F.round("score", 6).alias("score"), F.array_join("matched_keywords", ",").alias("matched"), F.col("total_keywords").cast("long").alias("total_keywords"))


@query(f"WITH {_EVAL} SELECT category, round(avg(score), 6) AS avg_score, count(*) AS n FROM sc WHERE score IS NOT NULL GROUP BY ROLLUP (category)")
def eval_summary(spark, sf_dir):
    """AG8, CJ6."""
    _, t = _scores(spark, sf_dir)
    return t.withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT day(ts)::INT AS round, round(avg((event_type = 'view')::INT), 6) AS retrieval_rate, round(avg((event_type = 'error')::INT), 6) AS warning_rate, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def round_metrics(spark, sf_dir):
    """AG9: days as rounds."""
    e = read(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("round"), (F.col("event_type") == "view").alias("retrieved"), (F.col("event_type") == "error").alias("warned"), F.col("value").alias("response_ms"))
    m = quality.round_metrics(e)
    return m.select("round", *[F.round(c, 6).alias(c) for c in ("retrieval_rate", "warning_rate", "mean_ms")])


def _callbacks(spark, sf_dir):
    """Events as callbacks, each sent twice; some without id, some of other kinds, tokens and message types."""
    e = read(spark, sf_dir, "events")
    content = F.to_json(F.struct(F.concat(F.lit("@_user_1 "), F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("text")))
    msg = F.struct(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chat_id"), F.when(F.col("event_type") == "error", "image").otherwise("text").alias("message_type"), content.alias("content"))
    head = F.struct(F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("event_id").cast("string")).alias("event_id"), F.when(F.col("event_type") == "signup", "other").otherwise("im.message.receive_v1").alias("event_type"), F.when(F.col("event_id") % 7 == 0, "bad").otherwise("t").alias("token"))
    one = e.select("ts", F.to_json(F.struct(head.alias("header"), F.struct(msg.alias("message")).alias("event"))).alias("value"))
    return S.parse_events(one.unionByName(one))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 1 AS n FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT '', 2 * count(*) FROM events WHERE event_id % 10 = 0")
def event_dedup(spark, sf_dir):
    """SS1 over a table."""
    return S.dedup_batch(_callbacks(spark, sf_dir)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'feishu-c' || user_id AS thread_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id, event_type || ' ' || user_id AS text FROM events, (VALUES (1), (2)) v(k) WHERE event_id % 7 <> 0 AND event_type NOT IN ('signup', 'error')")
def event_route(spark, sf_dir):
    """SS2, SC15."""
    return S.route_events(_callbacks(spark, sf_dir), "t")
