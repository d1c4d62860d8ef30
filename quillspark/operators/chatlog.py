"""Chat logs: turn states, answers from tokens, artifacts, citations, replay and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import estimate_tokens, strip

#: How the result of a failed tool call begins.
ERROR_PREFIXES = ["Tool execution error", "Error", "工具执行"]
NO_ANSWER = "抱歉，未能生成回答。"


def turn_state(calls: DataFrame) -> DataFrame:
    """AG10: one row a turn from (thread_id, turn, seq, tool, has_result)."""
    is_tool = lambda n: F.coalesce(F.bool_or(F.col("tool") == n), F.lit(False))
    return calls.groupBy("thread_id", "turn").agg(
        is_tool("retrieve").alias("kb_retrieve_done"), is_tool("grep").alias("kb_grep_done"),
        F.coalesce(F.bool_or("has_result"), F.lit(False)).alias("kb_has_coverage"), is_tool("web_search").alias("web_used"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"]).alias("tools_called"),
    )


def assemble_answers(sse: DataFrame, default: str = NO_ANSWER) -> DataFrame:
    """AG11: (request_id, answer, error) from (request_id, seq, event, data): tokens in order, unless an error came."""
    token = F.when(F.col("event") == "token", F.get_json_object("data", "$.text"))
    err = F.when(F.col("event") == "error", F.get_json_object("data", "$.message"))
    rows = sse.groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(token.isNotNull(), F.struct("seq", token.alias("t"))))).alias("r"), F.max_by(err, F.when(err.isNotNull(), F.col("seq"))).alias("error"))
    text = strip(F.array_join(F.transform("r", lambda x: x["t"]), ""))
    return rows.select("request_id", F.coalesce("error", F.nullif(text, F.lit("")), F.lit(default)).alias("answer"), "error")


def fold_appends(events: DataFrame) -> DataFrame:
    """AG12: (artifact_id, content, rejected) from (artifact_id, seq, op, text), op create or append.

    Creating again resets; appends before any creation are rejected and counted.
    """
    w = Window.partitionBy("artifact_id").orderBy("seq")
    last = F.max(F.when(F.col("op") == "create", F.col("seq")))
    e = events.withColumns({"made": last.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "newest": last.over(Window.partitionBy("artifact_id"))})
    live = F.when(F.col("made") == F.col("newest"), F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))
    g = e.groupBy("artifact_id").agg(F.array_sort(F.collect_list(live)).alias("r"), F.count_if(F.col("made").isNull()).alias("rejected"), F.max("newest").alias("newest"))
    return g.where("newest is not null").select("artifact_id", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("content"), "rejected")


def tool_outcomes(calls: DataFrame, prefixes: list[str] = ERROR_PREFIXES) -> DataFrame:
    """AG13: (name, n_calls, n_ok) from (id, name, result); calls without id or name go."""
    ok = ~F.coalesce("result", F.lit("")).rlike("^(?:" + "|".join(prefixes) + ")")
    return calls.where("coalesce(id, '') <> '' and coalesce(name, '') <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(ok).alias("n_ok"))


def merge_citations(hits: DataFrame) -> DataFrame:
    """WN6: per turn, document and section the hit of least distance, in the order in which they were first seen."""
    w = Window.partitionBy("thread_id", "turn", "doc_id", "section_id")
    h = hits.withColumns({"k": F.row_number().over(w.orderBy("distance", "seq")), "seen": F.min("seq").over(w)}).where("k = 1")
    return h.withColumn("pos", F.row_number().over(Window.partitionBy("thread_id", "turn").orderBy("seen", "doc_id", "section_id"))).drop("k", "seen")


def _replayable(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user' or (role = 'assistant' and coalesce(content, '') <> '')")


def replay(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """WN8: (thread_id, pos, role, content): the summary at 0, then what was not compacted, in order."""
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))
    m = messages.withColumn("n", n).join(summaries.select("thread_id", "compacted_count"), "thread_id", "left")
    m = _replayable(m.where(F.col("n") > F.coalesce("compacted_count", F.lit(0))))
    m = m.select("thread_id", F.row_number().over(Window.partitionBy("thread_id").orderBy("n")).alias("pos"), "role", "content")
    s = summaries.where("coalesce(summary, '') <> ''").select("thread_id", F.lit(0).alias("pos"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    return m.unionByName(s)


def compaction_plan(messages: DataFrame, summaries: DataFrame, budget: int = 50_000, keep_turns: int = 3, rate: float = 0.6) -> DataFrame:
    """WN9: (thread_id, from_n, to_n, new_count, old_text) of threads whose replay reaches the budget.

    Messages from_n to to_n - 1, counted from 0, are to be summarised; the last 2 * keep_turns stay. Threads with
    nothing older than those are left alone.
    """
    w = Window.partitionBy("thread_id")
    m = messages.withColumns({"n": F.row_number().over(w.orderBy("turn")) - 1, "total": F.count(F.lit(1)).over(w)})
    m = m.join(summaries.select("thread_id", "compacted_count", "summary"), "thread_id", "left").withColumn("c", F.coalesce("compacted_count", F.lit(0)))
    live = (F.col("n") >= F.col("c")) & ((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) != "")))
    to = F.greatest(F.col("total") - 2 * keep_turns, F.col("c"))
    name = F.when(F.col("role") == "user", "用户").otherwise("助手")
    line = F.when(live & (F.col("n") < to), F.struct("n", F.concat(name, F.lit(": "), F.coalesce("content", F.lit(""))).alias("t")))
    g = m.groupBy("thread_id").agg(estimate_tokens(F.sum(F.when(live, F.length(F.coalesce("content", F.lit("")))).otherwise(0)) + F.coalesce(F.max(F.length("summary")), F.lit(0)), rate).alias("tokens"), F.max("c").alias("from_n"), F.max(to).alias("to_n"), F.array_sort(F.collect_list(line)).alias("r"))
    return g.where((F.col("tokens") >= budget) & (F.col("to_n") > F.col("from_n"))).select("thread_id", "from_n", "to_n", F.col("to_n").alias("new_count"), F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("old_text"))


def recent_conversations(convs: DataFrame, as_of: str, query: str | None = None) -> DataFrame:
    """WN10: (thread_id, title, updated_at, bucket), newest first; buckets today, 30 days, or the month."""
    day, now = F.to_date("updated_at"), F.to_date(F.lit(as_of))
    bucket = F.when(day == now, "today").when(day >= F.date_sub(now, 30), "30 days").otherwise(F.date_format("updated_at", "yyyy-MM"))
    c = convs if not query else convs.where(F.contains(F.lower("title"), F.lit(query.lower())))
    return c.select("thread_id", "title", "updated_at", bucket.alias("bucket")).orderBy(F.desc("updated_at"), "thread_id")
