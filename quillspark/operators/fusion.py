"""Rank fusion, section dedup, context assembly and the hybrid retrieval job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import has_exact_id, snippet
from ..sources.staging import stage_table
from .bm25 import Index, bm25_topk
from .catalog import match_docs
from .vectors import vector_topk


def rrf_fuse(vec: DataFrame, bm25: DataFrame, k: int = 60) -> DataFrame:
    """WN1: (query_id, key, rrf_score, distance, rank). Ranks count from 0; of several chunks of one key the worst counts.

    Inputs: vec (query_id, key, rank, distance) and bm25 (query_id, key, rank), ranks from 0. Keys that only BM25 found
    get distance 0.5. Equal scores are ordered by key.
    """
    v = vec.groupBy("query_id", "key").agg(F.max("rank").alias("v_rank"), F.max_by("distance", "rank").alias("distance"))
    b = bm25.groupBy("query_id", "key").agg(F.max("rank").alias("b_rank"))
    part = lambda c: F.coalesce(1.0 / (F.col(c) + k), F.lit(0.0))
    both = v.join(b, ["query_id", "key"], "full").select("query_id", "key", (part("v_rank") + part("b_rank")).alias("rrf_score"), F.coalesce("distance", F.lit(0.5)).alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 9).desc(), "key")
    return both.withColumn("rank", F.row_number().over(w))


def dedup_sections(hits: DataFrame) -> DataFrame:
    """WN2: the first hit of each (query_id, doc_id, section_id) by rank."""
    w = Window.partitionBy("query_id", "doc_id", "section_id").orderBy("rank")
    return hits.withColumn("first_hit", F.row_number().over(w)).where("first_hit = 1").drop("first_hit")


def hit_docs(hits: DataFrame) -> DataFrame:
    """WN3: (query_id, doc_ids): distinct documents by their first position."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("pos"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def best_distance(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """WN7: the smallest distance of each query, 999.0 where nothing was found."""
    low = hits.groupBy("query_id").agg(F.min("distance").alias("d"))
    return queries.select("query_id").join(low, "query_id", "left").select("query_id", F.coalesce("d", F.lit(999.0)).alias("best_distance"))


def build_context(hits: DataFrame, max_chars: int = 1_000_000, label: str = "片段", joint: str = "\n\n---\n\n") -> DataFrame:
    """WN4: (query_id, context, n_parts) from (query_id, rank, doc_name, title, text).

    Parts are numbered by rank, also those without text, which then go. What is left for a part is max_chars less the
    headers and texts before it, its own header and 20; at the first part with nothing left the context ends; a longer
    text is cut and marked. A cut leaves less than nothing for the next part, so running sums of whole lengths suffice.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    named = hits.withColumn("i", F.row_number().over(order)).where("text is not null and text <> ''")
    header = F.concat(F.lit(f"[{label} "), F.col("i").cast("string"), F.lit(": "), F.when(F.coalesce("doc_name", F.lit("")) != "", F.concat(F.lit("《"), F.col("doc_name"), F.lit("》 > "))).otherwise(""), F.coalesce("title", F.lit("")), F.lit("]\n"))
    p = named.withColumn("header", header)
    before = F.coalesce(F.sum(F.length("header") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("left", F.lit(max_chars) - before - F.length("header") - 20)
    p = p.withColumn("least", F.min("left").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("least > 0")
    body = F.when(F.length("text") > F.col("left"), F.concat(F.substring("text", F.lit(1), F.col("left").cast("int")), F.lit("..."))).otherwise(F.col("text"))
    p = p.select("query_id", "i", F.concat("header", body).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"])
    return p.groupBy("query_id").agg(F.array_join(parts, joint).alias("context"), F.count(F.lit(1)).alias("n_parts"))


def build_prompt(queries: DataFrame, contexts: DataFrame, template: str = "参考资料：\n{context}\n\n问题：{question}") -> DataFrame:
    """CJ2: (query_id, prompt); a question without context stays plain."""
    head, rest = template.split("{context}")
    mid, tail = rest.split("{question}")
    full = F.concat(F.lit(head), F.col("context"), F.lit(mid), F.col("text"), F.lit(tail))
    return queries.join(contexts.select("query_id", "context"), "query_id", "left").select("query_id", F.when(F.coalesce("context", F.lit("")) == "", F.col("text")).otherwise(full).alias("prompt"))


def read_sections(requests: DataFrame, sections: DataFrame, max_chars: int = 16_000) -> DataFrame:
    """WN5: (request_id, text, truncated_ids): sections in asked order up to max_chars; the one that overflows is cut."""
    asked = get_sections(requests, sections)
    order = Window.partitionBy("request_id").orderBy("pos")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = asked.withColumn("left", F.lit(max_chars) - before)
    part = F.when(F.col("left") <= 0, None).when(F.length("text") > F.col("left"), F.concat(F.substring("text", F.lit(1), F.col("left").cast("int")), F.lit("…"))).otherwise(F.col("text"))
    gone = F.when((F.col("left") <= 0) | (F.length("text") > F.col("left")), F.col("section_id"))
    p = p.select("request_id", "pos", part.alias("part"), gone.alias("gone"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "part", "gone")))
    out = p.groupBy("request_id").agg(rows.alias("r"))
    return out.select("request_id", F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("text"), F.array_compact(F.transform("r", lambda x: x["gone"])).alias("truncated_ids"))


def get_sections(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """JN16: the asked (doc_id, section_id) in the order of the request; what is missing is skipped."""
    asked = requests.select("request_id", "doc_id", F.posexplode("section_ids").alias("pos", "section_id"))
    return asked.join(sections.select("doc_id", "section_id", "title", "text"), ["doc_id", "section_id"])


def attach_sections(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """JN3: section_title and section_text, from the section or else from the hit's own title and text."""
    s = sections.select("doc_id", "section_id", F.col("title").alias("s_title"), F.col("text").alias("s_text"))
    out = hits.join(s, ["doc_id", "section_id"], "left")
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return out.withColumns({"section_title": pick("s_title", "title"), "section_text": pick("s_text", "text")}).drop("s_title", "s_text")


def attach_names(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """JN4: doc_name of each hit."""
    return hits.join(docs.select("doc_id", F.col("name").alias("doc_name")), "doc_id", "left")


def _route(queries: DataFrame, sections: DataFrame, docs: DataFrame) -> DataFrame:
    """The scope (query_id, key) of the questions whose words name documents (JN1); the others have no row and no filter."""
    return match_docs(queries, docs).join(sections.select("key", "doc_id"), "doc_id").select("query_id", "key")


def hybrid_retrieve(queries: DataFrame, index: Index, vectors: DataFrame, sections: DataFrame, docs: DataFrame, k: int = 12, scope: DataFrame | None = None, rrf_k: int = 60) -> DataFrame:
    """CJ1: (query_id, rank, doc_id, section_id, doc_name, title, text, snippet, distance).

    queries (query_id, text, embedding); vectors (key, embedding), a row for each chunk, keys "doc:section" shared with the
    index; sections (key, doc_id, section_id, title, text). Given a scope (query_id, key), all questions stay within
    theirs. Without one, questions that name documents stay within those, and the others are not filtered.
    The k + 5 nearest chunks and the k + 5 best sections by keywords are fused into k + 5 sections at most. A question
    without keyword hits keeps the order of its chunks, of which the first of a section counts. One without any vector
    hit takes BM25's first of all sections at distance 0 if it names an exact identifier, else nothing.
    """
    most = k + 5
    within = stage_table(_route(queries, sections, docs) if scope is None else scope.select("query_id", "key"), "scope")
    asks = stage_table(queries.select("query_id", "text", "embedding").join(within.select("query_id", F.lit(True).alias("is_scoped")).distinct(), "query_id", "left"), "asks")
    scoped, free = asks.where("is_scoped" if scope is None else "true"), asks.where("is_scoped is null" if scope is None else "false")
    vec = vector_topk(scoped, vectors, most, within)
    key = bm25_topk(scoped, index, most, within)
    if scope is None:
        vec = vec.unionByName(vector_topk(free, vectors, most))
        key = key.unionByName(bm25_topk(free, index, most))
    vec = stage_table(vec.withColumn("rank", F.col("rank") - 1), "near")
    found = vec.select("query_id").distinct()
    key = stage_table(key.withColumn("rank", F.col("rank") - 1).join(found, "query_id", "left_semi"), "worded")
    both = key.select("query_id").distinct()
    fused = rrf_fuse(vec.join(both, "query_id", "left_semi"), key, rrf_k).where(F.col("rank") <= most).select("query_id", "key", "distance", "rank")
    alone = vec.join(both, "query_id", "left_anti").groupBy("query_id", "key").agg(F.min_by("distance", "rank").alias("distance"), F.min("rank").alias("at"))
    alone = alone.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    lost = asks.join(found, "query_id", "left_anti").where(has_exact_id(F.col("text")))
    only = bm25_topk(lost, index, 1).select("query_id", "key", F.lit(0.0).alias("distance"), "rank")
    hits = fused.unionByName(alone.select(*fused.columns)).withColumn("named", F.lit(True)).unionByName(only.withColumn("named", F.lit(False)))
    hits = dedup_sections(hits.join(sections.select("key", "doc_id", "section_id"), "key"))
    hits = attach_names(hits, docs).withColumn("doc_name", F.when(F.col("named"), F.col("doc_name")))
    own = sections.select("key", "title", "text", snippet(F.col("text")).alias("snippet"))  # who needs no texts moves none
    return hits.join(own, "key").select("query_id", "rank", "doc_id", "section_id", "doc_name", "title", "text", "snippet", "distance")
