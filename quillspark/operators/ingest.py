"""Ingest: from files and pages to a catalog, sections and chunks, as one batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import collapse_blank_lines, content_hash, needs_summary
from ..sources.staging import stage_table
from .catalog import dedup_by_hash
from .split import chunks, index_documents, sections


def ingest(incoming: DataFrame, existing: DataFrame, level: int | None = None) -> dict[str, DataFrame]:
    """CJ4: catalog, sections and chunks of (doc_id, name, text); existing: (doc_id, content_hash, status).

    Content that a ready document has, or an earlier one of the batch, is neither parsed nor indexed again: its row
    names the survivor. Null or empty texts fail; the job goes on.
    """
    rows = incoming.select("doc_id", "name", collapse_blank_lines(F.col("text")).alias("text"), content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    plan = stage_table(rows.join(dedup_by_hash(rows, existing), "doc_id"), "plan")
    ok = F.coalesce("text", F.lit("")) != ""
    own = plan.where((F.col("doc_id") == F.col("survivor_id")) & ok)
    indexed = stage_table(index_documents(own, level), "indexed")
    status = F.when(~ok, "failed").when(F.col("doc_id") != F.col("survivor_id"), "duplicate").otherwise("ready")
    chars = F.coalesce(F.length("text"), F.lit(0))
    catalog = plan.select("doc_id", "name", "content_hash", "survivor_id", status.alias("status"), chars.alias("char_count"), needs_summary(chars).alias("needs_summary"), F.when(~ok, "empty text").alias("error"))
    return {"catalog": catalog, "sections": sections(indexed), "chunks": chunks(indexed)}
