"""The document catalog: folders, routing, upserts, and keeping catalog and index consistent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import name_tokens
from ..sources.staging import stage_table
from . import split
from .split import index_documents


def match_docs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """JN1, ST3: (query_id, doc_id, overlap): documents whose names share most tokens with a question, at least two.

    All documents at the best score stay. Queries without a row here are not filtered at all. Tokens stand in one order,
    rarest first; two sets that share two tokens share one that is not the last of either, so the most frequent token
    of a name or question is no join key. Candidates are verified on their whole token sets.
    """
    q = stage_table(queries.select("query_id", name_tokens(F.col("text")).alias("asked")), "asked")  # each is read three times
    d = stage_table(docs.select("doc_id", name_tokens(F.col("name")).alias("named")), "named")
    n = d.select(F.explode("named").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def keys(side: DataFrame, key: str, tokens: str) -> DataFrame:
        t = side.where(F.size(tokens) > 1).select(key, F.explode(tokens).alias("token")).join(n, "token", "left")
        line = t.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("line"))  # of one name
        return line.select(key, F.explode(F.slice("line", F.lit(1), F.size("line") - 1)).alias("x")).select(key, "x.token")

    pairs = keys(q, "query_id", "asked").join(keys(d, "doc_id", "named"), "token").select("query_id", "doc_id").distinct()
    overlap = F.size(F.array_intersect("asked", "named"))
    n_shared = stage_table(pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", overlap.cast("long").alias("overlap")).where("overlap >= 2"), "shared")
    best = n_shared.groupBy("query_id").agg(F.max("overlap").alias("overlap"))  # no task has all pairs of a question
    return n_shared.join(best, ["query_id", "overlap"], "left_semi").select("query_id", "doc_id", "overlap")


def scope_by_folder(docs: DataFrame, folder: str) -> DataFrame:
    """JN2: (doc_id) in a folder or below it; an empty result means no document, not all."""
    return docs.where((F.col("folder") == folder) | F.startswith("folder", F.lit(folder + "/"))).select("doc_id")


def orphans(index: DataFrame, docs: DataFrame) -> DataFrame:
    """JN6: (doc_id) that the index has and the catalog lacks."""
    return index.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def missing(index: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """JN7: (doc_id, char_count) to index: ready or indexing, not in the index, with a text."""
    wanted = docs.where(F.col("status").isin("ready", "indexing")).select("doc_id").join(index.select("doc_id").distinct(), "doc_id", "left_anti")
    return wanted.join(texts.where("text is not null and text <> ''").select("doc_id", F.length("text").alias("char_count")), "doc_id")


def section_gaps(docs: DataFrame, chunks: DataFrame, sections: DataFrame, backup: DataFrame) -> DataFrame:
    """JN8: backup rows of ready documents that have vectors but no section rows."""
    gap = docs.where("status = 'ready'").select("doc_id").join(chunks.select("doc_id"), "doc_id", "left_semi").join(sections.select("doc_id"), "doc_id", "left_anti")
    return backup.join(gap, "doc_id", "left_semi")


def delete_docs(df: DataFrame, ids: DataFrame) -> DataFrame:
    """JN11: without the rows of the documents in ids."""
    return df.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def dedup_by_hash(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """JN9: (doc_id, survivor_id): the ready document with the same content, else the smallest id of the batch."""
    known = existing.where("status = 'ready'").groupBy("content_hash").agg(F.min("doc_id").alias("known_id"))
    first = incoming.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return incoming.select("doc_id", "content_hash").join(first, "content_hash").join(known, "content_hash", "left").select("doc_id", F.coalesce("known_id", "first_id").alias("survivor_id"))


def upsert_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN10: (doc_id, action): insert, replace (other content or name), skip, or keep what the batch lacks."""
    o = old.select("doc_id", F.col("content_hash").alias("old_hash"), F.col("name").alias("old_name"), F.lit(True).alias("was"))
    n = new.select("doc_id", F.col("content_hash").alias("new_hash"), F.col("name").alias("new_name"), F.lit(True).alias("comes"))
    same = F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("old_name").eqNullSafe(F.col("new_name"))
    return o.join(n, "doc_id", "full").select("doc_id", F.when(F.col("was").isNull(), "insert").when(F.col("comes").isNull(), "keep").when(same, "skip").otherwise("replace").alias("action"))


def apply_upsert(rows: DataFrame, new_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Sections or chunks after an upsert: those of inserted and replaced documents are the new ones."""
    fresh = plan.where("action in ('insert', 'replace')").select("doc_id")
    return delete_docs(rows, fresh).unionByName(new_rows.join(fresh, "doc_id", "left_semi"))


def catalog_by_folder(docs: DataFrame, unfiled: str = "未分类") -> DataFrame:
    """AG5: (folder, n_docs, n_chars), sorted; null folders are the unfiled ones."""
    return docs.groupBy(F.coalesce("folder", F.lit(unfiled)).alias("folder")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("char_count").alias("n_chars")).orderBy("folder")


def folder_tree(docs: DataFrame, folders: DataFrame, root: str = "") -> DataFrame:
    """JN12: (folder, doc_count) of every folder, empty ones too; null or unknown folders count at the root."""
    known = folders.select(F.col("name").alias("folder")).distinct()
    placed = docs.select("folder").join(known.withColumn("ok", F.lit(True)), "folder", "left").groupBy(F.when(F.col("ok"), F.col("folder")).otherwise(root).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    every = known.unionByName(docs.sparkSession.createDataFrame([(root,)], "folder string")).distinct()
    return every.join(placed, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("doc_count"))


def refolder(rows: DataFrame, mapping: DataFrame, column: str = "folder") -> DataFrame:
    """JN13: folder names of documents or folders after a bulk rename (old, new)."""
    return rows.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def collection_stats(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """AG4: (model, chunks, sections, need_reindex) for every model."""
    n = chunks.groupBy("model").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id", "section_id").alias("sections"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return models.join(n, "model", "left").select("model", zero("chunks").alias("chunks"), zero("sections").alias("sections"), (zero("chunks") == 0).alias("need_reindex"))


def section_directory(sections: DataFrame) -> DataFrame:
    """AG6: (doc_id, n_sections, chars, listing) with the sections' ids, titles and lengths in order."""
    row = F.struct("section_id", "title", F.length("text").alias("chars"))
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(row)).alias("listing"))


def _like(rows: DataFrame, old: DataFrame) -> DataFrame:
    """rows with the columns of old; what they lack is null."""
    kinds = dict(old.dtypes)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in old.columns])


def sync_index(docs: DataFrame, texts: DataFrame, chunks: DataFrame, sections: DataFrame, backup: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """CJ3: docs, chunks and sections after a consistency run, to_index, and a report row.

    Rows of documents that the catalog lacks go. Ready or indexing documents with a text but without chunks are split
    and indexed (TX10), and those that were indexing become ready. Ready documents with chunks but without sections get
    theirs back from the backup. force: all chunks go first, so every document with a text is indexed anew. New rows
    have the columns of the given tables. A second run over the result finds nothing to do.
    """
    kept = chunks.where(F.lit(False)) if force else chunks
    gone = orphans(kept, docs)
    todo = stage_table(missing(kept, docs, texts), "to_index")
    fresh = stage_table(index_documents(texts.join(todo.select("doc_id"), "doc_id", "left_semi")), "indexed")
    found = delete_docs(kept, gone)
    left = delete_docs(delete_docs(sections, orphans(sections, docs) if force else gone), todo)
    restored = section_gaps(docs, found, left, backup)
    ready = docs.join(todo.select("doc_id", F.lit(True).alias("is_new"), F.col("char_count").alias("new_chars")), "doc_id", "left")
    status = F.when(F.col("is_new") & (F.col("status") == "indexing"), "ready").otherwise(F.col("status"))
    ready = ready.withColumn("status", status)
    if "char_count" in docs.columns:
        ready = ready.withColumn("char_count", F.coalesce("new_chars", "char_count").cast(dict(docs.dtypes)["char_count"]))
    count = lambda df, name: df.select("doc_id").distinct().agg(F.count(F.lit(1)).alias(name))
    report = count(gone, "removed")
    for df, name in ((todo, "reindexed"), (restored, "fixed"), (docs, "total")):
        report = report.join(count(df, name), F.lit(True), "left")  # one row each
    return {
        "docs": ready.select(*docs.columns), "chunks": found.unionByName(_like(split.chunks(fresh), chunks)),
        "sections": left.unionByName(restored.select(*sections.columns)).unionByName(_like(split.sections(fresh), sections)), "to_index": todo, "report": report,
    }


def sync_job(spark: SparkSession, base: str, out: str, force: bool = False, state: str | None = None) -> DataFrame:
    """SS5: one run of the consistency check over the stored tables docs, texts, chunks, sections and backup below base.

    What sync_index makes of them is written below out, and the report row, which comes back, is added to out/reports
    with its time. A scheduler calls this as often as it likes: with the last out as state, where docs, chunks and
    sections are then read, the job finds nothing left to do.
    """
    at = {n: f"{state or base}/{n}" for n in ("docs", "chunks", "sections")} | {n: f"{base}/{n}" for n in ("texts", "backup")}
    t = {n: spark.read.parquet(p) for n, p in at.items()}
    done = sync_index(t["docs"], t["texts"], t["chunks"], t["sections"], t["backup"], force)
    for name in ("docs", "chunks", "sections", "to_index"):
        done[name].write.mode("overwrite").parquet(f"{out}/{name}")
    done["report"].withColumn("at", F.current_timestamp()).write.mode("append").json(f"{out}/reports")
    return done["report"]
