"""Files in and out: corpora, pages, graphs, question sets, event logs, archives, indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import content_hash, edge_endpoints, strip

TEXT_ENDINGS = [".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".log"]
QUESTION = "id int, category string, question string, expected_answer_keywords array<string>"
TASK = "type string, doc_id bigint, url string, crawl boolean, max_depth int, max_pages int, file_path string, filename string, ext string"


def route_sources(files: DataFrame) -> DataFrame:
    """IO1, IO2: (path, ext, content_hash, size, text, status, error) from (path, length, content).

    Undecodable bytes become replacement characters. An unsupported ending gives a failed row, never a failed job.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    ok = ext.isin(TEXT_ENDINGS)
    text = F.when(ok, strip(_decode("content")))
    return files.select("path", ext.alias("ext"), content_hash(F.col("content")).alias("content_hash"), F.col("length").alias("size"), text.alias("text"), F.when(ok, "ready").otherwise("failed").alias("status"), F.when(~ok, F.concat(F.lit("unsupported: "), ext)).alias("error"))


def _decode(content: str) -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return run(content)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return route_sources(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """IO3: (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO5: services (name, description, type) and edges (src, dst, attrs) of JSON or YAML files.

    Edges are the first non-empty of edges, links and dependencies. Edges without both ends go.
    """
    edge = "array<map<string,string>>"
    schema = f"services array<string>, edges {edge}, links {edge}, dependencies {edge}"

    @F.pandas_udf("string")
    def as_json(content: pd.Series) -> pd.Series:
        import json

        import yaml

        return content.map(lambda b: json.dumps(yaml.safe_load(bytes(b).decode("utf-8", "replace")) or {}, ensure_ascii=False))

    doc = spark.read.format("binaryFile").load(path).select(F.from_json(as_json("content"), schema).alias("d"))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    edges = doc.select(F.explode(F.coalesce(full("d.edges"), full("d.links"), full("d.dependencies"))).alias("attrs")).select(edge_endpoints(F.col("attrs")).alias("e"), "attrs").select("e.src", "e.dst", "attrs").where("src is not null and dst is not null")
    one = doc.select(F.explode("d.services").alias("s"))
    get = lambda *keys: F.coalesce(*[F.get_json_object("s", f"$.{k}") for k in keys])
    services = one.select(F.coalesce(get("name"), F.col("s")).alias("name"), F.coalesce(get("desc", "description"), F.lit("")).alias("description"), get("type").alias("type"))
    return services, edges


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("multiLine", "true").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """IO11."""
    df.write.mode("overwrite").json(path)


def parse_sse(logs: DataFrame) -> DataFrame:
    """IO7: (request_id, seq, event, data) of raw event streams; data lines join, empty data and bad JSON go."""
    b = logs.select("request_id", F.posexplode(F.split(F.regexp_replace("raw", "\r\n", "\n"), "\n\n")).alias("seq", "block"))
    data = F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data:[ ]?(.*)$"), F.lit(1)), "")
    event = F.coalesce(F.nullif(F.trim(F.regexp_extract("block", r"(?m)^event:(.*)$", 1)), F.lit("")), F.lit("message"))
    out = b.select("request_id", "seq", event.alias("event"), F.trim(data).alias("data")).where("data <> ''")
    return out.where(F.try_parse_json("data").isNotNull())


def archive(df: DataFrame, path: str, as_of: str) -> None:
    """IO8: by ending and date."""
    df.withColumns({"ext": F.coalesce(F.nullif(F.ltrim(F.col("ext"), F.lit(".")), F.lit("")), F.lit("other")), "ingest_date": F.lit(as_of)}).write.mode("append").partitionBy("ext", "ingest_date").parquet(path)


def unique_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """IO9: (dir, name, stored_name): a name that its folder has gets _1, _2 and so on before its ending.

    Numbers go on from what the folder holds, so a stored name is never taken twice.
    """
    stem, ext = F.regexp_replace("name", r"\.[^.]+$", ""), F.regexp_extract("name", r"(\.[^.]+)$", 1)
    base = F.regexp_replace(F.regexp_replace("name", r"\.[^.]+$", ""), r"_\d+$", "")
    held = existing.select("dir", base.alias("stem"), ext.alias("ext"), F.coalesce(F.regexp_extract(stem, r"_(\d+)$", 1).try_cast("long"), F.lit(0)).alias("k"))
    plain = existing.select("dir", stem.alias("stem"), ext.alias("ext"), F.lit(0).cast("long").alias("k"))
    top = held.unionByName(plain).groupBy("dir", "stem", "ext").agg(F.max("k").alias("top"))
    rows = new.select("dir", "name", stem.alias("stem"), ext.alias("ext")).join(top, ["dir", "stem", "ext"], "left")
    n = F.row_number().over(Window.partitionBy("dir", "stem", "ext").orderBy("name")) + F.coalesce("top", F.lit(-1))
    rows = rows.withColumn("n", n)
    return rows.select("dir", "name", F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), "ext")).alias("stored_name"))


def write_index(sections: DataFrame, chunks: DataFrame, vectors: DataFrame, path: str, buckets: int = 64) -> None:
    """IO10: tables by bucket of the document; only the buckets that occur are replaced."""
    for df, name in ((sections, "sections"), (chunks, "chunks"), (vectors, "vectors")):
        out = df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).repartition("doc_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(f"{path}/{name}")


def workspace_inventory(files: DataFrame, root: str) -> DataFrame:
    """IO12, WN11: (session, n_files, bytes, latest, files), latest first, from (path, length, modificationTime).

    Sessions are the folders below root; loose files belong to _root.
    """
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    f = files.select(F.when(F.contains(rel, F.lit("/")), F.regexp_extract(rel, "^([^/]+)/", 1)).otherwise("_root").alias("session"), F.col("path"), rel.alias("rel"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return f.groupBy("session").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.max("mtime").alias("latest"), F.array_sort(F.collect_list(F.struct("rel", "name", "size", "mtime"))).alias("files")).orderBy(F.desc("latest"), "session")


def read_workspace(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def strip_json_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """SC25: a JSON column without a key, at any depth; bad JSON stays as it is."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        import json

        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if k != key}
            return [clean(x) for x in v] if isinstance(v, list) else v

        def one(t):
            try:
                return t if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except ValueError:
                return t

        return c.map(one)

    return df.withColumn(column, run(column))


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """SC26: (doc_id, text, status): an edit applies where its old text occurs exactly once; one edit a document."""
    j = edits.join(texts, "doc_id", "left")
    n = F.when(F.col("old") == "", 0).otherwise((F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old"))
    status = F.when(F.col("text").isNull(), "no document").when(n == 0, "not found").when(n > 1, "ambiguous").otherwise("ok")
    return j.select("doc_id", F.when(status == "ok", F.replace("text", "old", "new")).otherwise(F.col("text")).alias("text"), status.alias("status"))


