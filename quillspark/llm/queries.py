"""The registered queries of the training-data operators: thin views with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import crosstok, flac, lexical, linededup, mixing, packing, pii, sharding, simhash, toxicity, urlfilter, warc, winnow
from .common import stage_table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents"), whole=True).select("doc_id", "n_removed", "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), ["doc_id"], shingle_words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical urls of pages that a feed has carried; their other spellings are found by the list."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, RULES, pages.where(F.contains("url", F.lit("utm_source=feed")))).drop("url")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _is_kind(k: int):
    return lambda s: s["kind"] == k


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_read(spark, sf_dir, "documents"), ["doc_id"])
    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.spans_text("base"), 256).alias("base_sha256"), pii.spans_text("spans").alias("spans"))


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac.encode_texts(_read(spark, sf_dir, "documents"), ["doc_id"])
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    keys = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    blocks = flac.decode_media(media, keys)
    payload = blocks.select(*keys, "features", F.unhex(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), "")).alias("payload"))
    return payload.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", F.array_join(F.transform("features", lambda x: F.format_number(x, 6)), ":").alias("feature"),
    )


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", *[F.round(f"p_{c}", 4).alias(f"p_{c}") for c in toxicity.CHAIN], "is_toxic")


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(_read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(_read(spark, sf_dir, "pages")))
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    records = stage_table(records.select("page_id", "record_type", "record_id", "refers_id", "payload_bytes", "payload_digest"), "records")
    return warc.resolve_revisits(records, "payload_bytes", "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.xxhash64("item_id", "text").alias("qid"), "item_id", "text").distinct()
    found = lexical.lexical_topk(_read(spark, sf_dir, "documents"), items.select("qid", "text"), 20)
    return found.join(items.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = crosstok.score_alignments(_read(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_simhash, op3_mix, op4_url_filter, op5_shard, op6_pii, op7_flac, op8_pack, op9_toxicity, op10_winnow, op11_warc, op12_lexical, op13_align)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": f"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS canonical FROM parts),
rules(h, p, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, h || p AS rule, says, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM named, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
listed AS (SELECT DISTINCT canonical FROM named WHERE contains(url, '://') AND contains(url, 'utm_source=feed'))
SELECT n.page_id, host, path, f.rule,
       coalesce(f.says, CASE WHEN l.canonical IS NOT NULL AND contains(n.url, '://') THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fits f ON f.page_id = n.page_id AND f.k = 1 LEFT JOIN listed l ON l.canonical = n.canonical""",
    "op11_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op12_lexical": rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{lexical.TERM}')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{lexical.TERM}')) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, big_n),
x AS (
  SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20""",
}
