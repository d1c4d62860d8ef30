import gzip
import hashlib
import os
import random

from pyspark.sql import functions as F

from quillspark.llm import warc as W

PAGES = "page_id bigint, url string, html string, digest string, path int"


def rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc<>é\r\n ") for _ in range(n))
    a, b = text(500), text(99)
    out = [(i, f"http://x.org/{i}", text(rng.randrange(0, 3000)), "d", i) for i in range(40)]
    out += [(60, "http://x.org/a b\r\nWARC-Type: x", a, None, 1), (50, "u", a, None, 1), (None, None, a, None, 1), (70, None, a, "", None)]
    out += [(80, "u", "é" * 49 + "x", None, 1), (81, "u", "é" * 49 + "x", None, 1), (82, "u", "é" * 50, None, 1), (83, "u", "é" * 50, None, 1)]  # 99 and 100 bytes
    out += [(90, "u", None, None, 1), (91, None, "", None, 1), (92, "u", b, None, 1), (93, "u", b, None, 1)]
    out += [(50, "u", a, "again", 1), (95, "w", text(200), None, 1), (95, "v", "z" * 200, None, 1), (95, "w", "z" * 200, None, 1)]
    out += [(99, "long", "\r\n\r\nWARC/1.1\r\n" * 200_000, None, 1)]
    return out


def want(pages):
    """Payload digests, types and what revisits refer to, row by row."""
    groups = {}
    for k, (i, u, h, *_) in enumerate(pages):
        b = (h or "").encode()
        if len(b) >= 100:
            groups.setdefault(b, []).append((i is None, i or 0, u is None, u or "", k))
    out = []
    for k, (i, _u, h, *_) in enumerate(pages):
        b = (h or "").encode()
        own = min(groups.get(b, [(0, 0, 0, "", k)]))
        again = len(b) >= 100 and own[4] != k
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", (None if own[0] else own[1]) if again else None))
    return sorted(out, key=str)


def test_round_trip_equals_plain_version(spark):
    pages = rows()
    df = spark.createDataFrame(pages, PAGES).repartition(3)
    index = W.write_archives(df)
    got = W.read_records(index).withColumns({"n": F.octet_length("payload").cast("long"), "sha": F.sha2("payload", 256)})
    flat = W.resolve_revisits(got, "n", "sha").select("page_id", "n", "sha", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in flat), key=str) == want(pages)
    urls = {r["url"] for r in got.where("page_id = 60").collect()}
    assert urls == {"http://x.org/a%20b%0D%0AWARC-Type:%20x"}


def test_archives_are_plain_gzip_and_the_index_holds(spark, tmp_path):
    pages = rows()
    index = W.write_archives(spark.createDataFrame(pages, PAGES), f"file://{tmp_path}/warc").collect()
    assert len(index) == len(pages) and {r["record_id"] for r in index} == {r["record_id"] for r in index if r["record_id"]} and len({r["record_id"] for r in index}) == len(pages)
    for r in index:
        raw = open(r["path"].removeprefix("file://"), "rb").read()
        named, block = W.parse_record(gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]))
        assert named["WARC-Record-ID"] == f"<{r['record_id']}>" and named["WARC-Payload-Digest"] == "sha256:" + r["digest"]
        if r["record_type"] == "response":
            assert hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() == r["digest"] and r["payload_bytes"] == len(block.partition(b"\r\n\r\n")[2])
    for f in os.listdir(tmp_path / "warc"):  # members one behind the other and nothing else
        if f.endswith(".gz"):
            own = sorted((r["offset"], r["length"]) for r in index if r["path"].endswith(f))
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == os.path.getsize(tmp_path / "warc" / f)


def test_selected_records_come_by_few_reads(spark):
    index = W.write_archives(spark.createDataFrame(rows(), PAGES).coalesce(1))
    some = index.where("page_id % 10 = 0 and page_id < 40").unionByName(index.where("page_id = 10"))  # one place twice
    assert sorted(r["page_id"] for r in W.read_records(some).collect()) == [0, 10, 20, 30]
    ranges = W.byte_ranges(some).collect()
    assert len(ranges) == 1 and len(ranges[0]["records"]) == 4
    apart = W.byte_ranges(some, gap=10).collect()
    assert len(apart) == 4 and all(r["end"] - r["start"] == r["records"][0]["length"] for r in apart)
    assert sorted(r["page_id"] for r in W.read_records(some, gap=10).collect()) == [0, 10, 20, 30]
    split = W.byte_ranges(index, span=1000).collect()
    assert len(split) > 3 and sum(len(r["records"]) for r in split) == index.count()


def test_empty_table(spark):
    index = W.write_archives(spark.createDataFrame([], PAGES))
    assert index.collect() == [] and W.resolve_revisits(W.read_records(index), "payload").collect() == []
