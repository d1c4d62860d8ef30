import random
import zlib
from collections import Counter, defaultdict

from quillspark.llm import sharding as H


def check(rows, placed, shards=8):
    assert len(placed) == len(rows)
    counts = Counter(r["shard"] for r in placed)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 if rows else not placed
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together_and_counts_are_even(spark):
    rng = random.Random(2)
    rows = [(i, f"text {i}") for i in range(900)]
    rows += [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(2000 + i, "hot") for i in range(700)] + [(3000 + i, f"five {i // 5}") for i in range(200)]
    rows += [(None, "pair 1"), (4000, None), (4001, ""), (4000, None), (4002, "ünï")]
    rng.shuffle(rows)
    placed = H.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(rows, placed)
    text = dict(rows)
    for r in placed:
        if r["doc_id"] is not None:
            b = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b)
    at = defaultdict(set)
    for r in placed:
        at[r["link"]].add(r["shard"])
    n = Counter(r["link"] for r in placed)
    cut = [k for k in at if len(at[k]) > 1]
    assert len(cut) <= 8, "few groups are cut"
    assert max(len(v) for k, v in at.items() if n[k] == 700) <= 5  # 700 of 2205 rows: three shards at least


def test_small_and_empty(spark):
    for rows in ([], [(1, "a")], [(i, "same") for i in range(10)]):
        check(rows, H.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(1, "a", 5), (1, "b", 6), (1, "a", 7), (None, "a", 8), (None, None, 9), (None, None, 9), (2, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, at int").selectExpr("*", "'mine' slot", "0 spans")
    H.write_shards(docs, H.shard_documents(docs, 2), f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["at"]) for r in got))) == sorted(map(str, rows))
    check(rows, got, 2)


def test_shard_rows_keeps_columns_with_clashing_names(spark):
    df = spark.range(50).selectExpr("id", "id % 5 link", "id row_tie", "-id at", "'x' spans", "id shard", "id slot", "id link_at")
    got = H.shard_rows(df).collect()
    check([0] * 50, got)
    assert all(r["row_tie"] == r["id"] == -r["at"] == r["link_at"] and r["spans"] == "x" for r in got) and len({r["id"] for r in got}) == 50
