import json
import time

from quillspark.streaming import events as S


def run(spark, df, name, rows, seconds=90):
    """Start a stream into memory and wait for so many rows; batches for timeouts never cease, so not for all to be done."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    end = time.time() + seconds
    while time.time() < end and spark.sql(f"select * from {name}").count() < rows:
        time.sleep(0.5)
    return q


def callbacks(spark, path):
    msg = lambda i, kind="text", token="t": json.dumps({"header": {"event_id": i, "event_type": "im.message.receive_v1", "token": token}, "event": {"message": {"chat_id": "c", "message_type": kind, "content": json.dumps({"text": "@_user_1 hi"})}}})
    rows = [(msg("1"),), (msg("1"),), (msg(""),), (msg(""),), (msg("2", "image"),), (msg("3", token="bad"),), (json.dumps({"uuid": "4", "token": "t", "event": {"type": "im.message.receive_v1", "message": {"chat_id": "c", "message_type": "text", "content": "{bad"}}}),)]
    spark.createDataFrame(rows, "value string").selectExpr("value", "timestamp'2026-01-01 00:00:00' as ts").write.parquet(path)


def test_dedup_and_routing_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    callbacks(spark, path)
    batch = S.parse_events(spark.read.parquet(path))
    want = sorted(map(tuple, S.route_events(S.dedup_batch(batch), "t").collect()))
    assert want == [("feishu-c", "", "hi"), ("feishu-c", "", "hi"), ("feishu-c", "1", "hi")]
    stream = S.parse_events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    q = run(spark, S.route_events(S.dedup_events(stream), "t"), "routed", 3)
    assert sorted(map(tuple, spark.sql("select * from routed").collect())) == want
    q.stop()


def test_answers_end_or_time_out(spark, tmp_path):
    rows = [("a", 2, "token", "lo"), ("a", 1, "token", "hel"), ("a", 3, "done", None), ("b", 1, "token", "x"), ("b", 2, "error", "broke"), ("c", 1, "token", "cut"), ("c", 2, "interrupted", None), ("d", 1, "token", "open")]
    path = f"file://{tmp_path}/t"
    schema = "request_id string, seq bigint, event string, text string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    q = run(spark, S.assemble_stream(spark.readStream.schema(schema).parquet(path), 500), "answers", 4)
    got = {r["request_id"]: (r["answer"], r["status"]) for r in spark.sql("select * from answers").collect()}
    q.stop()
    assert got == {"a": ("hello", "done"), "b": ("broke", "error"), "c": ("cut" + S.INTERRUPTED, "interrupted"), "d": ("open", "timeout")}


def test_ingest_tasks(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/1.json").write_text(json.dumps({"type": "url", "doc_id": 1, "url": "u"}))
    (tmp_path / "q/2.json").write_text(json.dumps({"type": "odd", "doc_id": 2}))
    (tmp_path / "q/3.json").write_text("{broken")
    seen = []
    q = S.ingest_stream(spark, f"file://{tmp_path}/q", lambda df, _: seen.extend(r["doc_id"] for r in df.collect()), f"file://{tmp_path}/c", f"file://{tmp_path}/bad")
    q.awaitTermination(60)
    assert seen == [1] and spark.read.json(f"file://{tmp_path}/bad").count() == 2
