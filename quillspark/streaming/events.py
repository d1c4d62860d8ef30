"""Streams: event dedup and routing, answers from token streams, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import message_text
from ..sources.files import TASK

EVENT = "header struct<event_id:string,event_type:string,token:string>, token string, uuid string, type string, event struct<type:string,message:struct<chat_id:string,message_type:string,content:string>>"
INTERRUPTED = "\n\n[已中断]"


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """(event_id, token, event_type, chat_id, message_type, content) and the other columns of raw, for both schemas."""
    e = raw.withColumn("_e", F.from_json(F.col(column), EVENT))
    others = [c for c in raw.columns if c != column]
    return e.select(*others, F.coalesce("_e.header.event_id", "_e.uuid", F.lit("")).alias("event_id"), F.coalesce("_e.header.token", "_e.token").alias("token"), F.coalesce("_e.header.event_type", "_e.event.type").alias("event_type"), "_e.event.message.chat_id", "_e.event.message.message_type", "_e.event.message.content")


def dedup_events(stream: DataFrame, time: str = "ts", horizon: str = "10 minutes") -> DataFrame:
    """SS1: each event_id once within the horizon; events without an id all pass.

    State is bounded by the watermark: repeats that come later than the horizon pass again.
    """
    own = stream.where("event_id <> ''").withWatermark(time, horizon).dropDuplicatesWithinWatermark(["event_id"])
    return own.unionByName(stream.where("coalesce(event_id, '') = ''"))


def dedup_batch(events: DataFrame, time: str = "ts") -> DataFrame:
    """SS1 over a table: the first event of each id."""
    first = events.where("event_id <> ''").groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), time).alias("r")).select("event_id", "r.*")
    return first.select(*events.columns).unionByName(events.where("coalesce(event_id, '') = ''"))


def route_events(events: DataFrame, token: str, kind: str = "im.message.receive_v1") -> DataFrame:
    """SS2: (thread_id, event_id, text) of the messages to answer. Works on tables and streams alike."""
    text = message_text(F.col("message_type"), F.col("content"))
    good = events.where((F.col("token") == token) & (F.col("event_type") == kind)).withColumn("text", text)
    return good.where("coalesce(chat_id, '') <> '' and text <> ''").select(F.concat(F.lit("feishu-"), "chat_id").alias("thread_id"), "event_id", "text")


def assemble_stream(stream: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """SS3: (request_id, answer, status) from rows (request_id, seq, event, text), once a request ends.

    done, error or interrupted end it; a request that stays silent for timeout_ms is given out as timeout.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts: list[tuple[int, str]] = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []

        def out(status: str, error: str | None = None) -> pd.DataFrame:
            text = "".join(t for _, t in sorted(parts)).strip()
            if status == "interrupted":
                text += INTERRUPTED
            return pd.DataFrame({"request_id": [key[0]], "answer": [error if error is not None else text], "status": [status]})

        if state.hasTimedOut:
            state.remove()
            yield out("timeout")
            return
        end, error = None, None
        for b in batches:
            for seq, event, text in zip(b["seq"], b["event"], b["text"], strict=True):
                if event == "token":
                    parts.append((int(seq), text or ""))
                elif event in ("done", "error", "interrupted"):
                    end = event
                    error = text if event == "error" else error
        if end:
            if state.exists:
                state.remove()
            yield out("error" if error is not None else end, error)
        else:
            state.update(([s for s, _ in parts], [t for _, t in parts]))
            state.setTimeoutDuration(timeout_ms)

    return stream.groupBy("request_id").applyInPandasWithState(run, "request_id string, answer string, status string", "seqs array<bigint>, texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest_stream(spark: SparkSession, task_dir: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, quarantine: str) -> StreamingQuery:
    """IO4, SS4: task files as they come; rows that are no known task go to the quarantine, the rest to on_batch.

    A batch may be given again after a failure, so on_batch must overwrite by document.
    """
    tasks = spark.readStream.schema(TASK + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(task_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        known = F.coalesce(F.col("type").isin("file", "url"), F.lit(False))
        batch = batch.persist()
        batch.where(~known).write.mode("append").json(quarantine)
        on_batch(batch.where(known).drop("_corrupt").orderBy(F.coalesce("filename", "url")), batch_id)
        batch.unpersist()

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of events by window and kind, with late data up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"))
