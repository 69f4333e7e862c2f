"""Streams of requests, uploads, job events, deliveries, hits and publications.

Each function takes a streaming (or batch) DataFrame and returns one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable

LATE = "10 minutes"


def _marked(rows: DataFrame, late: str = LATE) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def minute_counts(requests: DataFrame, tiers: DataFrame, users: DataFrame, late: str = LATE) -> DataFrame:
    """Requests per user in sliding minutes that are above the tier's limit (-1: no limit); a row of users that repeats counts once.

    Limits meet the requests, not the counts: what a stream's state hands on when event time has passed it can be large in a batch
    of one row, and Spark, which goes by the batch, would broadcast it through the driver. Users without a limit take no state.
    """
    rows = _marked(requests.withColumn("ts", F.col("ts").cast("timestamp")), late)
    limits = users.join(F.broadcast(tiers), "tier").filter("per_minute >= 0").select("user_id", "per_minute").distinct()
    counts = rows.join(limits, "user_id").groupBy("user_id", "per_minute", F.window("ts", "1 minute", "10 seconds")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > per_minute").select("user_id", F.col("window.start").alias("start"), "n", "per_minute")


def daily_counts(requests: DataFrame, late: str = LATE) -> DataFrame:
    """Requests per user and day."""
    rows = _marked(requests.withColumn("ts", F.col("ts").cast("timestamp")), late)
    return rows.groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


UPLOADS = "Records array<struct<eventName:string,eventTime:timestamp,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:bigint>>>>"


def uploads(messages: DataFrame, body: str = "value") -> DataFrame:
    """One row per record of object-store messages: ts, key, size and the job id in keys like uploads/<job>.<suffix>."""
    rows = messages.select(F.explode(F.from_json(F.col(body).cast("string"), UPLOADS)["Records"]).alias("r"))
    key = F.url_decode("r.s3.object.key")
    return rows.select(F.col("r.eventTime").alias("ts"), key.alias("key"), F.col("r.s3.object.size").alias("size"), F.nullif(F.regexp_extract(key, r"^uploads/(.*)\.", 1), F.lit("")).alias("job_id"))


def matched_uploads(messages: DataFrame, jobs: DataFrame, max_age_seconds: int, late: str = LATE, body: str = "value") -> DataFrame:
    """Uploads of jobs that wait for a file, each job once; jobs older than allowed are marked (0 or less: never)."""
    rows = uploads(messages, body).filter("job_id is not null")
    rows = _marked(rows, late)
    rows = rows.dropDuplicatesWithinWatermark(["job_id"]) if rows.isStreaming else rows.dropDuplicates(["job_id"])
    met = rows.join(jobs.filter("status = 'waiting-file'").select("job_id", "created_at"), "job_id")
    return met.withColumn("expired", expired(F.col("created_at"), F.col("ts"), max_age_seconds))


def expired(created: Column, now: Column, max_age_seconds: int) -> Column:
    if max_age_seconds <= 0:
        return F.lit(False)
    return F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1e6 > max_age_seconds, F.lit(False))


def stale(events: DataFrame, long_seconds: int = 4 * 3600, short_seconds: int = 2 * 3600, late: str = LATE) -> DataFrame:
    """Jobs (job_id, status, ts) whose last event is active and that event time has left behind: keyed state with an
    event-time timeout."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def follow(key, batches, state):
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "ts": [pd.Timestamp(at, unit="us")], "new_status": ["failed"]})
            return
        status, at = state.get if state.exists else (None, -1)
        for rows in batches:
            for s, t in zip(rows["status"], rows["ts"], strict=True):
                micros = t.value // 1000
                if (micros, s) > (at, status or ""):
                    status, at = s, micros
        if status in ("done", "failed"):
            if state.exists:
                state.remove()
            return
        state.update((status, at))
        limit = long_seconds if status in ("running", "converting") else short_seconds
        state.setTimeoutTimestamp(max(at // 1000 + limit * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.select("job_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    kind = rows.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").applyInPandasWithState(follow, f"job_id {kind}, status string, ts timestamp, new_status string", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def orphan_deliveries(sent: DataFrame, answers: DataFrame, minutes: int = 5, late: str = LATE) -> DataFrame:
    """Deliveries without a callback of the same key within the minutes after; callbacks that repeat count once."""
    a = sent.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    b = answers.select(F.col("key").alias("answer_key"), F.col("ts").cast("timestamp").alias("answer_ts")).withWatermark("answer_ts", late).dropDuplicatesWithinWatermark(["answer_key", "answer_ts"])
    near = F.expr(f"key = answer_key and answer_ts >= ts and answer_ts <= ts + interval {minutes} minutes")
    return a.join(b, near, "leftOuter").filter("answer_key is null").select("event_id", "key", "ts")


#: Which of two delivery states wins (fixed values), from the weakest.
STATUS_ORDER = ("pending", "delivering", "failed", "delivered")


def resolved_status(callbacks: DataFrame) -> DataFrame:
    """The strongest status of each event."""
    rank = F.array_position(F.lit(list(STATUS_ORDER)), F.col("status"))
    return callbacks.groupBy("event_id").agg(F.max_by("status", F.struct(rank, "ts")).alias("status"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Counters per document and chunk, for update mode."""
    return hits.groupBy("document_id", "chunk_id").agg(F.count(F.lit(1)).alias("hit_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_hit_at"))


def upserting(path: str, keys: list[str], buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key in a BucketTable below path; a batch written twice is the same."""

    def write(rows: DataFrame, batch: int) -> None:
        newest = lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        BucketTable(rows.sparkSession, path, keys, buckets).apply(rows, batch, newest)

    return write


def publishing(spark: SparkSession, path: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of parsed chunks (document_id, revision_id, job_created_at, …): of each document only the
    revision of the newest job stays, a batch that arrives late changes nothing. Only the buckets of the batch's documents are written."""
    from ..operators.sections import latest_revisions, published

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        known = old.select("document_id", "revision_id", "job_created_at").unionByName(new.select("document_id", "revision_id", "job_created_at")).distinct()
        best = latest_revisions(known).select("document_id", "revision_id")
        return published(old, new.join(best, ["document_id", "revision_id"], "left_semi"))

    def write(rows: DataFrame, batch: int) -> None:
        BucketTable(spark, path, ["document_id"], buckets).apply(rows, batch, merge)

    return write


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that upserting and publishing keep below path, as its last batch left it."""
    return BucketTable(spark, path, []).read()


def recovered_deliveries(sent: DataFrame, callbacks: DataFrame, minutes: int = 5, late: str = LATE) -> DataFrame:
    """Delivery recovery as a stream: event_id, key, ts, status, orphan of each sent event.

    Callbacks that repeat (by key and time) count once within the watermark. A sent event meets the callbacks of its key in the minutes
    after; it has the strongest status of those (STATUS_ORDER), and without any it is an orphan and still pending. Two streams
    meet in an outer join, so a row without callback comes once event time has left its minutes behind; statuses are summed
    up per event when their window closes.
    """
    a = sent.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts"))
    b = callbacks.select(F.col("key").alias("_key"), F.col("ts").cast("timestamp").alias("_ts"), "status")
    if sent.isStreaming:
        a, b = a.withWatermark("ts", late), b.withWatermark("_ts", late).dropDuplicatesWithinWatermark(["_key", "_ts", "status"])
    else:
        b = b.dropDuplicates(["_key", "_ts", "status"])
    near = F.expr(f"key = _key and _ts >= ts and _ts <= ts + interval {minutes} minutes")
    rank = F.array_position(F.lit(list(STATUS_ORDER)), F.coalesce("status", F.lit("pending")))
    met = a.join(b, near, "leftOuter").select("event_id", "key", "ts", rank.alias("_rank"), F.col("_key").isNotNull().cast("int").alias("_met"))
    each = met.groupBy(F.window("ts", "1 second"), "event_id", "key").agg(F.min("ts").alias("ts"), F.max("_rank").alias("_rank"), F.max("_met").alias("_met"))
    return each.select("event_id", "key", "ts", F.element_at(F.lit(list(STATUS_ORDER)), F.col("_rank").cast("int")).alias("status"), (F.col("_met") == 0).alias("orphan"))
