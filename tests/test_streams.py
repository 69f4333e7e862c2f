"""Streams give what their batch forms give."""

import datetime as dt

from inkwell.operators.ledger import orphans
from inkwell.sources.buckets import BucketTable
from inkwell.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, name, frames, build, mode="append"):
    """build(stream) over a folder to which frames are written one after another."""
    path = str(tmp_path / name)
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{path}/batch={k}")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    query = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_daily_counts(spark, tmp_path):
    rows = [(u, at(600 * k)) for u in (1, 2) for k in range(6)]
    frame = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    batch = {(r.user_id, r.day): r.n for r in J.daily_counts(frame).collect()}
    stream = {(r.user_id, r.day): r.n for r in streamed(spark, tmp_path, "daily", [frame], J.daily_counts, "complete")}
    assert batch == stream and sum(batch.values()) == 12


def test_minute_counts(spark):
    rows = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=k)) for k in range(5)] + [(2, T0)] * 5, "user_id int, ts timestamp")
    users = spark.createDataFrame([(1, "free"), (2, "vip")], "user_id int, tier string")
    tiers = spark.createDataFrame([("free", 3), ("vip", -1)], "tier string, per_minute int")
    got = J.minute_counts(rows, tiers, users).collect()
    assert {r.user_id for r in got} == {1} and max(r.n for r in got) == 5


def test_stale_jobs(spark, tmp_path):
    kind = "job_id int, status string, ts timestamp"
    frames = [spark.createDataFrame([(1, "running", at(0)), (2, "waiting-file", at(0)), (3, "running", at(0))], kind), spark.createDataFrame([(3, "done", at(60)), (4, "running", at(200))], kind), spark.createDataFrame([(4, "running", at(600))], kind), spark.createDataFrame([(5, "done", at(620))], kind)]
    got = streamed(spark, tmp_path, "stale", frames, J.stale)
    assert sorted((r.job_id, r.status) for r in got) == [(1, "running"), (2, "waiting-file")]


def test_orphans(spark, tmp_path):
    sent = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(1)), (3, "c", at(2)), (9, "z", at(100))], "event_id int, key string, ts timestamp")
    answers = spark.createDataFrame([("a", at(3)), ("a", at(3)), ("b", at(30)), ("y", at(100))], "key string, ts timestamp")
    path = str(tmp_path / "answers")
    answers.coalesce(1).write.parquet(path)
    other = spark.readStream.schema(answers.schema).parquet(path)
    more = spark.createDataFrame([(10, "w", at(300))], sent.schema)
    got = streamed(spark, tmp_path, "orphans", [sent, more], lambda s: J.orphan_deliveries(s, other))
    assert {r.event_id for r in got} >= {2, 3} and 1 not in {r.event_id for r in got}
    assert {r.event_id for r in orphans(sent, answers).collect()} == {2, 3, 9}


def test_uploads(spark):
    body = '{"Records":[{"eventName":"Put","eventTime":"2024-01-01T00:00:00Z","s3":{"bucket":{"name":"b"},"object":{"key":"uploads/job%2D1.pdf","size":3}}},{"s3":{"object":{"key":"other/x.pdf"}}}]}'
    messages = spark.createDataFrame([(body,), (body,)], "value string")
    jobs = spark.createDataFrame([("job-1", "waiting-file", at(-10)), ("job-2", "done", at(0))], "job_id string, status string, created_at timestamp")
    assert [(r.job_id, r.size, r.expired) for r in J.matched_uploads(messages, jobs, 60).collect()] == [("job-1", 3, True)]
    assert [r.expired for r in J.matched_uploads(messages, jobs, 0).collect()] == [False]


def test_hits_and_publication(spark, tmp_path):
    kind = "document_id string, revision_id int, job_created_at timestamp, chunk_id string"
    write = J.publishing(spark, str(tmp_path / "pub"))
    write(spark.createDataFrame([("d", 2, at(5), "x"), ("e", 1, at(1), "y")], kind), 0)
    write(spark.createDataFrame([("d", 1, at(1), "old"), ("e", 3, at(9), "new")], kind), 1)
    assert {(r.document_id, r.chunk_id) for r in J.latest_version(spark, str(tmp_path / "pub")).collect()} == {("d", "x"), ("e", "new")}
    hits = spark.createDataFrame([("d", "c", at(1)), ("d", "c", at(4)), ("d", "k", at(2))], "document_id string, chunk_id string, ts timestamp")
    save = J.upserting(str(tmp_path / "hits"), ["document_id", "chunk_id"])
    save(J.hit_counts(hits.limit(1)), 0)
    save(J.hit_counts(hits), 1)
    assert {r.chunk_id: r.hit_count for r in J.latest_version(spark, str(tmp_path / "hits")).collect()} == {"c": 2, "k": 1}
    states = spark.createDataFrame([(1, "delivering", at(1)), (1, "delivered", at(0)), (2, "pending", at(3))], "event_id int, status string, ts timestamp")
    assert {r.event_id: r.status for r in J.resolved_status(states).collect()} == {1: "delivered", 2: "pending"}




def test_sinks_touch_their_buckets_only(spark, tmp_path):
    """A batch of one document leaves the files of other buckets as they are; a replayed batch changes nothing; old data go."""
    path = str(tmp_path / "t")
    kind = "k int, v int"
    save = J.upserting(path, ["k"], 8)
    save(spark.createDataFrame([(k, 0) for k in range(100)], kind), 0)
    table = BucketTable(spark, path, ["k"], 8)
    first = table.manifest()
    assert len(first["folders"]) == 8
    save(spark.createDataFrame([(7, 1), (7000, 1)], kind), 1)
    second = table.manifest()
    changed = [b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)]
    assert 1 <= len(changed) <= 2 and table.read(second, [int(b) for b in changed]).filter("v = 1").count() == 2
    assert {r.k: r.v for r in table.read().collect()} == {k: int(k == 7) for k in range(100)} | {7000: 1}
    save(spark.createDataFrame([(8, 5)], kind), 1)  # the same batch again
    assert table.manifest() == second and table.read().filter("v = 5").count() == 0
    for n in range(2, 6):
        save(spark.createDataFrame([(7, n)], kind), n)
    assert len(table.versions()) == 2 and table.read().filter("k = 7").first().v == 5 and table.read().count() == 101
    folders = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert folders == {f for v in table.versions() for f in table.manifest(v)["folders"].values()}
    J.publishing(spark, path + "2", 4)(spark.createDataFrame([], "document_id string, revision_id int, job_created_at timestamp, chunk_id string"), 0)
    assert J.latest_version(spark, path + "2").count() == 0


def test_recovered_deliveries(spark, tmp_path):
    """The strongest status of the callbacks in time; repeated, late and foreign callbacks; the stream equals the batch."""
    sent = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(1)), (3, "c", at(2)), (4, "a", at(30))], "event_id int, key string, ts timestamp")
    back = spark.createDataFrame([("a", at(1), "delivered"), ("a", at(2), "delivering"), ("a", at(2), "delivering"), ("b", at(9), "delivered"), ("c", at(3), "failed"), ("z", at(3), "failed")], "key string, ts timestamp, status string")
    want = {(1, "delivered", False), (2, "pending", True), (3, "failed", False), (4, "pending", True)}
    assert {(r.event_id, r.status, r.orphan) for r in J.recovered_deliveries(sent, back).collect()} == want
    ends = [spark.createDataFrame([(-1, "end", at(500 + k))], sent.schema) for k in range(3)]
    path = str(tmp_path / "back")
    for k, frame in enumerate([back, *[spark.createDataFrame([("end", at(500 + k), "failed")], back.schema) for k in range(3)]]):
        frame.coalesce(1).write.parquet(f"{path}/batch={k}")
    other = spark.readStream.schema(back.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = streamed(spark, tmp_path, "recovered", [sent, *ends], lambda s: J.recovered_deliveries(s, other))
    assert {(r.event_id, r.status, r.orphan) for r in got if r.event_id > 0} == want
