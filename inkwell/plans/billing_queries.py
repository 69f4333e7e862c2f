"""Credits, tiers, refunds, job logs, plans and query runs over orders, lineitem and events; and the streams' sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import ledger as M
from ..operators import sections as N
from ..sources.store import shared_dir
from ..streaming import jobs as J
from .operations_queries import JOBLOG, LEDGER, STATES, job_log, jobs, ledger
from .registry import query, table


@query(f"""WITH {LEDGER} SELECT user_id, abs(sum(credits_amount))::BIGINT AS used, round(500 * abs(sum(credits_amount)) / (100.0 * 3000000), 4) AS price FROM ledger WHERE transaction_type = 'usage' GROUP BY user_id""")
def net_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Net credits and their price by the first active package."""
    prices = spark.createDataFrame([(1, False, 1000, 1), (2, True, 3000000, 500), (3, True, 9000000, 900)], "price_id int, is_active boolean, credits_amount long, amount_cents long")
    return M.net_usage(ledger(spark, sf), prices)


@query(f"""WITH j AS (SELECT o_custkey AS user_id, ['free', 'pro', 'open'][o_custkey % 3 + 1] AS tier, {STATES} AS status FROM orders) SELECT user_id, tier, count(*) FILTER (status = 'running') AS n_open, [3, 8, -1][user_id % 3 + 1] AS max_jobs,
user_id % 3 = 2 OR count(*) FILTER (status = 'running') < [3, 8, -1][user_id % 3 + 1] AS may_create FROM j GROUP BY user_id, tier""")
def job_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Open jobs against the limit of the user's tier; -1 is no limit."""
    tiers = spark.createDataFrame([("free", 3), ("pro", 8), ("open", -1)], "tier string, max_jobs int")
    rows = jobs(spark, sf).withColumn("tier", F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("open")), (F.col("user_id") % 3 + 1).cast("int")))
    return M.capacity(rows, tiers)


@query("""WITH p AS (SELECT o_custkey AS user_id, sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F') AS paid FROM orders GROUP BY o_custkey)
SELECT c_custkey AS user_id, CASE WHEN paid >= 1000000 THEN 'gold' WHEN paid >= 200000 THEN 'silver' ELSE 'free' END AS tier FROM customer LEFT JOIN p ON user_id = c_custkey""")
def user_tiers(spark: SparkSession, sf: str) -> DataFrame:
    paid = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("open").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    steps = spark.createDataFrame([("silver", 200000), ("gold", 1000000)], "tier string, threshold long")
    return M.tiers_of(paid, steps, table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")))


@query("""SELECT event_id AS request_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'least' WHEN user_id % 2 = 0 THEN 'even' ELSE 'default' END AS rule_id FROM events""")
def rate_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule by priority whose globs match a request."""
    e = table(spark, sf, "events")
    rule = lambda name, priority, method, path: F.struct(F.lit(name).alias("rule_id"), F.lit(priority).alias("priority"), F.lit(method).alias("method"), path.alias("path"))
    both = F.array(rule("least", 1, "*", F.concat(F.lit("/v1/"), "m", F.lit("/*"))), rule("even", 2, "GET", F.lit("/v1/*/even+")))
    rules = e.agg(F.min("event_type").alias("m")).select(F.explode(both).alias("r")).select("r.*")
    asked = e.select(F.col("event_id").alias("request_id"), F.lit("GET").alias("method"), F.concat(F.lit("/v1/"), "event_type", F.when(F.col("user_id") % 2 == 0, F.lit("/even+")).otherwise(F.lit("/odd"))).alias("path"))
    return M.first_rules(asked, rules).select("request_id", "rule_id")


@query("""WITH l AS (SELECT user_id AS job_id, event_type AS state, ts, CASE WHEN event_id % 4 > 0 THEN event_id END AS v FROM events) SELECT job_id, state, max_by(v, ts)::VARCHAR AS value FROM l WHERE v IS NOT NULL GROUP BY ALL""")
def latest_metadata(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.when(F.col("event_id") % 4 > 0, F.to_json(F.struct(F.struct(F.col("event_id").alias("n")).alias("a")))).otherwise(F.lit('{"a":{}}'))
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("created_at"), meta.alias("metadata"))
    return M.latest_meta(log, "a.n")


@query("""SELECT o_custkey AS user_id, 'refund' AS transaction_type, o_orderkey::VARCHAR AS job_id, 1 AS n FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 = 0""")
def refunds(spark: SparkSession, sf: str) -> DataFrame:
    """Refunds of failed jobs: asked for twice, booked once, and not again where one is booked already."""
    j = jobs(spark, sf).withColumn("job_id", F.col("job_id").cast("string"))
    had = j.filter("cast(job_id as long) % 5 = 0").select("user_id", F.lit(7).cast("long").alias("credits_amount"), F.lit("refund").alias("transaction_type"), F.to_json(F.struct("job_id")).alias("metadata"))
    asked = j.filter("status = 'failed'").select("user_id", "job_id", F.lit(9).cast("long").alias("amount"))
    got = M.refunds(had, asked.unionByName(asked)).withColumn("job_id", F.get_json_object("metadata", "$.job_id"))
    return got.groupBy("user_id", "transaction_type", "job_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority AS task, sum(o_orderkey)::BIGINT AS input_tokens, sum(o_custkey)::BIGINT AS output_tokens, count(*) AS n_calls FROM orders GROUP BY o_orderpriority""")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_usage(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("input_tokens"), F.col("o_custkey").alias("output_tokens")))


@query("""WITH c AS (SELECT l_orderkey AS charge_id, max_by(l_linenumber * 100, l_linenumber) AS cents, max_by(l_linenumber % 2, l_linenumber) AS price FROM lineitem GROUP BY ALL), h AS (SELECT l_orderkey AS charge_id, sum(50) AS had FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
SELECT charge_id, (cents - coalesce(had, 0))::BIGINT AS new_cents, ((cents - coalesce(had, 0)) * CASE price WHEN 0 THEN 3000 ELSE 7000 END // CASE price WHEN 0 THEN 1000 ELSE 900 END)::BIGINT AS credits FROM c LEFT JOIN h USING (charge_id) WHERE cents - coalesce(had, 0) > 0""")
def refund_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as refund events of a charge, some of them recorded before."""
    li = table(spark, sf, "lineitem")
    prices = spark.createDataFrame([(0, 3000, 1000), (1, 7000, 900)], "price_id long, credits_amount long, amount_cents long")
    charges = li.select(F.col("l_orderkey").alias("charge_id"), (F.col("l_linenumber") % 2).cast("long").alias("price_id"), (F.col("l_linenumber") * 100).cast("long").alias("refunded_cents"), F.col("l_linenumber").alias("event_at"))
    had = li.filter("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("charge_id"), F.lit(50).cast("long").alias("cents"))
    return M.reconciled(charges, had, prices)


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS user_id, {STATES} AS status, o_orderpriority AS kind, o_orderdate AS made FROM orders), f AS (SELECT * FROM j WHERE status IN ('done', 'failed') AND kind IN ('1-URGENT', '2-HIGH') AND made >= TIMESTAMP '1995-01-01' AND made <= TIMESTAMP '1999-12-31')
SELECT job_id, user_id, status, ceil(row_number() OVER (PARTITION BY user_id ORDER BY made DESC, job_id) / 3.0)::BIGINT AS page, ceil(count(*) OVER (PARTITION BY user_id) / 3.0)::BIGINT AS n_pages FROM f""")
def filtered_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs by type, status and time of creation."""
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    got = M.listed_jobs(jobs(spark, sf), size=3, kinds=["1-URGENT", "2-HIGH"], statuses=["done", "failed"], begin=at("1995-01-01 00:00:00"), end=at("1999-12-31 00:00:00"))
    return got.select("job_id", "user_id", "status", "page", "n_pages")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS step_id FROM lineitem), h AS (SELECT plan_id, list(step_id) AS l FROM s GROUP BY plan_id),
ok AS (SELECT plan_id, list_contains(l, 1) AS two, list_contains(l, 1) AND list_contains(l, 2) AS three, list_contains(l, 1) AND list_contains(l, 2) AND list_contains(l, 3) AND list_contains(l, 5) AS six, list_contains(l, 6) AS six_there FROM h)
SELECT s.plan_id, s.step_id, CASE s.step_id WHEN 2 THEN CASE WHEN two THEN 1 END WHEN 3 THEN CASE WHEN three THEN 2 END WHEN 6 THEN CASE WHEN six THEN 3 END WHEN 7 THEN CASE WHEN six AND six_there AND s.plan_id % 2 = 1 THEN 4 END ELSE 0 END AS level, FALSE AS duplicate
FROM s JOIN ok USING (plan_id)""")
def plan_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as steps of a plan: chains, a second need, steps that wait for themselves or for missing ones."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_id")).distinct()
    k = F.col("step_id")
    needs = s.filter(k % 4 > 1).withColumn("needed", k - 1).unionByName(s.filter("step_id = 6").withColumn("needed", k - 3)).unionByName(s.filter("step_id = 7 and plan_id % 2 = 0").withColumn("needed", k))
    return N.plan_levels(s, needs)


@query("""WITH r AS (SELECT l_orderkey AS run_id, 'q' || l_orderkey % 10 AS query, l_suppkey AS document_id, l_partkey AS tokens FROM lineitem) SELECT run_id, query, count(document_id) AS n_results, list_sort(list(DISTINCT document_id)) AS documents, sum(tokens)::BIGINT AS tokens, round(count(*) * 0.25, 3) AS seconds, left(sha256(query), 16) AS query_hash FROM r GROUP BY run_id, query""")
def query_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("q"), F.col("l_orderkey") % 10).alias("query"), F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("tokens"), F.lit(0.25).alias("seconds"))
    return A.run_summary(rows)


@query("""SELECT o_orderkey AS id, 'order' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey + l_linenumber FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey + l_linenumber, 'missing' FROM lineitem WHERE l_orderkey + l_linenumber NOT IN (SELECT o_orderkey FROM orders)""")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by key, and the keys that no entity has."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    wanted = table(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("id"))
    there, missing = A.lookup(rows, wanted, "id")
    return there.withColumn("kind", F.lit("order")).unionByName(missing.withColumn("kind", F.lit("missing")))


# --- streams -----------------------------------------------------------------------------------------


@query("""SELECT 'job-' || o_orderkey AS job_id, o_orderkey AS size, o_orderkey % 3 = 0 AS expired FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 > 0""")
def upload_events(spark: SparkSession, sf: str) -> DataFrame:
    """Object-store messages, each sent twice, matched with the jobs that wait for a file."""
    o = table(spark, sf, "orders")
    record = F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("uploads/job%2D"), "o_orderkey", F.lit(".pdf"))).otherwise(F.lit("other/x.pdf"))
    body = F.concat(F.lit('{"Records":[{"eventTime":"2024-01-02T00:00:00Z","s3":{"bucket":{"name":"b"},"object":{"key":"'), record, F.lit('","size":'), "o_orderkey", F.lit("}}}]}"))
    messages = o.select(body.alias("value"))
    waiting = o.select(F.concat(F.lit("job-"), "o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "waiting-file").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("2023-01-01")).otherwise(F.lit("2024-01-01")).cast("timestamp").alias("created_at"))
    return J.matched_uploads(messages.unionByName(messages), waiting, 100 * 86400).select("job_id", "size", "expired")


@query("""SELECT event_id % 500 AS event_id, ['pending', 'delivering', 'failed', 'delivered'][max(event_id % 4) + 1] AS status FROM events GROUP BY event_id % 500""")
def delivery_states(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest of the states that callbacks report, in any order."""
    e = table(spark, sf, "events")
    state = F.element_at(F.array(*[F.lit(s) for s in J.STATUS_ORDER]), (F.col("event_id") % 4 + 1).cast("int"))
    return J.resolved_status(e.select((F.col("event_id") % 500).alias("event_id"), state.alias("status"), "ts"))


@query("""SELECT user_id AS document_id, event_type AS chunk_id, count(*) AS hit_count, min(ts) AS created_at, max(ts) AS last_hit_at FROM events GROUP BY ALL""")
def live_hits(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of hits, counted in update mode into a table that keeps the latest row per key."""
    path = shared_dir(spark)
    events = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("chunk_id"), "ts")
    events.repartition(3).write.parquet(f"{path}/in")
    hits = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    save = J.upserting(f"{path}/hits", ["document_id", "chunk_id"])
    J.hit_counts(hits).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return J.latest_version(spark, f"{path}/hits")


@query("""WITH r AS (SELECT o_custkey AS document_id, o_orderkey AS revision_id, o_orderdate AS made FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), b AS (SELECT document_id, max_by(revision_id, (made, revision_id)) AS revision_id FROM r GROUP BY ALL) SELECT b.document_id, b.revision_id, l_orderkey * 8 + l_linenumber AS chunk_id FROM b JOIN lineitem ON l_orderkey = b.revision_id""")
def live_publication(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed chunks arrive in a stream; of each document the revision of the newest job stays."""
    path = shared_dir(spark)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("job_created_at"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("revision_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_id"))
    rows = o.join(li, "revision_id").select("document_id", "revision_id", "job_created_at", "chunk_id")
    rows.repartition(3, "revision_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(J.publishing(spark, f"{path}/out")).start().awaitTermination()
    return J.latest_version(spark, f"{path}/out").select("document_id", "revision_id", "chunk_id")


@query(f"""WITH l AS (SELECT job_id, max_by(status, (ts, status)) AS status, max(ts) AS ts FROM {JOBLOG} GROUP BY job_id), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)
SELECT job_id, status FROM l, w WHERE status NOT IN ('done', 'failed') AND ts < w - CASE WHEN status IN ('running', 'converting') THEN INTERVAL 4 HOUR ELSE INTERVAL 2 HOUR END""")
def live_stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """State changes as a stream; jobs that event time has left behind. The log comes in one batch, then its last event again."""
    path = shared_dir(spark)
    log = job_log(spark, sf).withColumn("job_id", F.col("job_id").cast("long"))
    log.coalesce(1).write.parquet(f"{path}/in")
    end = log.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("job_id"), "ts", F.lit("done").alias("status"))
    for _ in range(2):
        end.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    J.stale(stream).writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.schema("job_id long, status string, ts timestamp, new_status string").parquet(f"{path}/out").select("job_id", "status")
