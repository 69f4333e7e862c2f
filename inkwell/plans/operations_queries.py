"""Sections, revisions, usage, jobs and rates over documents, orders, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as M
from ..operators import sections as N
from ..operators.ranking import hit_counters as counters
from ..operators.ranking import importance as importance_of
from ..operators.ranking import importance_multiplier
from .registry import query, table

AS_OF = "2024-07-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def library(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks of one library per source: sections by language and length."""
    size = F.when(F.length("text") < 1000, "short").when(F.length("text") < 4000, "medium").otherwise("long")
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("table")), (F.pmod(F.col("doc_id"), F.lit(7)) % 3 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 11 == 0, "Root").otherwise(F.concat_ws(" / ", "lang", size))
    return table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("sort_order"), path.alias("section_path"), kind.alias("chunk_type"), F.col("text").alias("content"), F.lit(None).cast("string").alias("summary"))


LIBRARY = """lib AS (SELECT source AS document_id, doc_id AS sort_order, CASE WHEN doc_id % 11 = 0 THEN 'Root' ELSE lang || ' / ' || CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 4000 THEN 'medium' ELSE 'long' END END AS section_path,
  ['text', 'image', 'table'][doc_id % 7 % 3 + 1] AS chunk_type, text AS content FROM documents),
ups AS (SELECT *, section_path AS spot FROM lib UNION ALL SELECT *, split_part(section_path, ' / ', 1) AS spot FROM lib WHERE section_path <> 'Root'),
firsts AS (SELECT document_id, spot AS section_path, min({'o': sort_order, 'd': CASE WHEN spot = 'Root' OR NOT contains(spot, ' / ') THEN 0 ELSE 1 END}) AS f FROM ups GROUP BY ALL),
sections AS (SELECT document_id, section_path, CASE WHEN contains(section_path, ' / ') THEN split_part(section_path, ' / ', 1) END AS parent_path,
  CASE WHEN contains(section_path, ' / ') THEN split_part(section_path, ' / ', 2) ELSE section_path END AS section_title,
  CASE WHEN section_path = 'Root' THEN 0 WHEN contains(section_path, ' / ') THEN 2 ELSE 1 END AS section_level,
  row_number() OVER (PARTITION BY document_id ORDER BY f, section_path) - 1 AS sort_order FROM firsts)"""


@query(f"WITH {LIBRARY} SELECT * FROM sections")
def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    return N.section_table(library(spark, sf))


@query(f"""WITH {LIBRARY} SELECT document_id, spot AS section_path, count(*) FILTER (chunk_type = 'text') AS n_text, CASE WHEN spot = 'Root' THEN 0 ELSE count(*) FILTER (chunk_type = 'image') END AS n_image,
CASE WHEN spot = 'Root' THEN 0 ELSE count(*) FILTER (chunk_type = 'table') END AS n_table, sum(length(content)) AS n_chars FROM ups GROUP BY document_id, spot""")
def section_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return N.rolled_up(N.direct_counts(library(spark, sf)))


@query(f"""WITH {LIBRARY}, own AS (SELECT document_id, section_path, min_by(left(content, 40), sort_order) AS summary FROM lib GROUP BY ALL),
base AS (SELECT s.*, coalesce(o.summary, '') AS own FROM sections s LEFT JOIN own o USING (document_id, section_path)),
kids AS (SELECT document_id, parent_path AS section_path, count(*) AS k, min_by(own, sort_order) AS one, string_agg(section_title, ', ' ORDER BY sort_order) AS titles FROM base WHERE section_level = 2 GROUP BY ALL),
mid AS (SELECT b.document_id, b.section_path, b.section_level, b.section_title, b.sort_order, CASE WHEN k = 1 THEN one WHEN k > 1 THEN 'This section covers: ' || titles ELSE own END AS summary
  FROM base b LEFT JOIN kids USING (document_id, section_path))
SELECT document_id, section_path, section_level, summary FROM mid
UNION ALL SELECT document_id, '', 0, 'This document includes: ' || string_agg(section_title, ', ' ORDER BY sort_order) FROM mid WHERE section_level = 1 GROUP BY document_id""")
def nav_summary(spark: SparkSession, sf: str) -> DataFrame:
    lib = library(spark, sf)
    own = lib.groupBy("document_id", "section_path").agg(F.min_by(F.substring("content", 1, 40), "sort_order").alias("summary"))
    sections = N.section_table(lib).join(own, ["document_id", "section_path"], "left")
    return N.summaries(sections, max_depth=3).select("document_id", "section_path", "section_level", "summary")


@query(f"""WITH {LIBRARY} SELECT document_id, spot AS section_path, count(*) AS n_chunks, max(CASE WHEN section_path = 'Root' THEN 0 ELSE 2 END) - any_value(CASE WHEN spot = 'Root' THEN 0 WHEN contains(spot, ' / ') THEN 2 ELSE 1 END) AS depth_below,
min_by(nullif(trim(left(content, 200), ' '), ''), sort_order) FILTER (section_path = spot) AS summary FROM ups GROUP BY document_id, spot""")
def nav_tree(spark: SparkSession, sf: str) -> DataFrame:
    return N.navigation(library(spark, sf))


@query("""SELECT o_custkey AS document_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS revision_id, max(o_orderdate) AS job_created_at FROM orders GROUP BY o_custkey""")
def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("job_created_at"))
    return N.latest_revisions(rows)


HITS = """hits AS (SELECT user_id AS query_id, event_type AS document_id, ts FROM events)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("document_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "ts")


@query("""WITH o AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL)
SELECT user_id AS document_id, event_type AS chunk_id, count(*) AS hit_count, min(a) AS created_at, max(b) AS last_hit_at FROM o GROUP BY ALL""")
def hit_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("query_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("chunk_id"), "ts")
    return counters(e, ["document_id", "chunk_id"])


@query(f"""WITH o AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL),
c AS (SELECT user_id AS document_id, event_type AS chunk_id, count(*) AS n, min(a) AS a, max(b) AS b FROM o GROUP BY ALL),
i AS (SELECT document_id, chunk_id, round(0.7 * n * exp(-0.693 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(b)) / 86400e6 / 30) + 0.3 * exp(-0.693 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(a)) / 86400e6 / 30), 4) AS importance FROM c),
s AS (SELECT chunk_id, list_sort(list(importance)) AS v FROM i GROUP BY chunk_id),
q AS (SELECT chunk_id, len(v) AS n, (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 AS m, CASE WHEN len(v) >= 4 THEN v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1] ELSE v[len(v)] - v[1] END AS r FROM s)
SELECT document_id, chunk_id, importance, CASE WHEN r <= 1e-9 THEN 1.0 ELSE round(0.1 + 1.9 / (1 + exp(-(importance - m) / r)), 4) END AS multiplier FROM i JOIN q USING (chunk_id)""")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = hit_counters(spark, sf).withColumn("importance", importance_of(F.col("hit_count"), F.col("last_hit_at"), F.col("created_at"), as_of()))
    return importance_multiplier(rows, ["chunk_id"], "importance").select("document_id", "chunk_id", "importance", "multiplier")


LEDGER = """ledger AS (SELECT event_id, user_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN -1 ELSE 1 END * CAST(round(coalesce(value, 0) * 1000000) AS BIGINT) AS credits_amount,
CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'usage' WHEN event_id % 3 = 0 THEN 'grant_permanent' ELSE 'payment' END AS transaction_type, ts AS created_at FROM events)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """events as a ledger: one type is usage, the others payments and grants that never expire."""
    e = table(spark, sf, "events")
    least = e.agg(F.min("event_type").alias("_least"))
    use = F.col("event_type") == F.col("_least")
    return e.crossJoin(F.broadcast(least)).select(
        "event_id", "user_id", (F.when(use, -1).otherwise(1) * F.round(F.coalesce("value", F.lit(0.0)) * 1000000).cast("long")).alias("credits_amount"),
        F.when(use, "usage").when(F.col("event_id") % 3 == 0, "grant_permanent").otherwise("payment").alias("transaction_type"), F.col("ts").alias("created_at"),
    )


@query(f"WITH {LEDGER} SELECT user_id, sum(credits_amount)::BIGINT AS balance, count(*) AS n_entries, round(sum(credits_amount) / 1000000, 4) AS shown FROM ledger GROUP BY user_id")
def ledger_balance(spark: SparkSession, sf: str) -> DataFrame:
    return M.balances(ledger(spark, sf)).withColumn("shown", M.dollars(F.col("balance")))


@query(f"WITH {LEDGER} SELECT event_id, user_id, (sum(credits_amount) OVER (PARTITION BY user_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM ledger")
def running_balance(spark: SparkSession, sf: str) -> DataFrame:
    return M.running_balance(ledger(spark, sf), ["created_at", "event_id"]).select("event_id", "user_id", "balance")


@query(f"""WITH {LEDGER} SELECT user_id, coalesce(sum(abs(credits_amount)) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY), 0)::BIGINT AS week_used, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week_n,
coalesce(sum(abs(credits_amount)) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY), 0)::BIGINT AS month_used, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS month_n,
sum(abs(credits_amount))::BIGINT AS all_used, count(*) AS all_n FROM ledger WHERE transaction_type = 'usage' GROUP BY user_id""")
def usage_periods(spark: SparkSession, sf: str) -> DataFrame:
    return M.usage_periods(ledger(spark, sf), as_of())


@query(f"""WITH {LEDGER} SELECT user_id, greatest(greatest(sum(credits_amount) - coalesce(sum(credits_amount) FILTER (transaction_type = 'grant_permanent'), 0), 0)
- coalesce(sum(credits_amount) FILTER (transaction_type = 'payment' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY), 0), 0)::BIGINT AS expiring FROM ledger GROUP BY user_id""")
def credit_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return M.expiring(ledger(spark, sf), as_of())


@query(r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?')) AS t FROM documents)
SELECT doc_id, greatest(1, ceil(t / 500.0))::BIGINT AS pages, greatest(1, ceil(t / 500.0))::BIGINT * 1500 AS cost FROM n""")
def workload_cost(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", M.workload(T.token_count(F.col("text"))).alias("_w")).select("doc_id", "_w.*")


STATES = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'running' END"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("kind"))


@query(f"""WITH j AS (SELECT o.o_orderpriority AS kind, {STATES} AS status, o_orderdate AS a, max(l_shipdate) AS b FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus, o_orderdate)
SELECT kind, count(*) AS n_jobs, round(100.0 * count(*) FILTER (status = 'done') / nullif(count(*) FILTER (status IN ('done', 'failed')), 0), 4) AS success_rate,
round(avg(epoch_us(b) - epoch_us(a)) FILTER (status IN ('done', 'failed')) / 1e6, 3) AS mean_seconds FROM j GROUP BY kind""")
def job_overview(spark: SparkSession, sf: str) -> DataFrame:
    ended = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("updated_at"))
    return M.overview(jobs(spark, sf).join(ended, "job_id"), ["kind"])


@query(f"""SELECT o_orderkey AS job_id, o_custkey AS user_id, {STATES} AS status, ceil(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) / 5.0)::BIGINT AS page,
ceil(count(*) OVER (PARTITION BY o_custkey) / 5.0)::BIGINT AS n_pages FROM orders""")
def job_listing(spark: SparkSession, sf: str) -> DataFrame:
    return M.listed_jobs(jobs(spark, sf), size=5).select("job_id", "user_id", "status", "page", "n_pages")


@query("""SELECT event_id, user_id, event_type, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def dwell_time(spark: SparkSession, sf: str) -> DataFrame:
    return M.dwell(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "ts").select("event_id", "user_id", "event_type", "seconds")


@query(f"""WITH s AS (SELECT o_orderkey AS job_id, {STATES} AS to_state, lag({STATES}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS from_state FROM orders)
SELECT job_id, from_state, to_state FROM s WHERE from_state IS NOT NULL AND from_state <> to_state AND NOT (to_state = 'failed' AND from_state NOT IN ('done', 'failed'))
AND (from_state, to_state) NOT IN (('pending', 'running'), ('pending', 'waiting-file'), ('waiting-file', 'pending'), ('running', 'converting'), ('running', 'done'), ('converting', 'done'), ('failed', 'pending'))""")
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("created_at", "job_id")
    log = jobs(spark, sf).select("job_id", F.col("status").alias("to_state"), F.lag("status").over(w).alias("from_state")).filter("from_state is not null")
    return M.illegal_transitions(log).select("job_id", "from_state", "to_state")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return M.sliding_rate(table(spark, sf, "events")).select("event_id", "user_id", "in_window")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) > 2 AS over_quota FROM events GROUP BY user_id, date_trunc('day', ts)")
def daily_quota(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.jobs import daily_counts

    return daily_counts(table(spark, sf, "events")).withColumn("over_quota", F.col("n") > 2)


JOBLOG = "(SELECT user_id AS job_id, ts, CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'waiting-file' WHEN 2 THEN 'done' WHEN 3 THEN 'converting' ELSE 'failed' END AS status FROM events)"


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as state changes of one job per user."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("running", "waiting-file", "done", "converting", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", status.alias("status"))


@query(f"""WITH l AS (SELECT job_id, max_by(status, (ts, status)) AS status, max(ts) AS ts FROM {JOBLOG} GROUP BY job_id), t AS (SELECT max(ts) AS now FROM events)
SELECT job_id, status, ts, 'failed' AS new_status FROM l, t WHERE status NOT IN ('done', 'failed') AND ts < now - CASE WHEN status IN ('running', 'converting') THEN INTERVAL 4 HOUR ELSE INTERVAL 2 HOUR END""")
def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return M.stale_jobs(job_log(spark, sf))


@query("""WITH k AS (SELECT *, user_id AS key FROM events), kinds AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events)
SELECT event_id, key, ts FROM k, kinds WHERE event_type = a AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = k.key AND x.event_type = b AND x.ts BETWEEN k.ts AND k.ts + INTERVAL 5 MINUTE)""")
def orphan_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("key", F.col("user_id"))
    kinds = F.broadcast(e.agg(F.min("event_type").alias("_a"), F.max("event_type").alias("_b")))
    both = e.crossJoin(kinds)
    return M.orphans(both.filter("event_type = _a").select("event_id", "key", "ts"), both.filter("event_type = _b").select("key", "ts"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS chunk_id FROM lineitem),
i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM c)
SELECT chunk_id, min(chunk_id) OVER (PARTITION BY l_orderkey, island) AS root, chunk_id - min(chunk_id) OVER (PARTITION BY l_orderkey, island) AS depth FROM i""")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as a chain of chunks: each line's parent is the line before."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(key.alias("chunk_id"), F.when(F.col("l_linenumber") > 1, key - 1).alias("parent_id"))
    return N.lineage(rows)
