"""Credits, usage, jobs and rates. Money is whole micro-dollars (LongType), never floating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1_000_000
PAGE_COST = 1_500
TERMINAL = ("done", "failed")
#: Legal changes of a job's state (fixed values); any state that is not terminal may fail.
TRANSITIONS = [("pending", "running"), ("pending", "waiting-file"), ("waiting-file", "pending"), ("running", "converting"), ("running", "done"), ("converting", "done"), ("failed", "pending")]


def dollars(micro: Column) -> Column:
    return F.round(micro / UNIT, 4)


def balances(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id").agg(F.sum("credits_amount").cast("long").alias("balance"), F.count(F.lit(1)).alias("n_entries"))


def running_balance(ledger: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum("credits_amount").over(w).cast("long"))


def usage_periods(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Absolute usage and its count for the last week, the last 30 days and all time, in one pass."""
    used, at = F.abs("credits_amount"), F.col("created_at")
    out = []
    for name, days in (("week", 7), ("month", 30), ("all", None)):
        hit = F.lit(True) if days is None else at >= as_of - F.expr(f"interval {days} days")
        out += [F.coalesce(F.sum(F.when(hit, used)), F.lit(0)).cast("long").alias(f"{name}_used"), F.count_if(hit).alias(f"{name}_n")]
    return ledger.filter("transaction_type = 'usage' and created_at is not null").groupBy("user_id").agg(*out)


def expiring(ledger: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Credits to expire: the balance beyond what does not expire, less payments of the last days, never below 0."""
    kind, amount = F.col("transaction_type"), F.col("credits_amount")
    total = F.sum(amount)
    keep = F.coalesce(F.sum(F.when(kind == "grant_permanent", amount)), F.lit(0))
    paid = F.coalesce(F.sum(F.when((kind == "payment") & (F.col("created_at") >= as_of - F.expr(f"interval {days} days")), amount)), F.lit(0))
    return ledger.groupBy("user_id").agg(F.greatest(F.greatest(total - keep, F.lit(0)) - paid, F.lit(0)).cast("long").alias("expiring"))


def net_usage(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Net credits of usage and refunds, with a price from the first active package."""
    price = prices.filter("is_active").agg(F.min_by(F.struct("credits_amount", "amount_cents"), "price_id").alias("_p"))
    used = ledger.filter(F.col("transaction_type").isin("usage", "refund")).groupBy("user_id").agg(F.abs(F.sum("credits_amount")).cast("long").alias("used"))
    return used.crossJoin(F.broadcast(price)).select("user_id", "used", F.round(F.col("_p.amount_cents") * F.col("used") / (100.0 * F.col("_p.credits_amount")), 4).alias("price"))


def workload(tokens: Column, tabular_rows: Column | None = None, per_page: int = 500) -> Column:
    """struct<pages, cost>: pages of per_page tokens (or of 50 rows), at least one."""
    pages = F.greatest(F.lit(1), F.ceil(tokens / float(per_page)) if tabular_rows is None else F.ceil(tabular_rows / 50.0)).cast("long")
    return F.struct(pages.alias("pages"), (pages * PAGE_COST).alias("cost"))


def overview(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Success rate in per cent and mean seconds of finished jobs."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    secs = (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_jobs"), F.round(100.0 * F.count_if(done) / F.nullif(F.count_if(done | failed), F.lit(0)), 4).alias("success_rate"), F.round(F.avg(F.when(done | failed, secs)), 3).alias("mean_seconds")
    )


def capacity(jobs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Open jobs per user against the limit of the user's tier."""
    open_ = jobs.groupBy("user_id", "tier").agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("n_open"))
    return open_.join(F.broadcast(tiers), "tier").withColumn("may_create", (F.col("max_jobs") < 0) | (F.col("n_open") < F.col("max_jobs")))


def tiers_of(payments: DataFrame, thresholds: DataFrame, users: DataFrame) -> DataFrame:
    """The highest tier whose threshold the sum of a user's succeeded payments reaches, else free."""
    paid = payments.filter("status = 'succeeded'").groupBy("user_id").agg(F.sum("amount").alias("_paid"))
    met = paid.join(F.broadcast(thresholds), F.col("_paid") >= F.col("threshold")).groupBy("user_id").agg(F.max_by("tier", "threshold").alias("tier"))
    return users.join(met, "user_id", "left").withColumn("tier", F.coalesce("tier", F.lit("free")))


def first_rules(requests: DataFrame, rules: DataFrame, default: str = "default") -> DataFrame:
    """The rule of least priority whose globs match a request's method and path. Rules are a short table, so it is broadcast."""
    glob = lambda c: F.concat(F.lit("^"), F.replace(F.regexp_replace(F.col(c), r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    ready = rules.select("rule_id", "priority", glob("method").alias("_m"), glob("path").alias("_p"))
    met = requests.join(F.broadcast(ready), F.rlike("method", F.col("_m")) & F.rlike("path", F.col("_p")))
    best = met.groupBy("request_id").agg(F.min_by("rule_id", F.struct("priority", "rule_id")).alias("rule_id"))
    return requests.join(best, "request_id", "left").withColumn("rule_id", F.coalesce("rule_id", F.lit(default)))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows (from_state, to_state) that are no legal change."""
    legal = log.sparkSession.createDataFrame(TRANSITIONS, "from_state string, to_state string")
    bad = log.filter((F.col("from_state") != F.col("to_state")) & ~((F.col("to_state") == "failed") & ~F.col("from_state").isin(*TERMINAL)))
    return bad.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti")


def dwell(log: DataFrame, key: str, order: list[str], at: str = "created_at") -> DataFrame:
    """Seconds from each state change to the next of the same job."""
    w = Window.partitionBy(key).orderBy(*order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return log.withColumn("seconds", F.round((F.lead(micros).over(w) - micros) / 1e6, 3))


def latest_meta(log: DataFrame, field: str) -> DataFrame:
    """The latest value of a field in the JSON metadata for each job and state."""
    value = F.get_json_object("metadata", f"$.{field}")
    return log.filter(value.isNotNull()).groupBy("job_id", "state").agg(F.max_by(value, "created_at").alias("value"))


def refunds(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """The ledger with refunds (user_id, job_id, amount), one per job, for jobs that have none."""
    had = ledger.filter("transaction_type = 'refund'").select(F.get_json_object("metadata", "$.job_id").alias("job_id")).distinct()
    new = asked.dropDuplicates(["job_id"]).join(had, "job_id", "left_anti")
    return ledger.unionByName(new.select("user_id", F.col("amount").alias("credits_amount"), F.lit("refund").alias("transaction_type"), F.to_json(F.struct("job_id")).alias("metadata")), allowMissingColumns=True)


def reconciled(charges: DataFrame, recorded: DataFrame, prices: DataFrame) -> DataFrame:
    """New refunds: the latest cumulative refund of each charge less what is recorded; credits in proportion to the price."""
    last = charges.groupBy("charge_id").agg(F.max_by(F.struct("price_id", "refunded_cents"), "event_at").alias("_c")).select("charge_id", "_c.*")
    had = recorded.groupBy("charge_id").agg(F.sum("cents").alias("_had"))
    new = last.join(had, "charge_id", "left").withColumn("new_cents", F.col("refunded_cents") - F.coalesce("_had", F.lit(0))).filter("new_cents > 0")
    return new.join(F.broadcast(prices), "price_id").select("charge_id", "new_cents", F.expr("new_cents * credits_amount div amount_cents").alias("credits"))


def token_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("task").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("n_calls"))


def listed_jobs(
    jobs: DataFrame, size: int = 20, days: int | None = None, as_of: Column | None = None, kinds: list[str] | None = None, statuses: list[str] | None = None, begin: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Jobs by owner, newest first, with page numbers and the number of pages: of the last days, or created from begin to end
    (both included; nothing if begin is after end), of some types (column kind) and statuses, if asked."""
    if days is not None:
        jobs = jobs.filter(F.col("created_at") >= as_of - F.expr(f"interval {days} days"))
    for name, some in (("kind", kinds), ("status", statuses)):
        jobs = jobs if some is None else jobs.filter(F.col(name).isin(some))
    jobs = jobs if begin is None else jobs.filter(F.col("created_at") >= begin)
    jobs = jobs if end is None else jobs.filter(F.col("created_at") <= end)
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "job_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return jobs.withColumn("page", F.ceil(F.row_number().over(w) / float(size)).cast("long")).withColumn("n_pages", F.ceil(n / float(size)).cast("long"))


def sliding_rate(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same user in the last seconds, this one included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


def stale_jobs(events: DataFrame, as_of: Column | None = None, long_hours: int = 4, short_hours: int = 2) -> DataFrame:
    """Jobs whose last event is active and older than allowed: running and converting ones may take long. Without as_of
    the time is that of the last event of all."""
    last = events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))
    limit = F.when(F.col("status").isin("running", "converting"), F.expr(f"interval {long_hours} hours")).otherwise(F.expr(f"interval {short_hours} hours"))
    if as_of is None:
        last = last.crossJoin(F.broadcast(events.agg(F.max("ts").alias("_now"))))  # one row
    old = F.col("ts") < (F.col("_now") if as_of is None else as_of) - limit
    return last.filter(~F.col("status").isin(*TERMINAL)).filter(old).drop("_now").withColumn("new_status", F.lit("failed"))


def orphans(sent: DataFrame, answers: DataFrame, minutes: int = 5) -> DataFrame:
    """Sent rows (key, ts) without an answer of the same key within the minutes after."""
    due = F.expr(f"interval {minutes} minutes")
    met = sent.join(answers.select("key", F.col("ts").alias("_at")), "key").filter((F.col("_at") >= F.col("ts")) & (F.col("_at") <= F.col("ts") + due))
    return sent.join(met.select("event_id").distinct(), "event_id", "left_anti")
