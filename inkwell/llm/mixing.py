"""Mixing sources to target weights by weighted fair queueing (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, named, running, sealed, spread, unsealed, word_count

#: Buckets of the per-source shuffle and of virtual time are 2 to these powers.
SHUFFLE_BITS, TIME_BINS = 12, 4096


def source_targets(totals: DataFrame, weights: tuple[int, ...], most_repeats: int, budget: Column) -> DataFrame:
    """_null, _src, source_size -> the same with target, its share of budget.

    Sources stand by code point, null last, and take the weights in turn. A target stops at most_repeats
    times the source's size; the excess is reshared by weight. In closed form: by rising cap/weight, a
    source is capped as long as its cap/weight is not above the level that the rest would get.
    The window holds one row per source.
    """
    place = Window.orderBy("_null", "_src")
    named = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(most_repeats))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rise = Window.orderBy("_ratio", "_null", "_src")
    before, after = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = named.withColumn("_level", level)
    # from the first uncapped source on, all take that source's level
    first = levels.withColumn("_at", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_null", "_src", "_level"))).over(Window.partitionBy()))
    return first.select("_null", "_src", "source_size", F.least("_cap", F.col("_w") * F.coalesce(F.col("_at._level"), F.lit(float("inf")))).alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    most_repeats: int = 3,
    budget_share: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """One row per document and copy in the mix, or one with taken 0: the columns of docs, then size,
    source_size, target, copy (from 1), taken, finish, mix_start and slot (with the source, it names a document).

    Each source's documents are shuffled by a hash of key and seed. A copy's virtual finish time is the
    cumulative size of its source divided by the source's target; copies are ordered by it over all
    sources and cut where the running total reaches the budget (budget_share of all sizes). The copy
    that crosses its source's target is taken in part, so that a target is met to a word.

    Null source: a source of its own, after all others. Null text: size 0. Documents of size 0 are never
    taken. Empty input: empty result. Repeated rows are documents of their own; between wholly equal rows
    the order is arbitrary and of no effect. Columns of docs named as outputs are replaced; others may have any name.
    """
    outputs = ["size", "source_size", "target", "copy", "taken", "finish", "mix_start", "slot"]
    size = word_count(named(text)) if size is None else size
    own = [c for c in docs.columns if c not in outputs]
    base = docs.select(*sealed(docs, own), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), named(source).isNull().alias("_null"), F.coalesce(named(source).cast("string"), F.lit("")).alias("_src"), named(key).alias("_key"))
    base = base.withColumn("_hash", F.xxhash64(F.lit(seed), "_key", "_size"))
    base = base.withColumn("_bucket", spread(F.col("_hash"), SHUFFLE_BITS))
    parts = base.groupBy("_null", "_src", "_bucket").agg(F.sum("_size").alias("_part"))
    before = Window.partitionBy("_null", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_null", "_src")
    parts = parts.select("*", F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"), F.sum("_part").over(every).alias("source_size"))
    totals = parts.groupBy("_null", "_src").agg(F.max("source_size").alias("source_size"))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget_share))
    totals = totals.withColumn("_budget", whole)
    targets = source_targets(totals.select("_null", "_src", "source_size", "_budget"), weights, most_repeats, F.col("_budget"))
    parts = parts.drop("source_size").join(targets.join(totals.select("_null", "_src", "_budget"), ["_null", "_src"]), ["_null", "_src"])
    at = ["_null", "_src", "_bucket"]
    order = Window.partitionBy(*at).orderBy("_hash", "_key", "_size")
    placed = base.join(parts, at).withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_offset")
    placed = placed.withColumn("_slot", F.shiftleft(F.col("_bucket").cast("long"), 48) + F.row_number().over(order))
    goal = F.floor(F.col("target"))
    # the copies of a document whose start is below the target; one with taken 0 for the others
    starts = F.transform(F.sequence(F.lit(0), F.lit(most_repeats - 1)), lambda i: (F.col("_before") + i * F.col("source_size")).cast("long"))
    starts = F.when(F.col("_size") > 0, F.filter(starts, lambda s: s < goal)).otherwise(F.array().cast("array<bigint>"))
    placed = placed.select("*", F.posexplode_outer(starts).alias("_i", "_start"))
    placed = placed.withColumn("_take", F.when(F.col("_start").isNull(), F.lit(0)).otherwise(F.least(F.col("_size"), goal - F.col("_start"))).cast("long"))
    placed = placed.withColumn("finish", F.when(F.col("_take") > 0, (F.col("_start") + F.col("_take")) / F.col("target")))
    # the global order: virtual time cut into bins, running totals of the bins, then rows within a bin
    placed = placed.withColumn("_bin", F.when(F.col("_take") > 0, F.least(F.floor(F.col("finish") * TIME_BINS), F.lit(TIME_BINS)).cast("int")).otherwise(F.lit(TIME_BINS + 1) + F.coalesce(F.col("_bucket"), F.lit(0))))
    placed = running(placed.withColumn("_one", F.lit(0)), ["_one"], "_bin", ["finish", "_null", "_src", "_hash"], "_take", "mix_start")
    taken = F.greatest(F.lit(0), F.least(F.col("_take"), F.ceil(F.col("_budget")) - F.col("mix_start"))).cast("long")
    return placed.select(
        *unsealed(own), F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.coalesce(F.col("_i"), F.lit(0)) + 1).cast("int").alias("copy"), taken.alias("taken"), "finish", "mix_start", F.col("_slot").alias("slot")
    )


def mix_summary(mixed: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows of mix_sources by document: key, size, source_size, target, taken (copies summed), copies."""
    had = F.sum((F.col("taken") > 0).cast("int")).alias("copies")
    grouped = mixed.groupBy(source, "slot").agg(*[F.first(c).alias(c) for c in (key, "size", "source_size", "target")], F.sum("taken").alias("taken"), had)
    return grouped.select(key, "size", "source_size", "target", "taken", F.col("copies").cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix as documents with the columns of docs: a row per copy taken, in part where it is cut.

    A copy taken in part keeps its first words, joined by one space; n_chars, if there, follows.
    Options as for mix_sources.
    """
    names = docs.columns
    at = {c: f"c{k}" for k, c in enumerate(names)}
    source, key, size = how.pop("source", "source"), how.pop("key", "doc_id"), how.pop("size", None)
    packed = docs.select(*sealed(docs), *([] if size is None else [size.alias("_words")]))
    got = mix_sources(packed, size=None if size is None else F.col("_words"), text=at[text], source=at[source], key=at[key], **how).filter("taken > 0")
    own, partly = F.col(at[text]), F.col("taken") < F.col("size")
    first = F.array_join(F.slice(F.filter(F.split(own, rf"[{SPACE}]+"), lambda w: w != ""), 1, F.col("taken").cast("int")), " ")
    kept = F.when(partly, first).otherwise(own)
    out = {text: kept}
    if "n_chars" in names:
        out["n_chars"] = F.when(partly, F.char_length(kept)).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return got.select(*[out.get(c, F.col(at[c])).alias(c) for c in names])
