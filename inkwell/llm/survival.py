"""Interaction of document filters by survival words.

A document's word has one bit for each subset of the filters: set where the document passes all of the subset. The words
of a part are summed by bit position with carry-save adders, which gives the survivors of every subset; what a filter
keeps, removes or finds already removed in any order follows from these counts, without another look at the documents.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, lean, named, written

#: Classes (part and flags) whose counts a task holds before it hands them on.
MOST = 1 << 16
#: Filters that a 32-bit word has room for.
FILTERS = 5


def truth_words(filters: int) -> np.ndarray:
    """For each set of failed filters (as a bit mask), the word of the subsets that such a document survives."""
    subset = np.arange(1 << filters, dtype=np.uint32)
    alive = (subset[:, None] & subset[None, :]) == 0
    return (alive.astype(np.uint32) << subset).sum(1, dtype=np.uint32)


def positional_popcounts(word: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """groups x 32: how many of each group's words have each bit set, by carry-save addition.

    Words of one group and one binary weight go through full adders, three to a sum and a carry of twice the weight,
    until at most two are left, then through a half adder; all groups go through an adder at once.
    """
    out = np.zeros((groups, 32), np.int64)
    place = np.arange(32, dtype=np.uint32)
    weight = 1
    while len(word):
        carried: list[tuple[np.ndarray, np.ndarray]] = []
        for width in (3, 2):
            while True:
                by = np.argsort(group, kind="stable")
                word, group = word[by], group[by]
                n = np.bincount(group, minlength=groups)
                full = n // width
                if not full.any():
                    break
                start = np.repeat(np.cumsum(n) - n, full) + width * (np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full))
                a, b, c = word[start], word[start + 1], word[start + 2] if width == 3 else np.uint32(0)
                carried.append(((a & b) | (c & (a ^ b)), group[start]))
                rest = np.ones(len(word), bool)
                rest[(start[:, None] + np.arange(width)).ravel()] = False
                word, group = np.concatenate([a ^ b ^ c, word[rest]]), np.concatenate([group[start], group[rest]])
        out[group] += weight * ((word[:, None] >> place) & np.uint32(1)).astype(np.int64)
        word = np.concatenate([w for w, _ in carried]) if carried else word[:0]
        group = np.concatenate([g for _, g in carried]) if carried else group[:0]
        weight *= 2
    return out


def survivors(rows: DataFrame, filters: int, flags: int) -> DataFrame:
    """rows (part string, flags int, failed int, as bit masks) -> (part, subset, n, n_0, n_1, ...): documents of the part
    that survive the subset of filters, and those of them that have flag 0, 1, ..."""
    words = truth_words(filters)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def spill() -> pa.RecordBatch:
            counts = np.concatenate(list(held.values()))
            to = np.arange(len(held) + 1, dtype=np.int32) * 32
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.ListArray.from_arrays(pa.array(to), pa.array(counts))], names=["part", "flags", "counts"])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            code = part.indices.to_numpy().astype(np.int64) << flags | batch.column(1).to_numpy()
            known, group = np.unique(code, return_inverse=True)
            for k, counts in zip(known.tolist(), positional_popcounts(words[batch.column(2).to_numpy()], group, len(known)), strict=True):
                name = (part.dictionary[k >> flags].as_py(), k & ((1 << flags) - 1))
                held[name] = held[name] + counts if name in held else counts
            if len(held) > MOST:
                yield spill()
        if held:
            yield spill()

    parts = rows.select("part", "flags", "failed").mapInArrow(lean(fold), "part string, flags int, counts array<long>")
    each = parts.select("part", "flags", F.posexplode("counts").alias("subset", "_n")).filter(F.col("subset") < (1 << filters))
    has = [F.sum(F.when(F.col("flags").bitwiseAND(1 << k) != 0, F.col("_n")).otherwise(0)).alias(f"n_{k}") for k in range(flags)]
    return each.groupBy("part", "subset").agg(F.sum("_n").alias("n"), *has)


def order_effects(counts: DataFrame, names: str, flags: list[str]) -> DataFrame:
    """survivors() -> a row per part, order of all filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    one lost count per flag, and shapley, the step's filter's removals summed over all orders. names: a letter per filter."""
    n = len(names)
    everything = (1 << n) - 1
    steps = []
    for order in itertools.permutations(range(n)):
        done = 0
        for step, f in enumerate(order):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": step + 1, "filter": f, "before": done, "after": done | 1 << f})
            done |= 1 << f
    values = ["n", *(f"n_{k}" for k in range(len(flags)))]
    arrays = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *values))).alias("_at"))  # one entry per subset
    arrays = arrays.select("part", *(F.col(f"_at.{v}").alias(v) for v in values))
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter int, before int, after int>>")

    def at(value: str, mask: Column | int) -> Column:
        return F.element_at(value, (F.lit(mask) if isinstance(mask, int) else mask) + 1)

    def shapley(f: int) -> Column:
        rest = [s for s in range(1 << n) if not s >> f & 1]
        weight = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in rest]
        return sum(((at("n", s) - at("n", s | 1 << f)) * w for s, w in zip(rest, weight, strict=True)), F.lit(0)).cast("long")

    single = [F.array(*(at("n", 1 << f) for f in range(n))).alias("_alone"), F.array(*(at("n", everything & ~(1 << f)) - at("n", everything) for f in range(n))).alias("_unique"), F.array(*(shapley(f) for f in range(n))).alias("_shapley")]
    rows = arrays.select("*", *single).select("*", F.explode(plan).alias("_s")).select("*", "_s.*")
    own = F.col("filter") + 1
    removed = at("n", F.col("before")) - at("n", F.col("after"))
    fails = at("n", 0) - F.element_at("_alone", own)
    lost = [(at(v, F.col("before")) - at(v, F.col("after"))).alias(f"{flag}_lost") for v, flag in zip(values[1:], flags, strict=True)]
    return rows.select("part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), F.element_at("_unique", own).alias("unique_fails"), *lost, F.element_at("_shapley", own).alias("shapley"))


def text_failures(text: Column) -> Column:
    """Which of the filters A to D a text (null: empty) fails, as a bit mask.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * capitals A-Z > 5 * code points. D: one of # $ % & * |.
    """
    whole = F.coalesce(text, F.lit(""))
    word = F.filter(F.split(whole, f"[{SPACE}]+"), lambda w: w != "")
    fails = [F.size(word) < 50, 100 * F.size(F.array_distinct(word)) < 65 * F.size(word), 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 5 * F.length(whole), whole.rlike(r"[#$%&*|]")]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0)).cast("int")


def audited(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, flags (1: quality is 1, 2: toxic is 1), failed (filters A to E) per row of docs.

    E: the text is identical with that of a row of smaller key. Texts are compared by SHA-256. The join that finds E is
    dealt by digest and key, so copies of one text are spread.
    """
    whole = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(key).alias("_key"), F.coalesce(named(part), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("_digest"), text_failures(named(text)).alias("_failed"))
    rows = written(rows)
    firsts = rows.groupBy("_digest").agg(F.min(F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("key"))).alias("_f")).select(F.col("_digest").alias("_d"), F.col("_f.key").alias("_first"), F.lit(0).alias("_e"))
    rows = rows.join(firsts, (F.col("_digest") == F.col("_d")) & F.col("_key").eqNullSafe(F.col("_first")), "left")
    known = labels.groupBy(named(key).alias("_labelled")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("_toxic"))
    rows = rows.join(known, F.col("_key") == F.col("_labelled"), "left")
    flags = (F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))).cast("int").alias("flags")
    return rows.select("part", flags, (F.col("_failed") + F.coalesce("_e", F.lit(16))).cast("int").alias("failed"))


def filter_interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Filters A to E (text_failures, audited) over whole texts: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, for each part, each of the 120 orders and each step.

    kept and removed: after and by this step. redundant: fail its filter, removed earlier. unique_fails: fail its filter only.
    good_lost, toxic_lost: removed here with quality 1, toxic 1 in labels. shapley: its filter's removals over all orders.

    Null text: the empty text. Null part: the part ''. Null key: after all other keys, without label. Repeated rows: equal keys
    are not smaller than each other, so rows of the smallest key all pass E. Repeated labels: a flag holds if one row has it.
    Empty docs: no part, no row. Other columns are not read, so their names may clash.
    """
    return order_effects(survivors(audited(docs, labels, key, text, part), FILTERS, 2), "ABCDE", ["good", "toxic"])


#: The audit in SQL, document by document.
AUDIT_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m
          FROM t LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    x(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
          WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    k AS (SELECT filter_order, step, x.x AS filter, x.b AS bit, coalesce((SELECT sum(y.b) FROM x y WHERE position(y.x IN filter_order) < step), 0) AS before
          FROM o, (SELECT unnest(range(1, 6)) AS step) JOIN x ON x.x = filter_order[step]),
    r AS (SELECT part, filter_order, step, filter,
                 sum(CASE WHEN m & (before + bit)::BIGINT = 0 THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN m & before::BIGINT = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN m & before::BIGINT <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN m & before::BIGINT = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN m & before::BIGINT = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM c, k GROUP BY ALL)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
    FROM r"""
