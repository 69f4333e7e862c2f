"""What the training-data operators share: the shared folder, written tables, running sums and Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import lean, shared_dir, written  # noqa: F401

#: The six characters that the contracts call white space, as a Java class body.
SPACE = r"\x20\x09-\x0D"


def named(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def sealed(docs: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of docs (or those named) as c0, c1, ..., so that no name of theirs clashes with a working column."""
    return [named(c).alias(f"c{k}") for k, c in enumerate(docs.columns if names is None else names)]


def unsealed(names: list[str]) -> list[Column]:
    """The columns that sealed() made of these names, under their own names."""
    return [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]


def collapsed(text: Column) -> Column:
    """text (null: empty) with each run of white space replaced by one space.

    The pattern skips single spaces, which would be replaced by themselves.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{SPACE}]+")).cast("long")


def spread(key: Column, bits: int) -> Column:
    """The top bits of a hash column as a bucket number, so that buckets follow the order of unsigned hashes."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def row_key(key: str, text: str) -> Column:
    """128 bits that name a row by key and text; null and empty differ, and what stands in one part can't look like another's end."""
    parts = [[named(c).isNull().cast("string"), F.md5(F.coalesce(named(c).cast("string"), F.lit("")))] for c in (key, text)]
    return F.md5(F.concat_ws("|", *parts[0], *parts[1]))


#: Bits of the filter of possible(); 4 MB, whatever the corpus.
FILTER_BITS = 1 << 25


def possible(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose column of this name may be among those of wanted: all that are, and a share of the others that grows with
    wanted / FILTER_BITS. The bitmaps have a fixed size, so they are broadcast; rows are not shuffled."""
    bit = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    bitmaps = wanted.select(F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmaps), "_bucket")
    return met.filter(F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1).select(*rows.columns)


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows before this one, per keys, in the order (bucket, *order).

    Two levels keep hot keys apart: sums per (keys, bucket) are summed up first, rows are ordered only
    within their (keys, bucket). The bucket must not decrease in the wanted order. keys must not be null.
    """
    at = [*keys, bucket]
    sums = df.groupBy(*at).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*at, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = df.join(offsets, at).withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(own), F.lit(0)))
    return got.drop("_offset")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and its n + 1 offsets, without a copy; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(offsets: np.ndarray, most: int, rows: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most so many bytes and rows, so that work arrays stay small; a longer row stands alone."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        out.append((a, min(b, n, a + rows)))
        a = out[-1][1]
    return out
