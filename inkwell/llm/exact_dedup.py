"""Exact deduplication with stateful streaming (native: DataFrame and Structured Streaming only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import collapsed, possible, sealed, shared_dir, unsealed, written

#: The state store on local disk, backed up in the checkpoint folder; memory for all its instances together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
#: Salts of a group's texts while their bytes are compared.
SALTS = 16


def located(docs: DataFrame, names: list[str], a_scan: bool = False) -> DataFrame:
    """The named columns of docs as c0, c1, ... and _locator: the file and row where the content lies.

    Only the caller knows whether docs is a_scan, that is files read and at most filtered and projected: an explode or a join
    gives several rows of one place. Any other frame is written first, so that every row has a locator of its own.
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_locator")
    if a_scan and "_metadata" not in docs.columns:
        try:
            return docs.select(*sealed(docs, names), place)
        except AnalysisException:
            pass
    return written(docs.select(*sealed(docs, names))).select("*", place)


def stream_state(fingerprints: DataFrame, path: str, files_per_batch: int = 64) -> DataFrame:
    """Streams a written table of (_digest, _key, _locator) through keyed state; a row per digest.

    The state (RocksDB, no expiry, no watermark) holds for each digest its smallest key, that row's
    locator and the number of rows. Every micro-batch writes the states it touched; since counts only
    grow and keys only fall, the last state of a digest has the largest count.
    """
    spark = fingerprints.sparkSession
    fingerprints.write.parquet(f"{path}/fingerprints")
    first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), F.col("_locator").alias("locator")))
    state = (
        spark.readStream.schema(fingerprints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/fingerprints").groupBy("_digest").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    updates = f"{path}/updates"
    spark.createDataFrame([], state.schema).write.parquet(f"{updates}/batch=-1")
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{updates}/batch={n}")).start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    read = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(updates)
    return read.groupBy("_digest").agg(F.min("_first").alias("_first"), F.max("_n").alias("_n"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256), files_per_batch: int = 64, a_scan: bool = False) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of white space become one space. Digests pass through
    disk-backed streaming state; then the bytes of all texts that share a digest are compared, and the
    rows of a digest whose texts differ are grouped anew by their whole texts.

    Null text: equal to the empty text. Null key: after all other keys; a group of null keys only keeps
    one. Repeated rows (equal key and text): all are in the group, just one of them is kept, in any frame:
    rows are told apart by locators, file and row. docs is written first, unless the caller says that it is a_scan (see located).
    Empty input: empty result. Other columns of docs are not read.
    """
    return _grouped_texts(located(docs, [key, text], a_scan), digest, files_per_batch).withColumnRenamed("_key", key)


def _grouped_texts(rows: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """exact_dedup of rows (c0: key, c1: text, _locator); the key is named _key."""
    path = shared_dir(rows.sparkSession)
    base = rows.select(F.col("c0").alias("_key"), collapsed(F.col("c1")).alias("_norm"), "_locator")
    base = base.select("_key", "_norm", "_locator", digest(F.col("_norm")).alias("_digest"))
    fingerprints = base.select("_key", "_locator", "_digest", F.sha2("_norm", 256).alias("_sha"))
    state = stream_state(fingerprints, path, files_per_batch)
    state = written(state, f"{path}/digests")
    rows = rows.sparkSession.read.schema(fingerprints.schema).parquet(f"{path}/fingerprints")

    # full bytes on hits: a salted comparison, with the extremes of a group's texts built map-side
    hits = state.filter("_n > 1").select("_digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    texts = possible(base, state.filter("_n > 1"), "_digest").select("_digest", "_norm", F.pmod(F.hash("_locator"), F.lit(SALTS)).alias("_salt"))
    extremes = texts.join(hits, ["_digest", "_salt"]).groupBy("_digest", "_salt").agg(F.min("_norm").alias("_a"), F.max("_norm").alias("_b"))
    differ = extremes.groupBy("_digest").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")).filter("_a <> _b").select("_digest")
    differ = written(differ, f"{path}/collisions")

    grouped = rows.join(state, "_digest").select("_key", "_locator", "_digest", "_sha", F.col("_first.key").alias("_keep"), F.col("_first.locator").alias("_keeper"), "_n")
    if not differ.isEmpty():
        again = base.join(differ, "_digest", "left_semi")
        first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), F.col("_locator").alias("locator")))
        exact = again.groupBy("_digest", "_norm").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
        exact = again.join(exact, ["_digest", "_norm"]).select("_key", "_locator", "_digest", F.sha2("_norm", 256).alias("_sha"), F.col("_first.key").alias("_keep"), F.col("_first.locator").alias("_keeper"), "_n")
        grouped = grouped.join(differ, "_digest", "left_anti").unionByName(exact)
    return grouped.select("_key", F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_locator") == F.col("_keeper")).alias("kept"), F.col("_sha").alias("text_sha256"), F.col("_locator").alias("locator"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256), files_per_batch: int = 64, a_scan: bool = False) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    names = docs.columns
    rows = located(docs, names, a_scan)
    keyed = rows.select(F.col(f"c{names.index(key)}").alias("c0"), F.col(f"c{names.index(text)}").alias("c1"), "_locator")
    found = _grouped_texts(keyed, digest, files_per_batch).filter("kept").select(F.col("locator").alias("_locator"))
    return rows.join(found, "_locator", "left_semi").select(*unsealed(names))
