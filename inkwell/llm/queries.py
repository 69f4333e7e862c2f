"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import scan_sql
from .odd_sketch import NEAR_SQL
from .shared import word_count, written
from .stripes import DIVERGENCE_SQL
from .survival import AUDIT_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The place of the byte-level vocabulary; another can be passed to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), a_scan=True).drop("locator")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, fold, identify

    docs = table(spark, sf_dir, "documents")
    got = identify(docs, fit(docs.filter(fold() != 1)))
    return got.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cotrain import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, mix_summary

    sizes = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_words")))
    return mix_summary(mix_sources(sizes, size=F.col("_words")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import chosen_path_join

    return chosen_path_join(table(spark, sf_dir, "documents")).drop("row_key")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .page_diff import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .run_index import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_round_trip

    return media_round_trip(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), vocabulary())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stripes import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survival import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .odd_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


ALL = (
    op1_exact_dedup, op2_language_id, op3_quality_classifier, op4_source_mixing, op5_license_scan, op6_ngram_jaccard_join,
    op7_html_extraction, op8_suffix_array_dedup, op9_media_columns, op10_best_fit_packing,
    op11_source_divergence, op12_filter_interactions, op13_odd_sketch_dedup,
)
QUERIES = {f.__name__: f for f in ALL}

ORACLES = {
    "op1_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op5_license_scan": scan_sql(),
    "op11_source_divergence": DIVERGENCE_SQL,
    "op12_filter_interactions": AUDIT_SQL,
    "op13_odd_sketch_dedup": NEAR_SQL,
    # all pairs that share a shingle: for small tables only, the query itself runs over any
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT min(doc_id) AS text_id, ws FROM w GROUP BY ws),
        s AS (SELECT text_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM t),
        n AS (SELECT text_id, count(*) AS n FROM s GROUP BY text_id),
        p AS (SELECT a.text_id AS x, b.text_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.text_id < b.text_id GROUP BY ALL),
        l AS (SELECT p.x, p.y FROM p JOIN n a ON a.text_id = p.x JOIN n b ON b.text_id = p.y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT text_id, text_id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.text_id),
        c AS (SELECT text_id, min(root) AS class_id FROM r GROUP BY text_id)
        SELECT w.doc_id, c.class_id, t.text_id, (SELECT count(*) FROM e WHERE e.x = t.text_id) AS n_links, w.doc_id = c.class_id AS kept
        FROM w JOIN t USING (ws) JOIN c USING (text_id)""",
}
