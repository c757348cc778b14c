"""The corpus operators' queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compaction, hmm_lm, iso_media, ngram_jaccard, ordinal_quality, packing, raking, robust_quality, token_edits, weak_toxicity
from .common import documents, fresh_path, remainder


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rated = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    grades = rated.select("doc_id", ordinal_quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal_quality.score(docs, ordinal_quality.train(docs, grades, 3))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.grouped(documents(spark, sf_dir), links=False).select("doc_id", "n_shingles", "class_id", "component_id")


def op4_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with the exact number of links of each document, a column that the SQL of the join doesn't have."""
    return ngram_jaccard.grouped(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_edits.edited(token_edits.sample_edits(documents(spark, sf_dir)))
    return counted.withColumn("after_crc32", F.crc32(F.col("text_after").cast("binary"))).drop("text_after", "tree_after")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.verdicts(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compaction.inventory(compaction.ingest(docs, fresh_path(spark, "shards")), id_kind=docs.schema["doc_id"].dataType.simpleString())


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iso_media.digest_rows(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    out = weak_toxicity.predicted(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return out.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: All pairs that share a shingle, counted in full, and their components: fit for the small tables alone.
JACCARD_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
        SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM w
    ), e AS (
        SELECT doc_id, unnest(s) AS g FROM s
    ), p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), l AS (
        SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 90 * (len(a.s) + len(b.s) - c)
    ), both_ways AS (
        SELECT x, y FROM l UNION ALL SELECT y, x FROM l
    ), r(doc_id, root) AS (
        SELECT doc_id, doc_id FROM s UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.doc_id
    )
    SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, any_value(k.class_id) AS class_id, min(r.root) AS component_id
    FROM s JOIN r USING (doc_id) JOIN (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s) k USING (doc_id)
    GROUP BY s.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": JACCARD_SQL}
