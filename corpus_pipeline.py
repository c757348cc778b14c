"""From documents to packed sequences in five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactra.llm import ngram_jaccard, packing, raking, robust_quality, weak_toxicity
from redactra.llm.common import documents, drop_tables, made, remainder, written


#: Which tables each stage's operator has left behind its result, by thread: two runs at once don't touch each other's.
LEFT: dict[tuple[int, str], list[str]] = {}


def after(before: str | None) -> Callable:
    """A stage that begins when the one ``before`` it is written: what that one's operator left goes first."""

    def wrap(stage: Callable) -> Callable:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if paths := LEFT.pop((get_ident(), before), None):
                drop_tables(spark, paths)
            with made() as paths:
                out = stage(spark, docs, sf_dir)
            LEFT[get_ident(), stage.__name__] = paths
            return out

        return run

    return wrap


@after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the robust distances reject go."""
    return robust_quality.keep_good(docs)


@after("quality")
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go. Ratings of the training folds come from ``labels``."""
    labels = documents(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    return weak_toxicity.keep_clean(docs, labels)


@after("toxicity")
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component of five-word shingle sets with similarity 0.8 or more, the first row stays."""
    return ngram_jaccard.keep_one(docs, 5, 80)


@after("near_copies")
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents drawn by raked probabilities."""
    return raking.sample(docs)


@after("mixture")
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row for each piece of the remaining documents."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("ngram_jaccard_join", near_copies), ("mixing", mixture), ("packing", packed)]

#: Robust estimates, trained models and packings have no SQL form; the pipeline is tested against its operators one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
