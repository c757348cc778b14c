"""Leakage between training and test texts at three levels: equal, equal when folded, equal with digits masked too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import leak_keys, nfkc

LEVELS = ("exact", "norm", "masked")


def keyed(df: DataFrame, text_col: str = "text", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``df`` with ``keys`` of the levels asked for, in one pass in the JVM."""
    if set(levels) <= {"exact"}:
        return df.withColumn("keys", leak_keys(F.col(text_col), levels=levels))
    # A projection of its own: each text is brought into NFKC once.
    full = df.withColumn("_full", nfkc(F.col(text_col)))
    return full.withColumn("keys", leak_keys(F.col(text_col), F.col("_full"), levels)).drop("_full")


def marked(train: DataFrame, test: DataFrame, text_col: str = "text", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Test rows with ``leak_`` columns of the levels asked for; distinct training keys are joined, a level at a time."""
    keys = keyed(train.select(text_col), text_col, levels).select("keys.*")
    out = keyed(test, text_col, levels)
    for level in levels:
        known = keys.select(F.col(level).alias("_k")).distinct().withColumn("_hit", F.lit(True))
        out = out.join(known, F.col(f"keys.{level}") == F.col("_k"), "left").withColumn(f"leak_{level}", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")
    return out.drop("keys")


def counts(rows: DataFrame, spans_col: str | None = None) -> DataFrame:
    """(level, n, percent, spans) of marked test rows."""
    spans = F.coalesce(F.size(spans_col), F.lit(0)) if spans_col else F.lit(0)
    levels = [x for x in LEVELS if f"leak_{x}" in rows.columns]
    hit = lambda x: F.col(f"leak_{x}").cast("int")
    one = rows.agg(F.count("*").alias("total"), *(F.sum(hit(x)).alias(f"n_{x}") for x in levels), *(F.sum(hit(x) * spans).alias(f"s_{x}") for x in levels))
    each = F.array(*(F.struct(F.lit(x).alias("level"), F.coalesce(f"n_{x}", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.col(f"n_{x}") * 100.0, "total"), F.lit(0.0)).alias("percent"), F.coalesce(f"s_{x}", F.lit(0)).alias("spans")) for x in levels))
    return one.select(F.inline(each))


def splits(rows: DataFrame) -> dict[str, DataFrame]:
    """The four subsets of marked test rows: without and with equal texts, without and with masked equals."""
    bare = rows.drop(*(f"leak_{x}" for x in LEVELS))
    pick = lambda cond: rows.filter(cond).select(*bare.columns)
    return {"dedup": pick(~F.col("leak_exact")), "dupsonly": pick(F.col("leak_exact")), "maskdedup": pick(~F.col("leak_masked")), "maskdupsonly": pick(F.col("leak_masked"))}
