"""Sinks: JSON Lines with a summary, error dumps, results, the four leakage splits, and command line output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import surface
from ..operators import dataset, leakage, scoring


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Writes unified rows as JSON Lines and returns their summary, from what was written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return dataset.summary(df.sparkSession.read.schema(df.schema).json(path))


def write_errors(df: DataFrame, path: str, **columns: str) -> None:
    """Rows whose gold and found spans differ. The file has text in clear; keep it where the data may be."""
    scoring.errors(df, **columns).write.json(path)


def write_result(result: DataFrame, path: str) -> None:
    result.write.json(path)


def write_leak_splits(rows: DataFrame, folder: str, stem: str) -> list[str]:
    """Writes the four subsets of marked rows; they are marked once, so persist them before."""
    paths = []
    for name, part in leakage.splits(rows).items():
        paths.append(f"{folder}/{stem}_{name}")
        part.write.json(paths[-1])
    return paths


def span_lines(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """(start, end, label, score, value) a row for each span: the command line's table."""
    each = df.select(text_col, F.explode(spans_col).alias("s"))
    return each.select("s.start", "s.end", "s.label", "s.score", surface(F.col(text_col), F.col("s")).alias("value"))


def as_json(spans: Column, summary: Column) -> Column:
    return F.to_json(F.struct(spans.alias("spans"), summary.alias("summary")))
