"""Report tables from evaluation results: comparisons by label, deltas, rankings, and Markdown of what is small."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

RESULT = (
    "micro struct<p:double,r:double,f1:double,partial_f1:double,support:long>, per_entity map<string,struct<support:long,p:double,r:double,f1:double,partial_f1:double>>,"
    " n_rows long, sec double, ms_per_row double, tag string, model string, dataset string"
)


def supported(results: DataFrame) -> DataFrame:
    """Results by label alone; a missing ``micro.support`` is the sum of the labels' support."""
    total = F.aggregate(F.map_values("per_entity"), F.lit(0).cast("long"), lambda a, v: a + v["support"])
    have = results.filter(F.size(F.coalesce("per_entity", F.create_map())) > 0)
    return have.withColumn("micro", F.col("micro").withField("support", F.coalesce("micro.support", total)))


def by_label(results: DataFrame) -> DataFrame:
    """(model, dataset, label, support, p, r, f1, partial_f1)."""
    return results.select("model", "dataset", F.explode("per_entity").alias("label", "v")).select("model", "dataset", "label", "v.*")


def comparison(labels: DataFrame, dataset: str, models: list[str], metric: str = "f1") -> DataFrame:
    """(label, support, a column for each model) of the schema's labels: null where a model wasn't run there, 0 where it has no figure.

    Support is the first model's that has the label. Cells are null too where a label has neither gold nor found spans.
    """
    here = labels.filter((F.col("dataset") == dataset) & F.col("model").isin(models))
    order = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    # One pass over the results, which may be costly: support, a cell and a mark that it ran for each model.
    cells = [F.struct(F.first(F.when(F.col("model") == m, F.col(metric)), ignorenulls=True).alias("v"), F.max(F.col("model") == m).alias("ran")).alias(f"_{i}") for i, m in enumerate(models)]
    each = here.groupBy("label").agg(F.min_by("support", order).alias("support"), *cells)
    all_labels = Window.partitionBy(F.lit(0))  # a row for each label
    each = each.withColumns({f"_ran_{i}": F.max(f"_{i}.ran").over(all_labels) for i in range(len(models))})
    every = labels.sparkSession.createDataFrame([(x, i) for i, x in enumerate(L.LABELS)], "label string, ord int")
    out = every.join(F.broadcast(each), "label", "left").fillna(0, ["support"])
    fill = [F.when(F.col(f"_ran_{i}"), F.when(F.col("support") > 0, F.coalesce(f"_{i}.v", F.lit(0.0))).otherwise(F.col(f"_{i}.v"))).alias(m) for i, m in enumerate(models)]
    return out.select("label", "support", *fill, "ord").orderBy(F.desc("support"), "ord").drop("ord")


def without_support(table: DataFrame) -> DataFrame:
    return table.filter("support = 0").select("label")


def drops(labels: DataFrame, dataset: str, before: str, after: str, metric: str = "r", least: float = 0.05, most: int = 3) -> DataFrame:
    """(label, delta in points) of the labels that lose more than ``least`` points, worst first: a top-k report."""
    here = labels.filter(F.col("dataset") == dataset)
    # Both models' figures of a label meet in one group, in one pass over the results; a figure that is null gives no delta.
    figures = [F.collect_list(F.when(F.col("model") == m, F.col(metric))).alias(k) for m, k in ((before, "a"), (after, "b"))]
    both = here.filter(F.col("label").isNotNull()).groupBy("label").agg(*figures).select("label", F.explode("a").alias("a"), "b").select("label", "a", F.explode("b").alias("b"))
    delta = both.select("label", ((F.col("b") - F.col("a")) * 100).alias("delta"))
    return delta.filter(F.col("delta") < -least).orderBy("delta", "label").limit(most)


def variant_deltas(results: DataFrame) -> DataFrame:
    """(variant, support, base_f1, f1, delta, r) from results tagged ``stress_<variant>`` and ``stress_<variant>_base``."""
    name = F.regexp_extract("tag", r"^stress_(.*?)(_base)?\z", 1)
    mine = results.filter(F.col("tag").startswith("stress_")).withColumn("variant", name)
    base = mine.filter(F.col("tag").endswith("_base")).select("variant", F.col("micro.f1").alias("base_f1"))
    own = mine.filter(~F.col("tag").endswith("_base")).select("variant", F.col("micro.support").alias("support"), F.col("micro.f1").alias("f1"), F.col("micro.r").alias("r"))
    return own.join(base, "variant").select("variant", "support", "base_f1", "f1", ((F.col("f1") - F.col("base_f1")) * 100).alias("delta"), "r").orderBy("variant")


def by_length(results: DataFrame) -> DataFrame:
    """(length, n_rows, p, r, f1) from results tagged ``longdoc_<length>``; repaired runs are left out."""
    mine = results.filter(F.col("tag").rlike(r"^longdoc_.*\d\z"))
    return mine.select(F.regexp_extract("tag", r"(\d+)\z", 1).cast("int").alias("length"), "n_rows", "micro.p", "micro.r", "micro.f1").orderBy("length")


def ranking(results: DataFrame) -> DataFrame:
    """Results in order of tag and falling f1."""
    return results.select("model", "tag", F.col("n_rows").alias("n"), "micro.f1", "micro.p", "micro.r", F.col("micro.partial_f1").alias("partial"), "ms_per_row").orderBy("tag", F.desc("f1"), "model")


def best_variant(df: DataFrame, max_mb: float = 160.0) -> DataFrame:
    """The row with the best f1 among those small enough; of equals the smallest."""
    names = df.columns
    return df.filter(F.col("size_mb") <= max_mb).agg(F.max_by(F.struct(*names), F.struct("f1", -F.col("size_mb"))).alias("b")).select("b.*")


def _cell(x: object, digits: int) -> str:
    return "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def markdown(table: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows is an error, not a cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [table.columns, ["---"] * len(table.columns), *([_cell(x, digits) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(re.sub(r"\|", r"\\|", str(c)) for c in line) + " |" for line in lines)


def html_table(table: DataFrame, title: str, digits: int = 4, most: int = 1000) -> str:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "".join(line([_cell(x, digits) for x in r], "td") for r in rows)
    return f"<h2>{html.escape(title)}</h2><table>{line(table.columns, 'th')}{body}</table>"


def against(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, support, base_f1, f1, delta, r) for a manifest of (name, tag, base_tag): deduplicated sets, rules and hybrids against their base.

    A name whose result isn't there keeps its row, with nulls.
    """
    own = results.select(F.col("tag"), F.col("micro.support").alias("support"), F.col("micro.f1").alias("f1"), F.col("micro.r").alias("r"))
    base = results.select(F.col("tag").alias("base_tag"), F.col("micro.f1").alias("base_f1"))
    out = manifest.join(own, "tag", "left").join(base, "base_tag", "left")
    return out.select("name", "support", "base_f1", "f1", ((F.col("f1") - F.col("base_f1")) * 100).alias("delta"), "r").orderBy("name")


def html_report(results: DataFrame, leaks: DataFrame | None = None, final: list[str] | None = None, digits: int = 4) -> str:
    """A page with a table for each dataset, best model first; ``final`` keeps these models alone.

    ``leaks`` (dataset, percent) flags datasets whose texts are partly in the training set.
    """
    rows = ranking(results.withColumn("tag", F.col("dataset")))
    rows = rows.filter(F.col("model").isin(final)) if final is not None else rows
    names = [r[0] for r in results.select("dataset").distinct().orderBy("dataset").collect()]
    flags = {r["dataset"]: r["percent"] for r in leaks.filter(F.col("dataset").isin(names)).groupBy("dataset").agg(F.max("percent").alias("percent")).collect()} if leaks is not None else {}
    parts = []
    for name in names:
        flag = f" ({flags[name]:.2f} % in training)" if flags.get(name) else ""
        parts.append(html_table(rows.filter(F.col("tag") == name).drop("tag"), f"{name}{flag}", digits))
    return "<!doctype html><meta charset='utf-8'>" + "".join(parts)
