"""Scoring of spans: exact and partial matches, by label, micro and macro, restricted, and the rows that differ.

Rows are paired by key, never by place. Counts are folded inside a row first and summed by label, so the shuffle has a row
for each label and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"p": p, "r": r, "f1": ratio(2 * p * r, p + r)}


def _keys(spans: Column) -> Column:
    """Distinct (start, end, label): equal spans count once in exact scoring."""
    return F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))


def partial_hits(gold: Column, found: Column) -> Column:
    """Places in ``found`` that greedy matching uses: each gold span in order takes the first free one of its label that overlaps."""
    start = F.array().cast("array<int>")
    places = F.sequence(F.lit(0), F.size(found) - 1)

    def step(used: Column, g: Column) -> Column:
        fits = lambda i: ~F.array_contains(used, i) & (F.get(found, i)["label"] == g["label"]) & S.overlap(F.get(found, i), g)
        first = F.get(F.filter(places, fits), F.lit(0))
        return F.when(first.isNull(), used).otherwise(F.concat(used, F.array(first)))

    return F.when(F.size(found) == 0, start).otherwise(F.aggregate(gold, start, step))


def counts(df: DataFrame, gold: str = "gold", found: str = "spans", by: list[str] | None = None, rows_col: str | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn, ptp, pfp, pfn) over all rows; null arrays are empty.

    ``rows_col`` adds the number of rows, all of it at a null label.
    """
    by = by or []
    g, p = F.coalesce(gold, S.empty()), F.coalesce(found, S.empty())
    rows = df.select(*by, g.alias("g"), p.alias("p")).select(*by, "g", "p", _keys(F.col("g")).alias("gk"), _keys(F.col("p")).alias("pk"), partial_hits(F.col("g"), F.col("p")).alias("used"))
    kinds = {
        "tp": F.transform(F.array_intersect("gk", "pk"), lambda s: s["label"]),
        "fp": F.transform(F.array_except("pk", "gk"), lambda s: s["label"]),
        "fn": F.transform(F.array_except("gk", "pk"), lambda s: s["label"]),
        "ptp": F.transform("used", lambda i: F.get(F.col("p"), i)["label"]),
        "p_all": F.transform("p", lambda s: s["label"]),
        "g_all": F.transform("g", lambda s: s["label"]),
    }
    mark = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("label"))
    marked = F.concat(*(F.transform(v, mark(k)) for k, v in kinds.items()), *([F.array(mark("row")(F.lit(None).cast("string")))] if rows_col else []))
    each = rows.select(*by, F.explode(marked).alias("m")).groupBy(*by, F.col("m.label").alias("label"))
    out = each.agg(*(F.count_if(F.col("m.kind") == k).alias(k) for k in kinds), *([F.count_if(F.col("m.kind") == "row").alias(rows_col)] if rows_col else []))
    # A gold span or a found one that takes no part in a partial match is a miss or a false alarm of its label.
    return out.select(*by, "label", "tp", "fp", "fn", "ptp", (F.col("p_all") - F.col("ptp")).alias("pfp"), (F.col("g_all") - F.col("ptp")).alias("pfn"), *([rows_col] if rows_col else []))


def _figures() -> list[Column]:
    """p, r, f1 and partial_f1 from columns of counts."""
    exact, part = prf(F.col("tp"), F.col("fp"), F.col("fn")), prf(F.col("ptp"), F.col("pfp"), F.col("pfn"))
    return [*(v.alias(k) for k, v in exact.items()), part["f1"].alias("partial_f1")]


def _support() -> Column:
    return (F.col("tp") + F.col("fn")).alias("support")


def _occurs(labels: list[str] | None = None) -> Column:
    return F.col("label").isin(labels or L.LABELS) & (F.col("tp") + F.col("fp") + F.col("fn") > 0)


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("tp", "fp", "fn", "ptp", "pfp", "pfn")]


def per_label(c: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(label, support, p, r, f1, partial_f1) of the schema's labels that occur."""
    return c.filter(_occurs(labels)).select("label", _support(), *_figures())


def micro(c: DataFrame) -> DataFrame:
    """One row over all labels, those outside the schema included."""
    return c.agg(*_totals()).select(*_figures(), _support())


def macro(labels: DataFrame, min_support: int = 1) -> DataFrame:
    """Means over labels with this support or more."""
    return labels.filter(F.col("support") >= min_support).agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"), F.count("*").alias("labels"))


def restricted(labels: DataFrame, some: list[str]) -> DataFrame:
    """Micro figures over some labels, from figures by label alone: tp = r * support, fp = tp / p - tp."""
    tp = F.col("r") * F.col("support")
    fp = F.when(F.col("p") > 0, tp / F.col("p") - tp).otherwise(0.0)
    t = labels.filter(F.col("label").isin(some)).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(F.col("support") - tp).alias("fn"))
    zero = F.lit(0.0)
    return t.select(*(v.alias(k) for k, v in prf(F.coalesce("tp", zero), F.coalesce("fp", zero), F.coalesce("fn", zero)).items()))


def restrict_gold(df: DataFrame, some: list[str], gold: str = "gold") -> DataFrame:
    """Gold spans of some labels alone; found spans stay."""
    return df.withColumn(gold, S.of_labels(F.col(gold), some))


def errors(df: DataFrame, id_col: str = "id", text_col: str = "text", gold: str = "gold", found: str = "spans") -> DataFrame:
    """(id, text, fn, fp) of rows whose exact sets differ, with surfaces."""
    shown = lambda keys: F.transform(keys, lambda s: F.struct(S.surface(F.col(text_col), s).alias("span"), s["label"].alias("label"), s["start"].alias("start")))
    g, p = _keys(F.coalesce(gold, S.empty())), _keys(F.coalesce(found, S.empty()))
    out = df.select(id_col, text_col, shown(F.array_sort(F.array_except(g, p))).alias("fn"), shown(F.array_sort(F.array_except(p, g))).alias("fp"))
    return out.filter((F.size("fn") > 0) | (F.size("fp") > 0))


def tally(df: DataFrame, gold: str = "gold", found: str = "spans") -> DataFrame:
    """(exact, partial, missed, false_alarms) of the demo view: partial is any overlap of the same label."""
    g, p = F.col(gold), F.col(found)
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
    touch = lambda a, b: S.overlap(a, b) & (a["label"] == b["label"])
    exact = F.size(F.filter(g, lambda a: F.exists(p, lambda b: same(a, b))))
    near = F.size(F.filter(g, lambda a: ~F.exists(p, lambda b: same(a, b)) & F.exists(p, lambda b: touch(a, b))))
    return df.withColumns({"exact": exact, "partial": near, "missed": F.size(g) - exact - near, "false_alarms": F.size(F.filter(p, lambda b: ~F.exists(g, lambda a: touch(a, b))))})


def evaluate(df: DataFrame, tag: str, gold: str = "gold", found: str = "spans", seconds: float | None = None, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each ``by``: by..., micro, per_entity as a map, n_rows, sec, ms_per_row, tag. Rows are gone over once for all."""
    by = by or []
    c = counts(df, gold, found, by, "n_rows")
    label = F.struct("label", F.struct(_support(), *_figures()))
    entities = F.map_from_entries(F.array_sort(F.collect_list(F.when(_occurs(), label)))).alias("per_entity")
    out = c.groupBy(*by).agg(*_totals(), entities, F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    sec = F.lit(seconds).cast("double")
    return out.select(*by, F.struct(*_figures(), _support()).alias("micro"), "per_entity", "n_rows", sec.alias("sec"), F.try_divide(sec * 1000, F.col("n_rows")).alias("ms_per_row"), F.lit(tag).alias("tag"))
