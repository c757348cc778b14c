"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells (source, language, topic). Raking multiplies each cell's token weight by one factor for each of
its three margins until the weighted token totals meet the target shares of every margin. Documents are then sampled by
calibrated probabilities: the same raking with a bound of 1 on each cell, so that it is the expected sample that has the
target shares. A hash of the id decides, so reruns and lost executors change nothing.

The topic is a column, or else a stand-in by form (legal lines, records, tables, prose) that three fixed patterns tell.

The cell table is a partial aggregate, far smaller than the documents. Up to ``local_cells`` cells are raked in the
driver's memory; beyond that the same sweeps run as DataFrame joins on the cell table. Both give the same factors up to
rounding. The number of cells is counted first.

Defined results: a null source, language or text is a category or an empty text of its own; a margin's category without
tokens gets no share and the rest is scaled to one; categories of the table that a given target lacks get share 0, and
their documents probability 0; an empty table gives an empty result. Repeated rows of one id share one decision; rows
without an id are told by their text. Raking that ends unconverged after ``SWEEPS`` sweeps says so by its residual.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACES, drop_tables, made, small, written

MARGINS = ("source", "lang", "topic")
NONE = "\x00none"
SWEEPS, TOLERANCE, LOCAL_CELLS = 200, 1e-9, 200_000
#: Target shares are token shares to this power; the worst share of the expected sample may be off by so much.
POWER, NEAR = 0.9, 0.005
#: The first pattern that a text has names its topic. Fixed values.
TOPICS = (
    ("legal", r"(?i)\b(licen[sc]e|licensed|copyright|all rights reserved|warrant(y|ies))\b"),
    ("records", r"(?i)([\w.+-]+@[\w-]+\.\w+|\b(password|token|secret|api_?key)\s*[=:])"),
    ("tables", r"( \| \S+){3}"),
)


def topic(text: Column) -> Column:
    """A topic by form: ``legal``, ``records``, ``tables``, else ``prose``; null texts are ``prose``."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def n_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")).cast("long"), F.lit(0).cast("long"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: its categories' token shares to a power below 1, which lifts the small ones."""
    each = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    return each.select(margin, F.pow("tokens", F.lit(power)).alias("share"))


def _filled(have: np.ndarray, share: np.ndarray, goal: float) -> np.ndarray:
    """Tokens of each category: in the shares' proportions, but none more than it has; together ``goal``, if there are so many."""
    out = np.where(share > 0, have, 0.0)
    if out.sum() <= goal:
        return out
    scale = goal / share[have > 0].sum()
    while True:
        full = scale * share >= have
        free = share[~full & (have > 0)].sum()
        new = (goal - out[full].sum()) / free if free > 0 else scale
        if new <= scale * (1 + 1e-12):
            return np.where(full, out, scale * share)
        scale = new


def attainable(cells: DataFrame, targets: dict[str, DataFrame], goal: float) -> dict[str, DataFrame]:
    """The same for each margin as DataFrames (category, share): only sums reach the driver."""
    found = {}
    for m in MARGINS:
        each = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have")).filter("have > 0").join(targets[m], m).filter("share > 0")
        each = written(each.select(m, "have", "share"), "rake")
        total, shares = each.agg(F.coalesce(F.sum("have"), F.lit(0.0)), F.coalesce(F.sum("share"), F.lit(0.0))).first()
        scale = float("inf") if total <= goal else goal / shares
        while scale < float("inf"):
            full = F.col("share") * scale >= F.col("have")
            done, free = each.agg(F.coalesce(F.sum(F.when(full, F.col("have"))), F.lit(0.0)), F.sum(F.when(~full, F.col("share")))).first()
            if not free or (goal - done) / free <= scale * (1 + 1e-12):
                break
            scale = (goal - done) / free
        found[m] = each.select(m, (F.least("have", F.col("share") * scale) if scale < float("inf") else F.col("have")).alias("share"))
    return found


def _rake_local(cells: pd.DataFrame, targets: dict[str, pd.DataFrame], goal: float | None = None, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """(factors, residual): factors with which every margin has its target shares, and how far the worst share is off.

    With a ``goal`` of tokens, min(1, factor) is the probability of a cell's tokens to stay, and it is their expected sums
    that meet the shares of the goal: each step solves one margin exactly, by Newton's method from the left on a concave
    function, so the sweeps climb the dual of the bounded problem. Without a goal nothing bounds the factors.
    """
    base = cells["tokens"].to_numpy(float)
    codes, shares = {}, {}
    for m in MARGINS:
        codes[m], names = pd.factorize(cells[m])
        share = targets[m].set_index(m)["share"].reindex(names).fillna(0).to_numpy(float)
        there = np.bincount(codes[m], base, len(names)) > 0
        share = np.where(there, share, 0)
        shares[m] = share / (share.sum() or 1)
    most = np.inf if goal is None else 1.0
    want = base.sum() if goal is None else goal
    factor, off = np.full(len(cells), want / (base.sum() or 1)), 0.0
    for _ in range(sweeps):
        for m in MARGINS:
            k, n, aim = codes[m], len(shares[m]), want * shares[m]
            all_of = np.bincount(k, base * factor, n)
            by = np.divide(aim, all_of, out=np.zeros(n), where=all_of > 0)
            for _ in range(50 if goal is not None else 0):
                full = by[k] * factor >= most
                room, free = aim - np.bincount(k, base * full, n), np.bincount(k, base * factor * ~full, n)
                new = np.where((free > 0) & (room > 0), np.divide(room, free, out=by.copy(), where=free > 0), by)
                if np.allclose(new, by, rtol=1e-12, atol=0):
                    break
                by = np.maximum(new, by)
            factor = factor * by[k]
        off = max((float(np.abs(np.bincount(codes[m], base * np.minimum(factor, most), len(shares[m])) / (want or 1) - shares[m]).max(initial=0)) for m in MARGINS), default=0.0)
        if off < TOLERANCE:
            break
    return factor, off


def _rake_spread(cells: DataFrame, targets: dict[str, DataFrame], goal: float | None = None, sweeps: int = SWEEPS, inner: int = 4) -> tuple[DataFrame, float]:
    """The same as joins, for cell tables beyond the driver's bound; only sums reach the driver, and lineage is cut after each sweep."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    want = total if goal is None else goal
    goals = {}
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("tokens").alias("have")).filter("have > 0").join(targets[m], m, "left").fillna(0.0, ["share"])
        have = written(have.select(m, "share"), "rake")
        shares = have.agg(F.sum("share")).first()[0]
        if not total or not shares:
            return cells.withColumn("factor", F.lit(0.0)), 0.0
        goals[m] = have.select(m, (F.col("share") / shares * want).alias("aim"))
    now, off = cells.withColumn("factor", F.lit(want / total)), 0.0
    last: list[str] = []
    for _ in range(sweeps):
        with made() as paths:
            for m in MARGINS:
                q = F.col("factor") * F.coalesce("by", F.lit(0.0))
                start = now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have")).filter("have > 0")
                by = start.join(goals[m], m).select(m, "aim", (F.col("aim") / F.col("have")).alias("by"))
                for _ in range(inner if goal is not None else 0):
                    each = now.join(by, m).groupBy(m, "aim", "by").agg(F.sum(F.when(q >= 1, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(q < 1, F.col("tokens") * F.col("factor")).otherwise(0.0)).alias("free"))
                    room = F.col("aim") - F.col("full")
                    by = written(each.select(m, "aim", F.when((F.col("free") > 0) & (room > 0), F.greatest("by", room / F.col("free"))).otherwise(F.col("by")).alias("by")), "rake")
                now = now.join(by.select(m, "by"), m, "left").withColumn("factor", q).drop("by")
            now = written(now, "rake")
        stays = F.col("tokens") * (F.least("factor", F.lit(1.0)) if goal is not None else F.col("factor"))
        off = max(now.groupBy(m).agg(F.sum(stays).alias("have")).join(goals[m], m).agg(F.max(F.abs(F.col("have") - F.col("aim")))).first()[0] for m in MARGINS) / want
        drop_tables(cells.sparkSession, [*last, *paths[:-1]])
        last = paths[-1:]
        if off < TOLERANCE:
            break
    return now, off


def calibrate(df: DataFrame, keep_tokens: float = 0.8, power: float = POWER, targets: dict[str, DataFrame] | None = None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """The cells: (source, lang, topic, docs, tokens, factor, probability, residual).

    df has MARGINS (no nulls) and ``n_tokens``. ``factor`` is the raked weight, without bounds. ``probability``, to keep a
    document, is raked with its bound of 1, so that ``keep_tokens`` of all tokens are expected to stay. A category that has
    fewer tokens than its share asks for gives all it has, and the others share the rest in their proportions: no small
    category makes the whole sample small. Where categories of different margins stand in each other's way, the total is
    lowered, by tenths and three times at most, until the worst share is off by at most ``NEAR``. ``residual`` is its distance
    from what can be had; ``achieved`` shows all shares.
    """
    cells = written(df.groupBy(*MARGINS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "cells")
    goals = {m: tempered(cells, m, power) for m in MARGINS} | (targets or {})
    spark = df.sparkSession
    schema = StructType([*cells.schema, *(StructField(c, DoubleType()) for c in ("factor", "probability", "residual"))])
    n = cells.count()
    if not n:
        return spark.createDataFrame([], schema)
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    tries = [keep_tokens * total * 0.9**k for k in range(4)] if total else []
    if n <= local_cells:
        local, near = cells.toPandas().sort_values(list(MARGINS), ignore_index=True), {m: g.toPandas() for m, g in goals.items()}
        local["factor"], _ = _rake_local(local, near)

        def bounded(goal: float) -> tuple[np.ndarray, float]:
            can = {}
            for m, g in near.items():
                each = g.merge(local.groupby(m, as_index=False)["tokens"].sum(), on=m)
                can[m] = each[[m]].assign(share=_filled(each["tokens"].to_numpy(float), each["share"].to_numpy(float), goal))
            return _rake_local(local, can, min([goal, *(c["share"].sum() for c in can.values())]))

        best = (np.zeros(n), 0.0)
        for k, goal in enumerate(tries):
            some = bounded(goal)
            best = some if not k or some[1] < best[1] else best
            if best[1] <= NEAR:
                break
        local["probability"], local["residual"] = np.minimum(best[0], 1.0), best[1]
        return spark.createDataFrame(local, schema)
    raked, _ = _rake_spread(cells, goals)
    best = None
    for goal in tries:
        can = attainable(cells, goals, goal)
        least = min([goal, *(float(c.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0]) for c in can.values())])
        some = _rake_spread(cells, can, least)
        best = some if best is None or some[1] < best[1] else best
        if best[1] <= NEAR:
            break
    some, off = best or (raked.withColumn("factor", F.lit(0.0)), 0.0)
    out = raked.join(some.select(*MARGINS, F.least("factor", F.lit(1.0)).alias("probability")), list(MARGINS))
    return written(out.withColumn("residual", F.lit(float(off))).select(*schema.names), "raked")


def achieved(cells: DataFrame, power: float = POWER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(margin, category, target, expected): the shares aimed at, and those of the tokens that are expected to stay."""
    out = None
    for m in MARGINS:
        goal = (targets or {}).get(m, None)
        each = cells.groupBy(m).agg(F.sum(F.col("tokens") * F.col("probability")).alias("stay"), F.sum("tokens").alias("tokens")).join(tempered(cells, m, power) if goal is None else goal, m, "left").fillna(0.0, ["share"])
        sums = each.agg(F.sum("stay").alias("stays"), F.sum("share").alias("shares"))
        one = each.crossJoin(F.broadcast(sums)).select(F.lit(m).alias("margin"), F.col(m).alias("category"), (F.col("share") / F.col("shares")).alias("target"), (F.col("stay") / F.col("stays")).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def with_cells(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """(id, source, lang, topic, n_tokens, draw); the topic is derived from the text where no column has it."""
    cells = _cell_columns(text_col, source_col, lang_col, topic_col)
    return df.select(F.col(id_col).alias("id"), *(c.alias(m) for m, c in zip(MARGINS, cells, strict=True)), n_tokens(F.col(text_col)).alias("n_tokens"), draw(F.col(id_col), F.col(text_col)).alias("draw"))


def draw(*key: Column, seed: int = 17) -> Column:
    """A number in [0, 1) from the first of ``key`` that isn't null."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(*(k.cast("string") for k in key)), F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(df: DataFrame, keep_tokens: float = 0.8, power: float = POWER, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", **cols) -> DataFrame:
    """Every document with its cell, weight and probability, and whether the sample has it: (id, source, lang, topic, n_tokens, weight, probability, kept)."""
    each = written(with_cells(df, id_col, **cols), "mix")
    # The cells are written, so that they are counted before they are broadcast.
    cells = small(written(calibrate(each, keep_tokens, power, targets), "calibrated"))
    joined = each.join(cells.select(*MARGINS, F.col("factor").alias("weight"), "probability"), list(MARGINS), "left")
    joined = joined.withColumn("kept", F.coalesce(F.col("draw") < F.col("probability"), F.lit(False)))
    shown = [F.when(F.col(m) == NONE, None).otherwise(F.col(m)).alias(m) for m in MARGINS]
    return joined.select(F.col("id").alias(id_col), *shown, "n_tokens", "weight", "probability", "kept")


def sample(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled documents, with all columns of ``df``."""
    text, source, lang, topic_col = (options.pop(k, d) for k, d in (("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"), ("topic_col", None)))
    # The rows are written with their cells: a row is one column, so that no name clashes, and its topic is found once.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    each = [c.alias(m) for m, c in zip(MARGINS, _cell_columns(text, source, lang, topic_col), strict=True)]
    rows = written(df.select(row, *each, n_tokens(F.col(text)).alias("n_tokens"), draw(F.col(id_col), F.col(text)).alias("draw")), "mix")
    cells = small(written(calibrate(rows.drop("row"), **options), "calibrated"))
    joined = rows.select("row", *MARGINS, "draw").join(cells.select(*MARGINS, "probability"), list(MARGINS), "left")
    return joined.filter(F.col("draw") < F.col("probability")).select("row.*")


def _cell_columns(text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> list[Column]:
    t = F.col(text_col)
    return [
        F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)),
        F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE)) if topic_col else topic(t),
    ]
