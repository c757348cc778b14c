"""Quality rules by robust multivariate outliers, in DataFrame operations only.

A document's statistics (words, symbols, capitals, repeats) become a vector of transformed shares. For each language and
source the minimum-covariance-determinant estimate of centre and scatter is found by concentration steps: the ``CORE``
share of rows with the smallest distances gives the next mean and covariance. Of two starts that with the smaller
determinant after ``TRIAL`` steps goes on. A document goes when its squared Mahalanobis distance is beyond a chi-squared quantile, or when it fails the base rules.

Moments are partial aggregates, and quantiles are read from counts by fixed bins, so a hot source costs a task one row for
each bin at most in the shuffle. Distances come
from a Cholesky factor written out as column expressions.

Defined results: a null or empty text has no words, fails the base rules and isn't kept. Rows that fail the base rules
take no part in the estimates. Null languages and sources are groups of their own. Groups below ``SMALL`` rows are judged
by their language's rows from all such groups, and if these are few as well, by those of all such languages; the column
``pooled`` tells. Repeated
rows count as often as they occur. ``FLOOR`` bounds each statistic's spread from below, so ties, one row or a constant
column give no singular matrix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, small, tidy, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
CORE, STEPS, TRIAL, SMALL = 0.75, 4, 2, 200
#: Bins for one of a statistic, and for a doubling of a squared distance, in which quantiles are found.
BINS, D2_BINS = 2000, 256
#: Tables of at most so many groups are broadcast.
MANY = 100_000
QUANTILE, REWEIGHT = 0.99999, 0.975
SYMBOLS = "#*$%&|<>"
#: Transformed statistics and the least standard deviation that each is given.
FLOOR = {"x_length": 0.1, "x_symbols": 0.05, "x_capitals": 0.08, "x_marks": 0.08, "x_repeats": 0.15, "x_variety": 0.03}
DIMS = list(FLOOR)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return F.coalesce(F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != ""), F.array().cast("array<string>"))


def _shifted(h: Column, by: int) -> Column:
    """Hashes of h[i] and h[i + by], as far as both exist."""
    n = F.size(h) - by
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in the windows whose hash is found twice or more."""

    def at_twins(s: Column) -> Column:
        # Outside the array get() is null, and filter() drops nulls.
        twins = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twins, lambda x: x["i"]))

    places = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), at_twins)
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])


def _repeats(hashes: Column) -> Column:
    """Words in WINDOW-word windows found twice or more in the text, the first ones included."""
    zero = F.lit(0).cast("long")
    pairs = lambda h1: let(_shifted(h1, 1), lambda h2: let(_shifted(h2, 2), lambda h4: let(_shifted(h4, 4), look)))
    look = lambda h8: F.when(F.size(F.array_distinct(h8)) == F.size(h8), zero).otherwise(_covered(h8))
    return F.when(F.size(hashes) < WINDOW, zero).otherwise(pairs(hashes))


def statistics(text: Column) -> Column:
    """A struct of counts, each computed once from the whole text."""
    blank = F.coalesce(text, F.lit(""))
    none = F.translate(blank, SPACES, "")
    lines = F.filter(F.split(blank, "\n"), lambda x: F.translate(x, SPACES, "") != "")

    def body(hashes: Column) -> Column:
        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            F.length(none).cast("long").alias("word_chars"),
            (F.length(blank) - F.length(F.translate(blank, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeats(hashes).alias("n_repeat_words"),
            F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"),
            (F.length(blank) - F.length(F.regexp_replace(blank, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
            (F.length(none) - F.length(F.regexp_replace(none, r"[^\p{L}\p{N}]+", ""))).cast("long").alias("n_marks"),
        )

    return let(F.transform(text_words(text), lambda w: F.xxhash64(w)), body)


def with_statistics(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row, q): a struct of ``keep`` (default: all columns), so that no column's name clashes with another; and a struct of
    counts, base verdict, group names and the transformed vector."""
    none = "\x00none"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(none))
    row = F.struct(*(F.col(f"`{c}`") for c in (df.columns if keep is None else keep)))
    named = df.select(row.alias("row"), name(lang_col).alias("lang"), name(source_col).alias("source"), statistics(F.col(text_col)).alias("s"))
    n, chars = F.col("s.n_words"), F.greatest(F.col("s.word_chars"), F.lit(1))
    words = F.greatest(n, F.lit(1))
    failed = (n < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    vector = [
        F.log(chars / words),
        F.sqrt(F.col("s.n_symbols") / chars),
        F.sqrt(F.col("s.n_capitals") / chars),
        F.sqrt(F.col("s.n_marks") / chars),
        F.sqrt(F.col("s.n_repeat_words") / words),
        F.when(words < 2, 1.0).otherwise(F.log(F.greatest(F.col("s.n_distinct"), F.lit(1)).cast("double")) / F.log(words.cast("double"))),
    ]
    q = F.struct("s.*", failed.alias("base_failed"), "lang", "source", *(v.alias(d) for v, d in zip(vector, DIMS, strict=True)))
    return named.select("row", q.alias("q"))


def chi2_cdf(x: float, k: int) -> float:
    """The regularized lower incomplete gamma function at (k / 2, x / 2), as its power series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    i = 1
    while term > total * 1e-16:
        term *= z / (a + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _moments(rows: DataFrame, inflate: float) -> DataFrame:
    """Mean and scatter of each group's rows, scatter times ``inflate`` and its diagonal at least FLOOR squared."""
    aggs = [F.avg(d).alias(f"m_{d}") for d in DIMS] + [F.covar_pop(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    out = rows.groupBy("grp").agg(*aggs)
    wide = [(F.col(f"c_{a}_{b}") * inflate + (FLOOR[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return out.select("grp", *(f"m_{d}" for d in DIMS), *wide)


def _factored(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor (l_i_j) of each group; a column at a time (its diagonal, then all below), on one row for each group."""
    out = moments
    for j, b in enumerate(DIMS):
        for part in (DIMS[j : j + 1], DIMS[j + 1 :]):
            new = {}
            for a in part:
                i = DIMS.index(a)
                rest = F.col(f"c_{a}_{b}")
                for k in range(j):
                    rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
                new[f"l_{i}_{j}"] = F.sqrt(F.greatest(rest, F.lit(FLOOR[a] ** 2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}")
            out = out.withColumns(new) if new else out
    return out.select("grp", *(f"m_{d}" for d in DIMS), *(f"l_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1)))


def _d2(out: DataFrame) -> DataFrame:
    """Rows with their group's centre and factor, plus d2, the squared Mahalanobis distance, by forward substitution."""
    for i, d in enumerate(DIMS):
        rest = F.col(d) - F.col(f"m_{d}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"_z{k}")
        out = out.withColumn(f"_z{i}", rest / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"_z{i}") ** 2 for i in range(1, len(DIMS))), F.col("_z0") ** 2))


def _distances(rows: DataFrame, factored: DataFrame) -> DataFrame:
    return _d2(rows.join(factored, "grp", "left")).select(*rows.columns, "d2")


def _grouped(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, grp), and the vectors of rows that pass the base rules with their group."""
    sizes = q.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    every = q.groupBy("lang", "source").agg(F.lit(1).alias("_")).join(sizes, ["lang", "source"], "left").fillna(0, ["n"])
    few = every.filter(F.col("n") < SMALL).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    own = F.concat(F.lit("s:"), F.length("lang").cast("string"), F.lit(":"), "lang", "source")
    grp = F.when(F.col("n") >= SMALL, own).when(F.col("n_lang") >= SMALL, F.concat(F.lit("l:"), "lang")).otherwise("all")
    names = small(written(every.join(few, "lang", "left").select("lang", "source", grp.alias("grp")), "groups"))
    rows = q.filter(~F.col("base_failed")).join(names, ["lang", "source"]).select("grp", *DIMS)
    return names, rows


def _quantiles(binned: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, one column b<i> for each share): the bins in which the shares of each key's rows end.

    Rows are summed by key and bin on the map side, so a hot group costs a task as many rows as it has bins, and only a
    group's bins, whose number is bounded, meet in one place.
    """
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")))
    total = F.max("upto").over(Window.partitionBy(*keys))
    ends = upto.withColumn("total", total)
    return ends.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("total") * a)), F.col("bin"))).alias(f"b{i}") for i, a in enumerate(shares)))


def _d2_bin(d2: Column) -> Column:
    """Bins of 0.27 % width."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * D2_BINS).cast("int")


def _first(rows: DataFrame) -> DataFrame:
    """The first start: medians, and quartiles as spreads."""
    bins = F.array(*(F.floor(F.col(d) * BINS).cast("int") for d in DIMS))
    found = _quantiles(rows.select("grp", F.posexplode(bins).alias("dim", "bin")), ["grp", "dim"], [0.25, 0.5, 0.75])
    at = lambda c: (F.col(c) + 0.5) / BINS
    each = found.groupBy("grp").agg(*(F.max(F.when(F.col("dim") == i, at(f"b{k}"))).alias(f"_{i}_{k}") for i in range(len(DIMS)) for k in range(3)))
    spread = lambda i, d: F.greatest((F.col(f"_{i}_2") - F.col(f"_{i}_0")) / 1.349, F.lit(FLOOR[d]))
    factor = [(spread(i, d) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, d in enumerate(DIMS) for j in range(i + 1)]
    return each.select("grp", *(F.col(f"_{i}_1").alias(f"m_{d}") for i, d in enumerate(DIMS)), *factor)


def estimate(q: DataFrame, core: float = CORE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Group names, and each group's reweighted MCD centre and Cholesky factor.

    Two starts (medians and quartiles; mean and covariance of all rows) make ``TRIAL`` concentration steps side by side; the
    one with the smaller determinant goes on to ``steps`` in all.
    """
    names, rows = _grouped(q)
    # There are no more groups than rows of names, whose number is looked at once.
    hint = F.broadcast if names.limit(MANY + 1).count() <= MANY else (lambda table: table)
    p = len(DIMS)
    consistent = core / chi2_cdf(chi2_quantile(core, p), p + 2)

    def step(some: DataFrame, now: DataFrame) -> DataFrame:
        near = _distances(some, hint(now)).withColumn("bin", _d2_bin(F.col("d2")))
        cut = hint(_quantiles(near, ["grp"], [core]))
        out = written(_factored(_moments(near.join(cut, "grp").filter(F.col("bin") <= F.col("b0")), consistent)), "mcd")
        tidy(q.sparkSession)  # the plans of all steps together are more than the driver's heap should hold
        return out

    both = _factored(_moments(rows, 1.0))
    named = lambda df, k: df.withColumn("grp", F.concat("grp", F.lit(f":{k}")))
    now = written(named(_first(rows), 0).unionByName(named(both, 1)), "mcd")
    twice = rows.withColumn("grp", F.explode(F.array(F.concat("grp", F.lit(":0")), F.concat("grp", F.lit(":1")))))
    for _ in range(TRIAL):
        now = step(twice, now)
    # The logarithm of the determinant; of equal ones the first start goes on.
    size = F.round(sum((F.log(f"l_{i}_{i}") for i in range(1, p)), F.log("l_0_0")), 9)
    base = F.expr("substring(grp, 1, length(grp) - 2)")
    best = now.groupBy(base.alias("base")).agg(F.min(F.struct(size.alias("size"), "grp")).alias("best"))
    now = written(now.join(best.select(F.col("best.grp").alias("grp")), "grp", "left_semi").withColumn("grp", base), "mcd")
    for _ in range(steps - TRIAL):
        now = step(rows, now)
    inner = _distances(rows, hint(now)).filter(F.col("d2") <= chi2_quantile(REWEIGHT, p))
    again = REWEIGHT / chi2_cdf(chi2_quantile(REWEIGHT, p), p + 2)
    final = _factored(_moments(inner, again))
    # A group whose rows all lie beyond the quantile keeps its last concentration step.
    spare = now.join(final.select("grp"), "grp", "left_anti")
    return names, written(final.unionByName(spare), "mcd")


def judged(table: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(row, q, distance, pooled, kept) from ``with_statistics``, best read from storage: it is read several times.

    ``pooled`` says by whose rows a document was judged: ``source`` (its language and source), ``lang`` or ``all``.
    """
    tidy(table.sparkSession)
    names, now = estimate(table.select("q.*"))
    tidy(table.sparkSession)
    groups = small(written(names.join(now, "grp", "left"), "groups"))
    vectors = table.select("row", "q", F.col("q.lang").alias("lang"), F.col("q.source").alias("source"), *(F.col(f"q.{d}").alias(d) for d in DIMS))
    out = vectors.join(groups, ["lang", "source"], "left")
    d2 = _d2(out)
    kept = ~F.col("q.base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(quantile, len(DIMS)), F.lit(False))
    pooled = F.when(F.col("grp").startswith("s:"), "source").when(F.col("grp").startswith("l:"), "lang").otherwise("all")
    return d2.select("row", "q", F.sqrt("d2").alias("distance"), pooled.alias("pooled"), kept.alias("kept"))


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = QUANTILE) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, pooled) of every document."""
    table = written(with_statistics(df, text_col, lang_col, source_col, [id_col]), "statistics")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(table, quantile).select("row.*", *(F.col(f"q.{c}").alias(c) for c in counts), "kept", "distance", "pooled")


def keep_good(df: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of ``df``; texts and statistics are written once, not shuffled."""
    cols = {k: options.pop(k) for k in ("text_col", "lang_col", "source_col") if k in options}
    return judged(written(with_statistics(df, **cols), "statistics"), **options).filter("kept").select("row.*")
