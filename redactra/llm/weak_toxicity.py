"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

* Voters: a fixed lexicon of insults, fixed patterns, and lexicon voters mined from rated training rows (words and word
  beginnings that come far more often in toxic rows; languages differ in them, so they can't all be fixed). A voter says
  toxic, or abstains, which says nothing; one voter says clean where all others are silent. Ratings are no voter: they
  choose the mined voters and measure accuracies, which orient the label.
* Label model: a latent label with a vote distribution of each voter for each label, fitted to the votes by expectation maximisation.
  Voters that go together beyond what the label explains (the correlation of their residuals) would be counted twice, so
  each one's log-likelihood ratio is divided by its correlation mass; the two steps alternate.
* Classifier: logistic regression with an L1 penalty on the presence of words, word beginnings and patterns, fitted to
  the posterior labels. Presence, not frequency: a long clean text doesn't dilute or collect.

The fit takes at most ``max_rows`` rated rows of the training folds (those with the smallest hash of their id, up to a
third of them toxic): a bounded, documented sample. Of their terms at most ``MOST_TERMS`` reach the driver, at most
``MOST_VOTERS`` mined ones vote and at most ``MOST_FEATURES`` are the classifier's. Every document is scored over its whole text.

Defined results: null and empty texts have no features and get the bias' score. Null ratings aren't used; of several
ratings of one document the highest counts. Without ratings of both kinds the fixed lexicon alone makes the labels.
Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import fresh_names, hash_sample, slices, written

MAX_ROWS = 12_000
#: Bounds of the fit, beside its rows: terms looked at, mined voters, the classifier's features; the most telling ones stay.
MOST_TERMS, MOST_VOTERS, MOST_FEATURES = 50_000, 300, 2000
#: Insults that vote toxic: fixed values.
LEXICON = """
    bastard bitch clown cretin despicable dimwit disgusting dumbass filth filthy fool garbage halfwit idiot idiotic
    imbecile jerk loser lowlife maggot moron moronic numbskull parasite pathetic pig retard scum scumbag stupid trash
    twit ugly useless vermin vile worthless
""".split()
#: Patterns that vote toxic: fixed values.
PATTERNS = {
    "threat": r"(?i)\b(kill|hurt|beat|destroy|shoot|hang) (you|yourself|them|him|her)\b",
    "address": r"(?i)\byou(?: are|'re| r)? (?:all |such |an? |so )*(?:idiots?|morons?|losers?|stupid|pathetic|worthless|trash|scum|clowns?|disgusting)\b",
    "masked": r"(?i)\b(?:f[*@#u]+[c*]?k|sh[*!1]t|b[*!1]tch|a[*$]{2}(?:hole)?)\b",
    "hate": r"(?i)\b(?:i|we) (?:hate|despise) (?:you|them|him|her|those)\b",
    "leave": r"(?i)\b(?:shut up|get lost|go to hell|drop dead)\b",
}
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7, 8)


def terms(text: str | None) -> set[str]:
    """Distinct lower-case words of letters."""
    return set(WORD.findall(text.lower())) if text else set()


def parts(word: str) -> Iterable[str]:
    """The word and its beginnings, these marked with ^."""
    yield word
    for n in BEGINNINGS:
        if len(word) > n:
            yield "^" + word[:n]


def term_set(text: str | None) -> set[str]:
    return {p for w in terms(text) for p in parts(w)}


class Patterns:
    """Names, marked with !, of the fixed patterns that a text has; one quick search first, as nearly no text has any."""

    def __init__(self) -> None:
        self.each = {f"!{k}": re.compile(p) for k, p in PATTERNS.items()}
        # Whatever a pattern finds, this finds too; "masked" needs a mask or the word with u alone.
        self.quick = re.compile(r"(?i)\bfu+c?k\b|\byou|\byourself|\bthem\b|\bhim\b|\bher\b|[*@#!$1]|\bthose\b|shut up|get lost|go to hell|drop dead")

    def __call__(self, text: str | None) -> set[str]:
        return {k for k, p in self.each.items() if p.search(text)} if text and self.quick.search(text) else set()


@dataclass(frozen=True)
class LabelModel:
    """P(vote | label) of each voter, the share of toxic rows, and each voter's discount for its correlations.

    The last voter is the silent one: it says clean where no other votes. A voter that abstains gives no evidence, since most
    voters know one language only.
    """

    log_on: np.ndarray  # (2, voters): log P(votes | label)
    prior: float
    discount: np.ndarray
    correlations: np.ndarray = field(repr=False)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior)) + votes @ ((self.log_on[1] - self.log_on[0]) / self.discount)
        return 1 / (1 + np.exp(np.clip(-z, -60, 60)))

    @property
    def accuracies(self) -> np.ndarray:
        """P(a voter is right | it votes); the silent voter is right about clean rows."""
        on = np.exp(self.log_on) * np.array([[1 - self.prior], [self.prior]])
        share = on[1] / on.sum(axis=0)
        share[-1] = 1 - share[-1]
        return share


def with_silent(votes: np.ndarray) -> np.ndarray:
    """The votes and, last, the silent voter's."""
    return np.hstack([votes, ~votes.any(axis=1, keepdims=True)]).astype(votes.dtype)


def measured(votes: np.ndarray, ratings: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """(2, voters): each voter's share of votes among rows rated clean and among rows rated toxic, smoothed."""
    mass = np.array([(1 - ratings).sum(), ratings.sum()], float)
    on = np.vstack([(1 - ratings) @ votes, ratings @ votes]).astype(float)
    return np.clip((on + smooth) / (mass[:, None] + 2 * smooth), 1e-4, 1 - 1e-4)


def fit_label_model(votes: np.ndarray, accuracies: np.ndarray, prior: float, rounds: int = 25, anchor: float = 0.5) -> LabelModel:
    """votes: (rows, voters) of 0 and 1 from ``with_silent``; no rating is among them. The label is found from votes alone, by EM.

    ``accuracies`` (see ``measured``) orient it: they give the first guess, and in each round they count as ``anchor`` times
    the rows, so that the label keeps its meaning. A row's posterior hangs on its votes only. Voters' correlations come from
    what the label leaves over, and each voter's log-likelihood ratio is divided by its correlation mass.
    """
    n, m = votes.shape
    discount, corr, p, share = np.ones(m), np.eye(m), accuracies.astype(float), prior
    for i in range(rounds + 1):
        model = LabelModel(np.log(p), share, discount, corr)
        post = model.posterior(votes)
        if i == rounds:
            return model
        if i % 5 == 0:
            # What the label leaves over: residuals' covariance, label by label, scaled to correlations.
            cov = np.zeros((m, m))
            for k, w in enumerate((1 - post, post)):
                x = (votes - p[k].astype(votes.dtype)) * np.sqrt(w).astype(votes.dtype)[:, None]
                cov += x.T @ x / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr = np.clip(cov / np.outer(sd, sd), -1, 1)
            discount = np.maximum(1.0, (np.clip(corr, 0, 1) ** 2).sum(axis=1))
        mass = np.array([(1 - post).sum(), post.sum()])
        weight = anchor * n * np.array([1 - prior, prior]) + 1
        p = np.vstack([(1 - post) @ votes, post @ votes])
        p = np.clip((p + weight[:, None] * accuracies) / (mass + weight)[:, None], 1e-4, 1 - 1e-4)
        share = float(np.clip((mass[1] + anchor * n * prior) / (n * (1 + anchor)), 1e-3, 1 - 1e-3))


def surprise(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The log-likelihood ratio statistic of a term's counts in toxic and clean rows against equal shares in both."""
    a, b = toxic + clean, n_toxic + n_clean
    cells = ((toxic, n_toxic, a), (clean, n_clean, a), (n_toxic - toxic, n_toxic, b - a), (n_clean - clean, n_clean, b - a))
    return 2 * sum(x * math.log(x * b / (n * m)) for x, n, m in cells if x > 0)


def mine(sets: list[set[str]], toxic: np.ndarray, most: int = MOST_VOTERS, ratio: float = 5.0) -> list[str]:
    """Terms that come at least ``ratio`` times as often in toxic rows, smoothed, and too often for chance among so many terms; the surest first."""
    df = [Counter(), Counter()]
    for s, y in zip(sets, toxic, strict=True):
        df[y].update(s)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    sure = 2 * math.log(max(2, len(df[0].keys() | df[1].keys()))) + 4
    found = []
    for t, a in df[1].items():
        c = df[0].get(t, 0)
        if t[0] != "!" and a * (n0 or 1) >= ratio * (c + 0.5) * (n1 or 1) and (g := surprise(a, c, n1, n0)) >= sure:
            found.append((-g, t))
    return [t for _, t in sorted(found)[:most]]


@dataclass(frozen=True)
class ToxicModel:
    bias: float
    weights: dict[str, float]
    label_model: LabelModel | None = field(default=None, repr=False)
    voters: tuple[str, ...] = field(default=(), repr=False)


def _logistic(sets: list[set[str]], target: np.ndarray, names: list[str], l1: float = 3e-5, rounds: int = 600, share: float = 1 / 3) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression to soft targets by accelerated proximal steps; no penalty on the bias.

    Rows weigh so that the toxic ones have at least ``share`` of all weight. Each coordinate has its own step: sums of the
    widths of the rows that have it bound the Hessian from above.
    """
    at = {t: i for i, t in enumerate(names)}
    hits = [sorted(at[t] for t in s if t in at) for s in sets]
    wide = np.array([len(h) + 1 for h in hits], float)
    rows = np.repeat(np.arange(len(sets)), [len(h) for h in hits])
    cols = np.fromiter((c for h in hits for c in h), np.int64, len(rows))
    n, d = len(sets), len(names)
    weight = 1 + target * max(0.0, share / (1 - share) * (1 - target).sum() / max(target.sum(), 1e-9) - 1)
    weight /= weight.sum()
    bound = np.maximum(np.bincount(cols, (weight * wide)[rows], d) / 4, 1e-9)
    bound_b = (weight * wide).sum() / 4
    mean = float(weight @ target)
    w, b = np.zeros(d), math.log((mean + 1e-3) / (1 - mean + 1e-3))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        z = vb + np.bincount(rows, v[cols], n)
        g = weight * (1 / (1 + np.exp(np.clip(-z, -40, 40))) - target)
        new = v - np.bincount(cols, g[rows], d) / bound
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / bound, 0)
        nb = vb - g.sum() / bound_b
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return b, w


def fit(texts: list[set[str]], toxic: np.ndarray, most_features: int = MOST_FEATURES) -> ToxicModel:
    """texts: term and pattern sets of rated rows; toxic: their ratings, 0 or 1.

    Ratings choose the mined voters, measure accuracies and give the share of toxic rows; the classifier's targets are the
    label model's posteriors, not the ratings.
    """
    both = 0 < toxic.sum() < len(toxic)
    mined = mine(texts, toxic) if both else []
    fixed = [*LEXICON, *(f"!{k}" for k in PATTERNS)]
    voters = [*fixed, *(t for t in mined if t not in set(fixed))]
    if not len(texts) or not both:
        return ToxicModel(-3.0, dict.fromkeys(fixed, 5.0), None, tuple(voters))
    at = {v: i for i, v in enumerate(voters)}
    votes = np.zeros((len(texts), len(voters)), np.float32)
    for i, s in enumerate(texts):
        votes[i, [at[t] for t in s if t in at]] = 1
    votes = with_silent(votes)
    model = fit_label_model(votes, measured(votes, toxic), float(toxic.mean()))
    post = model.posterior(votes)
    # Features that go with the posterior, from presence in three rows on: those that say most about it first, chance excluded.
    df, on = Counter(), Counter()
    for s, p in zip(texts, post, strict=True):
        df.update(s)
        if p > 1e-3:
            for t in s:
                on[t] += p
    base = float(np.clip(post.mean(), 1e-6, 1 - 1e-6))
    gain = {t: (on[t] - c * base) ** 2 / (c * base * (1 - base)) for t, c in df.items() if c >= 3 and on[t] > c * base}
    sure = 2 * math.log(max(2, len(df))) + 4
    names = sorted((t for t in gain if gain[t] >= sure), key=lambda t: (-gain[t], t))[:most_features]
    names = sorted({*names, *(t for t in fixed if t in df)})
    b, w = _logistic(texts, post, names)
    weights = {t: float(x) for t, x in zip(names, w, strict=True) if x}
    # Lexicon words that no rated row has still count, by the least weight that crosses the bias.
    weights |= {t: 2.0 - b for t in fixed if t not in df}
    return ToxicModel(float(b), weights, model, tuple(voters))


def train(df: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """``ratings``: (id, toxic) of training rows only. At most ``max_rows`` rows' term sets reach the driver."""
    rated = ratings.select(id_col, F.col("toxic").cast("int").alias("toxic")).dropna().groupBy(id_col).agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    pick = lambda y, n: hash_sample(rated.filter(F.col("toxic") == y), n, id_col)
    # At most max_rows rows of two numbers: a proven bound.
    some = F.broadcast(pick(1, max_rows // 3).unionByName(pick(0, max_rows - max_rows // 3)))
    joined = written(df.select(id_col, text_col).join(some, id_col).select("toxic", text_col), "rated")
    terms_of = _telling(joined)
    kept = df.sparkSession.sparkContext.broadcast(frozenset(terms_of))

    def run(batches):
        find = Patterns()
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([" ".join(sorted((term_set(t) & kept.value) | find(t))) for t in texts])], names=["toxic", "terms"])

    got = joined.mapInArrow(run, "toxic int, terms string").toPandas().sort_values(["toxic", "terms"], ignore_index=True)
    # Equal terms are one string object, however many rows have them.
    sets, toxic = [set(map(sys.intern, x.split())) for x in got["terms"]], got["toxic"].to_numpy(int)
    del got
    return fit(sets, toxic)


def _telling(rated: DataFrame, least: int = 3, ratio: float = 3.0, most: int = MOST_TERMS) -> list[str]:
    """Terms of the sample that come at least ``ratio`` times as often in toxic rows, and the lexicon: what the fit can use."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def out():
            yield pa.record_batch([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "clean", "toxic"])
            seen.clear()

        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in term_set(text):
                    seen.setdefault(t, [0, 0])[toxic] += 1
                if len(seen) > 300_000:
                    yield from out()
        yield from out()

    n = {r[0]: r[1] for r in rated.groupBy("toxic").count().collect()}
    df = rated.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / max(1, n.get(1, 0))) / ((F.col("clean") + 0.5) / max(1, n.get(0, 0)))
    found = df.filter((F.col("toxic") >= least) & (lift >= ratio)).orderBy(F.desc(F.col("toxic") * F.log(lift)), "term").limit(most).select("term").toPandas()
    return [*LEXICON, *found["term"]]


def scorer(model: ToxicModel, remember: int = 300_000):
    """text -> score in 0..1."""
    weights, seen, find = model.weights, {}, Patterns()

    def active(word: str) -> tuple[str, ...]:
        if (got := seen.get(word)) is None:
            if len(seen) >= remember:
                seen.clear()
            got = seen[word] = tuple(p for p in parts(word) if p in weights)
        return got

    def run(text: str | None) -> float:
        on = {p for w in terms(text) for p in active(w)}
        on |= {p for p in find(text) if p in weights}
        z = model.bias + math.fsum(weights[p] for p in on)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    return run


def score(df: DataFrame, model: ToxicModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id or ``keep`` columns, then score and predicted, under names that the table lacks) of every document."""
    names = fresh_names(keep or [id_col], "score", "predicted")
    slim = ToxicModel(model.bias, model.weights)
    shared = df.sparkSession.sparkContext.broadcast(slim)
    own = df.select(text_col, *(keep or [id_col]))
    schema = StructType([*own.schema.fields[1:], StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])

    def run(batches):
        rate = scorer(shared.value)
        for b in slices(batches):
            s = np.array([rate(t) for t in b.column(0).to_pylist()])
            yield pa.record_batch([*b.columns[1:], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=schema.names)

    return own.mapInArrow(run, schema)


def predicted(df: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score, predicted), learning from the rows of ``labels`` for which ``training`` holds."""
    model = train(df, labels.filter(training), id_col=id_col, text_col=text_col)
    return score(df, model, id_col=id_col, text_col=text_col, **options)


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of ``df``; ``labels``: ratings of the training rows."""
    scored = score(df, train(df, labels, id_col=id_col, text_col=text_col), threshold, id_col, text_col, df.columns)
    return scored.filter(F.col(scored.columns[-1]) == 0).select(*df.columns)
