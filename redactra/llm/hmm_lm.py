"""LM scoring by a hidden Markov model, trained by Baum-Welch with counts aggregated across partitions.

Tokens are the words of a text and one end. The model emits symbols: a token has a symbol of its own if at least one
training token in ``SYMBOLS`` is it, and else the symbol of its bucket (a hash of its beginning and end); within a bucket a word has the
probability (c + 1) / (C + W + 1), where C tokens of W words were counted there and the last 1 is for words never seen.
So each word has a probability however large the vocabulary, which stays distributed, while states x symbols is bounded.

* Counting: one pass, a partial count for each task, summed by word.
* Starting point: a mixture of unigrams fitted to ``START_ROWS`` training rows drawn without regard to text or length; of one
  with more than ``START_TOKENS`` tokens so many, evenly spread, are looked at. It only starts the search.
* Baum-Welch: each pass runs the scaled forward-backward recursion over all training documents on the executors and sums
  expected starts, transitions and emissions across partitions; the driver gets states x symbols numbers. Documents
  above ``SEGMENT`` tokens keep their states at borders alone, to bound memory, and are as exact.
* Scoring: the scaled forward recursion over each whole document gives its exact log10 probability.

Words too rare for the broadcast table (less than one training token in ``HEAD``) are looked up by a join, so no table
that grows with the vocabulary reaches the driver or every executor. No such word can be hot in the training rows; one
that is hot elsewhere is a skewed join key that adaptive execution splits.

Defined results: a null or empty text is the end alone. Rows with a null id are training rows. Repeated rows count and are
scored as often as they occur. Without training rows N and V are 0: the base score is 0 and all symbols are alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, slices, words, written

END = b"\n"  # no word: it is white space
STATES, ROUNDS = 6, 3
SYMBOLS, BUCKETS, HEAD = 16_384, 4_096, 131_072
SEGMENT, BLOCK = 65_536, 400_000
START_ROWS, START_TOKENS, START_ROUNDS = 2_000, 4_096, 25


@dataclass(frozen=True)
class Coder:
    """What the executors need to turn a text into symbols; bounded by HEAD and BUCKETS."""

    place: dict[bytes, int]  # frequent token -> place in the next two
    symbol: np.ndarray  # by place, then by bucket
    log_count: np.ndarray  # log10(c + 1) by place; 0 for buckets
    log_norm: np.ndarray  # log10(C + W + 1) by symbol; 0 for symbols of one token
    own: int
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return self.own + BUCKETS


def bucket(word: bytes) -> int:
    """By the first two and last three bytes: words of one language and ending tend to fall together."""
    return zlib.crc32(word[:2] + word[-3:]) % BUCKETS


def bucket_column(word: Column) -> Column:
    return F.crc32(F.concat(F.substring(word, 1, 2), F.substring(word, -3, 3))) % BUCKETS


class _Places(dict):
    """word -> place; the bucket's place for words that aren't frequent, which it also lists."""

    def __init__(self, coder: Coder):
        super().__init__(coder.place)
        self.n, self.rare = len(coder.place), []

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return self.n + bucket(word)


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K): P(symbol | state)


def count_words(df: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """(word binary, c long) over all rows of ``df``; END counts each row."""

    def run(batches):
        got: Counter = Counter()

        def out():
            keys = list(got)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([got[k] for k in keys], pa.int64())], names=["word", "c"])
            got.clear()

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                got.update(words(text))
                got[END] += 1
                if len(got) >= most:
                    yield from out()
        yield from out()

    return df.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def make_coder(counts: DataFrame) -> Coder:
    """counts: a written (word, c) table."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most HEAD words have c * HEAD >= total: a proven bound for what is collected and broadcast.
    head = counts.filter((F.col("c") * HEAD >= total) | (F.col("word") == F.lit(bytearray(END)))).orderBy(F.desc("c"), "word").toPandas()
    first = (head["c"] * SYMBOLS >= total) | (head["word"].map(bytes) == END)
    own = int(first.sum())
    head = pd.concat([head[first], head[~first]], ignore_index=True)
    rest = counts.filter((F.col("c") * SYMBOLS < total) & (F.col("word") != F.lit(bytearray(END))))
    mass = np.ones(BUCKETS)
    for b, c, w in rest.groupBy(bucket_column(F.col("word")).alias("b")).agg(F.sum("c"), F.count("*")).collect():
        mass[b] += c + w
    names = [bytes(w) for w in head["word"]]
    symbol = np.concatenate([np.arange(own), [own + bucket(w) for w in names[own:]], own + np.arange(BUCKETS)]).astype(np.int64)
    log_count = np.concatenate([np.log10(head["c"].to_numpy(float) + 1), np.zeros(BUCKETS)])
    return Coder({w: i for i, w in enumerate(names)}, symbol, log_count, np.concatenate([np.zeros(own), np.log10(mass)]), own, int(total), int(distinct))


def encode(df: DataFrame, coder: Coder, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Symbols of each text (two bytes each), what frequent words add to the scores, and its rare words with counts."""
    shared = df.sparkSession.sparkContext.broadcast(coder)
    own = df.select(id_col, held_out.alias("held_out"), text_col)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "known", "base", "inner", "symbols", "rare", "times"]

    def run(batches):
        c = shared.value
        places = _Places(c)
        unit = np.log10(c.total + c.distinct + 1)
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(2).to_pylist():
                tokens = words(text)
                tokens.append(END)
                at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                rare, places.rare = places.rare, []
                seen = Counter(rare)
                s, g = c.symbol[at], c.log_count[at]
                inner = g[s >= c.own].sum() - c.log_norm[s].sum()
                for col, v in zip(cols, (len(tokens), len(tokens) - len(rare), g.sum() - len(tokens) * unit, inner, s.astype("<u2").tobytes(), list(seen), list(seen.values())), strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=names)

    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, known long, base double, inner double, symbols binary, rare array<binary>, times array<long>")


def _blocks(seqs: list[np.ndarray], most: int):
    """Sequences by falling length, in blocks of about ``most`` tokens: (places in seqs, lengths, symbols one after the other)."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    block, n = [], 0
    for i in order:
        block.append(i)
        n += len(seqs[i])
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def _by_step(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by step over sequences of falling length; how many sequences each step has, and where it begins."""
    lengths = np.array([len(s) for s in seqs])
    flat = np.concatenate(seqs).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    step = np.arange(len(flat)) - np.repeat(starts, lengths)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    offset = np.cumsum(active) - active
    out = np.empty(len(flat), np.int64)
    out[offset[step] + np.repeat(np.arange(len(seqs)), lengths)] = flat
    return out, active, offset


def forward(seqs: list[np.ndarray], model: Hmm, most: int = BLOCK) -> np.ndarray:
    """log10 P(sequence) of each, by the scaled forward recursion; all of a block's sequences step together."""
    result = np.zeros(len(seqs))
    for block in _blocks(seqs, most):
        by_step, active, offset = _by_step([seqs[i] for i in block])
        ll = np.zeros(len(block))
        a = np.empty((len(block), len(model.start)))
        for t, (m, o) in enumerate(zip(active.tolist(), offset.tolist(), strict=True)):
            e = model.emit[by_step[o : o + m]]
            a = (a[:m] @ model.move if t else model.start) * e
            c = a.sum(axis=1)
            a /= c[:, None]
            ll[:m] += np.log10(c)
        result[block] = ll
    return result


@dataclass
class Expected:
    """Sums over sequences of what Baum-Welch counts."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log10: float = 0.0

    @classmethod
    def zero(cls, k: int, symbols: int) -> Expected:
        return cls(np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)))


def expect(seqs: list[np.ndarray], model: Hmm, into: Expected, most: int = BLOCK, segment: int = SEGMENT) -> None:
    """Adds the expected counts of the sequences; those above ``segment`` tokens by checkpoints, which is as exact and bounds memory."""
    for s in seqs:
        if len(s) > segment:
            _expect_long(s, model, into, segment)
    seqs = [s for s in seqs if len(s) <= segment]
    k = len(model.start)
    for block in _blocks(seqs, most):
        by_step, active, offset = _by_step([seqs[i] for i in block])
        alpha = np.empty((len(by_step), k))
        scale = np.empty(len(by_step))
        a = model.start[None, :]
        for t, (m, o) in enumerate(zip(active.tolist(), offset.tolist(), strict=True)):
            a = (a[:m] @ model.move if t else model.start) * model.emit[by_step[o : o + m]]
            c = a.sum(axis=1)
            a /= c[:, None]
            alpha[o : o + m], scale[o : o + m] = a, c
        into.log10 += float(np.log10(scale).sum())
        beta = np.ones((int(active[-1]), k))
        for t in range(len(active) - 1, 0, -1):
            m, o = int(active[t]), int(offset[t])
            p = int(offset[t - 1])
            ahead = model.emit[by_step[o : o + m]] * beta / scale[o : o + m, None]
            into.move += model.move * (alpha[p : p + m].T @ ahead)
            alpha[o : o + m] *= beta
            beta = np.ones((int(active[t - 1]), k))  # sequences that end at the step before
            beta[:m] = ahead @ model.move.T
        alpha[: len(beta)] *= beta
        into.start += alpha[: int(active[0])].sum(axis=0)
        for j in range(k):
            into.emit[:, j] += np.bincount(by_step, alpha[:, j], into.emit.shape[0])


def _expect_long(s: np.ndarray, model: Hmm, into: Expected, segment: int) -> None:
    """One sequence: the forward pass keeps its state at segments' borders alone; the segments are then taken from the last
    one back, each with its forward states computed again from its border, and the backward state is carried over."""

    def states(part: np.ndarray, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        out, scale = np.empty((len(part), len(model.start))), np.empty(len(part))
        for t, e in enumerate(model.emit[part.astype(np.int64)]):
            a = (model.start if a is None else a @ model.move) * e
            scale[t] = a.sum()
            out[t] = a = a / scale[t]
        return out, scale

    parts = [s[i : i + segment] for i in range(0, len(s), segment)]
    border: list[np.ndarray | None] = [None]
    for part in parts[:-1]:
        border.append(states(part, border[-1])[0][-1])
    ahead = None  # emission, backward state and scale of the token after
    for part, a in zip(reversed(parts), reversed(border), strict=True):
        alpha, scale = states(part, a)
        into.log10 += float(np.log10(scale).sum())
        emit = model.emit[part.astype(np.int64)]
        for t in range(len(part) - 1, -1, -1):
            if ahead is None:
                beta = np.ones(len(model.start))
            else:
                into.move += model.move * np.outer(alpha[t], ahead)
                beta = model.move @ ahead
            ahead = emit[t] * beta / scale[t]
            alpha[t] *= beta
        for j in range(alpha.shape[1]):
            into.emit[:, j] += np.bincount(part.astype(np.int64), alpha[:, j], into.emit.shape[0])
    into.start += alpha[0]


def maximize(e: Expected, unigram: np.ndarray, weight: float = 200.0) -> Hmm:
    """The next model; emissions lean on the unigram by ``weight`` tokens, so every symbol keeps a probability."""
    emit = e.emit + weight * unigram[:, None]
    return Hmm((e.start + 1) / (e.start.sum() + len(e.start)), (e.move + 1) / (e.move.sum(axis=1, keepdims=True) + len(e.start)), emit / emit.sum(axis=0))


def starting(seqs: list[np.ndarray], unigram: np.ndarray, k: int = STATES, rounds: int = START_ROUNDS) -> Hmm:
    """A mixture of unigrams over whole documents."""
    size = len(unigram)
    flat = lambda w: (w + 50 * unigram[:, None]) / (w + 50 * unigram[:, None]).sum(axis=0)
    if not seqs:
        return Hmm(np.full(k, 1 / k), np.full((k, k), 1 / k), np.repeat(unigram[:, None], k, 1))
    symbols = np.concatenate(seqs).astype(np.int64)
    doc = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    # Each seed is the candidate that adds most to the log probability of all documents: large groups come first.
    rng = np.random.default_rng(7)
    gain = lambda d: np.bincount(doc, (np.log(flat(np.bincount(seqs[d], minlength=size)[:, None].astype(float))[:, 0]) - np.log(unigram))[symbols], len(seqs))
    best, seeds = np.zeros(len(seqs)), []
    while len(seeds) < k:
        tried = [(np.maximum(best, g := gain(d)).sum(), int(d), g) for d in rng.choice(len(seqs), min(24, len(seqs)), replace=False)]
        _, d, g = max(tried, key=lambda x: x[:2])
        seeds.append(d)
        best = np.maximum(best, g)
    emit = flat(np.stack([np.bincount(seqs[s], minlength=size) for s in seeds], 1).astype(float))
    share = np.full(k, 1 / k)
    for _ in range(rounds):
        z = np.stack([np.bincount(doc, np.log(emit[:, j])[symbols], len(seqs)) for j in range(k)], 1) + np.log(share)
        r = np.exp(z - z.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        share = (r.sum(axis=0) + 1) / (len(seqs) + k)
        emit = flat(np.stack([np.bincount(symbols, r[doc, j], size) for j in range(k)], 1))
    stay = 0.9
    return Hmm(share, stay * np.eye(k) + (1 - stay) * share[None, :], emit)


def train(encoded: DataFrame, coder: Coder, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """``encoded``: a written table of ``encode``; its rows that aren't held out are the training rows."""
    sc = encoded.sparkSession.sparkContext
    own = encoded.filter(~F.col("held_out"))
    cols = [f"k{j}" for j in range(states)]
    size = coder.size
    # The bucket counts hold their unseen word's 1, frequent symbols their count.
    unigram = np.zeros(size)
    unigram[: coder.own] = 10 ** coder.log_count[: coder.own]
    unigram[coder.own :] = 10 ** coder.log_norm[coder.own :]
    unigram /= unigram.sum()

    def thin(batches):
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]
            some = [s if len(s) <= START_TOKENS else s[np.linspace(0, len(s) - 1, START_TOKENS).astype(np.int64)] for s in seqs]
            yield pa.record_batch([pa.array([x.tobytes() for x in some], pa.binary())], names=["symbols"])

    few = hash_sample(own.select("row", "symbols"), START_ROWS, "row").select("symbols").mapInArrow(thin, "symbols binary").collect()
    model = starting([np.frombuffer(bytes(x[0]), "<u2") for x in few], unigram, states)
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def run(batches, shared=shared):
            e = Expected.zero(states, size)
            for b in batches:
                expect([np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()], shared.value, e)
            there = np.flatnonzero(e.emit.any(axis=1))
            place = np.concatenate([there, [size], size + 1 + np.arange(states)])
            rows = np.vstack([e.emit[there], e.start[None, :], e.move])
            yield pa.record_batch([pa.array(place, pa.int64()), *(pa.array(rows[:, j]) for j in range(states))], names=["place", *cols])

        sums = own.select("symbols").mapInArrow(run, "place long, " + ", ".join(f"{c} double" for c in cols))
        got = sums.groupBy("place").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()
        full = np.zeros((size + 1 + states, states))
        full[got["place"].to_numpy()] = got[cols].to_numpy()
        model = maximize(Expected(full[size], full[size + 1 :], full[:size]), unigram)
        shared.unpersist()
    return model


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; training rows aren't held out."""
    held = F.coalesce(held_out, F.lit(False))
    counts = written(count_words(df.filter(~held), text_col), "counts")
    coder = make_coder(counts)
    table = written(encode(df, coder, held, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "symbols")
    model = train(table, coder, states, rounds)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["row", id_col, "held_out", "n_tokens", "known", "base", "inner", "model"]

    def run(batches):
        for b in batches:
            lp = forward([np.frombuffer(x, "<u2") for x in b.column(7).to_pylist()], shared.value)
            yield pa.record_batch([*b.columns[:7], pa.array(lp, pa.float64())], names=names)

    scored = table.select(*names[:-1], "symbols").mapInArrow(run, f"row long, `{id_col}` {kind}, held_out boolean, n_tokens long, known long, base double, inner double, model double")
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts.filter(F.col("c") * HEAD < coder.total), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(coder.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + F.col("inner") + more).alias("score"),
    )
