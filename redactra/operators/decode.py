"""A model's side of detection: windows of tokens, constrained decoding of tags, tags to spans, and what follows.

The forward pass is pluggable (``Scorer``); weights aren't part of this repository. Windows of many documents run in one
batch. Everything after the scores is a pure function and is tested on made-up scores.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S

MAX_LENGTH, STRIDE, FORBIDDEN = 512, 128, -1e4
RAW = "array<struct<start:int,end:int,label:string,score:double,win:int>>"


def window_starts(n: int, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> list[int]:
    """First tokens of the windows over n tokens: bodies of max_length - 2 that overlap by the stride, up to the last token."""
    body = max_length - 2
    step = max(body - stride, 1)
    return list(range(0, max(n - body, 0) + step, step))[: 1 + -(-max(n - body, 0) // step)] if n else []


def windows(tokens: Column, max_length: int = MAX_LENGTH, stride: int = STRIDE) -> Column:
    """An array of (win, start, tokens) over an array of tokens; none for an empty one."""
    body = max_length - 2
    step = max(body - stride, 1)
    more = F.ceil(F.greatest(F.size(tokens) - body, F.lit(0)) / step).cast("int")
    made = F.transform(F.sequence(F.lit(0), more), lambda w: F.struct(w.alias("win"), (w * step).alias("start"), F.slice(tokens, w * step + 1, F.lit(body)).alias("tokens")))
    return F.when(F.size(tokens) > 0, made).otherwise(F.slice(made, F.lit(1), F.lit(0)))


def transitions(tags: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of moves between tags, of first and of last tags: 0 where BIOES allows it, else FORBIDDEN."""
    part = [t.partition("-")[::2] for t in tags]
    opens, goes_on = {"O", "B", "S"}, {"I", "E"}
    move = np.full((len(tags), len(tags)), FORBIDDEN, np.float32)
    for i, (a, label) in enumerate(part):
        for j, (b, other) in enumerate(part):
            if (b in opens) if a in ("O", "E", "S") else (b in goes_on and label == other):
                move[i, j] = 0
    first = np.array([0 if p in opens else FORBIDDEN for p, _ in part], np.float32)
    last = np.array([0 if p in ("O", "E", "S") else FORBIDDEN for p, _ in part], np.float32)
    return move, first, last


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def viterbi(scores: np.ndarray, move: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best path of tag ids; of equal ones the smallest id."""
    n = len(scores)
    best, back = scores[0] + first, np.empty((n, scores.shape[1]), np.int64)
    for t in range(1, n):
        via = best[:, None] + move
        back[t] = via.argmax(axis=0)
        best = via[back[t], np.arange(via.shape[1])] + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = (best + last).argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def tag_spans(tags: list[str], offsets: list[tuple[int, int]], probs: np.ndarray, win: int) -> list[dict]:
    """Spans of a path, with mean probabilities: a tag inside without a beginning opens a span, a change of label closes one.

    Tokens without width count for nothing.
    """
    out: list[dict] = []
    at: list[int] = []  # tokens of the open span

    def close() -> None:
        if at:
            out.append({"start": offsets[at[0]][0], "end": offsets[at[-1]][1], "label": tags[at[0]].partition("-")[2], "score": float(np.mean([probs[i] for i in at])), "win": win})
            at.clear()

    for i, (tag, (s, e)) in enumerate(zip(tags, offsets, strict=True)):
        if e <= s:
            continue
        kind, _, label = tag.partition("-")
        if kind in ("O", "B", "S") or (at and tags[at[0]].partition("-")[2] != label):
            close()
        if kind != "O":
            at.append(i)
        if kind in ("S", "E"):
            close()
    close()
    return out


def own_tags(path: list[str], win: int, n_windows: int, stride: int = STRIDE) -> list[str]:
    """The tags that a window answers for: half the stride at inner ends is left to its neighbour."""
    low = 0 if win == 0 else stride // 2
    high = len(path) if win == n_windows - 1 else len(path) - stride // 2
    return [t if low <= i < high else "O" for i, t in enumerate(path)]


def decoded(logits: np.ndarray, offsets: list[tuple[int, int]], tags: list[str], win: int, n_windows: int, o_bias: float = 0.0, stride: int = STRIDE, rules: tuple | None = None) -> list[dict]:
    """Raw spans of one window from its scores (tokens x tags), special tokens at both ends included."""
    x = logits.astype(np.float32)
    if o_bias:
        x = x.copy()
        x[:, 0] -= o_bias
    lp = log_softmax(x)
    path = viterbi(lp, *(rules or transitions(tags)))
    return tag_spans(own_tags([tags[i] for i in path], win, n_windows, stride), offsets, np.exp(lp[np.arange(len(path)), path]), win)


def finished(text: Column, raw: Column, adjacent: tuple[str, ...] = ("ADDRESS",)) -> Column:
    """Raw spans of all windows as final ones: trimmed, merged over windows, without particles, rounded, neighbours joined."""
    merged = S.drop_particles(text, S.merge_windows(text, S.trimmed(text, raw)))
    plain = F.transform(merged, lambda s: S.span(s["start"], s["end"], s["label"], F.round(s["score"], 4)))
    return S.merge_adjacent(text, plain, adjacent) if adjacent else plain


class Tokenize(Protocol):
    def __call__(self, text: str) -> tuple[list[int], list[tuple[int, int]]]: ...


class Scorer(Protocol):
    """Windows of ids (with special tokens) -> a matrix of scores for each."""

    def __call__(self, windows: list[list[int]]) -> list[np.ndarray]: ...


class ModelDetector:
    """Spans by a tokenizer and a scorer, both made once in each Python worker by ``load``."""

    def __init__(self, load: Callable[[], tuple[Tokenize, Scorer, list[str]]], batch: int = 16, max_length: int = MAX_LENGTH, stride: int = STRIDE, o_bias: float = 0.0, adjacent: tuple[str, ...] = ("ADDRESS",), special: tuple[int, int] = (2, 3)):
        self.load, self.batch, self.max_length, self.stride, self.o_bias, self.adjacent, self.special = load, batch, max_length, stride, o_bias, adjacent, special

    def raw(self, text: Column) -> Column:
        load, batch, max_length, stride, o_bias, (cls, sep) = self.load, self.batch, self.max_length, self.stride, self.o_bias, self.special

        @F.pandas_udf(RAW)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenize, scorer, tags = load()
            rules = transitions(tags)
            for texts in parts:
                jobs, out = [], [[] for _ in texts]
                for row, t in enumerate(texts):
                    ids, offsets = tokenize(t) if t else ([], [])
                    starts = window_starts(len(ids), max_length, stride)
                    for w, s in enumerate(starts):
                        jobs.append((row, w, len(starts), [cls, *ids[s : s + max_length - 2], sep], [(0, 0), *offsets[s : s + max_length - 2], (0, 0)]))
                # Windows of like lengths share a batch, whatever document they come from.
                jobs.sort(key=lambda j: len(j[3]))
                for i in range(0, len(jobs), batch):
                    some = jobs[i : i + batch]
                    for (row, w, n, _, offsets), scores in zip(some, scorer([j[3] for j in some]), strict=True):
                        out[row].extend(decoded(scores, offsets, tags, w, n, o_bias, stride, rules))
                for spans in out:
                    spans.sort(key=lambda s: (s["win"], s["start"]))
                yield pd.Series(out, index=texts.index, dtype=object)

        return run(text)

    def spans(self, text: Column) -> Column:
        return finished(text, self.raw(text), self.adjacent)


_LOADED: dict[str, tuple] = {}


def onnx_model(folder: str, weights: str = "model.int8.onnx", threads: int = 1) -> Callable[[], tuple[Tokenize, Scorer, list[str]]]:
    """A loader for ONNX weights with tokenizer.json and config.json in ``folder``, or in a file shipped by ``spark.files``.

    One thread for each task: Spark runs the tasks in parallel.
    """

    def load():
        if folder not in _LOADED:
            import onnxruntime as ort
            from tokenizers import Tokenizer

            names = json.loads(Path(folder, "config.json").read_text(encoding="utf-8"))["id2label"]
            tags = [names[str(i)] for i in range(len(names))]
            tk = Tokenizer.from_file(str(Path(folder, "tokenizer.json")))
            tk.no_truncation()
            tk.no_padding()
            options = ort.SessionOptions()
            options.intra_op_num_threads = threads
            session = ort.InferenceSession(str(Path(folder, weights)), options, providers=["CPUExecutionProvider"])
            wanted = {i.name for i in session.get_inputs()}

            def tokenize(text: str):
                e = tk.encode(text, add_special_tokens=False)
                return list(e.ids), [tuple(o) for o in e.offsets]

            def score(some: list[list[int]]) -> list[np.ndarray]:
                wide = max(map(len, some))
                ids = np.array([w + [0] * (wide - len(w)) for w in some], np.int64)
                mask = np.array([[1] * len(w) + [0] * (wide - len(w)) for w in some], np.int64)
                feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                logits = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
                return [logits[i, : len(w)] for i, w in enumerate(some)]

            _LOADED[folder] = (tokenize, score, tags)
        return _LOADED[folder]

    return load


def find_weights(given: str | None = None, places: tuple[str, ...] = ("/opt/models/pii", "release"), weights: str = "model.int8.onnx") -> str:
    """The first folder that has the weights: the given one, the one in the environment, then the usual places. No download."""
    for folder in (given, os.environ.get("REDACTRA_MODEL_DIR"), *places):
        if folder and all(Path(folder, f).exists() for f in (weights, "tokenizer.json", "config.json")):
            return str(folder)
    raise FileNotFoundError("no model folder with weights, tokenizer.json and config.json; set REDACTRA_MODEL_DIR")


def service_spans(entities: Column, text: Column) -> Column:
    """Spans of the cloud service's entities (category, subcategory, offset, length, confidenceScore), without particles."""
    label = lambda e: F.coalesce(L.map_label(e["category"], L.CLOUD_SERVICE), L.map_label(e["subcategory"], L.CLOUD_SERVICE))
    made = F.transform(entities, lambda e: S.span(e["offset"], e["offset"] + e["length"], label(e), F.coalesce(e["confidenceScore"], F.lit(1.0))))
    return S.drop_particles(text, F.filter(made, lambda s: s["label"].isNotNull()))


def best_bias(dev: DataFrame) -> DataFrame:
    """(o_bias, f1) with the best f1 among evaluated values, the smallest of equals: choose on dev, confirm on test."""
    return dev.agg(F.max_by(F.struct("o_bias", "f1"), F.struct("f1", -F.col("o_bias"))).alias("b")).select("b.*")
