"""Span algebra on arrays of (start, end, label, score): finding, resolving, joining and trimming, as column expressions.

Offsets are code points, half open, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let

SPAN = "struct<start:int,end:int,label:string,score:double>"
SPANS = f"array<{SPAN}>"


def empty() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, label: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), score.cast("double").alias("score"))


def surface(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def matches(text: Column, pattern: str) -> Column:
    """(start, found) of all matches of a pattern that never matches nothing.

    Spark gives matches without places. The pieces between them and the matches take turns, so a running length gives the
    places, in code points. Patterns look at the whole text on both sides, also in look-behinds and word borders.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        return F.struct((at + F.length(x["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), x["found"].alias("found")))).alias("out"))

    def body(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("found")))
        return F.aggregate(pairs, start, step, lambda a: a["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), body)


def by_start(spans: Column) -> Column:
    return F.sort_array(spans)


def resolve(ranked: Column) -> Column:
    """Greedy choice from spans in order of preference: one stays if it overlaps none that stayed; in order of starts."""
    pick = lambda acc, s: F.when(F.exists(acc, lambda o: overlap(s, o)), acc).otherwise(F.concat(acc, F.array(s)))
    return by_start(F.aggregate(ranked, empty(), pick))


def union(first: Column, second: Column) -> Column:
    """All of ``first``, and of ``second`` what overlaps nothing so far; in order of starts."""
    pick = lambda acc, s: F.when(F.exists(acc, lambda o: overlap(s, o)), acc).otherwise(F.concat(acc, F.array(s)))
    return by_start(F.aggregate(second, first, pick))


def at_least(spans: Column, threshold: float | None) -> Column:
    """Spans with this score or more; no threshold, or 0, keeps all."""
    return F.filter(spans, lambda s: s["score"] >= threshold) if threshold else spans


def of_labels(spans: Column, labels: list[str]) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(labels))


def trimmed(text: Column, spans: Column) -> Column:
    """White space at spans' ends goes; what is left empty goes as well. Other fields of a span stay."""

    def one(s: Column) -> Column:
        def body(v: Column) -> Column:
            left = F.length(v) - F.length(F.regexp_replace(v, f"^[{SPACE}]+", ""))
            right = F.length(v) - F.length(F.regexp_replace(v, f"[{SPACE}]+\\z", ""))
            return s.withField("start", (s["start"] + left).cast("int")).withField("end", (s["end"] - right).cast("int"))

        return let(surface(text, s), body)

    return F.filter(F.transform(spans, one), lambda s: s["end"] > s["start"])


def merge_windows(text: Column, spans: Column) -> Column:
    """Spans of several windows (with ``win``) as one list without overlaps.

    In order of (start, longest first): a span that touches or overlaps the last one, with its label but from another
    window and at most white space between, extends it (larger end, larger score); otherwise, of two that overlap the one
    with the strictly higher score stays.
    """
    ranked = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(acc: Column, s: Column) -> Column:
        def with_last(last: Column) -> Column:
            rest = F.slice(acc, F.lit(1), F.size(acc) - 1)
            between = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
            same = (s["label"] == last["label"]) & (s["start"] <= last["end"] + 1) & (s["win"] != last["win"]) & ~between.rlike(f"[^{SPACE}]")
            grown = last.withField("end", F.greatest(last["end"], s["end"])).withField("score", F.greatest(last["score"], s["score"]))
            return F.when(same, F.concat(rest, F.array(grown))).when(s["start"] < last["end"], F.when(s["score"] > last["score"], F.concat(rest, F.array(s))).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))

        return F.when(F.size(acc) == 0, F.array(s)).otherwise(let(F.element_at(acc, -1), with_last))

    return F.aggregate(ranked, F.slice(ranked, F.lit(1), F.lit(0)), step)


def merge_adjacent(text: Column, spans: Column, labels: tuple[str, ...] = ("ADDRESS",)) -> Column:
    """Neighbours of one of the labels with at most one blank between become one, with the lower score."""

    def step(acc: Column, s: Column) -> Column:
        def with_last(last: Column) -> Column:
            between = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
            near = s["label"].isin(*labels) & (s["label"] == last["label"]) & (s["start"] - last["end"] <= 1) & ~between.rlike(f"[^{SPACE}]")
            grown = last.withField("end", s["end"]).withField("score", F.least(last["score"], s["score"]))
            return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

        return F.when(F.size(acc) == 0, F.array(s)).otherwise(let(F.element_at(acc, -1), with_last))

    return F.aggregate(spans, empty(), step)


# Particles after numbers and other values, after persons, and those that need three characters before them.
AFTER_VALUE = "이라고 이라는 으로부터 에서는 에서도 까지는 까지도 부터는 부터 까지 으로 이나 이랑 이며 이고 이다 에서 에게 한테 처럼 보다 이면 이야 이가 이는 은 는 이 가 을 를 로 에 의 도 과 와 랑 만".split()
AFTER_PERSON = "이라고 이랑 한테 에게 이는 이가 은 는 을 를 도 의 과 와 랑 야 아 님 씨".split()
WEAK = "이 가 은 는 을 를 도 의 과 와 랑".split()
VALUE_ENDS = "0-9일년월호번층동실"


def drop_particles(text: Column, spans: Column) -> Column:
    """Particles at the end of a span go, by the label's list.

    A vocative goes only if the syllable before has a final consonant (아) or has none (야). Persons keep two characters,
    three if the particle is weak; other labels need a digit or unit before the particle, and two characters.
    """

    def particle(v: Column, some: list[str]) -> Column:
        return F.regexp_extract(v, f"({'|'.join(some)})\\n?\\z", 1)

    def person(v: Column, p: Column) -> Column:
        left = F.length(v) - F.length(p)
        before = F.ascii(F.substring(v, -2, 1))
        final = before.between(0xAC00, 0xD7A3) & ((before - 0xAC00) % 28 != 0)
        vocative = F.when(p == "아", final).when(p == "야", ~final).otherwise(F.lit(True))
        return vocative & (((left >= 2) & ~p.isin(*WEAK)) | (left >= 3))

    def value(v: Column, p: Column) -> Column:
        left = F.length(v) - F.length(p)
        return (left >= 2) & F.substring(v, F.lit(1), left).rlike(f"[{VALUE_ENDS}]\\n?\\z")

    def one(s: Column) -> Column:
        def body(v: Column) -> Column:
            p = F.when(s["label"] == "PERSON", particle(v, AFTER_PERSON)).otherwise(particle(v, AFTER_VALUE))

            def cut(q: Column) -> Column:
                ok = (F.length(q) > 0) & F.when(s["label"] == "PERSON", person(v, q)).otherwise(value(v, q))
                return s.withField("end", (s["end"] - F.when(ok, F.length(q)).otherwise(0)).cast("int"))

            return let(p, cut)

        return let(surface(text, s), body)

    return F.filter(F.transform(spans, one), lambda s: s["end"] > s["start"])


def inside(text: Column, spans: Column) -> Column:
    """Whether every span lies in the text and holds more than white space."""
    return F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & surface(text, s).rlike(f"[^{SPACE}]"))
