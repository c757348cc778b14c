"""Rule detection: patterns with checksums and deterministic resolution of overlaps, in the JVM throughout."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S
from ..functions.masking import anonymize, audit_summary
from ..functions.text import SPACE, normalize
from ..functions.validators import card_checksum, resident_checksum

# Label -> pattern, in order of priority.
RULES = {
    "EMAIL": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "URL": r"(?:https?://|www\.)[^\s,]+",
    "IPADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "MACADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b",
    "RRN": r"\b\d{6}\s?[-–]\s?[1-8]\d{6}\b",
    "CARD_NUMBER": r"\b(?:\d{4}[ \-]?){3}\d{4}\b",
    "PHONE": r"\b0(?:1[016-9]|2|[3-6]\d)[ \-]?\d{3,4}[ \-]?\d{4}\b",
    "ACCOUNT_NUMBER": r"\b\d{2,6}[ \-]\d{2,6}[ \-]\d{2,7}\b",
    "BUSINESS_ID": r"\b\d{3}[ \-]\d{2}[ \-]\d{5}\b",
    "PASSPORT": r"\b[MSRODmsrod]\d{8}\b",
    "DRIVER_LICENSE": r"\b\d{2}[ \-]\d{2}[ \-]\d{6}[ \-]\d{2}\b",
    "PORT": r"(?<=:)\b\d{2,5}\b",
}
#: What a text must have before these rules' patterns are tried on it.
GATES = {"EMAIL": "@", "URL": r"://|www\."}


#: Whatever any rule finds, this finds too: one pass spares most texts the rules' own gates.
HINT = r"@|://|www\.|\p{Nd}{2}|\p{Nd}\.\p{Nd}|(?:[0-9A-Fa-f]{2}[:\-]){5}"


def gate(label: str) -> str:
    """A quicker pattern that matches wherever the rule's does: the same without word borders, which are slow to test."""
    bare = RULES[label].replace(r"\b", "").replace("(?<=:)", ":")
    return GATES.get(label) or bare.replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")


CHECKS: dict[str, Callable[[Column], Column]] = {"CARD_NUMBER": card_checksum, "RRN": resident_checksum}


class Detector(Protocol):
    """Anything that gives spans for a text column; ``ModelDetector`` in ``operators.decode`` is one."""

    def spans(self, text: Column) -> Column: ...


def _found(text: Column, label: str, validate: bool) -> Column:
    """(priority, -length, start, end, label, score, ok) of a rule's matches; ``ok``: whether the rule's check passes, if it is asked for."""
    order = list(RULES).index(label)
    check = CHECKS.get(label) if validate else None

    def one(m: Column) -> Column:
        v = F.regexp_replace(m["found"], r"[ \-–]+\z", "")
        ok = check(v) if check else F.lit(True)
        return F.struct(F.lit(order).alias("priority"), (-F.length(v)).alias("short"), m["start"].alias("start"), (m["start"] + F.length(v)).alias("end"), F.lit(label).alias("label"), F.lit(1.0).alias("score"), ok.alias("ok"))

    return F.transform(S.matches(text, f"(?U){RULES[label]}"), one)


def _all_found(text: Column, validate: bool, rules: list[str] | None) -> Column:
    none = F.array().cast("array<struct<priority:int,short:int,start:int,end:int,label:string,score:double,ok:boolean>>")
    found = F.concat(*(F.when(text.rlike(gate(label)), _found(text, label, validate)).otherwise(none) for label in rules or RULES))
    return F.when(text.rlike(HINT), found).otherwise(none)


def _chosen(text: Column, found: Column) -> Column:
    # Structs sort by their fields: priority, length, start.
    ranked = F.transform(F.sort_array(found), lambda x: S.span(x["start"], x["end"], x["label"], x["score"]))
    return F.when(text.isNotNull(), S.resolve(ranked))


def rule_spans(text: Column, validate: bool = True, rules: list[str] | None = None) -> Column:
    """Spans of all rules; of overlapping ones the earlier rule wins, then the longer match, then the first."""
    found = _all_found(text, validate, rules)
    return _chosen(text, F.filter(found, lambda x: x["ok"]) if validate else found)


def both_spans(df: DataFrame, checked_col: str, unchecked_col: str, rules: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``rule_spans`` with and without validation; patterns go over a text once for both."""
    text, found = F.col(text_col), F.col("_found")
    # A projection of its own, so that matches are looked for once.
    out = df.withColumn("_found", _all_found(text, True, rules))
    return out.withColumns({checked_col: _chosen(text, F.filter(found, lambda x: x["ok"])), unchecked_col: _chosen(text, found)}).drop("_found")


class RuleDetector:
    def __init__(self, validate: bool = True, rules: list[str] | None = None):
        self.validate, self.rules = validate, rules

    def spans(self, text: Column) -> Column:
        return rule_spans(text, self.validate, self.rules)


class UnionDetector:
    """The first detector's spans, and of the others what overlaps nothing so far."""

    def __init__(self, *detectors: Detector):
        self.detectors = detectors

    def spans(self, text: Column) -> Column:
        return reduce(S.union, (d.spans(text) for d in self.detectors))


#: Detectors by name, for the command line and ``detect(df, "name")``.
REGISTRY: dict[str, Callable[[], Detector]] = {"rules": RuleDetector, "rules_unchecked": lambda: RuleDetector(validate=False)}


def detector(which: str | Detector) -> Detector:
    if isinstance(which, str):
        if which not in REGISTRY:
            raise ValueError(f"no detector {which}; there are {sorted(REGISTRY)}")
        return REGISTRY[which]()
    return which


def detect(df: DataFrame, which: str | Detector = "rules", text_col: str = "text", spans_col: str = "spans", threshold: float | None = None, normalized: bool = True) -> DataFrame:
    """``df`` with a column of spans, found in the normalized text, whose offsets are those of the text itself."""
    own = detector(which)
    if not normalized:
        return df.withColumn(spans_col, S.at_least(own.spans(F.col(text_col)), threshold))
    # A projection of its own: detectors refer to the text many times, and it is normalized once.
    plain = df.withColumn("_normalized", normalize(F.col(text_col)))
    return plain.withColumn(spans_col, S.at_least(own.spans(F.col("_normalized")), threshold)).drop("_normalized")


def mask(df: DataFrame, which: str | Detector = "rules", policy: str = "default", text_col: str = "text", masked_col: str = "masked", salt: bytes | None = None, fmt: str = "[{label}]") -> DataFrame:
    """``df`` with the masked text and the audit summary."""
    found = detect(df, which, text_col, "_spans")
    return found.withColumn(masked_col, anonymize(F.col(text_col), F.col("_spans"), policy, salt, fmt)).withColumn("summary", audit_summary(F.col("_spans"))).drop("_spans")


def limits(df: DataFrame, text_col: str = "text", longest: int = 20_000, most: int = 200_000, batch_col: str | None = None) -> DataFrame:
    """``df``, failing when a text is longer than ``longest`` or a batch's texts together than ``most``."""
    n = F.length(text_col)
    out = df.withColumn(text_col, F.when(F.coalesce(n, F.lit(0)) <= longest, F.col(text_col)).otherwise(F.raise_error(F.concat(F.lit("text too long: "), n.cast("string"))).cast("string")))
    if batch_col is None:
        return out
    total = df.groupBy(batch_col).agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total")).select(batch_col, F.when(F.col("_total") <= most, True).otherwise(F.raise_error(F.lit("batch too long")).cast("boolean")).alias("_fits"))
    return out.join(total, batch_col).filter("_fits").drop("_fits")


def entities(spans: Column, wanted: list[str] | None = None, floor: float = 0.0) -> Column:
    """The adapter's view: (entity_type, start, end, score) of spans whose entity is wanted and whose score reaches the floor."""
    named = F.transform(spans, lambda s: F.struct(L.map_label(s["label"], L.ENTITY_OF).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    keep = lambda e: e["entity_type"].isNotNull() & (e["score"] >= floor) & (e["entity_type"].isin(wanted) if wanted else F.lit(True))
    return F.filter(named, keep)


def counts_by_label(df: DataFrame, spans_col: str = "spans", by: list[str] | None = None) -> DataFrame:
    """(by..., label, n_spans, n_rows): partial sums before the shuffle."""
    return df.select(*(by or []), F.explode(F.col(spans_col)).alias("s"), F.size(spans_col)).groupBy(*(by or []), F.col("s.label").alias("label")).agg(F.count("*").alias("n_spans"))
