"""Masking policies over spans as column expressions: by label, by keyed hash, or in part.

Spans must be in order and without overlaps, as the detectors give them. The text itself is masked, not its normalized form,
so a value in full-width digits has another hash than the same one in plain digits.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L
from .spans import surface
from .text import let

POLICIES = ("default", "hash", "partial")
HASH_LENGTH = 10


def hmac_sha256(value: Column, salt: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal, from Spark's sha2.

    The salt becomes a literal of the plan and so shows in explain() and event logs of that session; where these are kept,
    use ``hmac_udf``.
    """
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def hmac_udf(salt: bytes) -> Callable[[Column], Column]:
    """The same by an Arrow function; the salt travels with the function's code and isn't printed in plans."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else hmac.new(salt, x.encode(), hashlib.sha256).hexdigest())

    return run


def keep_edges(value: Column, head: int, tail: int, sign: str = "*") -> Column:
    """Letters and digits between the first ``head`` and the last ``tail`` become the sign; separators stay.

    What is hidden is the slice [head : n - tail] of the n letters and digits, with negative ends counted from the end, so
    short values show as they do there: nothing is hidden once head + tail reaches n.
    """
    last = lambda n: n - tail if tail else n
    alnum = r"[\p{L}\p{N}]"

    def body(chars: Column) -> Column:
        n = F.size(F.filter(chars, lambda c: c.rlike(alnum)))
        end = F.when(last(n) < 0, F.greatest(n + last(n), F.lit(0))).otherwise(last(n))
        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

        def step(a: Column, c: Column) -> Column:
            own = c.rlike(alnum)
            hide = own & (a["i"] >= head) & (a["i"] < end)
            return F.struct((a["i"] + own.cast("int")).alias("i"), F.concat(a["out"], F.when(hide, F.lit(sign)).otherwise(c)).alias("out"))

        return F.aggregate(chars, start, step, lambda a: a["out"])

    return let(F.split(value, ""), body)


def mask_email(v: Column) -> Column:
    local, domain = F.regexp_extract(v, r"^([^@]+)(@.+)", 1), F.regexp_extract(v, r"^([^@]+)(@.+)", 2)
    hidden = F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(1))), domain)
    return F.when(v.rlike(r"^[^@]+@.+\n?\z"), hidden).otherwise(keep_edges(v, 1, 0))


def mask_name(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 1, v).when(n == 2, F.concat(F.substring(v, 1, 1), F.lit("*"))).otherwise(F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(v, -1, 1)))


def mask_address(v: Column) -> Column:
    """Up to the last token that names a city, county, district or town stays, else six characters; then at most eight signs."""
    kept = F.regexp_extract(v, r"(?Us)^(.*[가-힣0-9]+(?:시|군|구|읍|면|동)(?=\s|\n?\z))", 1)
    cut = F.when(F.length(kept) > 0, F.length(kept)).otherwise(F.least(F.length(v), F.lit(6)))
    return let(cut, lambda c: F.concat(F.substring(v, F.lit(1), c), F.when(F.length(v) > c + 1, F.concat(F.lit(" "), F.repeat(F.lit("*"), F.least(F.length(v) - c - 1, F.lit(8))))).otherwise("")))


def mask_ip(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)(\d+)(?=\.\d+\z)|(\d+)\z", "*")


# Letters and digits shown at the beginning and end of a value, by label.
SHOWN = {
    "CARD_NUMBER": (6, 4),
    "VIRTUAL_CARD_NUMBER": (6, 4),
    "ACCOUNT_NUMBER": (0, 4),
    "PHONE": (3, 4),
    "RRN": (6, 0),
    "FRN": (6, 0),
    "PASSPORT": (1, 0),
    "DRIVER_LICENSE": (2, 0),
    "BUSINESS_ID": (3, 0),
    "IMEI": (0, 4),
    "DEVICE_SERIAL": (0, 4),
    "SUBSCRIBER_ID": (0, 4),
    "VEHICLE_PLATE": (0, 0),
    "ZIPCODE": (0, 0),
}


def _edges(head: int, tail: int) -> Callable[[Column], Column]:
    return lambda v: keep_edges(v, head, tail)


#: Label -> how its values are masked in part; labels without a rule are replaced as a whole. May be overridden.
RULES: dict[str, Callable[[Column], Column]] = {label: _edges(*shown) for label, shown in SHOWN.items()} | {
    "EMAIL": mask_email,
    "PERSON": mask_name,
    "ADDRESS": mask_address,
    "IPADDRESS": mask_ip,
    "DATE": lambda v: v,
}


def replacement(value: Column, label: Column, policy: str, salt: bytes | None = None, fmt: str = "[{label}]", rules: dict | None = None) -> Column:
    """What stands for a value: ``fmt`` with the label, a salted token, or the label's partial rule (else ``fmt``)."""
    before, _, after = fmt.partition("{label}")
    whole = F.concat(F.lit(before), label, F.lit(after)) if "{label}" in fmt else F.lit(fmt)
    if policy == "default":
        return whole
    if policy == "hash":
        if salt is None:
            raise ValueError("the hash policy needs a salt: without one value's tokens would differ between tasks")
        return F.concat(F.lit("["), label, F.lit(":"), F.substring(hmac_sha256(value, salt), 1, HASH_LENGTH), F.lit("]"))
    if policy == "partial":
        out = whole
        for name, rule in (RULES if rules is None else rules).items():
            out = F.when(label == name, rule(value)).otherwise(out)
        return out
    raise ValueError(f"policy must be one of {POLICIES}")


def stitch(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with each span's value v and label l as ``put(v, l)``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), put(surface(text, s), s["label"])).alias("out"), s["end"].alias("at"))
    masked = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def anonymize(text: Column, spans: Column, policy: str = "default", salt: bytes | None = None, fmt: str = "[{label}]", rules: dict | None = None) -> Column:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    return stitch(text, spans, lambda v, label: replacement(v, label, policy, salt, fmt, rules))


def anonymize_entities(text: Column, spans: Column, policy: str = "default") -> Column:
    """The adapter's output: ``<ENTITY>``, a whole unsalted SHA-256, or the same partial rules (else ``<ENTITY>``)."""
    entity = lambda label: F.concat(F.lit("<"), F.coalesce(L.map_label(label, L.ENTITY_OF), label), F.lit(">"))
    if policy == "default":
        return stitch(text, spans, lambda v, label: entity(label))
    if policy == "hash":
        return stitch(text, spans, lambda v, label: F.sha2(v, 256))
    if policy == "partial":

        def put(v: Column, label: Column) -> Column:
            out = entity(label)
            for name, rule in RULES.items():
                out = F.when(label == name, rule(v)).otherwise(out)
            return out

        return stitch(text, spans, put)
    raise ValueError(f"policy must be one of {POLICIES}")


def encrypt(value: Column, key: bytes) -> Column:
    """AES-CBC with a random vector, as base64; ``decrypt`` gives the value back."""
    return F.base64(F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS")))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS")).cast("string")


def audit_summary(spans: Column) -> Column:
    """(total, by_label in order of labels, sensitive): counts without any text."""
    names = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    counts = F.transform(names, lambda n: F.struct(n, F.size(F.filter(spans, lambda s: s["label"] == n))))
    return F.struct(
        F.size(spans).alias("total"),
        F.map_from_entries(counts).alias("by_label"),
        F.size(F.filter(spans, lambda s: s["label"].isin(*L.SENSITIVE))).alias("sensitive"),
    )
