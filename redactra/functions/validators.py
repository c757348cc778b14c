"""Format validators: whether a value can be what its label says, as column expressions.

Each takes the value and whether the language is Korean (whose own formats are then asked for) and gives a boolean. Labels
without a validator pass. Values are stripped first and patterns must match all of the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import surface
from .text import digits, strip


def whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?U)^(?:{pattern})\\z")


def luhn(value: Column) -> Column:
    """Modulo-10 checksum of a string of digits; an empty one passes."""
    return (value == "") | F.call_function("luhn_check", value)


def card_checksum(value: Column) -> Column:
    """Twelve digits or more, with a valid checksum."""
    d = digits(value)
    return (F.length(d) >= 12) & F.call_function("luhn_check", d)


#: Weights of the resident number's checksum.
RESIDENT_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def resident_checksum(value: Column) -> Column:
    """Thirteen digits of which the last is (11 - weighted sum mod 11) mod 10."""
    d = digits(value)
    at = lambda i: F.ascii(F.substring(d, i + 1, 1)) - 48
    total = reduce(lambda a, b: a + b, (at(i) * w for i, w in enumerate(RESIDENT_WEIGHTS)))
    return F.coalesce((F.length(d) == 13) & d.rlike("^[0-9]{13}\\z") & ((11 - total % 11) % 10 == at(12)), F.lit(False))



def _number(d: Column, start: int, length: int) -> Column:
    return F.substring(d, start, length).try_cast("int")


def resident(v: Column, ko: Column) -> Column:
    d = digits(v)
    return whole(strip(v), r"\d{6}[- ]?\d{7}") & _number(d, 3, 2).between(1, 12) & _number(d, 5, 2).between(1, 31) & F.substring(d, 7, 1).isin(*"1234")


def foreigner(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"\d{6}[- ]?\d{7}") & F.substring(digits(v), 7, 1).isin(*"5678")


def driver(v: Column, ko: Column) -> Column:
    s = strip(v)
    own = whole(s, r"(?:[가-힣]{2}\s?)?\d{2}-\d{2}-\d{6}-\d{2}|(?:[가-힣]{2}\s?)?\d{2}-\d{6}-\d{2}|\d{10}|\d{12}")
    return F.when(ko, own).otherwise(whole(s, r"[A-Z0-9 -]{5,20}"))


def passport(v: Column, ko: Column) -> Column:
    s = F.replace(strip(v), F.lit(" "), F.lit(""))
    return F.when(ko, whole(s, r"[A-Z]\d{8}|[A-Z]\d{3}[A-Z]\d{4,5}|[A-Z]{2}\d{7}")).otherwise(whole(s, r"[A-Z0-9]{6,9}"))


def business(v: Column, ko: Column) -> Column:
    return F.when(ko, whole(strip(v), r"\d{3}-?\d{2}-?\d{5}")).otherwise(F.length(digits(v)).between(8, 12))


def card(v: Column, ko: Column) -> Column:
    return F.length(digits(v)).between(13, 19) & whole(strip(v), r"[\d\- ]+")


def virtual_card(v: Column, ko: Column) -> Column:
    return F.length(digits(v)).between(10, 19) & whole(strip(v), r"[\d\- ]+")


def phone(v: Column, ko: Column) -> Column:
    s = strip(v)
    spoken = F.regexp_replace(s, "[^0-9공영일이삼사오육칠팔구]", "")
    own = ~s.rlike(r"(?U)^\(\d{3}\)") & (F.length(spoken) >= 7) & ~s.rlike("[A-Za-z]")
    return F.when(ko, own).otherwise(F.length(digits(s)).between(7, 15))


def email(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}")


def zipcode(v: Column, ko: Column) -> Column:
    return F.when(ko, whole(strip(v), r"\d{5}|\d{3}-\d{3}")).otherwise(whole(strip(v), r"[A-Z0-9 -]{3,10}"))


def account(v: Column, ko: Column) -> Column:
    return ~v.rlike("[A-Za-z]") & F.length(digits(v)).between(8, 24)


def ssn(v: Column, ko: Column) -> Column:
    s = strip(v)
    return whole(s, r"\d{3}-?\d{2}-?\d{4}") | (ko & whole(s, r"\d{9,11}"))


def ip(v: Column, ko: Column) -> Column:
    s = strip(v)
    v4 = whole(s, r"(\d{1,3}\.){3}\d{1,3}") & F.forall(F.split(s, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) < 256)
    colons = F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit("")))
    return v4 | (whole(s, r"[0-9A-Fa-f:]{3,39}") & (colons >= 2))


def mac(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|([0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}")


def port(v: Column, ko: Column) -> Column:
    s = strip(v)
    return whole(s, r"0*[0-9]{1,5}") & F.coalesce(s.try_cast("long").between(1, 65535), F.lit(False))


def imei(v: Column, ko: Column) -> Column:
    return F.length(digits(v)) == 15


def cvc(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"\d{3,4}")


def expiry(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"(0[1-9]|1[0-2])\s?[/.-]\s?(\d{2}|\d{4})")


def url(v: Column, ko: Column) -> Column:
    return strip(v).rlike(r"(?U)(https?://|www\.|\.[a-z]{2,}/|\.(com|net|org|kr|io|co)\b)")


def plate(v: Column, ko: Column) -> Column:
    return whole(strip(v), r"(?:[가-힣]{2}\s?)?\d{2,3}\s?[가-힣]\s?\d{4}")


def person(v: Column, ko: Column) -> Column:
    s = strip(v)
    hangul, latin = s.rlike("[가-힣]"), s.rlike("[A-Za-z]")
    return ~ko | F.when(hangul, ~latin & (F.length(s) <= 12)).otherwise(F.length(s) <= 20)


VALIDATORS: dict[str, Callable[[Column, Column], Column]] = {
    "RRN": resident,
    "FRN": foreigner,
    "DRIVER_LICENSE": driver,
    "PASSPORT": passport,
    "BUSINESS_ID": business,
    "CARD_NUMBER": card,
    "VIRTUAL_CARD_NUMBER": virtual_card,
    "PHONE": phone,
    "EMAIL": email,
    "ZIPCODE": zipcode,
    "ACCOUNT_NUMBER": account,
    "SSN": ssn,
    "IPADDRESS": ip,
    "MACADDRESS": mac,
    "PORT": port,
    "IMEI": imei,
    "CVC": cvc,
    "CARD_EXPIRY": expiry,
    "URL": url,
    "VEHICLE_PLATE": plate,
    "PERSON": person,
}


def check(label: Column, value: Column, lang: Column) -> Column:
    """Whether the value passes its label's validator; what a validator can't judge passes."""
    ko, out = F.coalesce(lang == "ko", F.lit(False)), F.lit(True)
    for name, rule in reversed(VALIDATORS.items()):
        out = F.when(label == name, F.coalesce(rule(value, ko), F.lit(True))).otherwise(out)
    return out


def invalid_labels(text: Column, spans: Column, lang: Column) -> Column:
    """Distinct labels, in order, of spans that fail; empty if the row is valid."""
    failing = F.filter(spans, lambda s: ~check(s["label"], surface(text, s), lang))
    return F.array_sort(F.array_distinct(F.transform(failing, lambda s: s["label"])))
