"""Text scalars as column expressions: normalization that keeps offsets, comparison keys, grams and splits."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, for regular expression classes.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def width_table() -> tuple[str, str]:
    """Characters beyond ASCII whose NFKC form is one other character, and these forms, built from Unicode's own rule."""
    pairs = [(c, n) for c in map(chr, (*range(128, 0xD800), *range(0xE000, 0x110000))) if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


def normalize(text: Column) -> Column:
    """Full-width and compatibility characters become plain ones where one becomes one, so offsets stay valid."""
    many, one = width_table()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, many, one)).otherwise(text)


def strip(text: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def digits(text: Column) -> Column:
    """Decimal digits alone."""
    return F.regexp_replace(text, r"(?U)\D", "")


#: Blocks that Unicode 16 added and whose characters its NFKC changes, moves or joins; they are nothing to earlier versions.
NEW_IN_16 = r"\x{897}\x{105C0}-\x{105FF}\x{10D40}-\x{10D8F}\x{11380}-\x{113FF}\x{16100}-\x{1613F}\x{16D40}-\x{16D7F}\x{1CC00}-\x{1CEBF}\x{1E5D0}-\x{1E5FF}"


def nfkc(text: Column) -> Column:
    """The text in full NFKC as Python's ``unicodedata`` has it, by the ICU library that Spark brings: no text leaves the JVM.

    ICU knows Unicode 16. Where Python is older, what came with 16 stays as it is and parts the text.
    """
    icu = lambda t: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    out = F.when(text.isNull() | ~text.rlike(r"[^\x00-\x7F]"), text)
    if unicodedata.category("\U0001ccd6") == "Cn":
        parts = F.regexp_extract_all(text, F.lit(f"[{NEW_IN_16}]+|[^{NEW_IN_16}]+"), F.lit(0))
        each = F.transform(parts, lambda t: F.when(t.rlike(f"^[{NEW_IN_16}]"), t).otherwise(icu(t)))
        out = out.when(text.rlike(f"[{NEW_IN_16}]"), F.array_join(each, ""))
    return out.otherwise(icu(text))


def folded(text: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(without_space(text))


def leak_keys(text: Column, full_nfkc: Column | None = None, levels: tuple[str, ...] = ("exact", "norm", "masked")) -> Column:
    """A struct of md5 keys, of the levels asked for: ``exact``, ``norm`` (folded) and ``masked`` (digits as 0 too).

    ``full_nfkc``: the text in NFKC where it may have characters that NFKC changes; see ``operators.leakage``.
    """
    norm = folded(text if full_nfkc is None else full_nfkc)
    keys = {"exact": text, "norm": norm, "masked": F.regexp_replace(norm, r"(?U)\d", "0")}
    return F.struct(*(F.md5(keys[x]).alias(x) for x in levels))


def char_grams(text: Column, n: int = 12, step: int = 3) -> Column:
    """Distinct n-character substrings at every ``step``-th place, without white space; a short text is one gram.

    The text is cut into steps once and grams are put together from these, since a substring is found by counting characters
    from the beginning of the text.
    """
    if n % step:
        raise ValueError("n must be a multiple of step")
    bare, parts = without_space(text), n // step

    def grams(steps: Column) -> Column:
        full = F.sequence(F.lit(0), F.size(steps) - parts)
        return F.array_distinct(F.transform(full, lambda i: F.concat(*(F.get(steps, i + k) for k in range(parts)))))

    return let(bare, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(let(F.regexp_extract_all(t, F.lit(f"(?s).{{{step}}}"), F.lit(0)), grams)))


def hash_tenth(text: Column) -> Column:
    """md5 of the collapsed text as a number, modulo 10: which templates are held out (0) never changes."""
    h = F.md5(collapse_space(text))
    # 16 = 6 mod 10, and 6 * 6 = 6 mod 10: all digits but the last count six times.
    values = F.transform(F.split(h, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    total = F.aggregate(F.slice(values, 1, 31), F.lit(0), lambda a, x: a + x)
    return F.pmod(total * 6 + F.get(values, F.lit(31)), F.lit(10))


def dialogue_id(sentence_id: Column) -> Column:
    """The id without its last two parts (one, if it has only two)."""
    return F.regexp_replace(sentence_id, r"(_[^_]*){1,2}\z", "")


def source_prefix(source: Column) -> Column:
    return F.split_part(source, F.lit("/"), F.lit(1))
