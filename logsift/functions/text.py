"""Terms, tokens and times."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(data: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(data, UPPER, LOWER)


def has_term(data: Column, term: str | None) -> Column:
    """Substring search: the term is lowered in full, the data in ASCII only; an empty term fits all."""
    if not term:
        return F.lit(True)
    return F.contains(ascii_fold(data), F.lit(term.lower()))


def tokens(data: Column) -> Column:
    """Runs of letters and numbers, lowered, in order."""
    return F.transform(F.filter(F.split(data, r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.lower(x))


def token_list(term: str) -> list[str]:
    """tokens() of a term, on the driver."""
    return [t.lower() for t in re.findall(r"[^\W_]+", term)]


def has_tokens(token_set: Column, term: str) -> Column:
    """Whether a set of tokens has all of a term's; an empty set or term fits."""
    wanted = token_list(term)
    if not wanted:
        return F.lit(True)
    return (F.size(token_set) == 0) | (F.size(F.array_except(F.array(*map(F.lit, wanted)), token_set)) == 0)


UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def parse_time(text: str, now_ns: int, default: int) -> int:
    """Nanoseconds: "" is the default, a duration lies in the past whatever its sign, else an integer."""
    if not text:
        return default
    if re.fullmatch(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|μs|ms|s|m|h)(?:(?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))*", text):
        parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)", text)
        return now_ns - sum(int(Decimal(n if n[0] != "." else "0" + n) * UNITS[u]) for n, u in parts)
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    raise ValueError(f"neither a duration nor nanoseconds: {text!r}")


def time_range(timestamp: Column, start: int | None = None, end: int | None = None) -> Column:
    """Both ends included; without bounds 0 to 2^62."""
    return timestamp.between(0 if start is None else start, 1 << 62 if end is None else end)


def bound(text: str | None, default: int) -> int:
    """A bound of a request: what isn't an integer counts as absent."""
    return int(text) if text and re.fullmatch(r"[+-]?\d+", text) else default
