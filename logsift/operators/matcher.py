"""Matchers: line filters and label filters, all of which must hold."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions import regex

# Operators by the names that requests use; fixed values.
OPS = {"|=": "eq", "eq": "eq", "!=": "ne", "ne": "ne", "|~": "re", "re": "re", "!~": "nre", "nre": "nre", "=": "eq", "=~": "re"}
LINE_OPS = ("|=", "!=", "|~", "!~", "eq", "ne", "re", "nre")
LABEL_OPS = ("eq", "ne", "re", "nre", "=", "!=", "=~", "!~")


class BadMatcher(ValueError):
    """A matcher that is refused before any work is done."""


@dataclass(frozen=True)
class LineFilter:
    """Substring (case counts) or unanchored regular expression on the whole line."""

    op: str
    value: str

    def column(self, data: Column) -> Column:
        op = OPS[self.op]
        hit = data.contains(self.value) if op in ("eq", "ne") else data.rlike(regex.translate(self.value))
        return hit if op in ("eq", "re") else ~hit


@dataclass(frozen=True)
class LabelFilter:
    """Equality or a regular expression on the whole value; a missing label is an empty one."""

    label: str
    op: str
    value: str

    def column(self, label: Column) -> Column:
        op, value = OPS[self.op], F.coalesce(label, F.lit(""))
        hit = value == self.value if op in ("eq", "ne") else value.rlike(regex.anchored(self.value))
        return hit if op in ("eq", "re") else ~hit


@dataclass(frozen=True)
class Matcher:
    lines: tuple[LineFilter, ...] = field(default=())
    labels: tuple[LabelFilter, ...] = field(default=())

    def __post_init__(self):
        for f in self.lines:
            if f.op not in LINE_OPS:
                raise BadMatcher(f"bad line op: {f.op}")
        for f in self.labels:
            if f.op not in LABEL_OPS:
                raise BadMatcher(f"bad label op: {f.op}")
        for f in (*self.lines, *self.labels):
            if OPS[f.op] in ("re", "nre"):
                try:
                    regex.validate(regex.anchored(f.value) if isinstance(f, LabelFilter) else regex.translate(f.value))
                except regex.BadPattern as e:
                    raise BadMatcher(f"bad matcher: {e}") from None

    @classmethod
    def from_json(cls, text: str) -> Matcher:
        """From {"line": [{"op", "v"}], "labels": [{"l", "op", "v"}]}."""
        try:
            q = json.loads(text)
            lines = [(f.get("op", ""), f.get("v", "")) for f in q.get("line") or ()]
            labels = [(f.get("l", ""), f.get("op", ""), f.get("v", "")) for f in q.get("labels") or ()]
        except (ValueError, AttributeError, TypeError):
            raise BadMatcher("bad q") from None
        return cls(tuple(LineFilter(*f) for f in lines), tuple(LabelFilter(*f) for f in labels))

    def line_column(self, data: Column) -> Column:
        out = F.lit(True)
        for f in self.lines:
            out = out & f.column(data)
        return out

    def label_column(self, label_of: Callable[[str], Column]) -> Column:
        out = F.lit(True)
        for f in self.labels:
            out = out & f.column(label_of(f.label))
        return out

    def equalities(self) -> list[tuple[str, str]]:
        """Labels that must have a given value; an empty one says nothing that an index could."""
        return [(f.label, f.value) for f in self.labels if OPS[f.op] == "eq" and f.value]
