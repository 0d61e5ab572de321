"""Searches over entries(timestamp, data)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.labels import labels_column
from logsift.functions.text import has_term, has_tokens, time_range, token_list, tokens
from logsift.operators.matcher import Matcher


def matching(entries: DataFrame, start: int | None = None, end: int | None = None, term: str | None = None, q: str | Matcher | None = None, label_of: Callable[[str], Column] | None = None) -> DataFrame:
    """The rows that fit, with all their columns. `q` wins over `term`. Labels come from
    `label_of`, else from a column `labels`, else are extracted from the lines that are left."""
    out = entries.where(time_range(F.col("timestamp"), start, end))
    if not q:
        return out.where(has_term(F.col("data"), term))
    m = q if isinstance(q, Matcher) else Matcher.from_json(q)
    out = out.where(m.line_column(F.col("data")))
    if not m.labels:
        return out
    if label_of is None:
        if "labels" not in out.columns:  # only for the lines that are left; two filters, so that these run first
            return out.withColumn("labels", labels_column(out)).where(m.label_column(lambda k: F.element_at("labels", k))).drop("labels")
        label_of = lambda k: F.element_at("labels", k)
    return out.where(m.label_column(label_of))


def search(entries: DataFrame, **query) -> DataFrame:
    """matching(), as (timestamp, data)."""
    return matching(entries, **query).select("timestamp", "data")


def in_order(entries: DataFrame) -> DataFrame:
    """By time; lines of one time by their text."""
    return entries.orderBy("timestamp", "data")


def tail(entries: DataFrame, n: int = 100) -> DataFrame:
    """The last n rows in order; 0 is all."""
    if n <= 0:
        return in_order(entries)
    return in_order(entries.orderBy(F.desc("timestamp"), F.desc("data")).limit(n))


def head(entries: DataFrame, n: int) -> DataFrame:
    return in_order(entries).limit(n)


def token_gated(entries: DataFrame, part: str, term: str) -> DataFrame:
    """The term search of a store that skips parts whose token sets lack a whole token of
    the term. Opt-in: it misses rows that only hold the term within longer tokens."""
    sets = token_sets(entries, part)
    kept = sets.where(has_tokens(F.col("tokens"), term) | F.col("tokens_truncated")).select(part)
    return entries.join(kept, part, "left_semi").where(has_term(F.col("data"), term))


def token_sets(entries: DataFrame, part: str, cap: int = 10_000) -> DataFrame:
    """(part, tokens, tokens_truncated): sorted distinct tokens; over `cap` of them the set is cut and says so.
    Distinct pairs are counted before any set is built, so no group is larger than `cap`."""
    distinct = entries.select(part, F.explode(tokens(F.col("data"))).alias("token")).distinct()
    counts = distinct.groupBy(part).agg(F.count("*").alias("n"))
    small = distinct.join(counts.where(F.col("n") <= cap), part).groupBy(part).agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    parts = entries.select(part).distinct()
    out = parts.join(counts, part, "left").join(small, part, "left")
    return out.select(part, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce(F.col("n") > cap, F.lit(False)).alias("tokens_truncated"))


def gate_tokens(term: str) -> list[str]:
    return token_list(term)
