"""Command line: python -m logsift.cli STORE [term ...] [-n N] [-from T] [-to T] [-q JSON] [-parse] [-stats]."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import parse_time
from logsift.operators.search import tail
from logsift.plans.store import LogStore
from logsift.sources.ingest import formatted


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logsift", description="Searches a store; words are one term.")
    p.add_argument("store")
    p.add_argument("words", nargs="*")
    p.add_argument("-n", "-limit", dest="n", type=int, default=100, help="last so many lines; 0 is all")
    p.add_argument("-from", dest="start", default="", help="nanoseconds, or a duration before now")
    p.add_argument("-to", dest="end", default="")
    p.add_argument("-term", default="")
    p.add_argument("-q", default="", help="matcher as JSON; wins over the term")
    p.add_argument("-parse", action="store_true", help="print structured lines for reading")
    p.add_argument("-stats", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    now = time.time_ns()
    spark = SparkSession.builder.getOrCreate()
    found = LogStore(spark, a.store).search(parse_time(a.start, now, 0), parse_time(a.end, now, 1 << 62), a.term or " ".join(a.words), a.q or None)
    rows = tail(found.rows, a.n)
    line = formatted(F.col("data"), F.col("timestamp")) if a.parse else F.trim("data")
    printed = 0
    for r in rows.select(line.alias("line")).collect() if a.n > 0 else rows.select(line.alias("line")).toLocalIterator():
        print(r.line)
        printed += 1
    if a.stats:
        print(json.dumps(found.finished(None if a.n > 0 else printed).to_json()))


if __name__ == "__main__":
    main()
