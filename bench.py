"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logsift import queries as base
from logsift.operators.search import search, tail
from logsift.plans.store import LogStore
from logsift.sources.views import EPOCH_2024, entries, text_entries

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Terms of the published benchmark; fixed values, for comparison with it.
RARE, MISS = "special-uuid-42", "nonexistent-term"
DAY = 86_400_000_000_000


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    e, t = entries(spark, SF), text_entries(spark, SF)
    store = LogStore(spark, "file://" + tempfile.mkdtemp(prefix="bench-"))
    for k in range(4):
        store.append(e.where(f"event_id % 4 = {k}"), str(k))
    texts = LogStore(spark, "file://" + tempfile.mkdtemp(prefix="bench-texts-"))
    by_time = t.withColumn("part", F.floor((F.col("timestamp") - EPOCH_2024) / 10**9 / 2500))
    for k in range(4):
        texts.append(by_time.where(f"part = {k}"), str(k))
    label = '{"labels":[{"l":"level","op":"eq","v":"ERROR"}]}'
    runs = {
        "time_range": lambda: search(e, start=EPOCH_2024, end=EPOCH_2024 + 14 * DAY),
        "term_rare": lambda: search(t, term=RARE),
        "term_common": lambda: search(t, term="the"),
        "term_miss": lambda: search(t, term=MISS),
        "term_rare_store": lambda: texts.search(term=RARE).rows,
        "term_common_store": lambda: texts.search(term="the").rows,
        "term_miss_store": lambda: texts.search(term=MISS).rows,
        "term_gate_store": lambda: texts.search(term="license", token_gate=True).rows,
        "line_regex": lambda: search(t, q='{"line":[{"op":"|~","v":"[0-9]{3} 555-[0-9]+"}]}'),
        "label_eq": lambda: search(e, q=label, label_of=base.NATIVE),
        "label_eq_store": lambda: store.search(q=label).rows,
        "label_miss_store": lambda: store.search(q=label.replace("ERROR", "NONE")).rows,
        "label_eq_store_no_index": lambda: store.search(q=label, use_index=False).rows,
        "time_range_store": lambda: store.search(start=EPOCH_2024, end=EPOCH_2024 + 14 * DAY).rows,
        "tail_100": lambda: tail(search(e), 100),
        "tokenize": lambda: base.QUERIES["tokenize"](spark, SF),
        "block_meta": lambda: base.QUERIES["block_meta"](spark, SF),
    }
    took = {}
    for name, run in runs.items():
        run().write.format("noop").mode("overwrite").save()  # warm
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    store.compact()
    took["compact_4_parts"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
