"""Parts, blocks, postings and samples, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, SAMPLE_EVERY, OPEN_END = 512, 32, 2**31 - 1


def part_meta(entries: DataFrame, part: str) -> DataFrame:
    return entries.groupBy(part).agg(F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"), F.count("*").alias("count"))


def numbered(entries: DataFrame, part: str, *ties: str) -> DataFrame:
    """Rows with `idx`, their place in time order within their part."""
    return entries.withColumn("idx", F.row_number().over(Window.partitionBy(part).orderBy("timestamp", *ties)) - 1)


def block_meta(entries: DataFrame, part: str, *ties: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Time range and size of each block of `rows` rows; the last of a part may be short."""
    blocks = numbered(entries, part, *ties).withColumn("block", F.floor(F.col("idx") / rows))
    return blocks.groupBy(part, "block").agg(F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"), F.count("*").alias("count"))


def overlapping(parts: DataFrame, start: int, end: int) -> DataFrame:
    return parts.where((F.col("max_timestamp") >= start) & (F.col("min_timestamp") <= end))


def postings(entries: DataFrame, part: str, labels: Column) -> DataFrame:
    """Distinct (token, data_id), a token being `lbl:key=value`."""
    pairs = entries.select(F.col(part).alias("data_id"), F.explode(labels).alias("k", "v"))
    return pairs.where(F.col("v").isNotNull()).select(F.concat(F.lit("lbl:"), "k", F.lit("="), "v").alias("token"), "data_id").distinct()


def parts_with_all(index: DataFrame, wanted: list[str]) -> DataFrame:
    """data_ids that are posted under every wanted token."""
    wanted = sorted(set(wanted))
    hits = index.where(F.col("token").isin(wanted)).dropDuplicates(["token", "data_id"])
    return hits.groupBy("data_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("data_id")


def sparse_samples(entries: DataFrame, part: str, *ties: str, every: int = SAMPLE_EVERY) -> DataFrame:
    return numbered(entries, part, *ties).where(F.col("idx") % every == 0).select(part, F.col("timestamp").alias("ts"), F.col("idx").cast("long").alias("idx"))


def sparse_range(samples: DataFrame, part: str, start: int, end: int) -> DataFrame:
    """Row numbers that hold all of start..end for sure: from the last sample before, to the first after."""
    return samples.groupBy(part).agg(
        F.coalesce(F.max(F.when(F.col("ts") < start, F.col("idx"))), F.lit(0)).alias("lo"),
        F.coalesce(F.min(F.when(F.col("ts") > end, F.col("idx"))), F.lit(OPEN_END)).alias("hi"),
    )


def merged(entries: DataFrame, part: str, *ties: str) -> DataFrame:
    """Parts merged by time; of one time by part, then by place in the part."""
    return numbered(entries, part, *ties).orderBy("timestamp", part, "idx")


def active_parts(log: DataFrame) -> DataFrame:
    """Replays log(index, op, part_id, old_parts): PUT adds a part, MERGE takes the old ones away and adds one."""
    gone = log.where("op = 'MERGE'").select(F.explode("old_parts").alias("part_id")).distinct()
    return log.select("part_id").distinct().join(gone, "part_id", "left_anti")


def log_gaps(log: DataFrame) -> DataFrame:
    """Places where the log's index jumps. Neighbours are found by a join, not by a window over all rows."""
    after = log.select((F.col("index") - 1).alias("index"))
    ends = log.select("index").join(after, "index", "left_anti").select(F.col("index").alias("after"))
    last = log.agg(F.max("index").alias("last"))
    return ends.join(F.broadcast(last), F.col("after") < F.col("last")).select("after")


def least_pointer(pointers: DataFrame) -> DataFrame:
    """The node that lags most; of several, the first by id."""
    return pointers.orderBy("pointer", "node_id").limit(1)


def stale_files(files: DataFrame, active: DataFrame, before: int) -> DataFrame:
    """Files of no active part that were last changed before a time."""
    return files.join(active, "part_id", "left_anti").where(F.col("mtime") < before)


def compaction_candidates(parts: DataFrame, fan_in: int = 4) -> DataFrame:
    """The oldest `fan_in` parts of each level that has at least so many."""
    w = Window.partitionBy("level")
    ranked = parts.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy("min_timestamp", "part_id"))})
    return ranked.where((F.col("n") >= fan_in) & (F.col("rn") <= fan_in)).drop("n", "rn")
