"""Sources of entries: request bodies, rows of another database, write-ahead logs. OTLP is in otlp.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "timestamp long, data string"
ENVELOPE = f"data array<struct<{ENTRY.replace('timestamp long', 'timestamp:bigint').replace('data string', 'data:string')}>>"

# Columns of the importer's rows, in the order in which they are written; fixed values.
IMPORT_COLUMNS = ["service_instance_id", "service_name", "service_namespace", "severity_number", "severity_text", "trace_id", "span_id", "trace_flags", "body", "attribute", "resource", "scope_name", "scope_version", "scope"]


def envelope_rows(bodies: DataFrame) -> DataFrame:
    """Entries of {"data": [...]} bodies; missing fields are 0 and empty."""
    rows = bodies.select(F.inline("data"))
    return rows.select(F.coalesce("timestamp", F.lit(0)).alias("timestamp"), F.coalesce("data", F.lit("")).alias("data"))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Files of one body each, plain or compressed; other keys are passed over."""
    return envelope_rows(spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "FAILFAST").json(path))


def import_rows(logs: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of a table with a `timestamp` and the importer's columns (those it has)."""
    rows = logs.where(F.col("timestamp") >= F.lit(since).cast("timestamp")) if since else logs
    if limit:  # any so many rows, as the source gives them
        rows = rows.limit(limit)
    hexed = {"trace_id", "span_id"}
    kinds = dict(logs.dtypes)
    shown = lambda c: F.lower(F.hex(c)) if c in hexed and kinds[c] == "binary" else F.col(c)
    data = F.to_json(F.struct(*(shown(c).alias(c) for c in IMPORT_COLUMNS if c in kinds)))
    return rows.select((F.unix_micros("timestamp") * 1000).alias("timestamp"), data.alias("data"))


def read_jdbc(spark: SparkSession, url: str, table: str = "logs", since: str | None = None, limit: int | None = None, **options: str) -> DataFrame:
    """import_rows of a table behind JDBC; give partitionColumn and its bounds to read in parallel."""
    return import_rows(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), since, limit)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of write-ahead logs, a JSON object a line; damaged lines are dropped."""
    rows = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path)
    return rows.where("timestamp is not null or data is not null").select(F.coalesce("timestamp", F.lit(0)).alias("timestamp"), F.coalesce("data", F.lit("")).alias("data"))


def read_index_wal(spark: SparkSession, path: str) -> DataFrame:
    """Postings (token, data_id) of write-ahead logs of an index; damaged lines are dropped, each pair is there once."""
    rows = spark.read.schema("token string, data_id string").option("mode", "DROPMALFORMED").json(path)
    return rows.where("token is not null and data_id is not null").distinct()


def write_blocks(entries: DataFrame, path: str, codec: str = "none") -> None:
    """Lines of JSON, plain or compressed, as older stores keep them."""
    if codec not in ("none", "gzip", "zstd"):
        raise ValueError(f"unknown compression: {codec}")
    entries.select("timestamp", "data").write.option("compression", codec).json(path)


def formatted(data: Column, timestamp: Column) -> Column:
    """A line for reading: time, severity, body and what else a structured line has."""
    get = lambda k: F.coalesce(F.get_json_object(data, f"$.{k}"), F.lit(""))
    more = lambda name, k: F.when(~get(k).isin("", "{}"), F.concat(F.lit(f"{name}: "), get(k)))
    extra = F.concat_ws(", ", more("attrs", "attributes"), more("resource", "resource"), more("trace_id", "trace_id"), more("span_id", "span_id"))
    severity = F.when(get("severity_text") == "", "INFO").otherwise(get("severity_text"))
    line = F.concat(timestamp.cast("string"), F.lit(" ["), severity, F.lit("] "), get("body"), F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))
    return F.when((get("body") != "") | (get("severity_text") != ""), line).otherwise(F.concat_ws(" ", timestamp.cast("string"), data))
