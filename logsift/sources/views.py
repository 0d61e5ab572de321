"""The two views of the test tables: structured entries of events, plain ones of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_2024 = 1_704_067_200_000_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in any session time zone."""
    day, rest = F.unix_date(ts.cast("date")).cast("long"), F.hour(ts) * 3600 + F.minute(ts) * 60
    return day * 86_400_000_000 + rest.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, timestamp, data): JSON lines with severity, body, resource and attributes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    data = F.concat(
        F.lit('{"severity_text":"'), F.upper("event_type"), F.lit('","body":"'), F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string"),
        F.lit('","resource":{"service.name":"svc-'), (F.col("user_id") % 5).cast("string"), F.lit('"},"attributes":'), F.coalesce("props", F.lit("{}")), F.lit("}"),
    )
    return e.select("event_id", (micros(F.col("ts").cast("timestamp_ntz")) * 1000).alias("timestamp"), data.alias("data"))


def text_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, timestamp, data): one second a document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", (F.lit(EPOCH_2024) + F.col("doc_id") * 1_000_000_000).alias("timestamp"), F.col("text").alias("data"))


#: The same views in DuckDB's SQL.
VIEWS_SQL = f"""WITH entries AS (
  SELECT event_id, epoch_us(ts) * 1000 AS "timestamp",
    '{{"severity_text":"' || upper(event_type) || '","body":"' || event_type || ' of user ' || user_id || '","resource":{{"service.name":"svc-' || (user_id % 5) || '"}},"attributes":' || coalesce(props, '{{}}') || '}}' AS data,
    upper(event_type) AS level, 'svc-' || (user_id % 5) AS service, CAST(json_extract(props, '$.k') AS VARCHAR) AS k
  FROM events),
text_entries AS (SELECT doc_id, {EPOCH_2024} + doc_id * 1000000000 AS "timestamp", text AS data FROM documents)
"""
