"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.labels import labels_column, native_label
from logsift.functions.text import has_tokens, tokens
from logsift.operators import layout as L
from logsift.operators.search import head, in_order, matching, search, tail, token_gated, token_sets
from logsift.sources import ingest, otlp
from logsift.sources.views import EPOCH_2024, VIEWS_SQL, entries, text_entries

DAY = 86_400_000_000_000
FROM, TO = EPOCH_2024, EPOCH_2024 + 14 * DAY - 1
NATIVE = lambda k: native_label(F.col("data"), k)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name; `sql` follows the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = VIEWS_SQL + sql
        return f

    return put


def _by_search(name: str, view: Callable, sql: str, **q) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(view(spark, sf_dir), label_of=NATIVE, **q)

    QUERIES[name] = run
    table = "entries" if view is entries else "text_entries"
    ORACLE_SQL[name] = VIEWS_SQL + f'SELECT "timestamp", data FROM {table} WHERE {sql}'


FOLD = "translate(data, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OPEN = '"timestamp" BETWEEN 0 AND 4611686018427387904'
_by_search("time_range", entries, f'"timestamp" BETWEEN {FROM} AND {TO}', start=FROM, end=TO)
_by_search("time_point_inclusive", text_entries, f'"timestamp" = {EPOCH_2024 + 7 * 10**9}', start=EPOCH_2024 + 7 * 10**9, end=EPOCH_2024 + 7 * 10**9)
_by_search("time_open_bounds", entries, OPEN)
# "nonexistent-term" and "test-service" below are fixed values, as the published tests have them.
for _name, _term in (("term_search", "license"), ("term_case_fold", "LiCeNsE"), ("term_multiword", "the and"), ("term_miss", "nonexistent-term"), ("term_non_ascii", "É"), ("term_part_of_token", "icens")):
    _by_search(_name, text_entries, f"contains({FOLD}, '{_term.lower()}')", term=_term)
_by_search("term_empty", text_entries, OPEN, term="")
_by_search("line_eq", text_entries, "contains(data, 'License')", q='{"line":[{"op":"|=","v":"License"}]}')
_by_search("line_ne", text_entries, "NOT contains(data, 'the')", q='{"line":[{"op":"!=","v":"the"}]}')
_by_search("line_re", text_entries, r"regexp_matches(data, '[0-9]{3} 555-[0-9]+|licen[sc]e')", q=r'{"line":[{"op":"|~","v":"[0-9]{3} 555-[0-9]+|licen[sc]e"}]}')
_by_search("line_re_end", text_entries, r"regexp_matches(data, '[[:alpha:]]+\.$')", q=r'{"line":[{"op":"re","v":"[[:alpha:]]+\\.$"}]}')
_by_search("line_nre", text_entries, "NOT regexp_matches(data, 'th[aeo]')", q='{"line":[{"op":"!~","v":"th[aeo]"}]}')
_by_search("line_multi_and", text_entries, "contains(data, 'the') AND NOT contains(data, 'and') AND regexp_matches(data, 'er')", q='{"line":[{"op":"|=","v":"the"},{"op":"!=","v":"and"},{"op":"|~","v":"er"}]}')
_by_search("label_eq", entries, "level = 'ERROR'", q='{"labels":[{"l":"level","op":"eq","v":"ERROR"}]}')
_by_search("label_eq_resource", entries, "service = 'svc-1'", q='{"labels":[{"l":"service_name","op":"eq","v":"svc-1"}]}')
_by_search("label_ne", entries, "level <> 'CLICK'", q='{"labels":[{"l":"level","op":"ne","v":"CLICK"}]}')
_by_search("label_re", entries, "regexp_full_match(level, 'P.*|VI.W')", q='{"labels":[{"l":"level","op":"re","v":"P.*|VI.W"}]}')
_by_search("label_nre", entries, "NOT regexp_full_match(level, 'P.*')", q='{"labels":[{"l":"level","op":"nre","v":"P.*"}]}')
_by_search("label_attribute", entries, "coalesce(k, '') = '69'", q='{"labels":[{"l":"k","op":"eq","v":"69"}]}')
_by_search("label_missing_eq_empty", entries, OPEN, q='{"labels":[{"l":"none","op":"eq","v":""}]}')
_by_search("label_missing_ne_empty", entries, "1 = 0", q='{"labels":[{"l":"none","op":"ne","v":""}]}')
_by_search("label_missing_re", entries, OPEN, q='{"labels":[{"l":"none","op":"re","v":".*"}]}')
_by_search("matcher_combined", entries, "contains(data, 'user 1') AND service = 'svc-2' AND regexp_full_match(level, 'C.*')", q='{"line":[{"op":"|=","v":"user 1"}],"labels":[{"l":"service_name","op":"eq","v":"svc-2"},{"l":"level","op":"re","v":"C.*"}]}')
_by_search("matcher_empty", entries, OPEN, q="{}")
_by_search("term_ignored_when_q", text_entries, "contains(data, 'License')", term="nonexistent", q='{"line":[{"op":"|=","v":"License"}]}')


@query("SELECT \"timestamp\", data FROM entries WHERE level = 'PURCHASE' AND \"timestamp\" BETWEEN {0} AND {1}".format(FROM, TO))
def label_eq_exact(spark, sf_dir):
    """Through the exact extractor, on the lines that are left by the time range."""
    return search(entries(spark, sf_dir), start=FROM, end=TO, q='{"labels":[{"l":"level","op":"eq","v":"PURCHASE"}]}')


@query("""SELECT event_id, unnest(['level', 'service_name', 'body', 'k']) AS key, unnest([level, service, json_extract_string(data, '$.body'), k]) AS value FROM entries WHERE k IS NOT NULL
UNION ALL SELECT event_id, unnest(['level', 'service_name', 'body']), unnest([level, service, json_extract_string(data, '$.body')]) FROM entries WHERE k IS NULL""")
def extract_labels_long(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("event_id", F.explode(labels_column(e)).alias("key", "value"))


@query("""SELECT * FROM (VALUES (1, 'a_b', 'r2'), (1, 'x', 'a1'), (1, 'n', '1.50'), (1, 'level', 'WARN'), (2, 'k', '{"v" : 1}')) t(id, key, value)""")
def label_precedence(spark, sf_dir):
    rows = [
        (1, '{"a.b":"t","x":"t","resource":{"a.b":"r1","a_b":"r2"},"attributes":{"x":"a1","x":"a2","a_b":"a"},"n":1.50,"no":true,"level":"t","severity_text":"WARN"}'),
        (2, '{"resource":"{\\"k\\":{\\"v\\" : 1}}"}'),
        (3, "plain"),
    ]
    df = spark.createDataFrame(rows, "id int, data string")
    return df.select("id", F.explode(labels_column(df)).alias("key", "value"))


TOKENS_SQL = r"list_transform(list_filter(regexp_split_to_array(data, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x))"


@query(f"SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM text_entries")
def tokenize(spark, sf_dir):
    t = text_entries(spark, sf_dir).withColumn("t", tokens(F.col("data")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def _parts(spark, sf_dir):
    """text_entries in parts of 250 documents."""
    return text_entries(spark, sf_dir).withColumn("part", F.floor(F.col("doc_id") / 250))


def _entry_parts(spark, sf_dir):
    return entries(spark, sf_dir).withColumn("part", F.floor(F.col("event_id") / 1000))


PARTS = "doc_id // 250 AS part"
TOKEN_SETS = f"""sets AS (SELECT part, count(DISTINCT token) AS n, CASE WHEN count(DISTINCT token) > 10000 THEN '' ELSE string_agg(DISTINCT token, ' ' ORDER BY token) END AS tokens
  FROM (SELECT {PARTS}, unnest({TOKENS_SQL}) AS token FROM text_entries) GROUP BY part)"""


@query(f", {TOKEN_SETS} SELECT part, tokens, n > 10000 AS tokens_truncated FROM sets")
def token_set_per_part(spark, sf_dir):
    s = token_sets(_parts(spark, sf_dir), "part")
    return s.select("part", F.array_join("tokens", " ").alias("tokens"), "tokens_truncated")


@query(f", {TOKEN_SETS} SELECT \"timestamp\", data FROM text_entries WHERE contains({FOLD}, 'license') AND doc_id // 250 IN (SELECT part FROM sets WHERE n > 10000 OR list_contains(string_split(tokens, ' '), 'license'))")
def term_token_gated(spark, sf_dir):
    return token_gated(_parts(spark, sf_dir), "part", "license").select("timestamp", "data")


@query(f"SELECT doc_id FROM text_entries WHERE list_contains({TOKENS_SQL}, 'the') AND list_contains({TOKENS_SQL}, 'and') OR len({TOKENS_SQL}) = 0")
def has_token(spark, sf_dir):
    return text_entries(spark, sf_dir).where(has_tokens(F.array_distinct(tokens(F.col("data"))), "the-AND")).select("doc_id")


@query('SELECT event_id // 1000 AS part, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp, count(*) AS "count" FROM entries GROUP BY 1')
def part_meta(spark, sf_dir):
    return L.part_meta(_entry_parts(spark, sf_dir), "part")


NUMBERED = 'numbered AS (SELECT *, event_id // 1000 AS part, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY "timestamp", event_id) - 1 AS idx FROM entries)'


@query(f', {NUMBERED} SELECT part, idx // 512 AS block, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp, count(*) AS "count" FROM numbered GROUP BY 1, 2')
def block_meta(spark, sf_dir):
    return L.block_meta(_entry_parts(spark, sf_dir), "part", "event_id")


POSTINGS = "postings AS (SELECT DISTINCT 'lbl:' || key || '=' || value AS token, event_id // 1000 AS data_id FROM (SELECT event_id, unnest(['level', 'service_name', 'k']) AS key, unnest([level, service, k]) AS value FROM entries) WHERE value IS NOT NULL)"


def _postings(spark, sf_dir):
    e = _entry_parts(spark, sf_dir)
    labels = F.map_from_arrays(F.array(*map(F.lit, ("level", "service_name", "k"))), F.array(*map(NATIVE, ("level", "service_name", "k"))))
    return L.postings(e, "part", labels)


@query(f", {POSTINGS} SELECT token, data_id FROM postings")
def label_postings(spark, sf_dir):
    return _postings(spark, sf_dir)


WANTED = ["lbl:level=ERROR", "lbl:k=69", "lbl:service_name=svc-1"]


@query(f", {POSTINGS} SELECT data_id FROM postings WHERE token IN ('lbl:level=ERROR', 'lbl:k=69', 'lbl:service_name=svc-1') GROUP BY data_id HAVING count(*) = 3")
def postings_intersect(spark, sf_dir):
    return L.parts_with_all(_postings(spark, sf_dir), WANTED)


@query(f'SELECT part, min_timestamp, max_timestamp, "count" FROM (SELECT event_id // 1000 AS part, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp, count(*) AS "count" FROM entries GROUP BY 1) WHERE max_timestamp >= {FROM} AND min_timestamp <= {FROM + DAY}')
def part_prune_time(spark, sf_dir):
    return L.overlapping(L.part_meta(_entry_parts(spark, sf_dir), "part"), FROM, FROM + DAY)


@query(f", {POSTINGS} SELECT \"timestamp\", data FROM entries WHERE k = '69' AND event_id // 1000 IN (SELECT data_id FROM postings WHERE token = 'lbl:k=69')")
def part_prune_postings(spark, sf_dir):
    kept = L.parts_with_all(_postings(spark, sf_dir), ["lbl:k=69"]).withColumnRenamed("data_id", "part")
    e = _entry_parts(spark, sf_dir).join(kept, "part", "left_semi")
    return search(e, q='{"labels":[{"l":"k","op":"eq","v":"69"}]}', label_of=NATIVE)


@query("SELECT DISTINCT event_id // 1000 AS part FROM entries WHERE (event_id // 1000) % 3 = 0")
def coverage_missing(spark, sf_dir):
    parts = _entry_parts(spark, sf_dir).select("part").distinct()
    return parts.join(parts.where("part % 3 <> 0"), "part", "left_anti")


@query(f"""SELECT count(*) AS entries_scanned, count(*) FILTER (WHERE contains({FOLD}, 'license')) AS entries_matched,
  count(DISTINCT doc_id // 250) AS parts_scanned FROM text_entries""")
def query_stats(spark, sf_dir):
    from logsift.functions.text import has_term

    return _parts(spark, sf_dir).agg(F.count("*").alias("entries_scanned"), F.count_if(has_term(F.col("data"), "license")).alias("entries_matched"), F.countDistinct("part").alias("parts_scanned"))


@query(f"SELECT \"timestamp\", data FROM entries WHERE level = 'ERROR' ORDER BY 1, 2")
def sorted_query(spark, sf_dir):
    return in_order(matching(entries(spark, sf_dir), q='{"labels":[{"l":"level","op":"eq","v":"ERROR"}]}', label_of=NATIVE).select("timestamp", "data"))


for _n in (1, 100):
    QUERIES[f"tail_{_n}"] = lambda spark, sf_dir, n=_n: tail(search(entries(spark, sf_dir)), n)
    ORACLE_SQL[f"tail_{_n}"] = VIEWS_SQL + f'SELECT * FROM (SELECT "timestamp", data FROM entries ORDER BY 1 DESC, 2 DESC LIMIT {_n}) ORDER BY 1, 2'


@query('SELECT "timestamp", data FROM entries ORDER BY 1, 2 LIMIT 25')
def head_25(spark, sf_dir):
    return head(search(entries(spark, sf_dir)), 25)


@query(f', {NUMBERED} SELECT "timestamp", part, idx FROM numbered ORDER BY "timestamp", part, idx')
def kway_merge_order(spark, sf_dir):
    return L.merged(_entry_parts(spark, sf_dir), "part", "event_id").select("timestamp", "part", F.col("idx").cast("long").alias("idx"))


@query("SELECT \"timestamp\", data FROM entries WHERE contains(data, 'user 7')")
def union_hot_cold(spark, sf_dir):
    e = entries(spark, sf_dir)
    q = '{"line":[{"op":"|=","v":"user 7"}]}'
    return search(e.where("event_id % 10 <> 0"), q=q).unionByName(search(e.where("event_id % 10 = 0"), q=q))


@query("""SELECT part, level, min_timestamp, max_timestamp FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n, row_number() OVER (PARTITION BY level ORDER BY min_timestamp, part) AS rn
  FROM (SELECT event_id // 500 AS part, (event_id // 500) % 3 AS level, min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp FROM entries GROUP BY 1, 2)) WHERE n >= 4 AND rn <= 4""")
def compaction_candidates(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("part_id", F.floor(F.col("event_id") / 500))
    parts = L.part_meta(e, "part_id").withColumn("level", F.col("part_id") % 3)
    return L.compaction_candidates(parts).select(F.col("part_id").alias("part"), "level", "min_timestamp", "max_timestamp")


@query('SELECT "timestamp", data FROM text_entries')
def compaction_equivalence(spark, sf_dir):
    """The rows of a store after flushes, compaction and a search without bounds."""
    from logsift.plans.store import LogStore
    from logsift.session import shared_dir

    store = LogStore(spark, shared_dir(spark, "store"))
    t = text_entries(spark, sf_dir)
    for k in range(5):
        store.append(t.where(F.col("doc_id") % 5 == k), str(k))
    store.compact(force=True)
    return store.search().rows


@query("""SELECT "timestamp", data FROM entries WHERE service = 'svc-3'""")
def store_label_search(spark, sf_dir):
    """Through a store with an index of labels."""
    from logsift.plans.store import LogStore
    from logsift.session import shared_dir

    store = LogStore(spark, shared_dir(spark, "store"))
    e = entries(spark, sf_dir)
    for k in range(5):
        store.append(e.where(F.get_json_object("data", "$['resource']['service.name']") == f"svc-{k}"), str(k))
    return store.search(q='{"labels":[{"l":"service_name","op":"eq","v":"svc-3"}]}').rows


def _log(spark, sf_dir):
    """A log in which every fifth entry merges the four before."""
    e = entries(spark, sf_dir).select(F.col("event_id").alias("index")).where("index % 7 <> 3")
    merge = F.col("index") % 5 == 4
    old = F.when(merge, F.transform(F.sequence(F.col("index") - 4, F.col("index") - 1), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select("index", F.when(merge, "MERGE").otherwise("PUT").alias("op"), F.concat(F.lit("p"), F.col("index").cast("string")).alias("part_id"), old.alias("old_parts"))


@query("SELECT 'p' || event_id AS part_id FROM entries WHERE event_id % 7 <> 3 AND NOT (event_id % 5 <> 4 AND (event_id - event_id % 5 + 4) % 7 <> 3 AND event_id - event_id % 5 + 4 IN (SELECT event_id FROM entries))")
def log_replay_active_parts(spark, sf_dir):
    return L.active_parts(_log(spark, sf_dir))


@query('SELECT event_id AS "after" FROM entries e WHERE event_id % 7 = 2 AND event_id + 2 <= (SELECT max(event_id) FROM entries WHERE event_id % 7 <> 3)')
def log_gap(spark, sf_dir):
    return L.log_gaps(_log(spark, sf_dir))


@query("SELECT 'n' || c_custkey AS node_id, c_custkey * 37 % 1001 AS pointer FROM customer ORDER BY 2, 1 LIMIT 1")
def log_cleanup_min_pointer(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return L.least_pointer(c.select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node_id"), (F.col("c_custkey") * 37 % 1001).alias("pointer")))


@query("SELECT DISTINCT event_id // 100 AS part_id FROM entries WHERE (event_id // 100) % 4 <> 0 AND (event_id // 100) * 3 < 90")
def gc_stale(spark, sf_dir):
    files = entries(spark, sf_dir).select(F.floor(F.col("event_id") / 100).alias("part_id")).distinct().withColumn("mtime", F.col("part_id") * 3)
    return L.stale_files(files, files.where("part_id % 4 = 0").select("part_id"), 90).select("part_id")


@query(f', {NUMBERED} SELECT part, "timestamp" AS ts, idx FROM numbered WHERE idx % 32 = 0')
def sparse_sample(spark, sf_dir):
    return L.sparse_samples(_entry_parts(spark, sf_dir), "part", "event_id")


@query(f""", {NUMBERED}, s AS (SELECT part, "timestamp" AS ts, idx FROM numbered WHERE idx % 32 = 0)
SELECT part, coalesce(max(idx) FILTER (WHERE ts < {FROM + 3 * DAY}), 0) AS lo, coalesce(min(idx) FILTER (WHERE ts > {FROM + 9 * DAY}), 2147483647) AS hi FROM s GROUP BY part""")
def sparse_range(spark, sf_dir):
    samples = L.sparse_samples(_entry_parts(spark, sf_dir), "part", "event_id")
    r = L.sparse_range(samples, "part", FROM + 3 * DAY, FROM + 9 * DAY)
    return r.select("part", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query("""SELECT "timestamp", data FROM (VALUES (5::BIGINT, 'a'), (0::BIGINT, 'b'), (7::BIGINT, '')) t("timestamp", data)""")
def envelope_ingest(spark, sf_dir):
    body = spark.createDataFrame([('{"x":1,"data":[{"timestamp":5,"data":"a","y":[]},{"data":"b"},{"timestamp":7}]}',)], "body string")
    return ingest.envelope_rows(body.select(F.from_json("body", ingest.ENVELOPE).alias("b")).select("b.data"))


OTLP_BODY = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"test-service"}}]},"scopeLogs":[{"scope":{},"logRecords":[{"timeUnixNano":"1700000000000000001","severityText":"INFO","body":{"stringValue":"say \\"hi\\""},"attributes":[{"key":"n","value":{"intValue":"3"}}],"traceId":"0AF7"},{"observedTimeUnixNano":"9","body":{"boolValue":true}}]}]}]}'


@query("""SELECT * FROM (VALUES (1700000000000000001::BIGINT, '{"timestamp":1700000000000000001,"severity_text":"INFO","body":"say \\"hi\\"","attributes":{"n":3},"trace_id":"0af7","resource":{"service.name":"test-service"},"scope":{}}'),
  (9::BIGINT, '{"timestamp":0,"observed_timestamp":9,"body":true,"resource":{"service.name":"test-service"},"scope":{}}')) t("timestamp", data)""")
def otlp_flatten(spark, sf_dir):
    return otlp.otlp_rows(spark.createDataFrame([(OTLP_BODY,)], "body string"))


#: A request for each event: values of all kinds, nested, and in each seventh a number that JSON hasn't.
_OTLP = """'{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-' || (user_id % 5) || '"}}]},"scopeLogs":[{"scope":{"name":"lib","version":"1"},"logRecords":[{"timeUnixNano":"' || (event_id + 1) || '","severityText":"' || upper(event_type) || '","body":{"kvlistValue":{"values":[{"key":"id","value":{"intValue":"' || event_id || '"}},{"key":"list","value":{"arrayValue":{"values":[{"boolValue":true},{"stringValue":"a"},{}]}}},{"key":"raw","value":{"bytesValue":"aGk="}}]}},"attributes":[{"key":"x","value":{"doubleValue":' || CASE WHEN event_id % 7 = 3 THEN '"NaN"' ELSE '0.5' END || '}}],"flags":1}]}]}]}'"""


@query("""SELECT event_id + 1 AS "timestamp", '{"timestamp":' || (event_id + 1) || ',"severity_text":"' || upper(event_type) || '","body":{"id":' || event_id || ',"list":[true,"a",null],"raw":"aGk="},"attributes":{"x":0.5},"flags":1,"resource":{"service.name":"svc-' || (user_id % 5) || '"},"scope":{"name":"lib","version":"1"}}' AS data FROM events WHERE event_id % 7 <> 3""")
def otlp_any_values(spark, sf_dir):
    return otlp.otlp_rows(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_OTLP).alias("body")))


@query("""SELECT epoch_us(ts) * 1000 AS "timestamp", '{"service_name":"svc-' || (user_id % 5) || '","severity_text":"' || upper(event_type) || '","trace_id":"' || lower(hex(CAST(event_id AS VARCHAR))) || '","body":"' || event_type || '"}' AS data FROM events""")
def import_row_json(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    from logsift.sources.views import micros

    rows = e.select(
        F.timestamp_micros(micros(F.col("ts").cast("timestamp_ntz"))).alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.upper("event_type").alias("severity_text"),
        F.encode(F.col("event_id").cast("string"), "utf-8").alias("trace_id"),
        F.col("event_type").alias("body"),
    )
    return ingest.import_rows(rows)


@query('SELECT "timestamp", data FROM entries')
def wal_replay(spark, sf_dir):
    """Entries written as JSON lines with damaged ones between, and read back."""
    from logsift.session import shared_dir

    path = shared_dir(spark, "wal")
    lines = entries(spark, sf_dir).select(F.to_json(F.struct("timestamp", "data")).alias("value"))
    lines.unionByName(spark.createDataFrame([('{"timestamp": 5, "da',), ("#",)], "value string")).write.text(path)
    return ingest.read_wal(spark, path)


@query(f", {POSTINGS} SELECT token, CAST(data_id AS VARCHAR) AS data_id FROM postings")
def index_wal_replay(spark, sf_dir):
    """Postings written twice as JSON lines with damaged ones between, and read back."""
    from logsift.session import shared_dir

    path = shared_dir(spark, "index-wal")
    lines = _postings(spark, sf_dir).select(F.to_json(F.struct("token", F.col("data_id").cast("string").alias("data_id"))).alias("value"))
    lines.unionByName(lines).unionByName(spark.createDataFrame([('{"token": "lbl:',), ("#",)], "value string")).write.text(path)
    return ingest.read_index_wal(spark, path)


@query("""SELECT event_id, "timestamp" || ' [' || level || '] ' || json_extract_string(data, '$.body') || ' (' || CASE WHEN CAST(json_extract(data, '$.attributes') AS VARCHAR) <> '{}' THEN 'attrs: ' || CAST(json_extract(data, '$.attributes') AS VARCHAR) || ', ' ELSE '' END || 'resource: ' || CAST(json_extract(data, '$.resource') AS VARCHAR) || ')' AS line FROM entries""")
def format_entry(spark, sf_dir):
    return entries(spark, sf_dir).select("event_id", ingest.formatted(F.col("data"), F.col("timestamp")).alias("line"))


# The store, over four parts


def _filled(spark: SparkSession, rows: DataFrame):
    """A new store with a batch for each of the parts 0 to 3 of rows(timestamp, data, part)."""
    from logsift.plans.store import LogStore
    from logsift.session import shared_dir

    store = LogStore(spark, shared_dir(spark, "store"))
    for k in range(4):
        store.append(rows.where(F.col("part") == k), str(k))
    return store


@query(f'SELECT "timestamp", data FROM text_entries WHERE contains({FOLD}, \'icens\')')
def store_term_search(spark, sf_dir):
    """A term and a part of it, before and after a compaction; parts are skipped by their 3-grams."""
    store = _filled(spark, text_entries(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("data"), F.lit(4))))
    before = store.search(term="ICENS").rows
    store.compact()
    return before.unionByName(store.search(term="license").rows).distinct()


@query("""SELECT 4 AS parts_total, 0 AS parts_pruned_by_ts, count(*) FILTER (WHERE found = 0) AS parts_pruned_by_index, count(*) FILTER (WHERE found > 0) AS parts_scanned,
  coalesce(sum(n) FILTER (WHERE found > 0), 0) AS entries_scanned, sum(found) AS entries_matched
  FROM (SELECT event_id // 250 AS part, count(*) AS n, count(*) FILTER (WHERE k = '69') AS found FROM entries WHERE event_id < 1000 GROUP BY 1)""")
def stats_json(spark, sf_dir):
    """Counters of a label search, from the response."""
    import json

    e = entries(spark, sf_dir).where("event_id < 1000").withColumn("part", F.floor(F.col("event_id") / 250))
    stats = json.loads("".join(_filled(spark, e).search(q='{"labels":[{"l":"k","op":"eq","v":"69"}]}').to_json()))["stats"]
    names = ["parts_total", "parts_pruned_by_ts", "parts_pruned_by_index", "parts_scanned", "entries_scanned", "entries_matched"]
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f", {POSTINGS} SELECT DISTINCT token FROM postings")
def store_index_compaction(spark, sf_dir):
    """Label postings after parts were merged and their postings compacted into one folder."""
    store = _filled(spark, entries(spark, sf_dir).withColumn("part", F.col("event_id") % 4))
    (part,) = store.compact()
    store.append(entries(spark, sf_dir).limit(1), "more")
    store.compact_index()
    rows = store._postings_of([p for p in store.parts() if p.part_id == part.part_id])
    return rows.where(F.col("token").rlike("^lbl:(level|service_name|k)=") & (F.col("data_id") == part.part_id)).select("token")


@query('SELECT "timestamp", data FROM entries')
def store_after_truncation(spark, sf_dir):
    """All rows of a store whose log was cut off behind its snapshot."""
    store = _filled(spark, entries(spark, sf_dir).withColumn("part", F.col("event_id") % 4))
    store.compact()
    store.snapshot()
    store.truncate_log()
    return store.search().rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two weeks, by label."""
    return search(entries(spark, sf_dir), start=FROM, end=TO, q='{"labels":[{"l":"level","op":"eq","v":"ERROR"}]}', label_of=NATIVE)
