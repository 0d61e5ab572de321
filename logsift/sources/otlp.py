"""OTLP log requests, as JSON or protobuf, to entries: one JSON line a record.

Values are of any kind and nest without bound, which no Spark schema can say, so requests are
walked in Arrow batches. A record with a number that JSON hasn't (NaN, infinity) is passed over, as is
one that isn't what the protocol says; a request that can't be read at all is an error. A record's time is its
own, else when it was observed, else now.
"""

from __future__ import annotations

import base64
import gzip
import json
import math
import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import ship_package

ENTRY = "timestamp long, data string"
MOST_BYTES = 32 << 20  # of a request, unpacked

# Fields of the protocol's messages by number, each with a name as in its JSON form and a kind; fixed values.
ANY = {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "int"), 4: ("doubleValue", "double"), 5: ("arrayValue", "ARRAY"), 6: ("kvlistValue", "PAIRS"), 7: ("bytesValue", "bytes")}
ARRAY = {1: ("values", "ANY*")}
PAIR = {1: ("key", "text"), 2: ("value", "ANY")}
PAIRS = {1: ("values", "PAIR*")}
RESOURCE = {1: ("attributes", "PAIR*")}
SCOPE = {1: ("name", "text"), 2: ("version", "text"), 3: ("attributes", "PAIR*")}
RECORD = {1: ("timeUnixNano", "fixed"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", "ANY"), 6: ("attributes", "PAIR*"), 8: ("flags", "fixed"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed")}
SCOPE_LOGS = {1: ("scope", "SCOPE"), 2: ("logRecords", "RECORD*")}
RESOURCE_LOGS = {1: ("resource", "RESOURCE"), 2: ("scopeLogs", "SCOPE_LOGS*")}
REQUEST = {1: ("resourceLogs", "RESOURCE_LOGS*")}
MESSAGES = {"ANY": ANY, "ARRAY": ARRAY, "PAIR": PAIR, "PAIRS": PAIRS, "RESOURCE": RESOURCE, "SCOPE": SCOPE, "RECORD": RECORD, "SCOPE_LOGS": SCOPE_LOGS, "RESOURCE_LOGS": RESOURCE_LOGS, "REQUEST": REQUEST}


class BadRequest(ValueError):
    """A request that can't be read."""


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadRequest("bad protobuf: a number doesn't end")
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _wire(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, raw value) in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5, 2):
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            if at + size > len(data):
                raise BadRequest("bad protobuf: it is cut off")
            value, at = data[at : at + size], at + size
        else:
            raise BadRequest(f"bad protobuf: wire type {kind}")
        yield tag >> 3, value


def decode(data: memoryview, message: str = "REQUEST") -> dict:
    """A protobuf message in its JSON form; unknown fields are passed over."""
    out: dict = {}
    for number, raw in _wire(data):
        if number not in MESSAGES[message]:
            continue
        name, kind = MESSAGES[message][number]
        if isinstance(raw, int) != (kind in ("int", "bool")):
            raise BadRequest(f"bad protobuf: {name} has another type")
        if kind.rstrip("*") in MESSAGES:
            value = decode(raw, kind.rstrip("*"))
        elif kind == "text":
            value = bytes(raw).decode("utf-8", "replace")
        elif kind == "bytes":
            value = base64.b64encode(raw).decode()
        elif kind == "hex":
            value = bytes(raw).hex()
        elif kind == "bool":
            value = bool(raw)
        elif kind == "int":
            value = raw - (1 << 64) if raw >= 1 << 63 else raw
        elif kind == "double":
            (value,) = struct.unpack("<d", raw)
        else:
            value = int.from_bytes(raw, "little")
        if kind.endswith("*"):
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def _number(x: float) -> str:
    """A float in its shortest form."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("unsupported float value")
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    digits, _, power = repr(x).partition("e")
    if power:
        return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-').lstrip('0')}"
    return digits if abs(x) >= 1e-6 else repr(x)


_quoted = lambda text: json.dumps(text, ensure_ascii=False)


def _any(v: dict | None) -> str | None:
    """A value of any kind as JSON text; None if it holds nothing."""
    for name, x in (v or {}).items():
        if x is None:
            continue
        if name == "stringValue":
            return _quoted(str(x))
        if name == "boolValue":
            return "true" if x else "false"
        if name == "intValue":
            return str(int(x))
        if name == "doubleValue":
            return _number(float(x))
        if name == "bytesValue":
            return _quoted(base64.b64encode(base64.b64decode(x)).decode())
        if name == "arrayValue":
            return "[" + ",".join(_any(y) or "null" for y in x.get("values") or ()) + "]"
        if name == "kvlistValue":
            return _object(x.get("values")) or "{}"
    return None


def _object(pairs: list | None) -> str | None:
    """Attributes as the text of an object, of which a later key wins; None if there are none."""
    found = {p.get("key", ""): _any(p.get("value")) or "null" for p in pairs or ()}
    return "{" + ",".join(f"{_quoted(k)}:{v}" for k, v in found.items()) + "}" if found else None


def _text(v) -> str | None:
    return _quoted(v) if v else None


def _id(v) -> str | None:
    return _quoted(v.lower()) if v and v.strip("0") else None


def _unsigned(v) -> str | None:
    return str(int(v)) if v and int(v) else None


def records(request: dict, now: int) -> Iterator[tuple[int, str]]:
    """(timestamp, JSON line) of each record; empty fields are left out, `timestamp` and `scope` never are."""
    for r in request.get("resourceLogs") or ():
        for s in r.get("scopeLogs") or ():
            scope = s.get("scope") or {}
            for log in s.get("logRecords") or ():
                try:
                    own, seen = int(log.get("timeUnixNano") or 0), int(log.get("observedTimeUnixNano") or 0)
                    around = (("name", _text(scope.get("name"))), ("version", _text(scope.get("version"))), ("attributes", _object(scope.get("attributes"))))
                    found = (
                        ("timestamp", str(own)),
                        ("observed_timestamp", _unsigned(seen)),
                        ("severity_number", _unsigned(log.get("severityNumber"))),
                        ("severity_text", _text(log.get("severityText"))),
                        ("body", _any(log.get("body"))),
                        ("attributes", _object(log.get("attributes"))),
                        ("trace_id", _id(log.get("traceId"))),
                        ("span_id", _id(log.get("spanId"))),
                        ("flags", _unsigned(log.get("flags"))),
                        ("resource", _object((r.get("resource") or {}).get("attributes"))),
                        ("scope", "{" + ",".join(f'"{k}":{v}' for k, v in around if v is not None) + "}"),
                    )
                    line = "{" + ",".join(f'"{k}":{v}' for k, v in found if v is not None) + "}"
                except (ValueError, TypeError, AttributeError):
                    continue  # nothing that JSON could say
                at = (own or seen or now) & (1 << 64) - 1
                yield at - (1 << 64) if at >= 1 << 63 else at, line


def _walk(protobuf: bool):
    def run(batches):
        for batch in batches:
            now, out = time.time_ns(), []
            for body in batch.column(0).to_pylist():
                if body is None:
                    continue
                body = body.encode() if isinstance(body, str) else bytes(body)
                body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
                if len(body) > MOST_BYTES:
                    raise BadRequest(f"a request of {len(body)} bytes; {MOST_BYTES} are the most")
                try:
                    request = decode(memoryview(body)) if protobuf else json.loads(body)
                except ValueError as e:
                    raise BadRequest(f"bad request: {e}") from None
                out += records(request, now)
            times, lines = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(times, pa.int64()), pa.array(lines, pa.string())], names=["timestamp", "data"])

    return run


def otlp_rows(bodies: DataFrame, protobuf: bool = False) -> DataFrame:
    """Entries of requests, the first column of `bodies` (text, or bytes that may be gzipped)."""
    ship_package(bodies.sparkSession)
    return bodies.select(F.col(f"`{bodies.columns[0]}`")).mapInArrow(_walk(protobuf), ENTRY)


def read_otlp(spark: SparkSession, path: str, protobuf: bool = False) -> DataFrame:
    """Entries of files of one request each, plain or gzipped."""
    return otlp_rows(spark.read.format("binaryFile").load(path).select("content"), protobuf)
