import gzip
import json
import struct

import pytest

from logsift.sources import otlp


def field(number, value, kind=2):
    tag = bytes([number << 3 | kind])
    if kind == 2:
        return tag + varint(len(value)) + value
    return tag + (varint(value) if kind == 0 else value)


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def text(s):
    return field(1, s.encode())


def pair(key, value):
    return field(1, key.encode()) + field(2, value)


LIST = field(1, field(2, 1, 0)) + field(1, field(4, struct.pack("<d", 1.5), 1)) + field(1, b"")
RECORD = b"".join(
    [
        field(1, struct.pack("<Q", 123), 1),
        field(11, struct.pack("<Q", 124), 1),
        field(2, 9, 0),
        field(3, b"ERROR"),
        field(5, field(6, field(1, pair("n", field(3, -5, 0))) + field(1, pair("l", field(5, LIST))))),
        field(6, pair("k", text("v"))) + field(6, pair("raw", field(7, b"hi"))),
        field(8, struct.pack("<I", 1), 5),
        field(9, bytes(range(1, 17))) + field(10, bytes(range(1, 9))),
        field(4, b"unknown"),
    ]
)
SCOPE = field(1, b"logger") + field(2, b"1.2.3") + field(3, pair("scope_key", text("scope_val")))
REQUEST = field(1, field(1, field(1, pair("service.name", text("svc")))) + field(2, field(1, SCOPE) + field(2, RECORD) + field(2, field(5, text("no time")))))
LINE = {"timestamp": 123, "observed_timestamp": 124, "severity_number": 9, "severity_text": "ERROR", "body": {"n": -5, "l": [True, 1.5, None]}, "attributes": {"k": "v", "raw": "aGk="}, "trace_id": "0102030405060708090a0b0c0d0e0f10", "span_id": "0102030405060708", "flags": 1, "resource": {"service.name": "svc"}, "scope": {"name": "logger", "version": "1.2.3", "attributes": {"scope_key": "scope_val"}}}


def test_protobuf_and_json_say_the_same(spark, tmp_path):
    (tmp_path / "a.pb").write_bytes(REQUEST)
    (tmp_path / "b.pb").write_bytes(gzip.compress(REQUEST))
    rows = otlp.read_otlp(spark, f"file://{tmp_path}/*.pb", protobuf=True).collect()
    assert len(rows) == 4
    own = [r for r in rows if r.timestamp == 123]
    assert len(own) == 2 and all(json.loads(r.data) == LINE and list(json.loads(r.data)) == list(LINE) for r in own)
    late = [r for r in rows if r.timestamp != 123]
    assert all(r.timestamp > 1 << 60 and json.loads(r.data)["timestamp"] == 0 and json.loads(r.data)["body"] == "no time" for r in late)
    as_json = json.dumps(otlp.decode(memoryview(REQUEST)))
    again = otlp.otlp_rows(spark.createDataFrame([(as_json,)], "body string")).collect()
    assert sorted(r.data for r in again) == sorted({r.data for r in rows})


@pytest.mark.parametrize("value,shown", [({"doubleValue": 1.0}, "1"), ({"doubleValue": 1e21}, "1e+21"), ({"doubleValue": 1e-7}, "1e-7"), ({"doubleValue": 0.1}, "0.1"), ({"intValue": "9007199254740993"}, "9007199254740993"), ({"stringValue": 'a"\n'}, '"a\\"\\n"'), ({"arrayValue": {}}, "[]"), ({"kvlistValue": {}}, "{}"), ({}, None), (None, None), ({"boolValue": False}, "false"), ({"stringValue": ""}, '""')])
def test_values(value, shown):
    assert otlp._any(value) == shown


def test_records_that_json_cannot_say_are_passed_over():
    record = lambda body: {"timeUnixNano": "1", "body": body}
    bodies = [{"doubleValue": "NaN"}, {"doubleValue": float("inf")}, {"intValue": "x"}, {"arrayValue": {"values": [{"doubleValue": "-Infinity"}]}}, {"stringValue": "ok"}]
    assert len(list(otlp.records({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(b) for b in bodies]}]}]}, 5))) == 1
    assert list(otlp.records({}, 5)) == []


@pytest.mark.parametrize("body", [b"\x0a\xff", b"\x0a\x05ab", b"\x0b", b"\x08\x01", b"\x0a\x02\x08\x01"])
def test_bad_protobuf_is_refused(body):
    with pytest.raises(otlp.BadRequest):
        otlp.decode(memoryview(body))
