"""Labels of a log line, by schema on read.

Rules: keys have `.` turned to `_`. `resource` (an object, or a string that holds one) beats
`attributes`, which beats other top-level keys; of these only strings and numbers count. A
resource key that comes twice keeps the last value, any other the first. A non-string
value is its JSON text. `severity_text` (as `level`), `body`, `trace_id` and `span_id` win over all
when they aren't empty; the ids and the severity count only as strings. What is no JSON object has
no labels.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import ship_package

SPECIAL = {"severity_text": "level", "body": "body", "trace_id": "trace_id", "span_id": "span_id"}


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_constant=_refuse)
_SPACE = " \t\n\r"


def _members(text: str) -> list[tuple[str, object, str]]:
    """(key, value, JSON text) of an object, in order; raises ValueError for anything else."""
    i = 0

    def skip(i: int) -> int:
        while i < len(text) and text[i] in _SPACE:
            i += 1
        return i

    i, out = skip(i), []
    if text[i : i + 1] != "{":
        raise ValueError("not an object")
    i = skip(i + 1)
    if text[i : i + 1] == "}":
        return out
    while True:
        if text[i : i + 1] != '"':
            raise ValueError("a key is expected")
        key, i = _decoder.raw_decode(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(": is expected")
        start = skip(i + 1)
        value, i = _decoder.raw_decode(text, start)
        out.append((key, value, text[start:i]))
        i = skip(i)
        if text[i : i + 1] == "}":
            return out
        if text[i : i + 1] != ",":
            raise ValueError(", is expected")
        i = skip(i + 1)


def _nested(value: object, raw: str) -> list[tuple[str, str]]:
    try:
        text = value if isinstance(value, str) else raw
        return [(k.replace(".", "_"), v if isinstance(v, str) else r) for k, v, r in _members(text)]
    except ValueError:
        return []


def extract_labels(data: str | None) -> dict[str, str]:
    """The labels of one line, with numbers and nested values exactly as written."""
    try:
        members = _members(data or "")
    except (ValueError, RecursionError):
        return {}
    resource, attributes, top, special = {}, {}, {}, {}
    for key, value, raw in members:
        if key == "resource":
            resource.update(_nested(value, raw))
        elif key == "attributes":
            for k, v in _nested(value, raw):
                attributes.setdefault(k, v)
        elif key in SPECIAL:
            if isinstance(value, str):
                special[key] = value
            elif key == "body" and value is not None:
                special[key] = raw
        elif isinstance(value, str) or isinstance(value, (int, float)) and not isinstance(value, bool):
            top.setdefault(key.replace(".", "_"), value if isinstance(value, str) else raw)
    return {**top, **attributes, **resource, **{SPECIAL[k]: v for k, v in special.items() if v}}


def labels_column(df: DataFrame, data: str = "data") -> Column:
    """extract_labels of a column, in Arrow batches; meant for ingest, where it runs once a line."""
    ship_package(df.sparkSession)

    @F.arrow_udf("map<string,string>")
    def labels(lines: pa.Array) -> pa.Array:
        return pa.array([list(extract_labels(x).items()) for x in lines.to_pylist()], pa.map_(pa.string(), pa.string()))

    return labels(F.col(data))


def native_label(data: Column, key: str) -> Column:
    """One label in built-in functions: exact where values are strings or plain integers."""
    of = lambda path: F.transform_keys(F.from_json(F.get_json_object(data, path), "map<string,string>"), lambda k, _: F.translate(k, ".", "_"))
    top = F.element_at(F.transform_keys(F.from_json(data, "map<string,string>"), lambda k, _: F.translate(k, ".", "_")), key)
    plain = F.when(~top.rlike(r"^[\[{]") & ~top.isin("true", "false"), top) if key not in ("resource", "attributes", "severity_text") else F.lit(None).cast("string")
    value = F.coalesce(F.element_at(of("$.resource"), key), F.element_at(of("$.attributes"), key), plain if key not in SPECIAL else F.lit(None).cast("string"))
    for source, name in SPECIAL.items():
        if name == key:
            own = F.get_json_object(data, f"$.{source}")
            value = F.coalesce(F.when(own != "", own), value)
    return value
