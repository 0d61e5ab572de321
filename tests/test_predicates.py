import json

import pytest
from pyspark.sql import functions as F

from logsift.functions import regex
from logsift.functions.labels import extract_labels, native_label
from logsift.functions.text import bound, has_term, has_tokens, parse_time, token_list, tokens
from logsift.operators.matcher import BadMatcher, LabelFilter, LineFilter, Matcher
from logsift.operators.search import head, matching, search, tail, token_gated, token_sets


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(2, "hello World"), (1, "Error: DISK full"), (3, ""), (4, "naïve É\nend"), (-1, "before"), (5, "foo\n")]
    return spark.createDataFrame(rows, "timestamp long, data string")


def found(df):
    return sorted(r.timestamp for r in df.collect())


def by_line(lines, op, value):
    return found(search(lines, q=json.dumps({"line": [{"op": op, "v": value}]})))


def test_terms(lines):
    assert found(search(lines, term="wor")) == [2]
    assert found(search(lines, term="ERROR")) == [1]
    assert found(search(lines, term="É")) == []  # the term is lowered in full, the data in ASCII
    assert found(search(lines, term="é")) == []
    assert found(search(lines, term="")) == [1, 2, 3, 4, 5]


def test_time_bounds(lines):
    assert found(search(lines, start=1, end=2)) == [1, 2]
    assert found(search(lines, start=-5)) == [-1, 1, 2, 3, 4, 5]
    assert bound("x", 7) == 7 and bound("12", 7) == 12


def test_line_filters(lines):
    assert by_line(lines, "|=", "Error") == [1] and by_line(lines, "|=", "error") == []
    assert by_line(lines, "!=", "hello") == [1, 3, 4, 5]
    assert by_line(lines, "|~", "^h.*d$") == [2]
    assert by_line(lines, "|~", "^foo$") == []  # $ is the end of the text, not before its last line break
    assert by_line(lines, "|~", "x*") == [1, 2, 3, 4, 5]
    assert by_line(lines, "|~", "(?m)^naïve É$") == [4]
    assert by_line(lines, "!~", "[[:upper:]]") == [3, 4, 5]


@pytest.mark.parametrize("bad", ["(", ")", "[a", "a**", "*a", r"\1", "(?=a)", "(?<!a)", "a{1001}", "[[:nope:]]", "\\"])
def test_bad_patterns(spark, bad):
    with pytest.raises(BadMatcher):
        Matcher((LineFilter("re", bad),))


@pytest.mark.parametrize("pattern,text,hit", [("(?P<n>a)b", "ab", True), ("a.c", "a\rc", True), ("a.c", "a\nc", False), (r"\Qa.c\E", "abc", False), ("[[:digit:]]+", "x1", True), ("[^[:space:]]", " ", False), ("(?U)a+", "aa", True), ("(?i)AB", "xab", True), ("[]a]", "]", True), ("a{,2}", "a{,2}", True)])
def test_patterns(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(regex.translate(pattern))).first()[0] is hit


def test_matcher_json():
    m = Matcher.from_json('{"line":[{"op":"|=","v":"a"}],"labels":[{"l":"k","op":"eq","v":""},{"l":"j","op":"eq","v":"x"}]}')
    assert m.lines == (LineFilter("|=", "a"),) and m.labels[0] == LabelFilter("k", "eq", "")
    assert m.equalities() == [("j", "x")]
    for text, said in (("[", "bad q"), ('{"line":[{"op":"?","v":""}]}', "bad line op"), ('{"labels":[{"l":"a","op":"?","v":""}]}', "bad label op")):
        with pytest.raises(BadMatcher, match=said):
            Matcher.from_json(text)


@pytest.mark.parametrize(
    "data,labels",
    [
        ("plain", {}), ("", {}), (None, {}), ("[1]", {}), ('{"a":1', {}), ('{"a":NaN}', {}),
        ('{"severity_text":"INFO","body":"b","trace_id":"t"}', {"level": "INFO", "body": "b", "trace_id": "t"}),
        ('{"resource":{"service.name":"s","n":1.50,"e":1e3,"o":{"v" : 1},"z":null}}', {"service_name": "s", "n": "1.50", "e": "1e3", "o": '{"v" : 1}', "z": "null"}),
        ('{"resource":"{\\"a.b\\":\\"c\\"}"}', {"a_b": "c"}),
        ('{"attributes":{"a":"2","a":"3"},"resource":{"a":"1"},"a":"4"}', {"a": "1"}),
        ('{"attributes":{"a":"2","a":"3"},"a":"4"}', {"a": "2"}),
        ('{"a":true,"b":null,"c":{},"d":[],"e":7,"scope":{}}', {"e": "7"}),
        ('{"body":{"x":1},"level":"t","severity_text":""}', {"body": '{"x":1}', "level": "t"}),
        ('{"attribute":"{\\"k\\":1}"}', {"attribute": '{"k":1}'}),
        ('{"trace_id":5}', {}),
    ],
)
def test_labels(data, labels):
    assert extract_labels(data) == labels


def test_native_labels_agree(spark):
    rows = ['{"severity_text":"E","resource":{"service.name":"s"},"attributes":{"k":69,"service.name":"no"},"top.x":"y","n":5}', '{"level":"x"}', "plain"]
    df = spark.createDataFrame([(r,) for r in rows], "data string")
    for key in ("level", "service_name", "k", "top_x", "n", "none"):
        assert [r[0] for r in df.select(native_label(F.col("data"), key)).collect()] == [extract_labels(r).get(key) for r in rows]


def test_label_filters(spark):
    rows = [(1, '{"severity_text":"INFO","resource":{"s":"a"}}'), (2, '{"severity_text":"WARN"}'), (3, "text")]
    df = spark.createDataFrame(rows, "timestamp long, data string")
    q = lambda op, v, k="level": found(search(df, q=json.dumps({"labels": [{"l": k, "op": op, "v": v}]})))
    assert q("eq", "INFO") == [1] and q("ne", "INFO") == [2, 3]
    assert q("re", "IN") == [] and q("re", "IN.*") == [1] and q("nre", "IN.*") == [2, 3]
    assert q("eq", "") == [3] and q("ne", "", "none") == [] and q("re", ".*", "none") == [1, 2, 3]


def test_q_wins(lines):
    assert found(search(lines, term="zzz", q='{"line":[{"op":"|=","v":"hello"}]}')) == [2]
    assert matching(lines, q="{}").columns == lines.columns


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World-2x! été_",), ("",)], "d string")
    assert [r[0] for r in df.select(tokens(F.col("d"))).collect()] == [["hello", "world", "2x", "été"], []]
    assert token_list("A-b") == ["a", "b"]
    has = lambda s, t: spark.createDataFrame([(s,)], "s array<string>").select(has_tokens(F.col("s"), t)).first()[0]
    assert has(["a", "b"], "B a") and not has(["a"], "a b") and has([], "x") and has(["a"], "")


def test_token_sets_and_gate(spark):
    df = spark.createDataFrame([(1, 1, "world one"), (1, 2, "words"), (2, 3, "a b c"), (3, 4, "...")], "part int, timestamp long, data string")
    sets = {r.part: (r.tokens, r.tokens_truncated) for r in token_sets(df, "part", cap=3).collect()}
    assert sets == {1: (["one", "words", "world"], False), 2: (["a", "b", "c"], False), 3: ([], False)}
    assert {r.part: r.tokens_truncated for r in token_sets(df, "part", cap=2).collect()}[1]
    assert found(token_gated(df, "part", "wor")) == []
    assert found(token_gated(df, "part", "words")) == [2]


def test_tail_and_head(lines):
    assert [r.timestamp for r in tail(lines, 2).collect()] == [4, 5]
    assert [r.timestamp for r in tail(lines, 0).collect()] == [-1, 1, 2, 3, 4, 5]
    assert [r.timestamp for r in head(lines, 2).collect()] == [-1, 1]


def test_parse_time():
    assert parse_time("", 100, 7) == 7 and parse_time("12", 100, 7) == 12
    assert parse_time("1h30m", 10**14, 0) == parse_time("-1h30m", 10**14, 0) == 10**14 - 5400 * 10**9
    with pytest.raises(ValueError):
        parse_time("soon", 0, 0)


def test_has_term_is_pushed_nowhere_else(lines):
    assert lines.where(has_term(F.col("data"), "disk")).count() == 1


def test_patterns_match_as_re2_does(spark):
    import duckdb

    from logsift.functions.regex import translate

    lines = ["a b", "a\vb", "a\tb", "ÄRGER", "ärger", "Straße", "ΣΑΣ", "σας", "plain", "K", "a\u00a0b", ""]
    patterns = [r"a\sb", r"a[\s,]b", r"a\Sb", r"a[[:space:]]b", r"(?i)ärger", r"(?i:ä)rger", r"(?i)σας", r"(?i)plain(?-i)", r"^\S+$", r"(?i)k"]
    con = duckdb.connect()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    for p in patterns:
        expected = [i for i, x in enumerate(lines) if con.execute("SELECT regexp_matches(?, ?)", [x, p]).fetchone()[0]]
        assert [r.i for r in df.where(F.col("x").rlike(translate(p))).orderBy("i").collect()] == expected, p
