"""RE2 patterns for Spark's rlike, which runs Java's regular expressions."""

from __future__ import annotations

import re

# POSIX classes by name, as Java knows them; fixed values of both syntaxes.
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}"}


SPACE = r"\t\n\f\r "  # what RE2's \s is; Java's also has \v
SPACES = {"s": f"[{SPACE}]", "S": f"[^{SPACE}]", "C": r"[\s\S]"}


class BadPattern(ValueError):
    """The pattern is no RE2 pattern."""


def _class(p: str, i: int) -> tuple[str, int]:
    """The bracket expression that starts at i, and where it ends."""
    out, start, i = "[", i, i + 1
    if p[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if m := re.match(r"\[:(\^?)(\w+):\]", p[i:]):
            if m[2] not in POSIX:
                raise BadPattern(f"invalid character class range: {m[0]}")
            out += (POSIX[m[2]] if not m[1] else f"[^{POSIX[m[2]]}]")
            i += m.end()
        elif c == "\\":
            if i + 1 >= len(p):
                break
            out, i = out + (SPACE if p[i + 1] == "s" else p[i : i + 2]), i + 2
        else:
            out, i = out + ("\\" + c if c in "[&^~" or c == "]" else c), i + 1
    raise BadPattern(f"missing closing ]: {p[start:]}")


def translate(pattern: str) -> str:
    """The Java pattern that matches as RE2 would; raises BadPattern for what RE2 refuses."""
    out, i, multiline, depth, last = ["(?d)"], 0, [False], 0, ""
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1 : i + 2]
            if not n:
                raise BadPattern("trailing backslash")
            if n == "Q":
                end = pattern.find(r"\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else None]
                out.append("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text))
                i = end + 2 if end >= 0 else len(pattern)
                last = "x"
                continue
            if n.isdigit() and n != "0" or n in "GkZhHRVXKu":
                raise BadPattern(f"invalid escape sequence: \\{n}")
            if m := re.match(r"\\x\{([0-9a-fA-F]+)\}|\\[pP](?:\{\^?\w+\}|\w)", pattern[i:]):
                out.append(m[0])
                i += m.end()
            else:
                out.append(SPACES.get(n, pattern[i : i + 2]))
                i += 2
            last = "x"
        elif c == "[":
            part, i = _class(pattern, i)
            out.append(part)
            last = "x"
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?":
                if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:]):
                    out.append(f"(?<{m[1].replace('_', 'U')}g{len(out)}>")
                    multiline.append(multiline[-1])
                elif m := re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", pattern[i:]):
                    on, off = m[1].replace("i", "iu"), (m[2] or "").replace("i", "iu")  # case folds in all scripts
                    value = ("m" in on or multiline[-1]) and "m" not in off
                    flags = "".join(x for x in on if x != "U") + ("-" + kept if (kept := "".join(x for x in off if x != "U")) else "")
                    if m[3] == ":":
                        out.append(f"(?{flags}:" if flags else "(?:")
                        multiline.append(value)
                    else:
                        out.append(f"(?{flags})" if flags else "")
                        multiline[-1] = value
                        i += m.end()
                        continue
                else:
                    raise BadPattern(f"invalid or unsupported Perl syntax: {pattern[i : i + 4]}")
                depth += 1
                i += m.end()
            else:
                out.append("(")
                multiline.append(multiline[-1])
                depth += 1
                i += 1
            last = "("
        elif c == ")":
            if not depth:
                raise BadPattern("unexpected )")
            depth -= 1
            multiline.pop()
            out.append(")")
            i, last = i + 1, "x"
        elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            m = re.match(r"[*+?]|\{\d+(?:,\d*)?\}", pattern[i:])
            if last in ("", "(", "|"):
                raise BadPattern(f"missing argument to repetition operator: {m[0]}")
            if last == "*":
                raise BadPattern(f"invalid nested repetition operator: {m[0]}")
            if any(int(x) > 1000 for x in re.findall(r"\d+", m[0])):
                raise BadPattern("invalid repeat count")
            i += m.end()
            lazy = pattern[i : i + 1] == "?"
            out.append(m[0] + "?" * lazy)
            i, last = i + lazy, "*"
        else:
            out.append(r"\z" if c == "$" and not multiline[-1] else "\\" + c if c in "{}" else c)
            i, last = i + 1, "|" if c == "|" else "x"
    if depth:
        raise BadPattern("missing closing )")
    return "".join(out)


def anchored(pattern: str) -> str:
    """The Java pattern that an RE2 pattern must match in whole."""
    return rf"\A(?:{translate(pattern)})\z"


def validate(java: str) -> None:
    """Raises BadPattern if Java can't compile it, before any job runs."""
    from py4j.protocol import Py4JJavaError
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Py4JJavaError as e:
            raise BadPattern(str(e.java_exception.getMessage()).split("\n")[0]) from None
