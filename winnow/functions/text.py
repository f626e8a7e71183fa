"""Column expressions for text: strip, tokenizers, number extraction.

Everything here is a built-in Spark expression (JVM side, no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The 29 code points Python's str.strip()/str.split() treat as whitespace, in
# code-point order: tab, LF, VT, FF, CR, U+001C..U+001F, space, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS29 = "".join(chr(c) for c in WS_CODEPOINTS)
# Regex for alphanumeric tokens (applied to lower-cased text).
ALNUM_TOKEN = "[a-z0-9]+"
# Regex for the last number in an answer: optional minus, a digit, digits or
# commas, an optional dot, more digits.
NUMBER = r"-?\d[\d,]*\.?\d*"
# ---------------------------------------------------------------------------

WS_CLASS = "[" + WS29 + "]+"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim all 29 whitespace code points."""
    return F.btrim(as_col(c), F.lit(WS29))


def blank_to_empty(c) -> Column:
    """``(x or "").strip()``: NULL -> '', then strip."""
    return py_strip(F.coalesce(as_col(c), F.lit("")))


def is_blank(c) -> Column:
    return F.coalesce(py_strip(as_col(c)) == F.lit(""), F.lit(True))


def tokenize_alnum(c) -> Column:
    """Lower-case, then runs of ASCII letters/digits (array<string>)."""
    return F.regexp_extract_all(F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit(ALNUM_TOKEN), 0)


def _spaces(c: Column) -> Column:
    """Map the 28 other whitespace code points to a plain space (char-by-char)."""
    others = WS29.replace(" ", "")
    return F.translate(c, others, " " * len(others))


def _ws_split(c: Column) -> Column:
    """Python ``str.split()``: other whitespace -> space, trim, split at single spaces (no regular expression is
    run for that), drop the empty pieces that runs of spaces leave."""
    s = F.trim(_spaces(F.coalesce(c, F.lit(""))))
    return F.when(s == F.lit(""), F.array().cast("array<string>")).otherwise(F.array_remove(F.split(s, " "), ""))


def tokenize_whitespace(c) -> Column:
    """Lower-case, then Python ``str.split()`` (no empty tokens).

    translate + trim + split on spaces is the same split as one regex class of
    all 29 code points, several times faster, and needs no per-token lambda.
    """
    return _ws_split(F.lower(as_col(c)))


def whitespace_split(c) -> Column:
    """Python ``str.split()`` without lower-casing."""
    return _ws_split(as_col(c))


def last_number(c) -> Column:
    """Last number in the text, commas removed, trailing dots removed; else NULL."""
    found = F.regexp_extract_all(F.coalesce(as_col(c), F.lit("")), F.lit(NUMBER), 0)
    last = F.try_element_at(found, F.lit(-1))
    return F.rtrim(F.regexp_replace(last, ",", ""), F.lit("."))


# --- DuckDB spellings of the same fixed values, for oracle SQL -------------

def sql_ws29() -> str:
    """WS29 as a DuckDB string expression built from chr() calls."""
    return "(" + " || ".join(f"chr({c})" for c in WS_CODEPOINTS) + ")"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {sql_ws29()})"


def sql_tokenize_alnum(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{ALNUM_TOKEN}')"


def sql_tokenize_whitespace(expr: str) -> str:
    return (f"list_filter(string_split_regex(lower({expr}), '[' || {sql_ws29()} || ']+'), "
            f"lambda x: x <> '')")
