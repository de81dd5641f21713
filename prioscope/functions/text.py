"""Column-expression builders for text matching.

All of it stays JVM-side (``contains`` / ``rlike`` / higher-order ``filter``), so it
compiles into whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — the characters Python's ``str.strip()`` removes (str.isspace()).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_REGEX_META = set(".^$*+?{}[]\\|()")


def ws_trim(c: Column) -> Column:
    """Strip all Unicode whitespace from both ends (Spark ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def is_literal(pattern: str) -> bool:
    """True when a pattern has no regex syntax, so a substring test is equivalent."""
    return not any(ch in _REGEX_META for ch in pattern)


def python_dot(pattern: str) -> str:
    """Rewrite ``.`` so that, as in Python, it excludes only ``\\n``.

    Java's ``.`` also stops at ``\\r``, ``\\u0085``, ``\\u2028`` and ``\\u2029``.
    """
    out, in_class, escaped = [], False, False
    for ch in pattern:
        if escaped:
            out.append(ch)
            escaped = False
        elif ch == "\\":
            out.append(ch)
            escaped = True
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "]":
            in_class = False
            out.append(ch)
        elif ch == "." and not in_class:
            out.append("[^\\n]")
        else:
            out.append(ch)
    return "".join(out)


# Long lexicons are rendered as one SQL expression string per column: building the
# same tree from hundreds of small Column objects costs one py4j round trip each,
# while the optimised plan is identical.


def sql_lit(s: str) -> str:
    """Spark SQL string literal (backslash escapes)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(text_lc: str | Column) -> str:
    if isinstance(text_lc, str):
        return f"`{text_lc}`"
    raise TypeError("pass the lower-cased text as a column name")


def matches_sql(text_lc: str, item: str) -> str:
    t = _name(text_lc)
    if is_literal(item):
        return f"contains({t}, {sql_lit(item)})"
    return f"({t} RLIKE {sql_lit(python_dot(item))})"


def matches(text_lc: str, item: str) -> Column:
    """Boolean: does one keyword or pattern hit the (already lower-cased) text column."""
    return F.expr(matches_sql(text_lc, item))


def hit_count(text_lc: str, items) -> Column:
    """Number of distinct list entries that hit the text (not occurrences)."""
    items = list(items)
    if not items:
        return F.lit(0)
    return F.expr(" + ".join(f"CAST({matches_sql(text_lc, it)} AS INT)" for it in items))


# Separator for joining hits; never part of a keyword.
_SEP = "\x01"


def hits_in_order(text_lc: str, words) -> Column:
    """array<string> of the list entries found in the text, in list order.

    Rendered as ``concat_ws`` over ``CASE WHEN contains(..) THEN word END`` (nulls are
    skipped) and a ``split``: all codegen'd, and the ``contains`` tests are shared
    with ``hit_count`` by subexpression elimination when both sit in one projection.
    A higher-order ``filter(array, lambda)`` would run interpreted per element.
    """
    words = list(words)
    if not words or any(_SEP in w for w in words):
        if not words:
            return F.expr("CAST(array() AS array<string>)")
        raise ValueError("keyword contains the reserved separator")
    t = _name(text_lc)
    parts = ", ".join(f"CASE WHEN contains({t}, {sql_lit(w)}) THEN {sql_lit(w)} END" for w in words)
    joined = f"concat_ws('{_SEP}', {parts})"
    return F.expr(f"CASE WHEN {joined} = '' THEN CAST(array() AS array<string>) "
                  f"ELSE split({joined}, '{_SEP}') END")


def to_pipe(c: Column) -> Column:
    """array<string> -> 'a|b|c' (only at CSV edges)."""
    return F.array_join(c, "|")


def from_pipe(c: Column) -> Column:
    """'a| b ||c' -> ['a', 'b', 'c']: split on '|', strip, drop blanks; null -> []."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: ws_trim(x))
    return F.filter(parts, lambda x: x != "")


def number_text(x: Column) -> Column:
    """A finite double as the original tool prints it: shortest digits, plain from 1e-4 up to
    1e16 (``10000000.0``), else with a two-digit exponent (``1e+16``, ``5e-05``)."""
    java = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(java.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(java, "E(-?[0-9]+)$", 1).cast("int")
    far = F.concat(F.regexp_replace(F.regexp_replace(java, "E.*$", ""), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"),
                   F.format_string("%02d", F.abs(power)))
    return F.when(~F.contains(java, F.lit("E")), java).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(far)
