"""String expressions (native Column expressions, no UDFs).

Java's ``\\s`` does not match NBSP, and Spark's ``trim`` removes only the
space character, so the white-space classes of the two source languages are
spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as matched by a JavaScript ``\s`` (and removed by
# ``String.prototype.trim``).
JS_WS = "[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
# White space removed by Python's ``str.strip()``.
PY_WS = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


# The same sets as plain character lists (for translate / edge tests).
JS_WS_CHARS = ("\t\n\x0b\f\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")
PY_WS_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def qcol(name: str) -> Column:
    """Column by exact name (dots, spaces and '%' allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _col(c) -> Column:
    return qcol(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """``String(x).trim()``: the set of characters goes to ``trim`` itself, so
    the text is read once and stays in generated code."""
    return F.trim(_col(c), F.lit(JS_WS_CHARS))


def py_strip(c) -> Column:
    """``str(x).strip()``."""
    return F.trim(_col(c), F.lit(PY_WS_CHARS))


def clean_header(c) -> Column:
    """Collapse every white-space run to one space and trim (NULL -> '').

    Every white-space character is first mapped to a plain space
    (``translate``), so that the collapse is a simple regex and ``trim``
    (which removes spaces only) finishes the job.  The argument is read once:
    a copy in each branch of a condition would be evaluated again."""
    spaced = F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), JS_WS_CHARS, " " * len(JS_WS_CHARS))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def clean_value(c) -> Column:
    """Cleaned cell value as used by filters: same rule as headers."""
    return clean_header(c)


def filter_value(c, empty_token: str) -> Column:
    """Cleaned value, or the empty token for a blank cell."""
    return F.coalesce(F.nullif(clean_value(c), F.lit("")), F.lit(empty_token))


def display_or_dash(c) -> Column:
    """Cleaned value, or ``-`` when blank."""
    return filter_value(c, "-")


def text_or_blank(c) -> Column:
    """Falsy (NULL, empty, a numeric zero) -> '', else the value as text.
    A zero is falsy as a number only: the texts '0' and '000' stay."""
    c = _col(c)
    as_text = c.cast("string")
    numeric_zero = (F.typeof(c) != "string") & F.coalesce(c.try_cast("double") == 0, F.lit(False))
    return F.when(c.isNull() | (as_text == "") | numeric_zero, F.lit("")).otherwise(as_text)


def joined_lower(cols: list, sep: str = " ") -> Column:
    """Lower-cased join of several text columns (NULL as '')."""
    if not cols:
        return F.lit("")
    return F.lower(F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]))


def at(arr, index) -> Column:
    """1-based array element, NULL when out of range (ANSI-safe)."""
    idx = index if isinstance(index, Column) else F.lit(index)
    return F.try_element_at(_col(arr), idx)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (keeps a shared sub-expression from being copied into every branch)."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))
