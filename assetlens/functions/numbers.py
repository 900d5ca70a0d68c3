"""Lenient number parsing and number display as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_WS, _col


def _zero_if_null_or_neg_zero(x: Column) -> Column:
    # ``Number(s) || 0``: NaN, NULL and -0 all become 0.
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(0.0)).otherwise(x)


def parse_id_number(c) -> Column:
    """Indonesian-formatted number: drop every '.', first ',' becomes '.',
    keep only digits, '.' and '-', then a strict parse; anything else is 0."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    s = F.regexp_replace(s, "\\.", "")
    s = F.regexp_replace(s, "^([^,]*),", "$1.")
    s = F.regexp_replace(s, "[^0-9.\\-]", "")
    # A strict numeric shape, so that Java's parser never sees what JS rejects.
    shaped = F.when(s.rlike("^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), s)
    return _zero_if_null_or_neg_zero(shaped.try_cast("double"))


def parse_percent_prefix(c) -> Column:
    """Leading number of a percent text: every '%' dropped, first ',' -> '.',
    then the longest numeric prefix (``parseFloat``); 0 if there is none."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    s = F.regexp_replace(s, "%", "")
    s = F.regexp_replace(s, "^([^,]*),", "$1.")
    prefix = F.regexp_extract(
        s, f"^{JS_WS}*([+-]?(Infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?))", 1)
    value = (F.when(prefix == "", F.lit(None).cast("double"))
             .when(prefix.endswith("Infinity"),
                   F.when(prefix.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
             .otherwise(prefix.try_cast("double")))
    return _zero_if_null_or_neg_zero(value)


def format_count(c) -> Column:
    """Integer with ',' thousands grouping (``f"{n:,}"``)."""
    return F.format_number(_col(c).cast("double"), 0)


def format_id_number(c) -> Column:
    """``Intl.NumberFormat('id-ID')``: '.' groups, ',' decimals, at most three
    fraction digits, trailing zeros dropped; a non-number shows as 0."""
    x = _col(c).try_cast("double")
    x = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    rounded = F.round(x, 3)
    text = F.format_number(rounded, 3)
    text = F.translate(text, ",.", ".,")
    text = F.regexp_replace(text, ",?0+$", "")
    text = F.when(text == "-0", F.lit("0")).otherwise(text)
    return text


def format_rupiah(c) -> Column:
    """Rupiah display with T / M / Jt units; NULL and 0 show as '-'."""
    v = _col(c).cast("double")
    a = F.abs(v)
    return (F.when(v.isNull() | (v == 0), F.lit("-"))
            .when(a >= 1e12, F.concat(F.lit("Rp "), F.format_number(v / 1e12, 2), F.lit(" T")))
            .when(a >= 1e9, F.concat(F.lit("Rp "), F.format_number(v / 1e9, 2), F.lit(" M")))
            .when(a >= 1e6, F.concat(F.lit("Rp "), F.format_number(v / 1e6, 2), F.lit(" Jt")))
            .otherwise(F.concat(F.lit("Rp "), F.format_number(v, 0))))


def metric_with_pct(value, q1, pct) -> Column:
    """``'<n> bidang (q1 / pct)'``, omitting blank parts."""
    q1 = F.nullif(F.coalesce(_col(q1).cast("string"), F.lit("")), F.lit(""))
    pct = F.nullif(F.coalesce(_col(pct).cast("string"), F.lit("")), F.lit(""))
    details = F.concat_ws(" / ", q1, pct)
    head = F.concat(format_id_number(value), F.lit(" bidang"))
    return F.when(details == "", head).otherwise(F.concat(head, F.lit(" ("), details, F.lit(")")))


def marker_radius(c, scale: float, base: float, minimum: float) -> Column:
    """Circle radius that grows with the value, never below ``minimum``."""
    return F.greatest(_col(c).cast("double") / F.lit(scale) + F.lit(base), F.lit(minimum))
