"""Row filters (pushed to the scan by Catalyst when they reach a Parquet
source)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import clean_value, filter_value, joined_lower, py_strip, qcol
from .slots import Slots


def filter_in(df: DataFrame, selections: Mapping[str, Sequence] | None) -> DataFrame:
    """AND of ``col IN (values)`` over the given columns; an empty or missing
    list means "no filter" for that column.  NULL never matches."""
    cond = in_condition(selections)
    return df if cond is None else df.filter(cond)


def in_condition(selections: Mapping[str, Sequence] | None) -> Column | None:
    cond = None
    for col, values in (selections or {}).items():
        if values:
            c = qcol(col).isin(list(values))
            cond = c if cond is None else (cond & c)
    return cond


def filter_by_dimension(df: DataFrame, dim: DataFrame | None, key: str, dim_key: str,
                        dim_col: str, values: Sequence | None) -> DataFrame:
    """Keep rows whose ``key`` is among the dimension keys whose ``dim_col``
    is in ``values`` (``key IN (SELECT dim_key FROM dim WHERE dim_col IN ..)``).
    Skipped when no values are chosen or the dimension is absent.

    Written as a left-semi join: Spark broadcasts the filtered dimension when
    its measured size is under the broadcast threshold and falls back to a
    shuffled semi join otherwise."""
    if not values or dim is None:
        return df
    keys = (dim.filter(F.col(dim_col).isin(list(values)))
            .select(F.col(dim_key).alias("__dim_key"))
            .filter(F.col("__dim_key").isNotNull()))
    return df.join(keys, df[key] == keys["__dim_key"], "left_semi")


def where_nonnull(df: DataFrame, col: str) -> DataFrame:
    return df.filter(qcol(col).isNotNull())


def filter_active(df: DataFrame, status_col: str, active: str = K.ACTIVE_STATUS) -> DataFrame:
    """Trimmed status equals the active marker."""
    return df.filter(active_condition(qcol(status_col), active))


def active_condition(status: Column, active: str = K.ACTIVE_STATUS) -> Column:
    return F.coalesce(py_strip(status.cast("string")), F.lit("")) == F.lit(active)


def drop_blank_rows(df: DataFrame, cols: Sequence[str] | None = None, blank_is_empty: bool = False) -> DataFrame:
    """Drop rows whose cells are all NULL (or, with ``blank_is_empty``, all
    blank after trimming)."""
    s = Slots(df)
    cond = F.lit(False)
    for c in cols or s.headers:
        cond = cond | ((clean_value(s.col(c)) != "") if blank_is_empty else s.col(c).isNotNull())
    return s.restore(s.keep(cond))


def drop_blank_array_rows(df: DataFrame, cells_col: str = "cells") -> DataFrame:
    """Drop rows whose cell array holds only NULLs."""
    return df.filter(F.exists(F.col(cells_col), lambda x: x.isNotNull()))


def keep_known(df: DataFrame, col: str, known: DataFrame, known_col: str) -> DataFrame:
    """Keep rows whose value exists in a dimension (the planner picks the
    join by the dimension's size)."""
    return df.join(known.select(F.col(known_col).alias("__known")), qcol(col) == F.col("__known"), "left_semi")


def filter_equals_or_all(df: DataFrame, col: str, value: str | None, all_token: str = "Semua") -> DataFrame:
    """One value, or every row when the value is the "all" token."""
    if value is None or value == all_token:
        return df
    return df.filter(qcol(col) == F.lit(value))


def search_condition(cols: Sequence[str | Column], query: str | None) -> Column | None:
    """Row text (values joined by a space, lower-cased) contains the trimmed,
    lower-cased query - a literal match that may span adjacent cells."""
    q = (query or "").strip().lower()
    if not q:
        return None
    return F.instr(joined_lower(list(cols)), q) > 0


def search_rows(df: DataFrame, query: str | None, cols: Sequence[str] | None = None) -> DataFrame:
    s = Slots(df)
    cond = search_condition([s.col(c) for c in cols or s.headers], query)
    return df if cond is None else s.restore(s.keep(cond))


def column_filter_conditions(headers: Sequence[str], filters: Mapping[str, Sequence[str] | str | None],
                             empty_token: str = K.EMPTY_TOKEN, skip: str | None = None,
                             col=qcol) -> list[tuple[str, Column]]:
    """Per active column filter: (header, condition).  A present-but-empty
    selection keeps no rows; filters on unknown headers are ignored.  ``col``
    finds a header's column."""
    out = []
    for h in headers:
        if h == skip or h not in filters:
            continue
        raw = filters[h]
        values = list(raw) if isinstance(raw, (list, tuple, set)) else ([raw] if raw else [])
        cond = filter_value(col(h), empty_token).isin(values) if values else F.lit(False)
        out.append((h, cond))
    return out


def filter_columns(df: DataFrame, filters: Mapping[str, Sequence[str] | str | None] | None,
                   headers: Sequence[str] | None = None, empty_token: str = K.EMPTY_TOKEN) -> DataFrame:
    """AND over the active column filters (values compared after cleaning;
    a blank cell is the empty token)."""
    s = Slots(df)
    out = s.df
    for _, c in column_filter_conditions(list(headers or s.headers), filters or {}, empty_token, col=s.col):
        out = out.filter(c)
    return s.restore(out)
