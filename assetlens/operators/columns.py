"""Projections and schema operators of the register ingest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.classify import classify_by_prefix
from ..functions.text import py_strip, qcol
from .slots import Slots

# Register columns with a type other than text.
LONG_COLUMNS = ("nomor", "nup")
MONEY_COLUMNS = ("nilai_perolehan", "nilai_buku")
MONEY_TYPE = "decimal(20,2)"


def canonical_header(name: str) -> str:
    """strip -> lower -> one pass of double space to single space."""
    return name.strip().lower().replace("  ", " ")


def canonical_names(headers: Sequence[str], synonyms: Mapping[str, str] = K.HEADER_SYNONYMS) -> list[str]:
    """Header list after the synonym rename (unknown headers keep their
    name).  Two headers ending on one name is an error."""
    out = [synonyms.get(canonical_header(h), h) for h in headers]
    dupes = sorted({n for n in out if out.count(n) > 1})
    if dupes:
        raise ValueError(f"header collision after renaming: {dupes}")
    return out


def canonical_name(name: Column, synonyms: Mapping[str, str] = K.HEADER_SYNONYMS) -> Column:
    """``canonical_names`` of one header held in a column."""
    known = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    cleaned = F.replace(F.lower(py_strip(name)), F.lit("  "), F.lit(" "))
    return F.coalesce(F.try_element_at(known, cleaned), name)


def canonicalize_columns(df: DataFrame, synonyms: Mapping[str, str] = K.HEADER_SYNONYMS) -> DataFrame:
    names = canonical_names(df.columns, synonyms)
    return df.withColumnsRenamed({old: new for old, new in zip(df.columns, names) if old != new})


def ensure_columns(df: DataFrame, fixed: Sequence[str] = K.FIXED_COLUMNS, types: Mapping[str, str] | None = None
                   ) -> DataFrame:
    """Missing fixed columns become NULL; fixed columns first, then the
    others in their order."""
    types = types or {}
    s = Slots(df)
    cols = [s.col(c) if c in s.headers else F.lit(None).cast(types.get(c, "string")) for c in fixed]
    extras = [c for c in s.headers if c not in fixed]
    return s.df.select(*cols, *[s.col(c) for c in extras]).toDF(*fixed, *extras)


def lenient_long(text: Column, kind: Column | None = None) -> Column:
    """Integer cast that gives NULL instead of failing: numbers are
    truncated (a whole number is never taken through a double), texts must be
    whole numbers (surrounding blanks allowed)."""
    if kind is None:
        return text.try_cast("long")
    whole = F.trim(text).try_cast("long")
    return F.coalesce(whole, F.when(kind == "n", text.try_cast("double").try_cast("long")))


def lenient_money(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast(MONEY_TYPE)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "^(.*)\\.[^.]*$", 1)


def cast_lenient(df: DataFrame, long_cols: Sequence[str] = LONG_COLUMNS, money_cols: Sequence[str] = MONEY_COLUMNS,
                 kinds: Mapping[str, str | Column] | None = None, text_cols: Sequence[str] = ()) -> DataFrame:
    """Tolerant casts: integers (bad -> NULL), money as DECIMAL, the listed
    text columns as text."""
    kinds = kinds or {}
    s = Slots(df)

    def cast(c: str, slot: str) -> Column:
        value = F.col(slot)
        if c in long_cols:
            # A kind is a column of ``df`` itself.
            kind = kinds.get(c)
            return lenient_long(value, s.col(kind) if isinstance(kind, str) else kind)
        if c in money_cols:
            return lenient_money(value)
        return value.cast("string") if c in text_cols else value
    return s.df.select(*[cast(c, slot) for c, slot in zip(s.names, s.slots)]).toDF(*s.names)


def tag_source(df: DataFrame, path_col: str = "path", out: str = "sumber_file") -> DataFrame:
    """File stem of the row's source file."""
    return df.withColumn(out, file_stem(F.col(path_col)))


def add_class(df: DataFrame, code_col: str = "kode_barang", out: str = "golongan_bmn") -> DataFrame:
    if code_col not in df.columns:
        raise ValueError(f"column {code_col!r} is required to classify the rows")
    return df.withColumn(out, classify_by_prefix(F.col(code_col)))


def select_rename_display(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.select(*[qcol(k).alias(v) for k, v in labels.items()])


def validate_columns(df: DataFrame, required: Sequence[str] = K.REQUIRED_COLUMNS) -> list[str]:
    """Required columns missing from the schema (no job runs)."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def union_strict(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concatenation: every frame must have the same columns."""
    if not frames:
        raise ValueError("nothing to union")
    first = frames[0]
    for f in frames[1:]:
        if sorted(f.columns) != sorted(first.columns):
            raise ValueError(f"column mismatch: {sorted(first.columns)} vs {sorted(f.columns)}")
    out = first
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
