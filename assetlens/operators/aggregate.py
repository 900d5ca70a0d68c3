"""Register aggregates, rankings and listings.

All aggregates are plain ``groupBy``/``agg`` (partial aggregation before the
shuffle, so a group holding a third of the rows costs one partial row per
task).  Money columns are DECIMAL and are summed exactly, then shown as
DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.classify import list_position, unit_type
from .filters import filter_by_dimension, filter_equals_or_all, filter_in, keep_known, where_nonnull


def money_sum(col: str) -> Column:
    """``COALESCE(SUM(col), 0)`` as DOUBLE (exact DECIMAL sum underneath)."""
    return F.coalesce(F.sum(F.col(col)), F.lit(0)).cast("double")


# Columns of a register cube: rows and non-NULL item numbers behind a group.
ROWS, NUMBERED = "__rows", "__nomor"


def row_count(df: DataFrame) -> Column:
    """Register rows: counted, or summed when ``df`` is a cube."""
    if ROWS in df.columns:
        return F.coalesce(F.sum(ROWS), F.lit(0)).cast("long")
    return F.count(F.lit(1))


def register_cube(register: DataFrame, keys: Sequence[str] = ("nama_satker", "golongan_bmn", "jenis_bmn", "kab_kota"),
                  value_cols: Sequence[str] = ("nilai_perolehan", "nilai_buku"),
                  count_col: str = "nomor") -> DataFrame:
    """The register reduced to one row per key combination, with additive
    measures.  Every aggregate below takes a cube in place of the register, so
    a page of results reads the register once, and joins on a unit carry one
    row per unit and class instead of one per asset."""
    return register.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(ROWS), F.count(F.col(count_col)).alias(NUMBERED),
        *[F.sum(c).alias(c) for c in value_cols])


def merge_cubes(cubes: Sequence[DataFrame], keys: Sequence[str] = ("nama_satker", "golongan_bmn", "jenis_bmn", "kab_kota")
                ) -> DataFrame:
    """One cube of several over the same keys: all measures are additive, so a
    new workbook only needs a cube of its own rows to join the others'."""
    merged = cubes[0]
    for cube in cubes[1:]:
        merged = merged.unionByName(cube)
    return merged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in merged.columns if c not in keys])


def metric_cards(df: DataFrame, value_cols: Sequence[str] = ("nilai_perolehan", "nilai_buku")) -> DataFrame:
    """Row count and the two money totals in one pass (one row, also for an
    empty input)."""
    return df.agg(row_count(df).alias("jumlah_aset"),
                  *[money_sum(c).alias(f"total_{c}") for c in value_cols])


def count_units(register: DataFrame, units: DataFrame | None, agencies: Sequence[str] | None = None,
                unit_names: Sequence[str] | None = None, unit_col: str = "nama_satker",
                dim_unit_col: str = "Nama Satker", dim_agency_col: str = "Nama K/L", selected: bool = False
                ) -> DataFrame:
    """Number of work units: with an agency or unit selection, the distinct
    non-NULL unit names of the register under only those two filters;
    otherwise the row count of the unit table; 0 without one.  ``selected``
    says that ``register`` holds the agencies' units only."""
    spark = register.sparkSession
    if agencies or unit_names or selected:
        df = register.filter(F.col(unit_col).isNotNull())
        df = filter_in(df, {unit_col: unit_names or []})
        df = filter_by_dimension(df, units, unit_col, dim_unit_col, dim_agency_col, agencies)
        return df.agg(F.count_distinct(F.col(unit_col)).alias("jumlah_satker"))
    if units is not None:
        return units.agg(F.count(F.lit(1)).alias("jumlah_satker"))
    return spark.range(1).select(F.lit(0).cast("long").alias("jumlah_satker"))


def dashboard_filter(register: DataFrame, units: DataFrame | None = None, classes=None, types=None,
                     unit_names=None, agencies=None) -> DataFrame:
    """The sidebar filter: class, type and unit lists plus the agency
    semi-join through the unit table."""
    df = filter_in(register, {"golongan_bmn": classes or [], "jenis_bmn": types or [],
                              "nama_satker": unit_names or []})
    return filter_by_dimension(df, units, "nama_satker", "Nama Satker", "Nama K/L", agencies)


def summary_by_class(df: DataFrame, class_col: str = "golongan_bmn",
                     value_cols: Sequence[str] = ("nilai_perolehan", "nilai_buku"),
                     order: Sequence[str] = K.CLASS_ORDER) -> DataFrame:
    """Count and money totals per class, in the class display order (classes
    outside the order last)."""
    out = df.groupBy(class_col).agg(row_count(df).alias("jumlah_aset"),
                                    *[money_sum(c).alias(f"total_{c}") for c in value_cols])
    return out.orderBy(list_position(F.col(class_col), order).asc_nulls_last(), F.col(class_col).asc_nulls_last())


def summary_with_total(df: DataFrame, class_col: str = "golongan_bmn",
                       value_cols: Sequence[str] = ("nilai_perolehan", "nilai_buku"),
                       order: Sequence[str] = K.CLASS_ORDER, total_label: str = K.TOTAL_LABEL) -> DataFrame:
    """Class summary plus a TOTAL row, in one ``ROLLUP`` pass; the total row
    is told apart from a NULL class by ``grouping()``."""
    out = (df.rollup(class_col)
           .agg(F.grouping(class_col).alias("is_total"), row_count(df).alias("jumlah_aset"),
                *[money_sum(c).alias(f"total_{c}") for c in value_cols]))
    label = F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(class_col))
    out = out.select(label.alias(class_col), (F.col("is_total") == 1).alias("is_total"), "jumlah_aset",
                     *[f"total_{c}" for c in value_cols])
    return out.orderBy(F.col("is_total").asc(), list_position(F.col(class_col), order).asc_nulls_last(),
                       F.col(class_col).asc_nulls_last())


def append_total(summary: DataFrame, totals: DataFrame, key_col: str, total_label: str = K.TOTAL_LABEL) -> DataFrame:
    """Append a total row (from ``metric_cards``) below a summary."""
    cols = [c for c in summary.columns if c != key_col]
    return summary.unionByName(totals.select(F.lit(total_label).alias(key_col), *cols))


def count_by_type(df: DataFrame, type_col: str = "jenis_bmn") -> DataFrame:
    return (df.groupBy(type_col).agg(row_count(df).alias("jumlah"))
            .orderBy(F.col("jumlah").desc(), F.col(type_col).asc_nulls_last()))


def distinct_values(df: DataFrame, col: str, drop_null: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of a column, sorted (or in a given list order)."""
    out = df.select(col)
    if drop_null:
        out = out.filter(F.col(col).isNotNull())
    out = out.distinct()
    if order is not None:
        return out.orderBy(list_position(F.col(col), order).asc_nulls_last(), F.col(col).asc_nulls_last())
    return out.orderBy(F.col(col).asc_nulls_last())


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def top_k_units(df: DataFrame, measure: str = "value", name_col: str = "nama_satker",
                value_col: str = "nilai_perolehan", k: int = K.TOP_K) -> DataFrame:
    """Top-k units by money total or row count (the NULL unit takes part);
    ties broken by name.  Plans as partial aggregate -> TakeOrderedAndProject."""
    agg = money_sum(value_col) if measure == "value" else row_count(df)
    return (df.groupBy(F.col(name_col).alias("nama")).agg(agg.alias("total_nilai"))
            .orderBy(F.col("total_nilai").desc(), F.col("nama").asc_nulls_last()).limit(k))


def agency_totals(units: DataFrame, register: DataFrame, measure: str = "value",
                  dim_unit_col: str = "Nama Satker", dim_agency_col: str = "Nama K/L",
                  unit_col: str = "nama_satker", value_col: str = "nilai_perolehan",
                  count_col: str = "nomor", dedupe: bool = False) -> DataFrame:
    """Every agency's total: the unit table joined with the register on the
    unit name and summed per agency.  A unit name listed twice in the unit
    table counts twice (``dedupe=True`` removes that).

    The register is first reduced to one row per unit (partial aggregation),
    so the join and the shuffle carry one row per unit, not one per asset -
    also when one unit holds a large share of the register."""
    per_unit = (register.filter(F.col(unit_col).isNotNull()).groupBy(unit_col)
                .agg(F.sum(F.col(value_col)).alias("__v"),
                     (F.sum(NUMBERED) if NUMBERED in register.columns else F.count(F.col(count_col))).alias("__n")))
    dim = units.select(F.col(dim_unit_col).alias("__unit"), F.col(dim_agency_col).alias("nama"))
    if dedupe:
        dim = dim.distinct()
    joined = dim.join(per_unit, dim["__unit"] == per_unit[unit_col], "inner")
    agg = (F.coalesce(F.sum("__v"), F.lit(0)).cast("double") if measure == "value"
           else F.coalesce(F.sum("__n"), F.lit(0)).cast("long"))
    return joined.groupBy("nama").agg(agg.alias("total_nilai"))


def top_k_agencies(units: DataFrame, register: DataFrame, measure: str = "value", k: int = K.TOP_K,
                   **kw) -> DataFrame:
    """Top-k agencies by money total or asset count, ties broken by name."""
    return (agency_totals(units, register, measure, **kw)
            .orderBy(F.col("total_nilai").desc(), F.col("nama").asc_nulls_last()).limit(k))


def with_unit_type(units: DataFrame, code_col: str = "Kode Satker") -> DataFrame:
    return units.withColumn("tipe_satker", unit_type(F.col(code_col)))


def unit_overview(units: DataFrame, place: str | None = None, place_col: str = "Kab/Kota",
                  agency_col: str = "Nama K/L", code_col: str = "Kode Satker",
                  types: Sequence[str] = K.UNIT_TYPES) -> DataFrame:
    """Distinct agencies, unit count and count per unit type, for one place
    or all."""
    df = filter_equals_or_all(units, place_col, place)
    t = unit_type(F.col(code_col))
    return df.agg(F.count_distinct(F.col(agency_col)).alias("jumlah_kl"),
                  F.count(F.lit(1)).alias("jumlah_satker"),
                  *[F.count_if(t == F.lit(x)).alias(x.lower()) for x in types])


def units_per_place(units: DataFrame, place: str | None = None, place_col: str = "Kab/Kota") -> DataFrame:
    df = filter_equals_or_all(units, place_col, place)
    return (df.filter(F.col(place_col).isNotNull()).groupBy(place_col)
            .agg(F.count(F.lit(1)).alias("jumlah")).orderBy(place_col))


def units_per_agency(units: DataFrame, place: str | None = None, place_col: str = "Kab/Kota",
                     agency_col: str = "Nama K/L") -> DataFrame:
    df = filter_equals_or_all(units, place_col, place)
    return (df.filter(F.col(agency_col).isNotNull()).groupBy(agency_col)
            .agg(F.count(F.lit(1)).alias("jumlah_satker"))
            .orderBy(F.col("jumlah_satker").desc(), F.col(agency_col).asc()))


def unit_listing(units: DataFrame, place: str, place_col: str = "Kab/Kota",
                 cols: Sequence[str] = ("Kode Satker", "Nama Satker", "Nama K/L"),
                 sort_col: str = "Nama K/L") -> DataFrame:
    """Units of one place, sorted by agency (range-partitioned sort)."""
    return (units.filter(F.col(place_col) == F.lit(place)).select(*cols)
            .orderBy(F.col(sort_col).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in cols if c != sort_col]))


def order_by_list(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Sort by position in a list; unknown values last."""
    return df.orderBy(list_position(F.col(col), values).asc_nulls_last(), F.col(col).asc_nulls_last())


def sort_multi(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def dashboard_grouping_sets(df: DataFrame, class_col: str = "golongan_bmn", type_col: str = "jenis_bmn",
                            place_col: str = "kab_kota",
                            value_cols: Sequence[str] = ("nilai_perolehan", "nilai_buku")) -> DataFrame:
    """Class summary, type counts, raw place totals and the global metrics of
    the (filtered) register in ONE scan and one shuffle:
    ``GROUPING SETS ((class), (type), (place), ())``.  On an empty input
    there is no 'total' row (use ``metric_cards`` for guaranteed zeros)."""
    g = df.groupingSets([[class_col], [type_col], [place_col], []], class_col, type_col, place_col)
    out = g.agg(F.grouping(class_col).alias("__gc"), F.grouping(type_col).alias("__gt"),
                F.grouping(place_col).alias("__gp"), row_count(df).alias("jumlah_aset"),
                *[money_sum(c).alias(f"total_{c}") for c in value_cols])
    dimension = (F.when(F.col("__gc") == 0, F.lit(class_col)).when(F.col("__gt") == 0, F.lit(type_col))
                 .when(F.col("__gp") == 0, F.lit(place_col)).otherwise(F.lit("total")))
    key = (F.when(F.col("__gc") == 0, F.col(class_col)).when(F.col("__gt") == 0, F.col(type_col))
           .when(F.col("__gp") == 0, F.col(place_col)))
    return out.select(dimension.alias("dimension"), key.cast("string").alias("key"), "jumlah_aset",
                      *[f"total_{c}" for c in value_cols])


def place_aggregate(df: DataFrame, cleaner, centres: DataFrame, place_col: str = "kab_kota",
                    value_col: str = "nilai_perolehan", centre_key: str = "place") -> DataFrame:
    """Totals per cleaned place, only for places with a map centre.

    Two phases: aggregate on the raw place text (partial aggregation, one row
    per distinct spelling), clean those few groups, keep the known places and
    aggregate again.  The cleaner never runs per asset row."""
    raw = (where_nonnull(df, place_col).groupBy(F.col(place_col).alias("kab_raw"))
           .agg(row_count(df).alias("jumlah_aset"), F.coalesce(F.sum(F.col(value_col)), F.lit(0)).alias("__v")))
    cleaned = raw.withColumn("kab_kota", cleaner(F.col("kab_raw")))
    known = keep_known(cleaned, "kab_kota", centres, centre_key)
    return (known.groupBy("kab_kota")
            .agg(F.sum("jumlah_aset").cast("long").alias("jumlah_aset"),
                 F.sum("__v").cast("double").alias("total_nilai")))
