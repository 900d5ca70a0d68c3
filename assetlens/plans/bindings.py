"""Binding of the driver's tables to the operators' inputs.

* ``assets``: the asset register view = lineitem LEFT JOIN (supplier, nation,
  region).  nomor=l_orderkey, nup=l_linenumber, kode_barang=l_partkey text,
  class from its first digit, jenis_bmn=l_returnflag, unit=s_name,
  nilai_perolehan=l_extendedprice, nilai_buku=l_extendedprice*(1-l_discount)
  rounded to cents, kab_kota=r_name.
* ``units``: the work-unit detail table = supplier JOIN nation JOIN region
  with display column names.
* sheets: all-text tables shaped like the achievement sheets, derived from
  lineitem / orders.

Every SQL text in ``plans.queries`` spells out the same bindings for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.classify import classify_by_prefix
from ..operators.aggregate import register_cube

# Binding parameter (not a reference value): map centres for the region
# names that play the part of places.  One region is left without a centre so
# that the "unknown place is dropped" rule is exercised.
REGION_CENTRES = {
    "AFRICA": (0.0, 20.0),
    "AMERICA": (15.0, -90.0),
    "ASIA": (35.0, 100.0),
    "EUROPE": (50.0, 10.0),
}

CODE_WIDTH = 9
# A sum of this type holds 28 digits before the point.
LINE_MONEY = "decimal(20,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy scan of one table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_code(suppkey: Column) -> Column:
    """Work-unit code: the key, zero-padded to at least ``CODE_WIDTH`` digits,
    plus a type suffix cycling over the unit types."""
    types = K.UNIT_TYPES
    suffix = None
    for i, t in enumerate(types):
        cond = (suppkey % len(types)) == i
        suffix = F.when(cond, F.lit(t)) if suffix is None else suffix.when(cond, F.lit(t))
    digits = suppkey.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(CODE_WIDTH)), F.lit("0")), suffix)


def unit_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: key, code, name, agency, place."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("__suppkey"),
                    unit_code(F.col("s_suppkey")).alias("kode_satker"),
                    F.col("s_name").alias("nama_satker"),
                    F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("kode_kl"),
                    F.col("n_name").alias("nama_kl"),
                    F.col("r_name").alias("kab_kota")))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work-unit detail table with its display column names."""
    d = unit_dimension(spark, sf_dir)
    return d.select(*[F.col(k).alias(v) for k, v in K.UNIT_DETAIL_LABELS.items()])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as register rows, still without the unit's columns."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(LINE_MONEY)
    factor = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
    book = F.round(price * factor, 2).cast(LINE_MONEY)
    code = F.col("l_partkey").cast("string")
    return li.select(
        F.col("l_orderkey").alias("nomor"),
        F.col("l_returnflag").alias("jenis_bmn"),
        F.col("l_suppkey").alias("__suppkey"),
        code.alias("kode_barang"),
        F.col("l_linenumber").cast("long").alias("nup"),
        classify_by_prefix(code).alias("golongan_bmn"),
        price.alias("nilai_perolehan"),
        book.alias("nilai_buku"),
    )


def assets(spark: SparkSession, sf_dir: str, with_units: bool = True) -> DataFrame:
    """The asset register view over lineitem.

    ``with_units=False`` leaves out the unit dimension (the unit, code and
    place columns are NULL).  Because the dimension is joined LEFT on its key,
    queries that read none of those columns get the same rows either way and
    skip the join."""
    base = _lines(spark, sf_dir)
    if with_units:
        dim = unit_dimension(spark, sf_dir).select("__suppkey", "kode_satker", "nama_satker", "kab_kota")
        base = base.join(dim, "__suppkey", "left")
    else:
        base = base.select("*", F.lit(None).cast("string").alias("kode_satker"),
                           F.lit(None).cast("string").alias("nama_satker"),
                           F.lit(None).cast("string").alias("kab_kota"))
    return base.select("nomor", "jenis_bmn", "kode_satker", "nama_satker", "kode_barang", "nup",
                       "golongan_bmn", "nilai_perolehan", "nilai_buku", "kab_kota")


def asset_cube(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("golongan_bmn", "jenis_bmn")) -> DataFrame:
    """The register view as a cube over ``keys`` and the unit's columns.

    Lineitem is reduced per supplier key and ``keys`` before the dimension is
    joined, so the join carries one row per unit and key combination; columns
    outside ``keys`` and the dimension are gone."""
    per_unit = register_cube(_lines(spark, sf_dir), ["__suppkey", *keys])
    dim = unit_dimension(spark, sf_dir).select("__suppkey", "kode_satker", "nama_satker", "nama_kl", "kab_kota")
    return per_unit.join(dim, "__suppkey", "left")


def selected_cube(spark: SparkSession, sf_dir: str, agencies, keys: tuple[str, ...] = ("golongan_bmn", "jenis_bmn")
                  ) -> DataFrame:
    """The cube of the units whose name belongs to one of the agencies.  The
    selection becomes supplier keys first; the dimension is joined once."""
    per_unit = register_cube(_lines(spark, sf_dir), ["__suppkey", *keys])
    return per_unit.join(selected_units(spark, sf_dir, agencies), "__suppkey")


def selected_units(spark: SparkSession, sf_dir: str, agencies) -> DataFrame:
    """Dimension rows whose unit name is among the agencies' unit names (a
    name may belong to several units)."""
    dim = unit_dimension(spark, sf_dir).select("__suppkey", "kode_satker", "nama_satker", "nama_kl", "kab_kota")
    chosen = F.max(F.col("nama_kl").isin(list(agencies))).over(Window.partitionBy("nama_satker"))
    return dim.withColumn("__chosen", chosen).filter("__chosen AND nama_satker IS NOT NULL").drop("__chosen")


def selected_assets(spark: SparkSession, sf_dir: str, agencies) -> DataFrame:
    """The register view's rows of the agencies' units."""
    return _lines(spark, sf_dir).join(selected_units(spark, sf_dir, agencies), "__suppkey")


# --- sheets ----------------------------------------------------------------

def target_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An achievement target sheet (K1..K3 style): one text row per lineitem.

    ``Progres`` is the quantity as a share of 50 (so 50 -> '100%'), the
    problem column is the discount text, blank for no discount."""
    li = table(spark, sf_dir, "lineitem")
    pct = F.round(F.col("l_quantity") * 2).cast("int").cast("string")
    disc = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return li.select(
        F.col("l_orderkey").cast("string").alias("Nomor"),
        F.col("l_linenumber").cast("string").alias("Baris"),
        F.col("l_partkey").cast("string").alias("Kode Barang"),
        F.col("l_returnflag").alias("Jenis"),
        F.col("l_linestatus").alias("Status"),
        F.concat(pct, F.lit("%")).alias("Progres"),
        F.when(F.col("l_discount") == 0, F.lit("")).otherwise(F.concat(F.lit("Diskon "), disc, F.lit("%")))
        .alias(K.PROBLEM_COLUMN_NAME),
    )


def action_plan_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action-plan sheet with merged-cell gaps, one row per (order, line)
    of lineitem (sheet order = (order, line), so ``_row`` is unique): the
    order number only on line 1, the largest return flag (blank for 'N'),
    the largest line status and the number of lineitem rows."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("_row"),
        F.when(F.col("l_linenumber") == 1, F.col("l_orderkey").cast("string")).otherwise(F.lit("")).alias("No"),
        F.when(F.col("flag") == "N", F.lit("")).otherwise(F.col("flag")).alias("Jenis"),
        F.col("status").alias("Status"),
        F.col("n").cast("string").alias("Jumlah"),
    )


def percent_text(num: Column, den: Column) -> Column:
    """'ab,c%' with one decimal, truncated, by integer arithmetic (so every
    engine prints the same text)."""
    permille = F.when(den > 0, F.floor(num * 1000 / den)).otherwise(F.lit(0)).cast("long")
    return F.concat((permille / 10).cast("long").cast("string"), F.lit(","), (permille % 10).cast("string"),
                    F.lit("%"))


def id_count_text(c: Column) -> Column:
    """Integer count written with '.' thousands groups."""
    return F.translate(F.format_number(c.cast("double"), 0), ",", ".")


CAPAIAN_HEADERS = [
    "TOTAL CAPAIAN K1 NUP", "Bidang", "K2 NUP", "Bidang 2", "K3 NUP", "Bidang 3", "K4 NUP", "Bidang 4",
    "JUMLAH KOMPONEN A Capaian", "% Capaian", "Permasalahan hukum Bidang", "% Capaian Hukum",
    "Permasalahan Penatausahaan Bidang", "% Capaian Penatausahaan", "Konsolidasi Bidang",
    "% Q2 Konsolidasi", "% Konsolidasi",
]


def capaian_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overview sheet: one row per order priority (sheet order = priority
    order).  K1..K3 = orders with status F, O, P; K4 = all orders; NUP = order
    count, Bidang = distinct customers; percent texts are shares of all
    orders."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")

    # Distinct customers without expanding the rows: per (priority, customer)
    # first, then a customer counts where it has orders.
    per_customer = o.groupBy("o_orderpriority", "o_custkey").agg(
        *[F.count_if(st == v).alias(f"n_{v}") for v in "FOP"], F.count(F.lit(1)).alias("n_all"))

    def orders(v):
        return F.sum(f"n_{v}")

    def customers(v):
        return F.count_if((F.col(f"n_{v}") > 0) & F.col("o_custkey").isNotNull())
    agg = per_customer.groupBy("o_orderpriority").agg(
        orders("F").alias("a"), customers("F").alias("b"), orders("O").alias("c"), customers("O").alias("d"),
        orders("P").alias("e"), customers("P").alias("f"), orders("all").alias("g"), customers("all").alias("h"))
    w = Window.orderBy("o_orderpriority")
    return agg.select(
        (F.row_number().over(w) - 1).cast("long").alias("_row"),
        *[id_count_text(F.col(x)).alias(hd) for x, hd in zip("abcdefgh", CAPAIAN_HEADERS[:8])],
        id_count_text(F.col("g")).alias(CAPAIAN_HEADERS[8]),
        percent_text(F.col("a"), F.col("g")).alias(CAPAIAN_HEADERS[9]),
        id_count_text(F.col("c")).alias(CAPAIAN_HEADERS[10]),
        percent_text(F.col("c"), F.col("g")).alias(CAPAIAN_HEADERS[11]),
        id_count_text(F.col("e")).alias(CAPAIAN_HEADERS[12]),
        percent_text(F.col("e"), F.col("g")).alias(CAPAIAN_HEADERS[13]),
        id_count_text(F.col("a") + F.col("c")).alias(CAPAIAN_HEADERS[14]),
        percent_text(F.col("a") + F.col("c"), F.col("g")).alias(CAPAIAN_HEADERS[15]),
        percent_text(F.col("b"), F.col("h")).alias(CAPAIAN_HEADERS[16]),
    )


def igt_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IGT sheet: one row per part type (sheet order = type order); the
    achievement percent is the share of parts of size 25 or more."""
    p = table(spark, sf_dir, "part")
    agg = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") >= 25).alias("big"))
    w = Window.orderBy("p_type")
    return agg.select((F.row_number().over(w) - 1).cast("long").alias("_row"),
                      F.col("p_type").alias("Jenis"), id_count_text(F.col("n")).alias("Jumlah Bidang"),
                      percent_text(F.col("big"), F.col("n")).alias("% Capaian IGT"))


def orders_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet over orders with a column that is blank on every row in
    practice (a note for negative totals) and a two-letter header."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("long").alias("_row"),
        F.col("o_orderkey").cast("string").alias("No"),
        F.col("o_custkey").cast("string").alias("Pelanggan"),
        F.col("o_orderstatus").alias("KD"),
        F.col("o_orderpriority").alias("Prioritas"),
        F.when(F.col("o_totalprice") < 0, F.lit("negatif")).otherwise(F.lit("")).alias("Catatan"),
    )


# Tabs of the target sheet: the return flag picks the tab.
TARGET_TABS = {"A": "K1", "N": "K2", "R": "K3"}


# Place spellings for the place-cleaner queries: every customer gets a raw
# place text built from a prefix, a place word and a suffix chosen by its
# keys (binding parameters, not reference values).
PLACE_WORDS = ["Badung", "bangli", "BULELENG", "Gianyar", "Jembrana", "Karangasem", "Klungkung", "Tabanan",
               "Denpasar", "Kuta Selatan", "Mangupura", "Semarapura", "Bali", "Jakarta", "Deanpasar"]
PLACE_PREFIXES = ["", "Kab. ", "Kabupaten ", " ", "Kota "]
PLACE_SUFFIXES = ["", ", Bali", " ", " dan Tabanan"]


def _pick(words, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (idx % len(words) + 1).cast("int"))


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = F.concat(_pick(PLACE_PREFIXES, F.col("c_custkey")), _pick(PLACE_WORDS, F.col("c_nationkey")),
                   _pick(PLACE_SUFFIXES, F.floor(F.col("c_custkey") / len(PLACE_PREFIXES))))
    return c.select(F.col("c_custkey"), raw.alias("raw"))


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals spread over unit ranges (x 10^0..10^7, every third one
    negative) and written as Indonesian number and percent texts."""
    o = table(spark, sf_dir, "orders")
    scale = F.pow(F.lit(10.0), (F.col("o_orderkey") % 8).cast("double"))
    sign = F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    whole = F.floor(F.col("o_totalprice")).cast("long")
    cents = F.round((F.col("o_totalprice") - F.floor(F.col("o_totalprice"))) * 100).cast("long")
    id_text = F.concat(id_count_text(whole), F.lit(","), F.lpad(cents.cast("string"), 2, "0"))
    pct = F.concat((F.col("o_custkey") % 1000).cast("string"), F.lit(","), (F.col("o_orderkey") % 10).cast("string"),
                   F.lit("%"))
    pct = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Rp "), pct)).otherwise(pct)
    return o.select("o_orderkey", (F.col("o_totalprice") * scale * sign).alias("amount"),
                    id_text.alias("id_text"), pct.alias("pct_text"))


REGISTER_SOURCES = {
    "part": ["No", "Jenis", "Kode Barang", "NUP", "nilai_perolehan", "Merek"],
    "customer": ["no", "jenis_bmn", "kode_barang", "nomor_urut_pendaftaran", "nilai_perolehan", "Merek"],
}


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part and customer written as decoded workbook rows (path, _row,
    cells, kinds): row 1 the header, then one row per table row, numbers as
    their Python text."""
    def num(c):
        return F.col(c).cast("string")
    p = table(spark, sf_dir, "part").select(
        F.lit("/tables/part.xlsx").alias("path"), (F.col("p_partkey") + 2).alias("_row"),
        F.array(num("p_partkey"), F.col("p_type"), F.col("p_partkey").cast("string"), num("p_size"),
                num("p_retailprice"), F.col("p_brand")).alias("cells"),
        F.array(*[F.lit(k) for k in "nssnns"]).alias("kinds"))
    c = table(spark, sf_dir, "customer").select(
        F.lit("/tables/customer.xlsx").alias("path"), (F.col("c_custkey") + 2).alias("_row"),
        F.array(num("c_custkey"), F.col("c_mktsegment"), F.col("c_custkey").cast("string"), num("c_nationkey"),
                num("c_acctbal"), F.col("c_name")).alias("cells"),
        F.array(*[F.lit(k) for k in "nssnns"]).alias("kinds"))
    headers = spark.createDataFrame(
        [(f"/tables/{name}.xlsx", 1, cols, ["s"] * len(cols)) for name, cols in REGISTER_SOURCES.items()],
        "path string, _row long, cells array<string>, kinds array<string>")
    return headers.unionByName(p.select("path", F.col("_row").cast("long"), "cells", "kinds")).unionByName(
        c.select("path", F.col("_row").cast("long"), "cells", "kinds"))
