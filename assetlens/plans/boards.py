"""Queries of the composite jobs: register store, dashboards and layouts.

Each dashboard is one table of tagged rows.  The SQL is put together from that
of the single results in ``plans.queries``; importing this module registers
the queries there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import format_count
from ..functions.text import display_or_dash
from ..operators import aggregate as A
from ..operators import columns as C
from ..operators import sheets as S
from ..session import checkpoint_dir
from ..sources import payloads as P
from ..sources.parquet import read_register, write_register
from . import bindings as B
from . import jobs as J
from .queries import (ASSETS_CTE, CAPAIAN_CTE, ORACLE_SQL, SEL_AGENCIES, SEL_CLASSES, SEL_PLACE, SEL_TYPES, TARGET_CTE,
                      TARGET_HEADERS, UNITS_CTE, _COMPLETION_SQL, _q, query, sql_clean)


def _shared_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- register store (S4, S5, S9, P8) and ingest (E1, E2) -------------------------



@query("register_store_rows", f"""WITH {ASSETS_CTE}
SELECT golongan_bmn, nama_satker, COUNT(*) AS jumlah, COUNT(DISTINCT kode_barang) AS kode,
       CAST(SUM(nilai_perolehan) AS DOUBLE) AS total_nilai, 0 AS kolom_kurang
FROM assets WHERE right(nama_satker, 1) IN ('3', '7') GROUP BY golongan_bmn, nama_satker""")
def q_register_store_rows(spark, sf_dir):
    """The register written clustered by class and unit, read back through the
    view's filter on units."""
    path = _shared_folder(spark, "register-store")
    write_register(B.assets(spark, sf_dir), path, ["golongan_bmn"], ["nama_satker"])
    back = read_register(spark, path, view=None)
    missing = C.validate_columns(back)
    return (back.filter(F.right("nama_satker", F.lit(1)).isin("3", "7")).groupBy("golongan_bmn", "nama_satker")
            .agg(F.count(F.lit(1)).alias("jumlah"), F.count_distinct("kode_barang").alias("kode"),
                 F.sum("nilai_perolehan").cast("double").alias("total_nilai"),
                 F.lit(len(missing)).alias("kolom_kurang")))


LAYOUT_HEADERS = ["No", "Kode  Barang", "NUP", "nilai_perolehan", "Merek"]


@query("register_layouts", """
SELECT CAST(o_orderkey AS BIGINT) AS nomor, CAST(o_custkey % 10 AS BIGINT) AS nup,
       'buku_' || CAST(o_custkey % 50 AS VARCHAR) AS sumber_file, o_orderpriority AS "Merek",
       CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS nilai_perolehan FROM orders""")
def q_register_layouts(spark, sf_dir):
    """Orders as workbooks, each with an order of its header row of its own
    (rotated by its number) and a spelling of its own."""
    o = B.table(spark, sf_dir, "orders")
    book = F.col("o_custkey") % 50
    values = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
                     (F.col("o_custkey") % 10).cast("string"), F.col("o_totalprice").cast("decimal(20,2)").cast("string"),
                     F.col("o_orderpriority"))
    n = len(LAYOUT_HEADERS)

    def rotated(array: Column, by: Column) -> Column:
        turn = (by % n).cast("int")
        return F.concat(F.slice(array, turn + 1, n), F.slice(array, 1, turn))
    path = F.concat(F.lit("file:/books/buku_"), book.cast("string"), F.lit(".xlsx"))
    kinds = rotated(F.array(*[F.lit(k) for k in "nsnns"]), book)
    data = o.select(path.alias("path"), (F.col("o_orderkey") + 2).cast("long").alias("_row"),
                    rotated(values, book).alias("cells"), kinds.alias("kinds"))
    spelled = F.transform(F.array(*map(F.lit, LAYOUT_HEADERS)), lambda h: F.when(
        (book % 2 == 0) & ~h.isin("nilai_perolehan", "Merek"), F.concat(F.lit(" "), F.upper(h))).otherwise(h))
    heads = o.select(path.alias("path"), F.lit(1).cast("long").alias("_row"), rotated(spelled, book).alias("cells"),
                     kinds.alias("kinds")).distinct()
    reg = J.register_frame(spark, [], rows=heads.unionByName(data))
    return reg.select("nomor", "nup", "sumber_file", "Merek", F.col("nilai_perolehan").cast("double").alias(
        "nilai_perolehan"))


@query("unit_dimension_rows", """
SELECT DISTINCT lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS kode_kl, 'KL ' || CAST(s_nationkey AS VARCHAR) AS nama_kl,
       CAST(s_suppkey AS VARCHAR) AS kode_satker, s_name AS nama_satker,
       CASE WHEN s_suppkey % 4 = 0 THEN 'KAB. BADUNG' ELSE 'KOTA DENPASAR' END AS kab_kota
FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 < 2""")
def q_unit_dimension_rows(spark, sf_dir):
    """Suppliers as rows of the unit export: a third is not active, half has
    no known place."""
    s = B.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    known = {1: key.cast("string"), 2: F.col("s_name"), 3: F.lpad(F.col("s_nationkey").cast("string"), 3, "0"),
             4: F.concat(F.lit("KL "), F.col("s_nationkey").cast("string")),
             19: F.when(key % 3 == 0, F.lit("TIDAK AKTIF")).otherwise(F.lit(f" {K.ACTIVE_STATUS} ")),
             22: F.element_at(F.array(*map(F.lit, ["Kab. Badung", "Kota Denpasar, Bali", "Jakarta", ""])),
                              (key % 4 + 1).cast("int"))}
    cells = F.array(*[known.get(i, F.lit(None).cast("string")) for i in range(K.UNIT_EXPORT_WIDTH)])
    kinds = F.array(*[F.lit("s" if i in known else "") for i in range(K.UNIT_EXPORT_WIDTH)])
    rows = s.select(F.lit("file:/books/units.xlsx").alias("path"), (key + 2).cast("long").alias("_row"),
                    cells.alias("cells"), kinds.alias("kinds"))
    return J.unit_dimension_frame(spark, "", rows)


# --- dashboards (E3, E4, E5) ------------------------------------------------------

def _tagged(df: DataFrame, section: str, label: str | None, count: str | None, value: str | None) -> DataFrame:
    def of(name, kind):
        return F.lit(None).cast(kind) if name is None else F.col(name).cast(kind)
    return df.select(F.lit(section).alias("section"), of(label, "string").alias("label"),
                     of(count, "long").alias("jumlah"), of(value, "double").alias("nilai"))


def _tagged_sql(parts) -> str:
    rows = [f"SELECT '{section}' AS section, CAST({label or 'NULL'} AS VARCHAR) AS label, "
            f"CAST({count or 'NULL'} AS BIGINT) AS jumlah, CAST({value or 'NULL'} AS DOUBLE) AS nilai\nFROM ({sql})"
            for section, sql, label, count, value in parts]
    return "\nUNION ALL ".join(rows)


REGISTER_BOARD = [
    ("metrics", "metric_cards_filtered", None, "jumlah_aset", "total_nilai_perolehan"),
    ("units", "count_units", None, "jumlah_satker", None),
    ("summary", "summary_filtered", "golongan_bmn", "jumlah_aset", "total_nilai_buku"),
    ("top_units_value", "top_units_value", "nama", None, "total_nilai"),
    ("top_units_count", "top_units_count", "nama", "total_nilai", None),
    ("top_agencies_value", "top_agencies_value", "nama", None, "total_nilai"),
    ("types", "distinct_types", "jenis_bmn", None, None),
]


@query("register_board", _tagged_sql([(tag, ORACLE_SQL[name], *cols) for tag, name, *cols in REGISTER_BOARD]))
def q_register_board(spark, sf_dir):
    """The register dashboard for one selection, from the cube of earlier
    workbooks and the rows of a new one."""
    register = B.assets(spark, sf_dir)
    new = F.col("nomor") % 5 == 0
    board = J.register_dashboard(
        spark, register.filter(new), B.units(spark, sf_dir),
        J.Selection(classes=SEL_CLASSES, types=SEL_TYPES, agencies=SEL_AGENCIES), centres=B.REGION_CENTRES,
        cubes=[A.register_cube(register.filter(~new | F.col("nomor").isNull()))])
    found = {"metrics": board.metrics, "units": board.unit_count, "summary": board.summary,
             "top_units_value": board.top_units["value"], "top_units_count": board.top_units["count"],
             "top_agencies_value": board.top_agencies["value"], "types": board.options["jenis_bmn"]}
    out = None
    for tag, _, label, count, value in REGISTER_BOARD:
        part = _tagged(found[tag], tag, label, count, value)
        out = part if out is None else out.unionByName(part)
    return out


UNIT_BOARD = [
    ("overview", "unit_overview_place", None, "jumlah_satker", "jumlah_kl"),
    ("kd", "unit_overview_place", None, "kd", None),
    ("agencies", None, "Nama K/L", "jumlah_satker", None),
    ("listing", "unit_listing", "Kode Satker", None, None),
    ("places", None, "Kab/Kota", None, None),
]


def _unit_board_sql() -> str:
    own = {"agencies": f"""WITH {UNITS_CTE} SELECT "Nama K/L", COUNT(*) AS jumlah_satker FROM units
                           WHERE "Kab/Kota" = '{SEL_PLACE}' AND "Nama K/L" IS NOT NULL GROUP BY 1""",
           "places": f'WITH {UNITS_CTE} SELECT DISTINCT "Kab/Kota" FROM units WHERE "Kab/Kota" IS NOT NULL'}
    return _tagged_sql([(tag, own.get(tag) or ORACLE_SQL[name], *[c if c is None else _q(c) for c in cols])
                        for tag, name, *cols in UNIT_BOARD])


@query("unit_board", _unit_board_sql())
def q_unit_board(spark, sf_dir):
    """The unit drill-down for one place."""
    board = J.unit_drilldown(spark, B.units(spark, sf_dir), SEL_PLACE, B.REGION_CENTRES)
    found = {"overview": board.overview, "kd": board.overview, "agencies": board.per_agency, "listing": board.listing,
             "places": board.places}
    out = None
    for tag, _, label, count, value in UNIT_BOARD:
        part = _tagged(found[tag], tag, label, count, value)
        out = part if out is None else out.unionByName(part)
    return out


IGT_HEADERS = ["Jenis", "Jumlah Bidang", "% Capaian IGT"]


def _tab_board_sql() -> str:
    filled = " UNION ALL ".join(
        f"""SELECT name AS tab, 'informative' AS section, '{h}' AS label,
            CAST(coalesce(bool_or({sql_clean(_q(h))} <> ''), FALSE) AS BIGINT) AS value FROM tabs GROUP BY name"""
        for h in TARGET_HEADERS)
    flags = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.TARGET_TABS.items())
    return f"""WITH {TARGET_CTE}, {_COMPLETION_SQL},
tabs AS (SELECT *, CASE "Jenis" {flags} END AS name FROM target WHERE "Jenis" IN ('A', 'N', 'R')),
igt AS (SELECT COUNT(DISTINCT p_type) AS n FROM part)
SELECT name AS tab, 'rows' AS section, '' AS label, total AS value FROM c
UNION ALL SELECT name, 'completed', '', completed FROM c
UNION ALL SELECT name, 'percent', '', CAST(floor(CAST(completed AS DOUBLE) / total * 100 + 0.5) AS BIGINT) FROM c
UNION ALL {filled}
UNION ALL SELECT 'IGT', 'rows', '', n FROM igt
UNION ALL SELECT 'IGT', 'informative', h, 1 FROM igt, (VALUES {", ".join(f"('{h}')" for h in IGT_HEADERS)}) v(h)"""


@query("achievement_board", _tab_board_sql())
def q_achievement_board(spark, sf_dir):
    """Counts, completion and informative columns of four tabs with different
    headers, from one keyed cell table in one pass."""
    def keyed(sheet: DataFrame, tab: Column, headers) -> DataFrame:
        return sheet.select(tab.alias("sheet"), F.array(*[F.col(f"`{h}`") for h in headers]).alias("cells"))
    target = B.target_sheet(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for kv in B.TARGET_TABS.items() for x in kv])
    rows = keyed(target, F.try_element_at(names, F.col("Jenis")), TARGET_HEADERS).unionByName(
        keyed(B.igt_sheet(spark, sf_dir), F.lit("IGT"), IGT_HEADERS))
    headers = {**{tab: TARGET_HEADERS for tab in B.TARGET_TABS.values()}, "IGT": IGT_HEADERS}
    return S.tab_board(rows, headers)


# --- other layouts (S8, A17, F11, F12, P14) and display texts (X10, X11) ---------

LINE_CELLS = ["l_partkey", "l_suppkey", "l_returnflag"]
LETTERS = [chr(65 + i) for i in range(7 * len(LINE_CELLS))]


def _letter_sql() -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {i // 3 + 1} THEN CAST({LINE_CELLS[i % 3]} AS VARCHAR) "
                      f"END), '') AS \"{letter}\"" for i, letter in enumerate(LETTERS))
    return f"SELECT l_orderkey AS _row, {cells} FROM lineitem GROUP BY l_orderkey"


@query("letter_sheet", _letter_sql())
def q_letter_sheet(spark, sf_dir):
    """An order's lines side by side, scattered from long cells."""
    li = B.table(spark, sf_dir, "lineitem")
    first = (F.col("l_linenumber") - 1) * len(LINE_CELLS)
    cells = li.select(F.lit("lines").alias("sheet"), F.col("l_orderkey").cast("long").alias("_row"), F.inline(F.array(
        *[F.struct((first + i).cast("int").alias("_col"), F.col(c).cast("string").alias("value"))
          for i, c in enumerate(LINE_CELLS)])))
    widths = P.cell_widths(cells)
    return P.letter_sheet(P.scatter_cells(cells, widths), with_sheet=False, widths=widths)


INDEX_WIDTH = 8


def _index_cell(i: int) -> str:
    """Cell i (from 1) of an order: column numbers, formulas in a few or many
    cells, blanks, or plain numbers.  The same text is SQL for both engines."""
    return f"""CASE o_orderkey % 7 WHEN 0 THEN CAST({i} AS STRING)
        WHEN 1 THEN {f"concat('=A', CAST({i} AS STRING))" if i <= 3 else "''"}
        WHEN 2 THEN concat('=S', CAST({i} AS STRING)) WHEN 3 THEN ''
        ELSE CAST(o_orderkey * {i} AS STRING) END"""


@query("index_rows", f"""
SELECT o_orderkey AS _row, {", ".join(f'{_index_cell(i)} AS "{chr(64 + i)}"' for i in range(1, INDEX_WIDTH + 1))}
FROM orders WHERE o_orderkey % 7 NOT IN (0, 2, 3)""")
def q_index_rows(spark, sf_dir):
    """Rows of column numbers, of formulas and blank ones are dropped."""
    o = B.table(spark, sf_dir, "orders")
    sheet = o.select(F.col("o_orderkey").cast("long").alias("_row"), *[
        F.expr(_index_cell(i)).alias(chr(64 + i)) for i in range(1, INDEX_WIDTH + 1)])
    return S.drop_index_rows(sheet)


RAW_WIDTH = 50
_RAW_CODE = "CASE WHEN s_suppkey % 5 = 4 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') ELSE 'baris' END"


def _positional_sql() -> str:
    texts = {n for n in K.KPI_RAW_POSITIONS if n.endswith(("_q1", "_pct"))}
    values = ", ".join(f"CAST(s_suppkey * {pos} AS VARCHAR) AS {n}" if n in texts else
                       f"CAST(s_suppkey * {pos} AS DOUBLE) AS {n}" for n, pos in K.KPI_RAW_POSITIONS.items())
    return f"SELECT {values} FROM supplier WHERE s_suppkey % 5 = 4 ORDER BY s_suppkey LIMIT 1"


@query("kpis_positional", _positional_sql())
def q_kpis_positional(spark, sf_dir):
    """Supplier rows as a raw overview of 50 columns: title rows without a
    code come first."""
    s = B.table(spark, sf_dir, "supplier")
    cells = [F.expr(_RAW_CODE.replace("VARCHAR", "STRING")), F.col("s_name"),
             *[F.when(F.col("s_suppkey") % 5 == 4, (F.col("s_suppkey") * i).cast("string")).otherwise(F.lit(""))
               for i in range(2, RAW_WIDTH)]]
    rows = s.select(F.lit("raw").alias("sheet"), F.col("s_suppkey").cast("long").alias("_row"),
                    F.array(*cells).alias("cells"))
    return S.achievement_kpis_positional(P.letter_sheet(rows, with_sheet=False))


LAST_MATCH_HEADERS = [
    "TOTAL CAPAIAN K1 NUP", "Bidang", "K2 NUP", "Bidang 2", "K2 NUP akhir", "Bidang 3", "K3 NUP", "Bidang 4",
    "K4 NUP", "Bidang 5", "JUMLAH KOMPONEN A Capaian", "Q1", "Pct", "Permasalahan hukum Bidang", "Q1 hukum",
    "Pct hukum", "Permasalahan Penatausahaan Bidang", "Q1 penatausahaan", "Pct penatausahaan", "Konsolidasi Bidang",
    "Q1 konsolidasi", "Pct konsolidasi"]
LAST_MATCH = {
    "k1_nup": 0, "k1_bidang": 1, "k2_nup": 4, "k2_bidang": 5, "k3_nup": 6, "k3_bidang": 7, "k4_nup": 8, "k4_bidang": 9,
    "total_bidang": 10, "total_q1": 11, "total_pct": 12, "hukum_bidang": 13, "hukum_q1": 14, "hukum_pct": 15,
    "penatausahaan_bidang": 16, "penatausahaan_q1": 17, "penatausahaan_pct": 18, "konsolidasi_bidang": 19,
    "konsolidasi_q1": 20, "konsolidasi_pct": 21}


def _last_match_sql() -> str:
    values = ", ".join(f"CAST(s_suppkey * {i + 11} AS {'VARCHAR' if n.endswith(('_q1', '_pct')) else 'DOUBLE'}) AS {n}"
                       for n, i in LAST_MATCH.items())
    return f"SELECT {values} FROM supplier WHERE s_suppkey % 4 = 3 ORDER BY s_suppkey LIMIT 1"


@query("kpis_last_match", _last_match_sql())
def q_kpis_last_match(spark, sf_dir):
    """Supplier rows under tokens that occur twice; rows of column numbers
    come first and are no data."""
    s = B.table(spark, sf_dir, "supplier")
    data = F.col("s_suppkey") % 4 == 3
    sheet = s.select(F.col("s_suppkey").cast("long").alias("_row"), *[
        F.when(data, (F.col("s_suppkey") * (i + 11)).cast("string")).otherwise(F.lit(str(i + 1))).alias(h)
        for i, h in enumerate(LAST_MATCH_HEADERS)])
    return S.achievement_kpis_last_match(sheet)


@query("relabelled_overview", f"""WITH {CAPAIAN_CTE}
SELECT c0 AS "K1 NUP", c1 AS "K1 Bidang", c2 AS "K2 NUP", c8 AS "Jumlah Capaian", c9 AS "% Capaian",
       c14 AS "Konsolidasi", c15 AS "% Q2 Konsolidasi", c16 AS "% Konsolidasi" FROM cap""")
def q_relabelled_overview(spark, sf_dir):
    """The overview's first row under its display labels."""
    sheet = B.capaian_sheet(spark, sf_dir)
    labels = [label for _, label in S.relabel_positional(sheet)]
    shown = sheet.filter("_row = 0").drop("_row").toDF(*labels)
    return shown.select("K1 NUP", "K1 Bidang", "K2 NUP", "Jumlah Capaian", "% Capaian", "Konsolidasi",
                        "% Q2 Konsolidasi", "% Konsolidasi")


@query("display_texts", f"""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE o_orderpriority END AS shown,
       format('{{:,}}', o_custkey * 997) AS counted
FROM orders""")
def q_display_texts(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", display_or_dash(F.when(F.col("o_custkey") % 3 == 0, F.lit(" \t")).otherwise(
            F.col("o_orderpriority"))).alias("shown"),
        format_count((F.col("o_custkey") * 997).cast("double")).alias("counted"))
