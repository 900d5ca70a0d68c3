"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` compute
the same result; output columns carry the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import numbers as NUM
from ..functions.classify import natural_sort_key
from ..functions.places import clean_place_contains, clean_place_exact
from ..functions.text import at, text_or_blank
from ..operators import aggregate as A
from ..operators import columns as C
from ..operators import maps as M
from ..operators import sheets as S
from ..operators import windows as W
from ..operators.filters import drop_blank_rows, filter_active
from ..sources import payloads as P
from ..sources import snapshots as SN
from ..sources.workbooks import read_positional
from . import bindings as B
from . import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# --- SQL spelling of the bindings -------------------------------------------

def _sql_case(expr: str, pairs, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in pairs)
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {whens}{tail} END"


def _sql_list_position(expr: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{v}' THEN {i}" for i, v in enumerate(values)) + " END"


_UNIT_SUFFIX = "CASE " + " ".join(f"WHEN s.s_suppkey % {len(K.UNIT_TYPES)} = {i} THEN '{t}'"
                                  for i, t in enumerate(K.UNIT_TYPES)) + " END"

UNITS_CTE = f"""
units_dim AS (
  SELECT s.s_suppkey AS suppkey,
         lpad(CAST(s.s_suppkey AS VARCHAR), CAST(greatest({B.CODE_WIDTH}, length(CAST(s.s_suppkey AS VARCHAR))) AS INTEGER), '0')
           || {_UNIT_SUFFIX} AS kode_satker,
         s.s_name AS nama_satker,
         lpad(CAST(n.n_nationkey AS VARCHAR), 3, '0') AS kode_kl,
         n.n_name AS nama_kl,
         r.r_name AS kab_kota
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
units AS (
  SELECT kode_kl AS "Kode K/L", nama_kl AS "Nama K/L", kode_satker AS "Kode Satker",
         nama_satker AS "Nama Satker", kab_kota AS "Kab/Kota" FROM units_dim)"""

_CLASS_CASE = _sql_case("substr(CAST(l.l_partkey AS VARCHAR), 1, 1)", K.CLASS_BY_PREFIX.items(), K.UNKNOWN_CLASS)

ASSETS_CTE = UNITS_CTE + f""",
assets AS (
  SELECT l.l_orderkey AS nomor, l.l_returnflag AS jenis_bmn, u.kode_satker, u.nama_satker,
         CAST(l.l_partkey AS VARCHAR) AS kode_barang, CAST(l.l_linenumber AS BIGINT) AS nup,
         {_CLASS_CASE} AS golongan_bmn,
         CAST(l.l_extendedprice AS DECIMAL(20,2)) AS nilai_perolehan,
         CAST(round(CAST(l.l_extendedprice AS DECIMAL(20,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2)
              AS DECIMAL(20,2)) AS nilai_buku,
         u.kab_kota
  FROM lineitem l LEFT JOIN units_dim u ON l.l_suppkey = u.suppkey)"""

CLASS_POS = _sql_list_position("golongan_bmn", K.CLASS_ORDER)

# Dashboard selections used by the filtered queries (the feature under test:
# the sidebar's multi-selects).
SEL_CLASSES = ["TANAH", "PERSEDIAAN", "TIDAK DIKENAL", "ASET TAK BERWUJUD"]
SEL_TYPES = ["A", "R"]
SEL_AGENCIES = ["NATION_1", "NATION_7", "NATION_19", "NATION_24"]
SEL_PLACE = "EUROPE"


def _sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FILTER_SQL = (f"golongan_bmn IN {_sql_in(SEL_CLASSES)} AND jenis_bmn IN {_sql_in(SEL_TYPES)} AND nama_satker IN "
              f"(SELECT \"Nama Satker\" FROM units WHERE \"Nama K/L\" IN {_sql_in(SEL_AGENCIES)})")


def _filtered_cube(spark, sf_dir):
    """The sidebar selection over the register, as a cube: the agencies become
    supplier keys, class and type filter its groups."""
    return A.dashboard_filter(B.selected_cube(spark, sf_dir, SEL_AGENCIES), classes=SEL_CLASSES, types=SEL_TYPES)


# --- register dashboard -----------------------------------------------------

@query("summary_by_class", f"""WITH {ASSETS_CTE}
SELECT golongan_bmn, COUNT(*) AS jumlah_aset,
       CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE) AS total_nilai_perolehan,
       CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) AS total_nilai_buku
FROM assets GROUP BY golongan_bmn ORDER BY {CLASS_POS}""")
def q_summary_by_class(spark, sf_dir):
    return A.summary_by_class(B.assets(spark, sf_dir, with_units=False))


_TOTAL_SQL = f"""
SELECT CASE WHEN GROUPING(golongan_bmn) = 1 THEN '{K.TOTAL_LABEL}' ELSE golongan_bmn END AS golongan_bmn,
       GROUPING(golongan_bmn) = 1 AS is_total, COUNT(*) AS jumlah_aset,
       CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE) AS total_nilai_perolehan,
       CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) AS total_nilai_buku
FROM assets {{where}} GROUP BY ROLLUP (golongan_bmn)"""


@query("summary_with_total", f"WITH {ASSETS_CTE}" + _TOTAL_SQL.format(where=""))
def q_summary_with_total(spark, sf_dir):
    return A.summary_with_total(B.assets(spark, sf_dir, with_units=False))


@query("summary_filtered", f"WITH {ASSETS_CTE}" + _TOTAL_SQL.format(where="WHERE " + FILTER_SQL))
def q_summary_filtered(spark, sf_dir):
    return A.summary_with_total(_filtered_cube(spark, sf_dir))


_METRICS_SQL = """
SELECT COUNT(*) AS jumlah_aset,
       CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE) AS total_nilai_perolehan,
       CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) AS total_nilai_buku
FROM assets {where}"""


@query("metric_cards", f"WITH {ASSETS_CTE}" + _METRICS_SQL.format(where=""))
def q_metric_cards(spark, sf_dir):
    return A.metric_cards(B.assets(spark, sf_dir, with_units=False))


@query("metric_cards_filtered", f"WITH {ASSETS_CTE}" + _METRICS_SQL.format(where="WHERE " + FILTER_SQL))
def q_metric_cards_filtered(spark, sf_dir):
    return A.metric_cards(_filtered_cube(spark, sf_dir))


@query("count_units", f"""WITH {ASSETS_CTE}
SELECT COUNT(DISTINCT nama_satker) AS jumlah_satker FROM assets
WHERE nama_satker IS NOT NULL AND nama_satker IN
  (SELECT "Nama Satker" FROM units WHERE "Nama K/L" IN {_sql_in(SEL_AGENCIES)})""")
def q_count_units(spark, sf_dir):
    return A.count_units(B.selected_cube(spark, sf_dir, SEL_AGENCIES, ()), None, selected=True)


@query("count_units_all", f"""WITH {UNITS_CTE}
SELECT COUNT(*) AS jumlah_satker FROM units""")
def q_count_units_all(spark, sf_dir):
    return A.count_units(B.assets(spark, sf_dir, with_units=False), B.units(spark, sf_dir))


@query("count_by_type", f"""WITH {ASSETS_CTE}
SELECT jenis_bmn, COUNT(*) AS jumlah FROM assets GROUP BY jenis_bmn ORDER BY jumlah DESC""")
def q_count_by_type(spark, sf_dir):
    return A.count_by_type(B.assets(spark, sf_dir, with_units=False))


@query("distinct_classes", f"""WITH {ASSETS_CTE}
SELECT DISTINCT golongan_bmn FROM assets WHERE golongan_bmn IS NOT NULL""")
def q_distinct_classes(spark, sf_dir):
    return A.distinct_values(B.assets(spark, sf_dir, with_units=False), "golongan_bmn", order=K.CLASS_ORDER)


@query("distinct_types", f"""WITH {ASSETS_CTE}
SELECT DISTINCT jenis_bmn FROM assets WHERE jenis_bmn IS NOT NULL""")
def q_distinct_types(spark, sf_dir):
    return A.distinct_values(B.assets(spark, sf_dir, with_units=False), "jenis_bmn")


@query("distinct_units", f"""WITH {ASSETS_CTE}
SELECT DISTINCT nama_satker FROM assets WHERE nama_satker IS NOT NULL""")
def q_distinct_units(spark, sf_dir):
    return A.distinct_values(B.asset_cube(spark, sf_dir, ()), "nama_satker")


@query("distinct_agencies", f"""WITH {UNITS_CTE}
SELECT DISTINCT "Nama K/L" FROM units""")
def q_distinct_agencies(spark, sf_dir):
    return A.distinct_values(B.units(spark, sf_dir), "Nama K/L", drop_null=False)


_TOP_UNITS_SQL = """
SELECT nama_satker AS nama, {agg} AS total_nilai FROM assets GROUP BY nama_satker
ORDER BY total_nilai DESC, nama ASC NULLS LAST LIMIT 20"""


@query("top_units_value", f"WITH {ASSETS_CTE}" + _TOP_UNITS_SQL.format(
    agg="CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE)"))
def q_top_units_value(spark, sf_dir):
    return A.top_k_units(B.asset_cube(spark, sf_dir, ()), "value")


@query("top_units_count", f"WITH {ASSETS_CTE}" + _TOP_UNITS_SQL.format(agg="COUNT(*)"))
def q_top_units_count(spark, sf_dir):
    return A.top_k_units(B.asset_cube(spark, sf_dir, ()), "count")


_TOP_AGENCIES_SQL = """
SELECT s."Nama K/L" AS nama, {agg} AS total_nilai
FROM units s JOIN assets m ON s."Nama Satker" = m.nama_satker
GROUP BY s."Nama K/L" ORDER BY total_nilai DESC, nama ASC NULLS LAST LIMIT 20"""


@query("top_agencies_value", f"WITH {ASSETS_CTE}" + _TOP_AGENCIES_SQL.format(
    agg="CAST(COALESCE(SUM(m.nilai_perolehan), 0) AS DOUBLE)"))
def q_top_agencies_value(spark, sf_dir):
    return A.top_k_agencies(B.units(spark, sf_dir), B.asset_cube(spark, sf_dir, ()), "value")


@query("top_agencies_count", f"WITH {ASSETS_CTE}" + _TOP_AGENCIES_SQL.format(agg="COUNT(m.nomor)"))
def q_top_agencies_count(spark, sf_dir):
    return A.top_k_agencies(B.units(spark, sf_dir), B.asset_cube(spark, sf_dir, ()), "count")


@query("filter_agency_semi", f"""WITH {ASSETS_CTE}
SELECT nomor, nup, nama_satker, golongan_bmn FROM assets
WHERE nama_satker IN (SELECT "Nama Satker" FROM units WHERE "Nama K/L" IN {_sql_in(SEL_AGENCIES)})""")
def q_filter_agency_semi(spark, sf_dir):
    return B.selected_assets(spark, sf_dir, SEL_AGENCIES).select("nomor", "nup", "nama_satker", "golongan_bmn")


@query("dashboard_grouping_sets", f"""WITH {ASSETS_CTE}
SELECT CASE WHEN GROUPING(golongan_bmn) = 0 THEN 'golongan_bmn' WHEN GROUPING(jenis_bmn) = 0 THEN 'jenis_bmn'
            WHEN GROUPING(kab_kota) = 0 THEN 'kab_kota' ELSE 'total' END AS dimension,
       CASE WHEN GROUPING(golongan_bmn) = 0 THEN golongan_bmn WHEN GROUPING(jenis_bmn) = 0 THEN jenis_bmn
            WHEN GROUPING(kab_kota) = 0 THEN kab_kota END AS key,
       COUNT(*) AS jumlah_aset,
       CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE) AS total_nilai_perolehan,
       CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) AS total_nilai_buku
FROM assets WHERE {FILTER_SQL}
GROUP BY GROUPING SETS ((golongan_bmn), (jenis_bmn), (kab_kota), ())""")
def q_dashboard_grouping_sets(spark, sf_dir):
    return A.dashboard_grouping_sets(_filtered_cube(spark, sf_dir))


# --- work-unit drill-down ---------------------------------------------------

_TYPE_COUNTS = ", ".join(f"COUNT(*) FILTER (WHERE right(\"Kode Satker\", 2) = '{t}') AS {t.lower()}"
                         for t in K.UNIT_TYPES)


@query("unit_overview", f"""WITH {UNITS_CTE}
SELECT COUNT(DISTINCT "Nama K/L") AS jumlah_kl, COUNT(*) AS jumlah_satker, {_TYPE_COUNTS} FROM units""")
def q_unit_overview(spark, sf_dir):
    return A.unit_overview(B.units(spark, sf_dir))


@query("unit_overview_place", f"""WITH {UNITS_CTE}
SELECT COUNT(DISTINCT "Nama K/L") AS jumlah_kl, COUNT(*) AS jumlah_satker, {_TYPE_COUNTS} FROM units
WHERE "Kab/Kota" = '{SEL_PLACE}'""")
def q_unit_overview_place(spark, sf_dir):
    return A.unit_overview(B.units(spark, sf_dir), place=SEL_PLACE)


@query("units_per_place", f"""WITH {UNITS_CTE}
SELECT "Kab/Kota", COUNT(*) AS jumlah FROM units WHERE "Kab/Kota" IS NOT NULL GROUP BY "Kab/Kota" ORDER BY 1""")
def q_units_per_place(spark, sf_dir):
    return A.units_per_place(B.units(spark, sf_dir))


@query("units_per_agency", f"""WITH {UNITS_CTE}
SELECT "Nama K/L", COUNT(*) AS jumlah_satker FROM units WHERE "Nama K/L" IS NOT NULL
GROUP BY "Nama K/L" ORDER BY jumlah_satker DESC, 1""")
def q_units_per_agency(spark, sf_dir):
    return A.units_per_agency(B.units(spark, sf_dir))


@query("unit_listing", f"""WITH {UNITS_CTE}
SELECT "Kode Satker", "Nama Satker", "Nama K/L" FROM units WHERE "Kab/Kota" = '{SEL_PLACE}'
ORDER BY "Nama K/L", "Kode Satker", "Nama Satker\"""")
def q_unit_listing(spark, sf_dir):
    return A.unit_listing(B.units(spark, sf_dir), SEL_PLACE)


# --- map layers -------------------------------------------------------------

def _centres_sql(centres) -> str:
    rows = ", ".join(f"('{k}', CAST({v[0]} AS DOUBLE), CAST({v[1]} AS DOUBLE))" for k, v in centres.items())
    return f"centres(place, lat, lon) AS (VALUES {rows})"


def sql_clean_place_exact(expr: str) -> str:
    """DuckDB spelling of the exact place cleaner."""
    stripped = f"trim({expr})"
    n = f"lower({stripped})"
    syn = []
    seen = set()
    for k, v in K.PLACE_SYNONYMS:
        if k not in seen:
            seen.add(k)
            syn.append((k, v))
    exact = _sql_case(n, syn)
    n_norm = f"trim(replace(replace(replace({n}, '.', ''), 'kab ', ''), 'kota ', ''))"
    short = _sql_case(n_norm, K.PLACE_SHORT_NAMES.items())
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE COALESCE({exact}, {short}, upper({stripped})) END"


def sql_clean_place_contains(expr: str) -> str:
    """DuckDB spelling of the contains place cleaner."""
    r = f"replace(replace(lower(trim({expr})), ', bali', ''), 'kab.', 'kab ')"
    syn = []
    seen = set()
    for k, v in K.PLACE_SYNONYMS:
        if k not in seen:
            seen.add(k)
            syn.append((k, v))
    exact = _sql_case(r, syn)
    contains = "CASE " + " ".join(f"WHEN instr({r}, '{k}') > 0 THEN '{v}'" for k, v in K.PLACE_SYNONYMS) + " END"
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE COALESCE({exact}, {contains}) END"


@query("place_layer", f"""WITH {ASSETS_CTE}, {_centres_sql(B.REGION_CENTRES)},
raw AS (SELECT kab_kota AS kab_raw, COUNT(*) AS jumlah_aset, COALESCE(SUM(nilai_perolehan), 0) AS v
        FROM assets WHERE kab_kota IS NOT NULL GROUP BY kab_kota),
cleaned AS (SELECT {sql_clean_place_exact('kab_raw')} AS kab_kota, jumlah_aset, v FROM raw),
agg AS (SELECT kab_kota, CAST(SUM(jumlah_aset) AS BIGINT) AS jumlah_aset, CAST(SUM(v) AS DOUBLE) AS total_nilai
        FROM cleaned WHERE kab_kota IN (SELECT place FROM centres) GROUP BY kab_kota)
SELECT a.kab_kota, c.lat, c.lon, a.jumlah_aset, a.total_nilai,
       greatest(CAST(a.jumlah_aset AS DOUBLE) / 600.0 + 8.0, 10.0) AS radius,
       '<b>' || a.kab_kota || '</b><br>Jumlah NUP: ' || format('{{:,}}', a.jumlah_aset) AS popup
FROM agg a JOIN centres c ON a.kab_kota = c.place""")
def q_place_layer(spark, sf_dir):
    return M.asset_map_layer(B.asset_cube(spark, sf_dir, ()), M.centres_frame(spark, B.REGION_CENTRES),
                             cleaner=clean_place_exact)


@query("unit_layer", f"""WITH {UNITS_CTE}, {_centres_sql(B.REGION_CENTRES)},
counts AS (SELECT "Kab/Kota" AS kab_kota, COUNT(*) AS jumlah FROM units WHERE "Kab/Kota" IS NOT NULL GROUP BY 1)
SELECT k.kab_kota, c.lat, c.lon, k.jumlah, CAST(16 AS DOUBLE) AS radius,
       '<b>' || k.kab_kota || '</b><br>Jumlah Satker: <b>' || CAST(k.jumlah AS VARCHAR) || '</b>' AS popup
FROM counts k JOIN centres c ON k.kab_kota = c.place WHERE k.jumlah > 0""")
def q_unit_layer(spark, sf_dir):
    return M.unit_map_layer(B.units(spark, sf_dir), M.centres_frame(spark, B.REGION_CENTRES))


# --- achievement sheets -------------------------------------------------------


TARGET_HEADERS = ["Nomor", "Baris", "Kode Barang", "Jenis", "Status", "Progres", K.PROBLEM_COLUMN_NAME]

TARGET_CTE = f"""
target AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "Nomor", CAST(l_linenumber AS VARCHAR) AS "Baris",
         CAST(l_partkey AS VARCHAR) AS "Kode Barang", l_returnflag AS "Jenis", l_linestatus AS "Status",
         CAST(CAST(round(l_quantity * 2) AS INTEGER) AS VARCHAR) || '%' AS "Progres",
         CASE WHEN l_discount = 0 THEN ''
              ELSE 'Diskon ' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' END
           AS "{K.PROBLEM_COLUMN_NAME}"
  FROM lineitem)"""


def _q(h: str) -> str:
    return '"' + h.replace('"', '""') + '"'


def sql_clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '\\s+', ' ', 'g'))"


def sql_filter_value(expr: str) -> str:
    c = sql_clean(expr)
    return f"CASE WHEN {c} = '' THEN '{K.EMPTY_TOKEN}' ELSE {c} END"


def sql_search(headers, q: str) -> str:
    joined = "concat_ws(' ', " + ", ".join(f"coalesce({_q(h)}, '')" for h in headers) + ")"
    return f"instr(lower({joined}), '{q.strip().lower()}') > 0"


SEARCH_TERM = "a f 1"
FACET_SEARCH = "diskon"
FACET_FILTERS = {"Status": ["F"], "Jenis": ["A", "R"]}
ROW_FILTERS = {"Status": ["F"], K.PROBLEM_COLUMN_NAME: [K.EMPTY_TOKEN, "Diskon 5%"]}
K3_PROBLEM = "Diskon 10%"


def _target(spark, sf_dir):
    return B.target_sheet(spark, sf_dir)


@query("search_rows", f"""WITH {TARGET_CTE}
SELECT * FROM target WHERE {sql_search(TARGET_HEADERS, SEARCH_TERM)}""")
def q_search_rows(spark, sf_dir):
    return S.search_sheet(_target(spark, sf_dir), SEARCH_TERM)


def _sql_filters(filters) -> str:
    parts = []
    for h, vals in filters.items():
        parts.append(f"{sql_filter_value(_q(h))} IN {_sql_in(vals)}" if vals else "FALSE")
    return " AND ".join(parts) or "TRUE"


@query("column_filters", f"""WITH {TARGET_CTE}
SELECT * FROM target WHERE {_sql_filters(ROW_FILTERS)}""")
def q_column_filters(spark, sf_dir):
    return S.filter_sheet(_target(spark, sf_dir), ROW_FILTERS)


def _facet_sql() -> str:
    oks = ", ".join(f"({sql_filter_value(_q(h))} IN {_sql_in(v)}) AS ok{i}" for i, (h, v) in enumerate(FACET_FILTERS.items()))
    fh = list(FACET_FILTERS)
    parts = []
    for h in TARGET_HEADERS:
        conds = [f"ok{i}" for i, k in enumerate(fh) if k != h]
        where = " AND ".join(conds) or "TRUE"
        parts.append(f"SELECT '{h}' AS header, {sql_filter_value(_q(h))} AS value FROM f WHERE {where}")
    return (f"WITH {TARGET_CTE},\nf AS (SELECT *, {oks} FROM target WHERE {sql_search(TARGET_HEADERS, FACET_SEARCH)}),\n"
            f"u AS ({' UNION '.join(parts)})\n"
            f"SELECT header, value, CASE WHEN value = '{K.EMPTY_TOKEN}' THEN '{K.EMPTY_LABEL}' ELSE value END AS label FROM u")


@query("facet_options", _facet_sql())
def q_facet_options(spark, sf_dir):
    return S.facet_options(_target(spark, sf_dir), FACET_FILTERS, search=FACET_SEARCH)


_PROBLEM_SQL = f"CASE WHEN {sql_clean(_q(K.PROBLEM_COLUMN_NAME))} = '' THEN '{K.EMPTY_LABEL}' ELSE {sql_clean(_q(K.PROBLEM_COLUMN_NAME))} END"


@query("problem_pivot", f"""WITH {TARGET_CTE}
SELECT {_PROBLEM_SQL} AS problem, COUNT(*) AS jumlah FROM target GROUP BY 1 ORDER BY jumlah DESC, problem""")
def q_problem_pivot(spark, sf_dir):
    return S.problem_pivot(_target(spark, sf_dir))


@query("problem_focus", f"""WITH {TARGET_CTE},
p AS (SELECT {_PROBLEM_SQL} AS problem, COUNT(*) AS jumlah FROM target GROUP BY 1)
SELECT (SELECT COUNT(*) FROM p) AS jumlah_jenis,
       (SELECT problem FROM p ORDER BY jumlah DESC, problem LIMIT 1) AS teratas,
       (SELECT MAX(jumlah) FROM p) AS jumlah_teratas""")
def q_problem_focus(spark, sf_dir):
    return S.problem_focus(S.problem_pivot(_target(spark, sf_dir)))


@query("k3_rows", f"""WITH {TARGET_CTE}
SELECT * FROM target WHERE {sql_search(TARGET_HEADERS, FACET_SEARCH)} AND {_PROBLEM_SQL} = '{K3_PROBLEM}'
  AND {_sql_filters(FACET_FILTERS)}""")
def q_k3_rows(spark, sf_dir):
    return S.filter_sheet(_target(spark, sf_dir), FACET_FILTERS, search=FACET_SEARCH, problem=K3_PROBLEM)


@query("row_counts", f"""WITH {TARGET_CTE}
SELECT COUNT(*) FILTER (WHERE {sql_search(TARGET_HEADERS, FACET_SEARCH)} AND {_PROBLEM_SQL} = '{K3_PROBLEM}'
  AND {_sql_filters(FACET_FILTERS)}) AS shown, COUNT(*) AS total FROM target""")
def q_row_counts(spark, sf_dir):
    return S.shown_counts(_target(spark, sf_dir), FACET_FILTERS, search=FACET_SEARCH, problem=K3_PROBLEM)


_TAB_SQL = "CASE " + " ".join(f"WHEN \"Jenis\" = '{k}' THEN '{v}'" for k, v in B.TARGET_TABS.items()) + " END"
_DONE_SQL = (f"regexp_matches(lower(concat_ws(' ', coalesce(\"Status\", ''), coalesce(\"Progres\", ''))), "
             f"'{K.COMPLETION_PATTERN}')")
_COMPLETION_SQL = f"""
c AS (SELECT {_TAB_SQL} AS name, COUNT(*) AS total, COUNT(*) FILTER (WHERE {_DONE_SQL}) AS completed
      FROM target GROUP BY 1)"""


def _tab_summaries(spark, sf_dir):
    sheet = _target(spark, sf_dir)
    tab = None
    for k, v in B.TARGET_TABS.items():
        tab = F.when(F.col("Jenis") == k, F.lit(v)) if tab is None else tab.when(F.col("Jenis") == k, F.lit(v))
    return S.completion_summary(sheet, "", by=tab)


@query("completion_summary", f"""WITH {TARGET_CTE}, {_COMPLETION_SQL}
SELECT name, total, completed,
       CAST(CASE WHEN total > 0 THEN floor(CAST(completed AS DOUBLE) / total * 100 + 0.5) ELSE 0 END AS BIGINT) AS percent
FROM c""")
def q_completion_summary(spark, sf_dir):
    return _tab_summaries(spark, sf_dir)


@query("composition", f"""WITH {TARGET_CTE}, {_COMPLETION_SQL},
g AS (SELECT SUM(total) AS grand FROM c)
SELECT name, total, CAST(floor(CAST(total AS DOUBLE) / grand * 100 + 0.5) AS BIGINT) AS share,
       CAST(greatest(floor(CAST(total AS DOUBLE) / grand * 100 + 0.5), {K.COMPOSITION_MIN_WIDTH}) AS BIGINT) AS width,
       CAST(grand AS BIGINT) AS grand_total
FROM c, g WHERE grand > 0""")
def q_composition(spark, sf_dir):
    return S.composition(_tab_summaries(spark, sf_dir))


ACTION_CTE = """
g AS (
  SELECT l_orderkey, l_linenumber, MAX(l_returnflag) AS flag, MAX(l_linestatus) AS status, COUNT(*) AS n
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
sheet AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS _row,
         CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS "No",
         CASE WHEN flag = 'N' THEN '' ELSE flag END AS "Jenis",
         status AS "Status", CAST(n AS VARCHAR) AS "Jumlah"
  FROM g),
long AS (
  SELECT _row, 'No' AS header, "No" AS value FROM sheet UNION ALL
  SELECT _row, 'Jenis', "Jenis" FROM sheet UNION ALL
  SELECT _row, 'Status', "Status" FROM sheet UNION ALL
  SELECT _row, 'Jumlah', "Jumlah" FROM sheet),
marked AS (SELECT *, trim(coalesce(value, '')) <> '' AS nonblank FROM long),
isl AS (SELECT *, CAST(SUM(CASE WHEN nonblank THEN 1 ELSE 0 END)
                  OVER (PARTITION BY header ORDER BY _row ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM marked),
heads AS (SELECT header, island, COUNT(*) AS span, MAX(CASE WHEN nonblank THEN value END) AS head
          FROM isl WHERE island > 0 GROUP BY header, island)"""


@query("merge_spans", f"""WITH {ACTION_CTE}
SELECT i._row, i.header, i.value, CASE WHEN i.nonblank THEN h.span END AS span,
       (i.island > 0 AND NOT i.nonblank) AS covered, coalesce(h.head, '') AS filled
FROM isl i LEFT JOIN heads h ON i.header = h.header AND i.island = h.island""")
def q_merge_spans(spark, sf_dir):
    return W.merge_spans(B.action_plan_sheet(spark, sf_dir))


@query("fill_down", f"""WITH {ACTION_CTE}
SELECT i._row, i.header, coalesce(h.head, '') AS filled
FROM isl i LEFT JOIN heads h ON i.header = h.header AND i.island = h.island""")
def q_fill_down(spark, sf_dir):
    return W.fill_down(B.action_plan_sheet(spark, sf_dir))


def _sql_id_count(expr: str) -> str:
    return f"replace(format('{{:,}}', CAST({expr} AS BIGINT)), ',', '.')"


def _sql_pct(num: str, den: str) -> str:
    pm = f"CAST(CASE WHEN ({den}) > 0 THEN floor(({num}) * 1000 / ({den})) ELSE 0 END AS BIGINT)"
    return f"CAST({pm} // 10 AS VARCHAR) || ',' || CAST({pm} % 10 AS VARCHAR) || '%'"


def _sql_parse_id(expr: str) -> str:
    s = f"regexp_replace(regexp_replace(replace(coalesce({expr}, ''), '.', ''), '^([^,]*),', '\\1.'), '[^0-9.\\-]', '', 'g')"
    return f"coalesce(TRY_CAST(CASE WHEN regexp_full_match({s}, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN {s} END AS DOUBLE), 0.0) + 0.0"


CAPAIAN_CTE = f"""
agg AS (
  SELECT o_orderpriority,
         COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS a,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS b,
         COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS c,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS d,
         COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS e,
         COUNT(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS f,
         COUNT(*) AS g, COUNT(DISTINCT o_custkey) AS h
  FROM orders GROUP BY o_orderpriority),
first AS (SELECT * FROM agg ORDER BY o_orderpriority LIMIT 1),
cap AS (
  SELECT {_sql_id_count('a')} AS c0, {_sql_id_count('b')} AS c1, {_sql_id_count('c')} AS c2,
         {_sql_id_count('d')} AS c3, {_sql_id_count('e')} AS c4, {_sql_id_count('f')} AS c5,
         {_sql_id_count('g')} AS c6, {_sql_id_count('h')} AS c7, {_sql_id_count('g')} AS c8,
         {_sql_pct('a', 'g')} AS c9, {_sql_id_count('a + c')} AS c14, {_sql_pct('a + c', 'g')} AS c15,
         {_sql_pct('b', 'h')} AS c16
  FROM first)"""


@query("achievement_kpis", f"""WITH {CAPAIAN_CTE},
k AS (SELECT {_sql_parse_id('c0')} AS k1_nup, {_sql_parse_id('c1')} AS k1_bidang,
             {_sql_parse_id('c2')} AS k2_nup, {_sql_parse_id('c3')} AS k2_bidang,
             {_sql_parse_id('c4')} AS k3_nup, {_sql_parse_id('c5')} AS k3_bidang,
             {_sql_parse_id('c6')} AS k4_nup, {_sql_parse_id('c7')} AS k4_bidang,
             {_sql_parse_id('c8')} AS total_bidang, c9 AS total_pct,
             {_sql_parse_id('c14')} AS konsolidasi_bidang, c15 AS konsolidasi_q1, c16 AS konsolidasi_pct
      FROM cap)
SELECT *, CAST(CASE WHEN total_bidang <> 0 THEN floor(k1_bidang / total_bidang * 100 + 0.5) ELSE 0 END AS BIGINT) AS k1_percent,
          CAST(CASE WHEN total_bidang <> 0 THEN floor(k2_bidang / total_bidang * 100 + 0.5) ELSE 0 END AS BIGINT) AS k2_percent,
          CAST(CASE WHEN total_bidang <> 0 THEN floor(k3_bidang / total_bidang * 100 + 0.5) ELSE 0 END AS BIGINT) AS k3_percent
FROM k""")
def q_achievement_kpis(spark, sf_dir):
    return S.achievement_kpis(B.capaian_sheet(spark, sf_dir))


@query("igt_kpi", f"""WITH agg AS (
  SELECT p_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE p_size >= 25) AS big FROM part GROUP BY p_type),
first AS (SELECT {_sql_pct('big', 'n')} AS pct FROM agg ORDER BY p_type LIMIT 1)
SELECT CASE WHEN pct = '' THEN '-' ELSE pct END AS igt_display,
       least(coalesce(TRY_CAST(regexp_extract(replace(replace(pct, '%', ''), ',', '.'),
             '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0.0), 100.0) AS igt_percent,
       (SELECT COUNT(*) FROM agg) AS row_count
FROM first""")
def q_igt_kpi(spark, sf_dir):
    return S.igt_kpi(B.igt_sheet(spark, sf_dir))


ORDERS_SHEET_HEADERS = ["No", "Pelanggan", "KD", "Prioritas", "Catatan"]
ORDERS_SHEET_CTE = """
osheet AS (SELECT CAST(o_orderkey AS VARCHAR) AS "No", CAST(o_custkey AS VARCHAR) AS "Pelanggan",
                  o_orderstatus AS "KD", o_orderpriority AS "Prioritas",
                  CASE WHEN o_totalprice < 0 THEN 'negatif' ELSE '' END AS "Catatan" FROM orders)"""


def _informative_sql(strict: bool) -> str:
    parts = []
    for i, h in enumerate(ORDERS_SHEET_HEADERS):
        keep = "has_value"
        if strict:
            keep += f" AND NOT regexp_full_match('{h}', '{K.LETTER_HEADER_PATTERN[1:-1]}')"
        parts.append(f"SELECT {i} AS position, '{h}' AS header, has_value, ({keep}) AS informative FROM "
                     f"(SELECT coalesce(bool_or({sql_clean(_q(h))} <> ''), FALSE) AS has_value FROM osheet)")
    return f"WITH {ORDERS_SHEET_CTE}\n" + "\nUNION ALL ".join(parts)


@query("informative_columns", _informative_sql(False))
def q_informative_columns(spark, sf_dir):
    return S.informative_report(B.orders_sheet(spark, sf_dir))


@query("informative_columns_strict", _informative_sql(True))
def q_informative_columns_strict(spark, sf_dir):
    return S.informative_report(B.orders_sheet(spark, sf_dir), strict=True)


# --- payload sources and snapshots ------------------------------------------


PAGE_ROWS = 1000
ROUNDTRIP_HEADERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _order_payloads(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    page = F.concat(F.lit("p"), F.floor(F.col("o_orderkey") / PAGE_ROWS).cast("string"))
    src = o.select(page.alias("__page"), F.col("o_orderkey"), *[F.col(c) for c in ROUNDTRIP_HEADERS if c != "o_orderkey"])
    src = src.withColumn("o_orderkey_t", F.col("o_orderkey").cast("string"))
    src = src.select("__page", "o_orderkey", F.col("o_orderkey_t").alias("o_orderkey_text"),
                     F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_totalprice",
                     "o_orderpriority")
    src = src.drop("o_orderkey").withColumnRenamed("o_orderkey_text", "o_orderkey")
    return P.to_payloads(src, F.col("__page"), ROUNDTRIP_HEADERS, F.col("o_orderkey").cast("long"),
                         numeric=["o_totalprice"])


@query("sheet_roundtrip", f"""
SELECT 'p' || CAST(o_orderkey // {PAGE_ROWS} AS VARCHAR) AS sheet,
       CAST(row_number() OVER (PARTITION BY o_orderkey // {PAGE_ROWS} ORDER BY o_orderkey) - 1 AS BIGINT) AS _row,
       CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
            ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
       o_orderpriority
FROM orders""")
def q_sheet_roundtrip(spark, sf_dir):
    parsed = P.parse_payloads(_order_payloads(spark, sf_dir))
    headers, rows = P.normalize_payloads(parsed)
    return P.sheet_frame(headers, rows, header_list=ROUNDTRIP_HEADERS)


@query("sheet_headers", f"""
SELECT DISTINCT 'p' || CAST(o_orderkey // {PAGE_ROWS} AS VARCHAR) AS sheet, h._col, h.header
FROM orders, (VALUES {", ".join(f"({i}, '{h}')" for i, h in enumerate(ROUNDTRIP_HEADERS))}) h(_col, header)""")
def q_sheet_headers(spark, sf_dir):
    parsed = P.parse_payloads(_order_payloads(spark, sf_dir))
    headers, _ = P.normalize_payloads(parsed)
    return headers.select("sheet", F.col("_col").cast("int").alias("_col"), "header")


@query("header_uniqueness", """
WITH h AS (SELECT user_id AS sheet, event_id AS _col, event_type AS name FROM events),
p1 AS (SELECT sheet, _col, CASE WHEN k = 1 THEN name ELSE name || ' ' || CAST(k AS VARCHAR) END AS name
       FROM (SELECT *, row_number() OVER (PARTITION BY sheet, name ORDER BY _col) AS k FROM h)),
p2 AS (SELECT sheet, _col, CASE WHEN k = 1 THEN name ELSE name || ' ' || CAST(k AS VARCHAR) END AS name
       FROM (SELECT *, row_number() OVER (PARTITION BY sheet, name ORDER BY _col) AS k FROM p1))
SELECT sheet, _col, name AS unique_header FROM p2""")
def q_header_uniqueness(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events")
    hdr = ev.select(F.col("user_id").alias("sheet"), F.col("event_id").alias("_col"), F.col("event_type").alias("header"))
    return S.unique_headers(hdr)


SNAPSHOT_NO_CACHE = ["u1"]


def _event_loads(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sheet"), "ts", "event_id",
                     (F.col("event_type") != "error").alias("ok"), F.col("props").alias("data"))


_SNAPSHOT_SQL = f"""
WITH l AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS sheet, ts, event_id, event_type <> 'error' AS ok, props AS data
           FROM events),
cur AS (SELECT sheet, ok, data, ts FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1),
good AS (SELECT sheet, data, ts FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY ts DESC, event_id DESC) AS rn FROM l WHERE ok) WHERE rn = 1),
st AS (
  SELECT c.sheet,
         CASE WHEN c.ok THEN 'live' WHEN c.sheet NOT IN {_sql_in(SNAPSHOT_NO_CACHE)} AND g.sheet IS NOT NULL THEN 'cache'
              ELSE 'failed' END AS source,
         c.ok AS cur_ok, c.data AS cur_data, c.ts AS cur_ts, g.data AS good_data, g.ts AS good_ts
  FROM cur c LEFT JOIN good g ON c.sheet = g.sheet)"""


@query("latest_good_snapshot", _SNAPSHOT_SQL + """
SELECT sheet, source, CASE source WHEN 'live' THEN cur_data WHEN 'cache' THEN good_data END AS data,
       CASE source WHEN 'live' THEN cur_ts WHEN 'cache' THEN good_ts END AS data_ts,
       CASE WHEN NOT cur_ok THEN cur_ts END AS error_ts
FROM st""")
def q_latest_good_snapshot(spark, sf_dir):
    return SN.latest_good_snapshot(_event_loads(spark, sf_dir), no_cache=SNAPSHOT_NO_CACHE, tiebreak_col="event_id")


@query("load_report", _SNAPSHOT_SQL + """
SELECT source, COUNT(*) AS jumlah FROM st GROUP BY source""")
def q_load_report(spark, sf_dir):
    status = SN.latest_good_snapshot(_event_loads(spark, sf_dir), no_cache=SNAPSHOT_NO_CACHE, tiebreak_col="event_id")
    return SN.load_report(status)


# --- scalar functions over derived texts ------------------------------------



def _pick_sql(words, expr: str) -> str:
    arr = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"{arr}[({expr}) % {len(words)} + 1]"


PLACE_TEXT_SQL = f"""
p AS (SELECT c_custkey, {_pick_sql(B.PLACE_PREFIXES, 'c_custkey')} || {_pick_sql(B.PLACE_WORDS, 'c_nationkey')}
                        || {_pick_sql(B.PLACE_SUFFIXES, f'CAST(floor(c_custkey / {len(B.PLACE_PREFIXES)}) AS BIGINT)')} AS raw
      FROM customer)"""


@query("clean_place_contains", f"""WITH {PLACE_TEXT_SQL}
SELECT c_custkey, raw, {sql_clean_place_contains('raw')} AS kab_kota FROM p""")
def q_clean_place_contains(spark, sf_dir):
    t = B.place_texts(spark, sf_dir)
    return t.select("c_custkey", "raw", clean_place_contains(F.col("raw")).alias("kab_kota"))


@query("clean_place_exact", f"""WITH {PLACE_TEXT_SQL}
SELECT c_custkey, raw, {sql_clean_place_exact('raw')} AS kab_kota FROM p""")
def q_clean_place_exact(spark, sf_dir):
    t = B.place_texts(spark, sf_dir)
    return t.select("c_custkey", "raw", clean_place_exact(F.col("raw")).alias("kab_kota"))


MONEY_TEXT_SQL = """
m AS (SELECT o_orderkey,
             o_totalprice * pow(10.0, CAST(o_orderkey % 8 AS DOUBLE)) * CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE 1.0 END
               AS amount,
             replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') || ',' ||
               lpad(CAST(CAST(round((o_totalprice - floor(o_totalprice)) * 100) AS BIGINT) AS VARCHAR), 2, '0') AS id_text,
             CASE WHEN o_orderkey % 7 = 0 THEN 'Rp ' ELSE '' END || CAST(o_custkey % 1000 AS VARCHAR) || ','
               || CAST(o_orderkey % 10 AS VARCHAR) || '%' AS pct_text
      FROM orders)"""


def _sql_rupiah(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '-' "
            f"WHEN abs({x}) >= 1e12 THEN 'Rp ' || format('{{:,.2f}}', {x} / 1e12) || ' T' "
            f"WHEN abs({x}) >= 1e9 THEN 'Rp ' || format('{{:,.2f}}', {x} / 1e9) || ' M' "
            f"WHEN abs({x}) >= 1e6 THEN 'Rp ' || format('{{:,.2f}}', {x} / 1e6) || ' Jt' "
            f"ELSE 'Rp ' || format('{{:,.0f}}', {x}) END")


@query("format_rupiah", f"""WITH {MONEY_TEXT_SQL}
SELECT o_orderkey, amount, {_sql_rupiah('amount')} AS rupiah FROM m""")
def q_format_rupiah(spark, sf_dir):
    m = B.money_texts(spark, sf_dir)
    return m.select("o_orderkey", "amount", NUM.format_rupiah(F.col("amount")).alias("rupiah"))


def _sql_parse_percent(x: str) -> str:
    s = f"regexp_replace(replace({x}, '%', ''), ',', '.')"
    pre = f"regexp_extract({s}, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1)"
    return f"coalesce(TRY_CAST(CASE WHEN {pre} <> '' THEN {pre} END AS DOUBLE), 0.0) + 0.0"


@query("parse_id_number", f"""WITH {MONEY_TEXT_SQL}
SELECT o_orderkey, id_text, {_sql_parse_id('id_text')} AS number FROM m""")
def q_parse_id_number(spark, sf_dir):
    m = B.money_texts(spark, sf_dir)
    return m.select("o_orderkey", "id_text", NUM.parse_id_number(F.col("id_text")).alias("number"))


@query("parse_percent", f"""WITH {MONEY_TEXT_SQL}
SELECT o_orderkey, pct_text, {_sql_parse_percent('pct_text')} AS prefix,
       least({_sql_parse_percent('pct_text')}, 100.0) AS capped FROM m""")
def q_parse_percent(spark, sf_dir):
    m = B.money_texts(spark, sf_dir)
    pre = NUM.parse_percent_prefix(F.col("pct_text"))
    return m.select("o_orderkey", "pct_text", pre.alias("prefix"), F.least(pre, F.lit(100.0)).alias("capped"))


@query("format_id_number", """
SELECT o_orderkey,
       regexp_replace(replace(replace(replace(format('{:,.3f}', round(o_totalprice, 3)), ',', '#'), '.', ','), '#', '.'),
                      ',?0+$', '') AS id_number
FROM orders""")
def q_format_id_number(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", NUM.format_id_number(F.col("o_totalprice")).alias("id_number"))


# --- register build over table-derived workbook rows ------------------------

def _register_sql() -> str:
    cls = _sql_case("substr(kode_barang, 1, 1)", K.CLASS_BY_PREFIX.items(), K.UNKNOWN_CLASS)
    return f"""
WITH r AS (
  SELECT 'part' AS sumber_file, p_partkey AS nomor, p_type AS jenis_bmn, CAST(p_partkey AS VARCHAR) AS kode_barang,
         CAST(p_size AS BIGINT) AS nup, CAST(p_retailprice AS VARCHAR) AS v, p_brand AS "Merek" FROM part
  UNION ALL
  SELECT 'customer', c_custkey, c_mktsegment, CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS BIGINT),
         CAST(c_acctbal AS VARCHAR), c_name FROM customer)
SELECT nomor, jenis_bmn, CAST(NULL AS VARCHAR) AS kode_satker, CAST(NULL AS VARCHAR) AS nama_satker, kode_barang, nup,
       {cls} AS golongan_bmn, CAST(TRY_CAST(trim(v) AS DECIMAL(18,2)) AS DOUBLE) AS nilai_perolehan, "Merek", sumber_file
FROM r"""


@query("classify_cast_register", _register_sql())
def q_classify_cast_register(spark, sf_dir):
    reg = J.register_frame(spark, [], rows=B.register_rows(spark, sf_dir))
    return reg.withColumn("nilai_perolehan", F.col("nilai_perolehan").cast("double"))


@query("union_sources", f"""WITH s AS ({_register_sql()})
SELECT sumber_file, COUNT(*) AS jumlah, COUNT(nomor) AS dengan_nomor, COUNT(DISTINCT golongan_bmn) AS golongan
FROM s GROUP BY sumber_file""")
def q_union_sources(spark, sf_dir):
    """The same rows as wide tables: rename, tag, classify, cast, fill, union."""
    wide = B.register_rows(spark, sf_dir).filter("_row > 1")
    frames = []
    for name, headers in B.REGISTER_SOURCES.items():
        kinds = [f"{h}__kind" for h in headers]
        one = wide.filter(F.col("path") == f"/tables/{name}.xlsx").select(
            "path", *[at("cells", i + 1) for i in range(len(headers))],
            *[at("kinds", i + 1) for i in range(len(headers))]).toDF("path", *headers, *kinds)
        names = dict(zip(headers, C.canonical_names(headers)))
        numeric = {names[h]: f"{h}__kind" for h in headers if names[h] in C.LONG_COLUMNS}
        one = C.cast_lenient(C.add_class(C.tag_source(C.canonicalize_columns(one))), kinds=numeric)
        frames.append(C.ensure_columns(one.drop("path", *kinds), types={"nomor": "long", "nup": "long"}))
    reg = C.union_strict(frames)
    return reg.groupBy("sumber_file").agg(F.count(F.lit(1)).alias("jumlah"), F.count("nomor").alias("dengan_nomor"),
                                          F.count_distinct("golongan_bmn").alias("golongan"))


@query("restrict_to_used", f"""WITH {ASSETS_CTE}
SELECT DISTINCT kode_kl AS "Kode K/L", nama_kl AS "Nama K/L", kode_satker AS "Kode Satker",
       nama_satker AS "Nama Satker", kab_kota AS "Kab/Kota"
FROM units_dim WHERE nama_satker IN (SELECT nama_satker FROM assets)""")
def q_restrict_to_used(spark, sf_dir):
    dim = B.unit_dimension(spark, sf_dir).drop("__suppkey")
    return J.unit_detail_frame(dim, B.asset_cube(spark, sf_dir, ()))


# --- order of sorted results ---------------------------------------------------

def _positions(df: DataFrame) -> DataFrame:
    """A sorted result with the position of each row: row ids rise along a
    sorted frame, so their rank is the order the operator produced."""
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    return marked.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__id"))).drop("__id")


@query("type_count_order", f"""WITH {ASSETS_CTE}, c AS (SELECT jenis_bmn, COUNT(*) AS jumlah FROM assets GROUP BY jenis_bmn)
SELECT *, row_number() OVER (ORDER BY jumlah DESC, jenis_bmn NULLS LAST) AS position FROM c""")
def q_type_count_order(spark, sf_dir):
    return _positions(A.count_by_type(B.assets(spark, sf_dir, with_units=False)))


@query("agency_order", f"""WITH {UNITS_CTE},
c AS (SELECT "Nama K/L", COUNT(*) AS jumlah_satker FROM units WHERE "Nama K/L" IS NOT NULL GROUP BY "Nama K/L")
SELECT *, row_number() OVER (ORDER BY jumlah_satker DESC, "Nama K/L") AS position FROM c""")
def q_agency_order(spark, sf_dir):
    return _positions(A.units_per_agency(B.units(spark, sf_dir)))


@query("listing_order", f"""WITH {UNITS_CTE}
SELECT "Kode Satker", "Nama Satker", "Nama K/L",
       row_number() OVER (ORDER BY "Nama K/L" NULLS LAST, "Kode Satker" NULLS LAST, "Nama Satker" NULLS LAST) AS position
FROM units WHERE "Kab/Kota" = '{SEL_PLACE}'""")
def q_listing_order(spark, sf_dir):
    return _positions(A.unit_listing(B.units(spark, sf_dir), SEL_PLACE))


@query("detail_order", f"""WITH {ASSETS_CTE}, d AS (SELECT DISTINCT * FROM units u
                              WHERE u."Nama Satker" IN (SELECT nama_satker FROM assets))
SELECT *, row_number() OVER (ORDER BY "Kab/Kota" NULLS LAST, "Nama K/L" NULLS LAST, "Nama Satker" NULLS LAST)
          AS position
FROM d""")
def q_detail_order(spark, sf_dir):
    names = B.asset_cube(spark, sf_dir, ()).select("nama_satker").distinct().withColumnRenamed("nama_satker", "Nama Satker")
    used = B.units(spark, sf_dir).join(names, "Nama Satker", "left_semi").select(*K.UNIT_DETAIL_LABELS.values()).distinct()
    return _positions(A.sort_multi(used, ["Kab/Kota", "Nama K/L", "Nama Satker"]))


@query("class_order", f"""WITH {ASSETS_CTE}, c AS (SELECT DISTINCT golongan_bmn FROM assets WHERE golongan_bmn IS NOT NULL)
SELECT golongan_bmn, row_number() OVER (ORDER BY {CLASS_POS} NULLS LAST, golongan_bmn) AS position FROM c""")
def q_class_order(spark, sf_dir):
    classes = A.distinct_values(B.assets(spark, sf_dir, with_units=False), "golongan_bmn")
    return _positions(A.order_by_list(classes, "golongan_bmn", K.CLASS_ORDER))


# Texts with a number of varying width behind a word in varying case.
SIZE_LABEL_SQL = "(CASE WHEN p_size % 2 = 0 THEN 'Ukuran ' ELSE 'UKURAN ' END) || CAST(p_size * p_size * 997 AS VARCHAR)"


@query("natural_order", f"""WITH c AS (SELECT DISTINCT p_size, {SIZE_LABEL_SQL} AS label FROM part)
SELECT label, row_number() OVER (ORDER BY p_size) AS position FROM c""")
def q_natural_order(spark, sf_dir):
    size = F.col("p_size").cast("long")
    label = F.concat(F.when(size % 2 == 0, F.lit("Ukuran ")).otherwise(F.lit("UKURAN ")),
                     (size * size * 997).cast("string"))
    labels = B.table(spark, sf_dir, "part").select(label.alias("label")).distinct()
    return _positions(labels.withColumn("key", natural_sort_key("label")).orderBy("key").drop("key"))


@query("facet_order", f"""WITH {TARGET_CTE},
u AS (SELECT DISTINCT 0 AS place, 'Baris' AS header, {sql_filter_value('"Baris"')} AS value FROM target
      UNION SELECT DISTINCT 1, 'Progres', {sql_filter_value('"Progres"')} FROM target
      UNION SELECT DISTINCT 2, '{K.PROBLEM_COLUMN_NAME}', {sql_filter_value(_q(K.PROBLEM_COLUMN_NAME))} FROM target),
l AS (SELECT *, CASE WHEN value = '{K.EMPTY_TOKEN}' THEN '{K.EMPTY_LABEL}' ELSE value END AS label FROM u)
SELECT header, value, label, row_number() OVER (ORDER BY place, regexp_extract(lower(label), '^[^0-9]*'),
           coalesce(TRY_CAST(regexp_extract(label, '[0-9]+') AS BIGINT), -1)) AS position FROM l""")
def q_facet_order(spark, sf_dir):
    return _positions(S.facet_options(_target(spark, sf_dir), headers=["Baris", "Progres", K.PROBLEM_COLUMN_NAME]))


# --- headers of every kind -------------------------------------------------------

ODD_HEADERS = ["No.", "Tgl. Terbit", "Status", "status", "Nilai `a`"]
ODD_SQL = """odd AS (SELECT CAST(o_orderkey AS VARCHAR) AS h0, strftime(o_orderdate, '%Y-%m-%d') AS h1,
                     o_orderstatus AS h2, lower(o_orderpriority) AS h3, CAST(o_custkey % 7 AS VARCHAR) AS h4 FROM orders)"""


def _odd_sheet(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus",
                    F.lower("o_orderpriority"), (F.col("o_custkey") % 7).cast("string")).toDF(*ODD_HEADERS)


@query("odd_header_rows", f"""WITH {ODD_SQL} SELECT h0 AS c0, h1 AS c1, h2 AS c2, h3 AS c3, h4 AS c4 FROM odd
WHERE h2 IN ('F', 'P') AND h3 <> '' AND h4 IN ('1', '3')
  AND instr(lower(concat_ws(' ', h0, h1, h2, h3, h4)), '-03-') > 0""")
def q_odd_header_rows(spark, sf_dir):
    rows = S.filter_sheet(_odd_sheet(spark, sf_dir), {"Status": ["F", "P"], "Nilai `a`": ["1", "3"]}, search=" -03- ")
    return rows.toDF(*[f"c{i}" for i in range(len(ODD_HEADERS))])


@query("odd_header_facets", f"""WITH {ODD_SQL},
u AS (SELECT 'Status' AS header, h2 AS value FROM odd WHERE h3 = '1-urgent'
      UNION SELECT 'status', h3 FROM odd
      UNION SELECT 'Nilai `a`', h4 FROM odd WHERE h3 = '1-urgent')
SELECT header, value, value AS label FROM u""")
def q_odd_header_facets(spark, sf_dir):
    return S.facet_options(_odd_sheet(spark, sf_dir), {"status": ["1-urgent"]}, headers=ODD_HEADERS[2:])


# --- further sheet and ingest operators --------------------------------------------

PROMOTED_HEADERS = ["Nomor Order", "Pelanggan", "Status Order", "Prioritas"]


@query("promoted_header_rows", f"""
SELECT 'p' || CAST(o_orderkey // {PAGE_ROWS} AS VARCHAR) AS sheet,
       CAST(row_number() OVER (PARTITION BY o_orderkey // {PAGE_ROWS} ORDER BY o_orderkey) - 1 AS BIGINT) AS _row,
       CAST(o_orderkey AS VARCHAR) AS "Nomor Order", CAST(o_custkey AS VARCHAR) AS "Pelanggan",
       o_orderstatus AS "Status Order", o_orderpriority AS "Prioritas"
FROM orders""")
def q_promoted_header_rows(spark, sf_dir):
    """Tabs with letter headers whose first row holds the real ones."""
    o = B.table(spark, sf_dir, "orders")
    letters = ["A", "B", "C", "D"]
    page = F.floor(F.col("o_orderkey") / PAGE_ROWS)
    rows = o.select(page.alias("page"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("A"),
                    F.col("o_custkey").cast("string").alias("B"), F.col("o_orderstatus").alias("C"),
                    F.col("o_orderpriority").alias("D"))
    heads = rows.select("page").distinct().select(
        "page", F.lit(-1).cast("long").alias("place"), *[F.lit(h).alias(x) for x, h in zip(letters, PROMOTED_HEADERS)])
    tabs = P.to_payloads(rows.unionByName(heads), F.concat(F.lit("p"), F.col("page").cast("string")), letters,
                         F.col("place"))
    headers, out = P.normalize_payloads(P.parse_payloads(tabs))
    return P.sheet_frame(headers, out, header_list=PROMOTED_HEADERS)


@query("active_suppliers", """
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 1""")
def q_active_suppliers(spark, sf_dir):
    key = F.col("s_suppkey") % 3
    status = (F.when(key == 0, F.lit(K.ACTIVE_STATUS)).when(key == 2, F.lit(f"\t{K.ACTIVE_STATUS} "))
              .otherwise(F.lit("Tidak")))
    rows = B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", status.alias("status"))
    return filter_active(rows, "status").drop("status")


@query("nonblank_rows", """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE o_orderstatus END AS a,
       CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_orderpriority END AS b
FROM orders WHERE o_custkey % 6 <> 0""")
def q_nonblank_rows(spark, sf_dir):
    c = F.col("o_custkey")
    rows = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(c % 2 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("a"),
        F.when(c % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("b"))
    return drop_blank_rows(rows, ["a", "b"], blank_is_empty=True)


@query("positional_rows", """
SELECT p_type AS jenis, CAST(p_size AS VARCHAR) AS nup, p_brand AS merek, 'n' AS nup__kind FROM part
UNION ALL SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name, 'n' FROM customer""")
def q_positional_rows(spark, sf_dir):
    rows = read_positional(B.register_rows(spark, sf_dir), {"jenis": 1, "nup": 3, "merek": 5}, 6)
    return rows.select("jenis", "nup", "merek", "nup__kind")


@query("appended_total", f"""WITH {ASSETS_CTE},
s AS (SELECT golongan_bmn, COUNT(*) AS jumlah_aset,
             CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE) AS total_nilai_perolehan,
             CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) AS total_nilai_buku FROM assets GROUP BY golongan_bmn)
SELECT * FROM s UNION ALL
SELECT '{K.TOTAL_LABEL}', COUNT(*), CAST(COALESCE(SUM(nilai_perolehan), 0) AS DOUBLE),
       CAST(COALESCE(SUM(nilai_buku), 0) AS DOUBLE) FROM assets""")
def q_appended_total(spark, sf_dir):
    rows = B.assets(spark, sf_dir, with_units=False)
    return A.append_total(A.summary_by_class(rows), A.metric_cards(rows), "golongan_bmn")


@query("falsy_texts", """
SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey % 5 AS VARCHAR) END AS number_text,
       CAST(o_custkey % 5 AS VARCHAR) AS text_text, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '000' END AS zeros
FROM orders""")
def q_falsy_texts(spark, sf_dir):
    c = F.col("o_custkey") % 5
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", text_or_blank(c).alias("number_text"), text_or_blank(c.cast("string")).alias("text_text"),
        text_or_blank(F.when(F.col("o_custkey") % 2 != 0, F.lit("000"))).alias("zeros"))


@query("category_total", f"""WITH {TARGET_CTE}, {_COMPLETION_SQL}
SELECT CAST(SUM(total) AS BIGINT) AS total FROM c""")
def q_category_total(spark, sf_dir):
    tab = F.element_at(F.create_map(*[F.lit(x) for kv in B.TARGET_TABS.items() for x in kv]), F.col("Jenis"))
    return S.category_total_fallback(S.completion_summary(_target(spark, sf_dir), "", by=tab))


@query("k3_counts", f"""WITH {TARGET_CTE}
SELECT COUNT(*) FILTER (WHERE {sql_search(TARGET_HEADERS, FACET_SEARCH)} AND {_PROBLEM_SQL} = '{K3_PROBLEM}'
  AND {_sql_filters(FACET_FILTERS)}) AS shown, COUNT(*) AS total FROM target WHERE "Jenis" = 'R'""")
def q_k3_counts(spark, sf_dir):
    tab = _target(spark, sf_dir).filter(F.col("Jenis") == "R")
    return S.shown_counts(tab, FACET_FILTERS, search=FACET_SEARCH, problem=K3_PROBLEM)


FALLBACK_NO_CACHE = ["p0"]


@query("tab_fallback_rows", f"""WITH o AS (SELECT *, o_orderkey // {PAGE_ROWS} AS page FROM orders)
SELECT 'p' || CAST(page AS VARCHAR) AS sheet,
       CAST(row_number() OVER (PARTITION BY page ORDER BY o_orderkey) - 1 AS BIGINT) AS _row,
       CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority
FROM o WHERE 'p' || CAST(page AS VARCHAR) NOT IN {_sql_in(FALLBACK_NO_CACHE)}""")
def q_tab_fallback_rows(spark, sf_dir):
    """Every second tab's last load failed: it is served from the copy before,
    but a tab that may not be served from a copy is not shown."""
    headers = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    o = B.table(spark, sf_dir, "orders").withColumn("page", F.floor(F.col("o_orderkey") / PAGE_ROWS))
    texts = o.select(F.concat(F.lit("p"), F.col("page").cast("string")).alias("__page"),
                     F.col("o_orderkey").alias("place"), *[F.col(h).cast("string").alias(h) for h in headers])
    good = P.to_payloads(texts, F.col("__page"), headers, F.col("place")).select(
        "sheet", F.lit(1).cast("timestamp").alias("ts"), "text")
    failed = o.filter("page % 2 = 0").select(F.concat(F.lit("p"), F.col("page").cast("string")).alias("sheet"),
                                            F.lit(2).cast("timestamp").alias("ts"), F.lit("broken").alias("text")).distinct()
    parsed = P.parse_payloads(good.unionByName(failed), keep=["ts"])
    _, served = J.served_payloads(parsed, no_cache=FALLBACK_NO_CACHE)
    names, rows = P.normalize_payloads(served)
    return P.sheet_frame(names, rows, header_list=headers)
