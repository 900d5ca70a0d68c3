"""Composite jobs: register ingest, unit dimension, the two dashboards.

Each job returns DataFrames (or writes Parquet); nothing is collected except
bounded metadata (the register's column names, one header list per tab).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.classify import classify_by_prefix
from ..functions.places import clean_place_contains, clean_place_exact
from ..functions.text import at, py_strip
from ..operators import aggregate as A
from ..operators import columns as C
from ..operators import maps as M
from ..operators import sheets as S
from ..operators import windows as W
from ..operators.filters import active_condition, drop_blank_array_rows, where_nonnull
from ..sources import payloads as P
from ..sources import snapshots as SN
from ..sources import workbooks as WB
from ..session import shared_table
from ..sources.parquet import read_detail, read_register, write_register


# --- E1: register ingest ------------------------------------------------------

def header_catalogue(rows: DataFrame) -> DataFrame:
    """(path, names, columns) of every workbook with data rows: its header row
    and the register columns that the headers name, in cell order.  One row per
    workbook, made and kept on the executors."""
    header = F.when(F.col("_row") == 1, F.col("cells"))
    info = rows.groupBy("path").agg(
        F.max_by(header, F.when(F.col("_row") == 1, F.lit(1))).alias("header"), F.max(F.size("cells")).alias("width"),
        F.count_if((F.col("_row") >= 2) & F.exists("cells", lambda x: x.isNotNull())).alias("n_data"))
    names = F.transform(F.sequence(F.lit(0), F.greatest(F.col("width"), F.lit(1)) - 1), lambda i: F.coalesce(
        py_strip(at("header", i + 1)), F.concat(F.lit("col_"), i.cast("string"))))
    catalogue = info.filter("n_data > 0").select("path", names.alias("names"))
    return catalogue.withColumn("columns", F.transform("names", lambda n: C.canonical_name(n)))


def agreed_columns(catalogue: DataFrame) -> list[str]:
    """The columns that all workbooks share, in the order of the first path's.

    One aggregate checks the whole catalogue and one row of it reaches the
    driver, whatever the number of workbooks or of header spellings.  Raises
    where two headers of a workbook name one column, where workbooks differ in
    their columns, and where the item code is missing."""
    columns = F.col("columns")
    ordered = F.sort_array(columns)
    twice = F.size(F.array_distinct(columns)) < F.size(columns)
    found = catalogue.agg(
        F.min_by(columns, "path").alias("read"), F.min(ordered).alias("least"), F.max(ordered).alias("greatest"),
        F.min_by(F.filter(F.array_distinct(columns), lambda c: F.size(F.filter(columns, lambda d: d == c)) > 1),
                 F.when(twice, F.col("path"))).alias("collisions")).first()
    if found["read"] is None:
        raise ValueError("no workbook holds data rows")
    if found["collisions"]:
        raise ValueError(f"header collision after renaming: {sorted(found['collisions'])}")
    if found["least"] != found["greatest"]:
        raise ValueError(f"column mismatch: {found['least']} vs {found['greatest']}")
    if "kode_barang" not in found["read"]:
        raise ValueError("column 'kode_barang' is required to classify the rows")
    return list(found["read"])


def register_frame(spark: SparkSession, source: DataFrame | Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Workbooks -> one typed, classified register DataFrame.

    Row 1 of each workbook is its header; wholly empty rows are skipped;
    headers are renamed by synonym; the class comes from the item code; the
    file stem is kept; fixed columns come first (NULL when missing); integer
    columns are cast leniently, money columns as DECIMAL.  All workbooks must
    end with the same columns; those without data rows are skipped.

    Workbooks are decoded once, into the shared folder.  The catalogue of
    their header rows gives each workbook the places of the agreed columns;
    it is joined to the rows by path, so any number of layouts is projected
    in one pass."""
    if rows is None:
        rows = shared_table(WB.pad_to_width(WB.read_workbooks(spark, source)), "workbook-rows")
    catalogue = header_catalogue(rows)
    read = agreed_columns(catalogue)
    places = catalogue.select("path", F.array(*[F.array_position("columns", F.lit(c)).cast("int") for c in read])
                              .alias("places"))
    data = drop_blank_array_rows(rows.filter("_row >= 2")).join(places, "path")

    def typed(name: str) -> Column:
        if name in computed:
            return computed[name]
        if name not in read:
            return F.lit(None).cast("long" if name in C.LONG_COLUMNS else "string")
        place = F.col("places")[read.index(name)]
        value = at("cells", place)
        if name in C.LONG_COLUMNS:
            return C.lenient_long(value, at("kinds", place))
        return C.lenient_money(value) if name in C.MONEY_COLUMNS else value
    computed = {"golongan_bmn": classify_by_prefix(at("cells", F.col("places")[read.index("kode_barang")])),
                "sumber_file": C.file_stem(F.col("path"))}
    out = [*K.FIXED_COLUMNS, *[c for c in [*read, *computed] if c not in K.FIXED_COLUMNS]]
    out = list(dict.fromkeys(out))
    return data.select(*[typed(c).alias(f"__c{i}") for i, c in enumerate(out)]).toDF(*out)


def build_register(spark: SparkSession, input_dir: str, out_path: str, fallback_dir: str | None = None,
                   partition_by_class: bool = True) -> DataFrame:
    """Discover, decode, normalise and write the register (Parquet, snappy,
    partitioned by class for partition pruning, clustered by unit)."""
    files = WB.find_workbooks(spark, input_dir, fallback_dir)
    if files is None:
        raise FileNotFoundError(f"no workbook in {input_dir}" + (f" or {fallback_dir}" if fallback_dir else ""))
    reg = register_frame(spark, files)
    write_register(reg, out_path, partition_by=["golongan_bmn"] if partition_by_class else [],
                   sort_within=["nama_satker"])
    return read_register(spark, out_path, view=None)


# --- E2: unit dimension ---------------------------------------------------------

def falsy_text(text: Column, kind: Column) -> Column:
    """Text of a cell, '' when the value is falsy (empty, zero, false)."""
    zero = (kind == "n") & (F.coalesce(text.try_cast("double"), F.lit(1.0)) == 0)
    false = (kind == "b") & (text == "False")
    return F.when(text.isNull() | (text == "") | zero | false, F.lit("")).otherwise(text)


def unit_dimension_frame(spark: SparkSession, export_path: str, rows: DataFrame | None = None) -> DataFrame:
    """Active units of the unit export, read by position, place cleaned
    (units with an unknown place are dropped), distinct."""
    rows = rows if rows is not None else WB.read_workbooks(spark, [export_path])
    pos = WB.read_positional(rows, K.UNIT_EXPORT_POSITIONS, K.UNIT_EXPORT_WIDTH, first_row=2)

    def txt(n):
        return falsy_text(F.col(n), F.col(n + "__kind"))
    d = pos.filter(active_condition(txt("status"))).select(
        txt("kode_kl").alias("kode_kl"), txt("nama_kl").alias("nama_kl"),
        txt("kode_satker").alias("kode_satker"), txt("nama_satker").alias("nama_satker"),
        clean_place_contains(F.col("kab_kota_raw")).alias("kab_kota"))
    return A.distinct_rows(where_nonnull(d, "kab_kota"))


def unit_detail_frame(units: DataFrame, register: DataFrame) -> DataFrame:
    """Units that own assets in the register, with display names, sorted by
    place, agency and unit."""
    # Distinct names first: partial aggregation leaves one row per unit per
    # task, so the register never crosses the network row by row.
    names = register.select("nama_satker").distinct()
    used = A.distinct_rows(units.join(names, "nama_satker", "left_semi"))
    out = C.select_rename_display(used, K.UNIT_DETAIL_LABELS)
    return A.sort_multi(out, ["Kab/Kota", "Nama K/L", "Nama Satker"])


def build_unit_dimension(spark: SparkSession, export_path: str, out_dir: str, register_path: str | None = None
                         ) -> tuple[DataFrame, DataFrame | None]:
    units = unit_dimension_frame(spark, export_path)
    write_register(units, f"{out_dir}/satker_bali.parquet")
    units = spark.read.parquet(f"{out_dir}/satker_bali.parquet")
    if register_path is None:
        return units, None
    detail = unit_detail_frame(units, spark.read.parquet(register_path))
    detail.write.mode("overwrite").option("compression", "snappy").parquet(f"{out_dir}/satker_detail.parquet")
    return units, read_detail(spark, f"{out_dir}/satker_detail.parquet")


# --- E3 / E4: dashboards over the register --------------------------------------

@dataclass
class Selection:
    classes: Sequence[str] = ()
    types: Sequence[str] = ()
    units: Sequence[str] = ()
    agencies: Sequence[str] = ()


@dataclass
class RegisterDashboard:
    missing_columns: list[str]
    options: dict[str, DataFrame]
    metrics: DataFrame
    unit_count: DataFrame
    summary: DataFrame
    by_type: DataFrame
    place_layer: DataFrame
    top_units: dict[str, DataFrame]
    top_agencies: dict[str, DataFrame] = field(default_factory=dict)
    fused: DataFrame | None = None


def register_dashboard(spark: SparkSession, register: DataFrame, units: DataFrame | None = None,
                       selection: Selection | None = None,
                       centres: Mapping[str, tuple[float, float]] = K.PLACE_CENTRES,
                       place_cleaner=clean_place_exact, cubes: Sequence[DataFrame] = ()) -> RegisterDashboard:
    """Every result of the register dashboard for one selection.

    The register is read once, into a cube (one row per unit, class, type and
    place) in the shared folder; options, metrics, summaries, place layer and
    rankings are all small aggregates of it.  ``fused`` holds the class, type,
    place and total groups of the selection.  Rankings ignore the selection.
    ``cubes`` are those of earlier workbooks: ``register`` is then only the rows
    that are new, and only they are read."""
    sel = selection or Selection()
    missing = C.validate_columns(register)
    own = A.register_cube(register)
    cube = shared_table(A.merge_cubes([*cubes, own]) if cubes else own, "register-cube")
    filtered = A.dashboard_filter(cube, units, sel.classes, sel.types, sel.units, sel.agencies)
    centre_df = M.centres_frame(spark, centres)
    options = {
        "golongan_bmn": A.distinct_values(cube, "golongan_bmn", order=K.CLASS_ORDER),
        "jenis_bmn": A.distinct_values(cube, "jenis_bmn"),
        "nama_satker": A.distinct_values(cube, "nama_satker"),
    }
    top_agencies = {}
    if units is not None:
        options["Nama K/L"] = A.distinct_values(units, "Nama K/L", drop_null=False)
        top_agencies = {m: A.top_k_agencies(units, cube, m) for m in ("value", "count")}
    return RegisterDashboard(
        missing_columns=missing,
        options=options,
        metrics=A.metric_cards(filtered),
        unit_count=A.count_units(cube, units, sel.agencies, sel.units),
        summary=A.summary_with_total(filtered),
        by_type=A.count_by_type(filtered),
        place_layer=M.asset_map_layer(filtered, centre_df, cleaner=place_cleaner),
        top_units={m: A.top_k_units(cube, m) for m in ("value", "count")},
        top_agencies=top_agencies,
        fused=A.dashboard_grouping_sets(filtered),
    )


@dataclass
class UnitDrilldown:
    overview: DataFrame
    unit_layer: DataFrame
    per_agency: DataFrame
    listing: DataFrame | None
    places: DataFrame


def unit_drilldown(spark: SparkSession, units: DataFrame, place: str | None = None,
                   centres: Mapping[str, tuple[float, float]] = K.PLACE_CENTRES) -> UnitDrilldown:
    """The unit drill-down for one place ("Semua"/None = all places)."""
    typed = A.with_unit_type(units)
    return UnitDrilldown(
        overview=A.unit_overview(typed, place),
        unit_layer=M.unit_map_layer(typed, M.centres_frame(spark, centres), place),
        per_agency=A.units_per_agency(typed, place),
        listing=A.unit_listing(typed, place) if place and place != "Semua" else None,
        places=A.distinct_values(units, "Kab/Kota"),
    )


# --- E5: achievement dashboard ----------------------------------------------------

@dataclass
class AchievementDashboard:
    status: DataFrame
    sheets: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    kpis: DataFrame | None
    summaries: DataFrame
    category_total: DataFrame
    composition: DataFrame
    igt: DataFrame | None
    overview_labels: list[tuple[str, str]]
    tab_counts: dict[str, DataFrame]
    k3_pivot: DataFrame | None
    k3_rows: DataFrame | None
    k3_facets: DataFrame | None
    action_plan: DataFrame | None


def load_tab_rows(parsed: DataFrame, names: Sequence[str] = K.SHEET_NAMES, cut_lineage: bool = True
                  ) -> tuple[dict[str, list[str]], DataFrame]:
    """Headers of each loaded tab, and the rows (sheet, _row, cells) of all.

    Every dashboard result reads these rows, so with ``cut_lineage`` they are
    spread over the tasks by (tab, row) and written once into the shared folder
    named by ``spark.checkpoint.dir``: a lost executor then re-reads them
    instead of re-parsing every payload."""
    headers, rows = P.normalize_payloads(parsed)
    if cut_lineage:
        rows = shared_table(rows.repartition("sheet", "_row"), "tab-rows")
    wanted = headers.filter(F.col("sheet").isin(list(names)))
    lists = {r["sheet"]: [h for _, h in sorted((x["_col"], x["header"]) for x in r["h"])]
             for r in wanted.groupBy("sheet").agg(F.collect_list(F.struct("_col", "header")).alias("h")).collect()}
    return {name: lists[name] for name in names if name in lists}, rows


def tab_frame(rows: DataFrame, sheet: str, headers: Sequence[str]) -> DataFrame:
    """Wide text frame of one tab (headers differ between tabs)."""
    return P.sheet_frame(None, rows.filter(F.col("sheet") == sheet), None, headers, with_sheet=False)


def served_payloads(parsed: DataFrame, loads: DataFrame | None = None, no_cache: Sequence[str] = K.NO_CACHE_SHEETS
                    ) -> tuple[DataFrame, DataFrame]:
    """(status, payloads to show).  A tab whose latest load failed is served
    from its last good copy, but never a ``no_cache`` tab.

    Copies come from the load history (``data`` is the table as JSON), or,
    without a history, from earlier payloads of ``parsed`` itself by their
    ``ts``."""
    if loads is not None:
        status = SN.latest_good_snapshot(loads, no_cache=no_cache)
        copies = status.filter("source = 'cache' AND data IS NOT NULL").select(
            "sheet", F.concat(F.lit('{"status":"ok","table":'), F.col("data"), F.lit("}")).alias("text"))
        live = parsed.join(status.filter("source IN ('cache', 'failed')").select("sheet"), "sheet", "left_anti")
        keep = [c for c in ("ts",) if c in parsed.columns]
        cached = P.parse_payloads(copies.select("*", *[F.lit(None).cast(parsed.schema[c].dataType).alias(c)
                                                       for c in keep]), keep=keep)
        return status, live.unionByName(cached)
    timed = parsed if "ts" in parsed.columns else parsed.withColumn("ts", F.lit(None).cast("timestamp"))
    history = timed.select("sheet", F.coalesce("ts", F.lit(0).cast("timestamp")).alias("ts"), "ok",
                           F.lit(None).cast("string").alias("data"))
    status = SN.latest_good_snapshot(history, no_cache=no_cache)
    return status, timed.join(status.filter("source = 'failed'").select("sheet"), "sheet", "left_anti")


def achievement_dashboard(spark: SparkSession, parsed: DataFrame, searches: Mapping[str, str] | None = None,
                          k3_problem: str | None = None, k3_filters: Mapping[str, Sequence[str]] | None = None,
                          loads: DataFrame | None = None) -> AchievementDashboard:
    """All results of the achievement dashboard from parsed tab payloads.

    With an overview row the K1..K3 summaries and the total are the overview's
    parcels; without one they are counted from the tabs.  ``tab_counts`` holds
    shown and all rows per tab; ``tables`` the rows shown, with informative
    columns."""
    searches = searches or {}
    status, served = served_payloads(parsed, loads)
    headers, rows = load_tab_rows(served)
    tabs = {name: tab_frame(rows, name, own) for name, own in headers.items()}
    # One pass over the rows of all tabs; one row per tab reaches the driver.
    facts = {r["sheet"]: r for r in S.tab_facts(rows, headers).collect()}
    cap = tabs.get("Capaian")
    kpis = S.achievement_kpis(cap) if cap is not None else None
    overview = kpis.first() if kpis is not None else None  # one row at most
    if overview is not None:
        summaries = S.overview_summaries(kpis)
        total = kpis.select(F.col("total_bidang").cast("long").alias("total"))
        composition = S.composition(summaries, grand_total=overview["total_bidang"])
    else:
        counted = [(name, facts[name]["total"], facts[name]["completed"]) if name in facts else (name, 0, 0)
                   for name in ("K1", "K2", "K3") if name in tabs]
        summaries = S.with_percent(spark.createDataFrame(counted, "name string, total long, completed long"))
        total = S.category_total_fallback(summaries)
        composition = S.composition(summaries)
    k3, plan = tabs.get("K3"), tabs.get("ActionPlan")
    informative = {name: S.filled_headers(headers[name], facts.get(name)) for name in tabs if name != "ActionPlan"}
    tables, tab_counts = {}, {}
    for name, tab in tabs.items():
        chosen = {"filters": k3_filters, "problem": k3_problem, "headers": informative["K3"]} if name == "K3" else {}
        search = None if name == "Capaian" else searches.get(name)
        tab_counts[name] = S.shown_counts(tab, search=search, **chosen)
        if name != "ActionPlan":
            tables[name] = S.pick_columns(S.filter_sheet(tab, search=search, **chosen), informative[name])
    return AchievementDashboard(
        status=status,
        sheets=tabs,
        tables=tables,
        kpis=kpis,
        summaries=summaries,
        category_total=total,
        composition=composition,
        igt=S.igt_kpi(tabs["IGT"]) if "IGT" in tabs else None,
        overview_labels=S.relabel_positional(cap, informative["Capaian"]) if cap is not None else [],
        tab_counts=tab_counts,
        k3_pivot=S.problem_pivot(k3) if k3 is not None else None,
        k3_rows=tables.get("K3"),
        k3_facets=(S.facet_options(k3, k3_filters, searches.get("K3"), k3_problem, informative["K3"])
                   if k3 is not None else None),
        action_plan=(W.merge_spans(S.search_sheet(plan, searches.get("ActionPlan")))
                     if plan is not None else None),
    )
