"""Operators over achievement sheets.

A sheet is a DataFrame of text columns named by its (cleaned, unique)
headers, plus an integer ``_row`` giving the sheet order.  Header look-ups
work on the header list (schema metadata); everything that touches rows is
a Column expression or a DataFrame operator.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import parse_id_number, parse_percent_prefix
from ..functions.classify import natural_sort_key
from ..functions.text import at, clean_header, clean_value, filter_value, joined_lower, let, qcol
from .filters import column_filter_conditions, search_condition
from .slots import Slots
from .windows import DEFAULT_BUCKET_ROWS, running_count

ROW = "_row"


def sheet_headers(sheet: DataFrame, row_col: str = ROW, keys: Sequence[str] = ()) -> list[str]:
    """Headers in column order; the first column of the row's or a key's name
    is not one."""
    return Slots(sheet, [row_col, *keys]).headers


# --- header look-ups (P15) --------------------------------------------------

def find_header(headers: Sequence[str], tokens: Sequence[str], last: bool = False) -> str:
    """First (or last) header containing every token, case-insensitive; ''
    when none does."""
    toks = [t.lower() for t in tokens]
    hits = [h for h in headers if all(t in h.lower() for t in toks)]
    if not hits:
        return ""
    return hits[-1] if last else hits[0]


def offset_header(headers: Sequence[str], header: str, offset: int = 1) -> str:
    """The header ``offset`` places after ``header``; '' when absent."""
    if header not in headers:
        return ""
    i = list(headers).index(header) + offset
    return headers[i] if 0 <= i < len(headers) else ""


def header_at(headers: Sequence[str], index: int) -> str:
    return headers[index] if 0 <= index < len(headers) else ""


def cell(header: str) -> Column:
    """``row[header] || ""``: the cell text, '' for a missing header."""
    if not header:
        return F.lit("")
    return F.coalesce(qcol(header), F.lit(""))


# --- informative columns (P12, P13) ----------------------------------------

def informative_report(sheet: DataFrame, headers: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """One row per header: position, whether any cell has text, and whether
    the header is kept.  A single aggregation pass over the rows."""
    s = Slots(sheet, [ROW])
    headers = list(headers or s.headers)
    if not headers:
        return sheet.sparkSession.createDataFrame([], "position int, header string, has_value boolean, informative boolean")
    flags = s.df.agg(*[F.max(clean_value(s.col(h)) != "").alias(f"f{i}") for i, h in enumerate(headers)])
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(h).alias("header"),
                                         F.coalesce(F.col(f"f{i}"), F.lit(False)).alias("has_value"))
                                for i, h in enumerate(headers)]))
    out = flags.select(stack.alias("s")).select("s.*")
    keep = F.col("has_value") & (clean_header(F.col("header")) != "")
    if strict:
        keep = keep & ~clean_header(F.col("header")).rlike(K.LETTER_HEADER_PATTERN)
    return out.withColumn("informative", keep)


def informative_headers(sheet: DataFrame, headers: Sequence[str] | None = None, strict: bool = False) -> list[str]:
    """Headers with a non-blank name and at least one non-blank cell (the
    report has one row per column, so collecting it is bounded)."""
    rep = informative_report(sheet, headers, strict).filter("informative").orderBy("position")
    return [r["header"] for r in rep.select("header").collect()]


def informative_columns(sheet: DataFrame, headers: Sequence[str] | None = None, strict: bool = False,
                        row_col: str = ROW) -> DataFrame:
    return pick_columns(sheet, informative_headers(sheet, headers, strict), row_col)


def pick_columns(sheet: DataFrame, headers: Sequence[str], row_col: str = ROW) -> DataFrame:
    """The row number (if there is one) and the given headers."""
    s = Slots(sheet, [row_col])
    own = list(s.reserved)
    return s.df.select(*[s.own(n) for n in own], *[s.col(h) for h in headers]).toDF(*own, *headers)


def relabel_positional(sheet: DataFrame, headers: Sequence[str] | None = None,
                       labels: Sequence[str] = K.CAPAIAN_LABELS,
                       rewrites: Sequence[tuple[str, str]] = K.CAPAIAN_HEADER_REWRITES) -> list[tuple[str, str]]:
    """Display labels of the overview columns: the positional label when
    there is one, else the header with the listed rewrites applied."""
    out = []
    for i, h in enumerate(headers if headers is not None else sheet_headers(sheet)):
        if i < len(labels) and labels[i]:
            out.append((h, labels[i]))
            continue
        label = re.sub(r"\s+", " ", h).strip()
        for pat, rep in rewrites:
            label = re.sub(re.escape(pat), rep, label, count=1, flags=re.IGNORECASE)
        out.append((h, re.sub(r"\s+", " ", label).strip()))
    return out


# --- search, problem column and column filters (F8-F10, X7) ----------------

def search_sheet(sheet: DataFrame, query: str | None, headers: Sequence[str] | None = None) -> DataFrame:
    s = Slots(sheet, [ROW])
    cond = search_condition([s.col(h) for h in headers or s.headers], query)
    return sheet if cond is None else s.restore(s.keep(cond))


def problem_header(headers: Sequence[str], name: str = K.PROBLEM_COLUMN_NAME,
                   tokens: Sequence[str] = K.PROBLEM_COLUMN_TOKENS, index: int = K.PROBLEM_COLUMN_INDEX) -> str:
    exact = next((h for h in headers if h.lower() == name.lower()), "")
    fuzzy = find_header(headers, tokens)
    return exact or fuzzy or header_at(headers, index)


def problem_value(headers: Sequence[str], empty_label: str = K.EMPTY_LABEL, of=cell, **kw) -> Column:
    """The cleaned problem text of a row, or the empty label; ``of`` reads
    the cell under a header."""
    return filter_value(of(problem_header(headers, **kw)), empty_label)


def filter_problem(sheet: DataFrame, value: str | None, headers: Sequence[str] | None = None) -> DataFrame:
    if not value:
        return sheet
    s = Slots(sheet, [ROW])
    return s.restore(s.df.filter(problem_value(list(headers or s.headers), of=s.cell) == F.lit(value)))


def value_pivot(sheet: DataFrame, value: Column, name: str = "problem") -> DataFrame:
    """Row count per value, largest first, then by label."""
    return (sheet.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("jumlah"))
            .orderBy(F.col("jumlah").desc(), F.collate(F.col(name), "UNICODE").asc()))


def problem_pivot(sheet: DataFrame, headers: Sequence[str] | None = None) -> DataFrame:
    s = Slots(sheet, [ROW])
    return value_pivot(s.df, problem_value(list(headers or s.headers), of=s.cell))


def problem_focus(pivot: DataFrame, name: str = "problem") -> DataFrame:
    """Number of distinct problems, the top one and its count."""
    return pivot.agg(F.count(F.lit(1)).alias("jumlah_jenis"),
                     F.min_by(F.col(name), F.struct(-F.col("jumlah"), F.col(name))).alias("teratas"),
                     F.max("jumlah").alias("jumlah_teratas"))


def facet_options(sheet: DataFrame, filters: Mapping[str, Sequence[str] | str | None] | None = None,
                  search: str | None = None, problem: str | None = None,
                  headers: Sequence[str] | None = None, all_headers: Sequence[str] | None = None,
                  empty_token: str = K.EMPTY_TOKEN, empty_label: str = K.EMPTY_LABEL) -> DataFrame:
    """Filter choices of every column: the distinct cleaned values among the
    rows that pass the search, the problem choice and all *other* column
    filters.

    One scan: each row records which active filters it fails; a cell is a
    choice for its column when the row fails no filter, or only that
    column's.  Cells become distinct by their raw text first, so that only
    distinct texts are cleaned and cross the network.  Choices come in column
    order, and within a column in numeric-aware order of their labels, case
    and accents aside."""
    s = Slots(sheet, [ROW])
    all_headers = list(all_headers or s.headers)
    headers = list(headers or all_headers)
    if not headers:
        return s.df.limit(0).select(*[F.lit("").alias(c) for c in ("header", "value", "label")])
    df = _shown(s, search, problem, all_headers)
    conds = column_filter_conditions(headers, filters or {}, empty_token, col=s.col)
    # Per row: how many active filters fail, and the column of the last one
    # that does (the only one, where one counts).
    fails = [F.when(c, F.lit(0)).otherwise(F.lit(1)) for _, c in conds]
    n_failed = sum(fails[1:], fails[0]) if fails else F.lit(0)
    failed = F.greatest(F.lit(-1), *[F.when(c, F.lit(-1)).otherwise(F.lit(headers.index(h))) for h, c in conds],
                        F.lit(-1))
    proj = df.select(n_failed.alias("__n"), failed.alias("__f"),
                     *[F.coalesce(s.col(h).cast("string"), F.lit("")).alias(f"__v{i}") for i, h in enumerate(headers)])
    cells = F.array(*[F.when((F.col("__n") == 0) | ((F.col("__n") == 1) & (F.col("__f") == i)), F.struct(
        F.lit(i).alias("__place"), F.col(f"__v{i}").alias("raw"))) for i in range(len(headers))])
    raw = proj.filter("__n <= 1").select(F.explode(cells).alias("c")).filter(F.col("c").isNotNull()).select(
        "c.__place", "c.raw").distinct()
    out = raw.select("__place", filter_value(F.col("raw"), empty_token).alias("value")).distinct()
    header = F.element_at(F.array(*map(F.lit, headers)), F.col("__place") + 1)
    out = out.select("__place", header.alias("header"), "value", F.when(
        F.col("value") == empty_token, F.lit(empty_label)).otherwise(F.col("value")).alias("label"))
    # The key is a column of its own: a sort would work an expression out at
    # each comparison.
    ordered = out.withColumn("__key", natural_sort_key(F.col("label"))).orderBy("__place", "__key")
    return ordered.select("header", "value", "label")


def _shown(s: Slots, search: str | None, problem: str | None, headers: Sequence[str]) -> DataFrame:
    """Slotted rows that pass the problem choice and the search.  The choice
    goes first: it reads one cell, the search joins a whole row's text."""
    df = s.df.filter(problem_value(headers, of=s.cell) == F.lit(problem)) if problem else s.df
    cond = search_condition([s.col(h) for h in headers], search)
    return df if cond is None else s.keep(cond, df)


def filter_sheet(sheet: DataFrame, filters: Mapping[str, Sequence[str] | str | None] | None = None,
                 search: str | None = None, problem: str | None = None,
                 headers: Sequence[str] | None = None, empty_token: str = K.EMPTY_TOKEN) -> DataFrame:
    """Rows shown in a target tab: search, problem choice, column filters."""
    s = Slots(sheet, [ROW])
    chosen = s.df.filter(shown_condition(s, filters, None, problem, headers, empty_token))
    found = search_condition([s.col(h) for h in s.headers], search)
    return s.restore(chosen if found is None else s.keep(found, chosen))


def shown_condition(s: Slots, filters: Mapping[str, Sequence[str] | str | None] | None = None,
                    search: str | None = None, problem: str | None = None, headers: Sequence[str] | None = None,
                    empty_token: str = K.EMPTY_TOKEN) -> Column:
    """The condition of ``filter_sheet`` over a slotted sheet: column filters,
    problem choice, then the search, which joins a whole row's text."""
    cond = F.lit(True)
    for _, c in column_filter_conditions(list(headers or s.headers), filters or {}, empty_token, col=s.col):
        cond = cond & c
    if problem:
        cond = cond & (problem_value(s.headers, of=s.cell) == F.lit(problem))
    found = search_condition([s.col(h) for h in s.headers], search)
    return cond if found is None else cond & found


def shown_counts(sheet: DataFrame, filters: Mapping[str, Sequence[str] | str | None] | None = None,
                 search: str | None = None, problem: str | None = None, headers: Sequence[str] | None = None
                 ) -> DataFrame:
    """Rows that ``filter_sheet`` shows, and all rows, in one pass."""
    s = Slots(sheet, [ROW])
    return row_counts(s.df, shown_condition(s, filters, search, problem, headers))


def row_counts(sheet: DataFrame, shown: Column | None = None) -> DataFrame:
    """Rows passing a condition and all rows, in one pass."""
    shown = F.lit(True) if shown is None else shown
    return sheet.agg(F.count_if(shown).alias("shown"), F.count(F.lit(1)).alias("total"))


# --- completion and composition (X8, A14, A15, A20) ------------------------

def completion_flag(headers: Sequence[str], tokens: Sequence[str] = K.COMPLETION_HEADER_TOKENS,
                    pattern: str = K.COMPLETION_PATTERN, of=cell) -> Column:
    """A row counts as complete when the pattern occurs in the lower-cased
    text of its status-like columns (all columns when there is none)."""
    priority = [h for h in headers if any(t in h.lower() for t in tokens)]
    cols = priority or list(headers)
    return joined_lower([of(h) for h in cols]).rlike("(?i)" + pattern)


def completion_summary(sheet: DataFrame, name: str | Column, headers: Sequence[str] | None = None,
                       by: Column | None = None) -> DataFrame:
    """Total rows, completed rows and the rounded completion percent - of
    the whole sheet, or per tab when ``by`` names the tab of each row (one
    pass for all tabs)."""
    s = Slots(sheet, [ROW])
    flag = completion_flag(list(headers or s.headers), of=s.cell)
    done = s.df.select(flag.alias("__done")) if by is None else sheet.select(
        by.alias("name"), completion_flag(list(headers or s.headers)).alias("__done"))
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if("__done").alias("completed")]
    if by is not None:
        agg = done.groupBy("name").agg(*aggs)
    else:
        name_col = F.lit(name) if isinstance(name, str) else name
        agg = done.agg(*aggs).select(name_col.alias("name"), "total", "completed")
    return with_percent(agg.select("name", "total", "completed"))


def with_percent(summary: DataFrame) -> DataFrame:
    """The rounded completion percent behind total and completed rows."""
    share = F.floor(F.col("completed").cast("double") / F.col("total") * 100 + F.lit(0.5))
    return summary.withColumn("percent", F.when(F.col("total") > 0, share).otherwise(F.lit(0)).cast("long"))


# --- all tabs at once (E5) ---------------------------------------------------

def tab_facts(rows: DataFrame, headers: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per tab with rows: sheet, total, completed, filled (per column,
    whether any cell has text), from one pass over the keyed cell table
    (sheet, _row, cells) of all tabs.  ``headers`` is the table of expressions:
    each tab's completion column is found in its own headers."""
    def of(tab: str):
        places = {h: i for i, h in reversed(list(enumerate(headers[tab], 1)))}
        return lambda h: F.coalesce(at("cells", places[h]), F.lit("")) if h in places else F.lit("")
    done = F.lit(False)
    for tab in headers:
        done = F.when(F.col("sheet") == tab, completion_flag(list(headers[tab]), of=of(tab))).otherwise(done)
    width = max(map(len, headers.values()), default=0)
    filled = [F.coalesce(F.max(clean_value(at("cells", i + 1)) != ""), F.lit(False)) for i in range(width)]
    return rows.filter(F.col("sheet").isin(list(headers))).groupBy("sheet").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"),
        (F.array(*filled) if filled else F.array().cast("array<boolean>")).alias("filled"))


def filled_headers(headers: Sequence[str], facts: Row | None) -> list[str]:
    """``informative_headers`` of a tab by its facts (None: no rows)."""
    return [h for h, f in zip(headers, facts["filled"] if facts else ()) if f and re.sub(r"\s+", " ", h).strip()]


def tab_board(rows: DataFrame, headers: Mapping[str, Sequence[str]], completion: Sequence[str] = ("K1", "K2", "K3")
              ) -> DataFrame:
    """``tab_facts`` as tagged rows (tab, section, label, value): rows of each
    tab, whether each column is informative, and completed rows and percent of
    the ``completion`` tabs."""
    facts = tab_facts(rows, headers)
    percent = with_percent(facts.select("sheet", "total", "completed", "filled"))

    def row(section: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"), value.cast("long").alias("value"))
    counts = [row("rows", F.lit(""), F.col("total"))]
    done = [row("completed", F.lit(""), F.col("completed")), row("percent", F.lit(""), F.col("percent"))]
    names = F.lit(None).cast("array<string>")
    for tab, own in headers.items():
        names = F.when(F.col("sheet") == tab, F.array(*map(F.lit, own))).otherwise(names)
    columns = F.transform(names, lambda h, i: row("informative", h, (F.get("filled", i) & (clean_header(h) != ""))
                                                  .cast("int")))
    return percent.select(F.col("sheet").alias("tab"), F.inline(F.concat(
        F.array(*counts), F.when(F.col("sheet").isin(list(completion)), F.array(*done)).otherwise(
            F.array().cast("array<struct<section: string, label: string, value: bigint>>")), columns)))


def overview_summaries(kpis: DataFrame) -> DataFrame:
    """(name, total, completed, percent) of K1..K3 as the overview row states
    them: parcels and their share; completed is not known there."""
    parts = [F.struct(F.lit(n.upper()).alias("name"), F.col(f"{n}_bidang").cast("long").alias("total"),
                      F.lit(None).cast("long").alias("completed"), F.col(f"{n}_percent").cast("long").alias("percent"))
             for n in ("k1", "k2", "k3")]
    return kpis.select(F.inline(F.array(*parts)))


def composition(summaries: DataFrame, min_width: int = K.COMPOSITION_MIN_WIDTH,
                grand_total: int | float | None = None) -> DataFrame:
    """Share of each category in the grand total (the categories' sum unless
    the overview gives one); no rows when it is 0.  The summaries are one row
    per category, so the sum is a window over all of them."""
    grand = F.sum("total").over(Window.partitionBy()) if grand_total is None else F.lit(grand_total)
    j = summaries.withColumn("__grand", grand).filter(F.col("__grand") > 0)
    share = F.floor(F.col("total").cast("double") / F.col("__grand") * 100 + F.lit(0.5)).cast("long")
    return j.select("name", "total", share.alias("share"),
                    F.greatest(share, F.lit(min_width)).cast("long").alias("width"),
                    F.col("__grand").cast("long").alias("grand_total"))


def category_total_fallback(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))


# --- KPIs (A16, A17, A18) ---------------------------------------------------

def first_row(sheet: DataFrame, cols: Sequence[str], row_col: str = ROW) -> DataFrame:
    """The first sheet row (smallest ``_row``) as one row, via a single
    ``min_by`` aggregate; no row for an empty sheet."""
    s = Slots(sheet, [row_col])
    packed = F.struct(*[s.cell(h).alias(f"c{i}") for i, h in enumerate(cols)])
    one = s.df.agg(F.min_by(packed, s.own(row_col)).alias("r"), F.count(F.lit(1)).alias("row_count"))
    return one.filter(F.col("r").isNotNull())


def achievement_kpis(capaian: DataFrame, headers: Sequence[str] | None = None, row_col: str = ROW) -> DataFrame:
    """Overview KPIs from the first row of the overview sheet, the columns
    found by header tokens (with the positional override of the
    consolidation columns)."""
    h = list(headers or sheet_headers(capaian, row_col))
    t = K.KPI_TOKENS
    k1 = find_header(h, t["k1_nup"])
    k2 = find_header(h, t["k2_nup"])
    k3 = find_header(h, t["k3_nup"])
    k4 = find_header(h, t["k4_nup"])
    total = find_header(h, t["total"])
    p14, p15, p16 = K.KPI_KONSOLIDASI_POSITIONS
    kons = header_at(h, p14) or find_header(h, t["konsolidasi"])
    kons_q = header_at(h, p15) or offset_header(h, kons, 1)
    kons_pct = header_at(h, p16) or offset_header(h, kons, 2)
    plan = [
        ("k1_nup", k1, "n"), ("k1_bidang", offset_header(h, k1), "n"),
        ("k2_nup", k2, "n"), ("k2_bidang", offset_header(h, k2), "n"),
        ("k3_nup", k3, "n"), ("k3_bidang", offset_header(h, k3), "n"),
        ("k4_nup", k4, "n"), ("k4_bidang", offset_header(h, k4), "n"),
        ("total_bidang", total, "n"), ("total_pct", offset_header(h, total), "s"),
        ("konsolidasi_bidang", kons, "n"), ("konsolidasi_q1", kons_q, "s"), ("konsolidasi_pct", kons_pct, "s"),
    ]
    one = first_row(capaian, [src for _, src, _ in plan], row_col)
    cols = []
    for i, (name, _, kind) in enumerate(plan):
        c = F.col(f"r.c{i}")
        cols.append((parse_id_number(c) if kind == "n" else c).alias(name))
    out = one.select(*cols)

    def share(x):
        return F.when(F.col("total_bidang") != 0,
                      F.floor(F.col(x) / F.col("total_bidang") * 100 + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    return out.select("*", share("k1_bidang").alias("k1_percent"), share("k2_bidang").alias("k2_percent"),
                      share("k3_bidang").alias("k3_percent"))


def igt_kpi(igt: DataFrame, headers: Sequence[str] | None = None, row_col: str = ROW,
            tokens: Sequence[str] = K.IGT_HEADER_TOKENS, cap: float = K.PERCENT_CAP) -> DataFrame:
    """Percent text of the first IGT row (first header containing '%' and
    'capaian'), its numeric prefix capped at 100, and the row count."""
    h = list(headers or sheet_headers(igt, row_col))
    pct_header = find_header(h, tokens)
    one = first_row(igt, [pct_header] if pct_header else [], row_col) if pct_header else \
        igt.agg(F.min_by(F.struct(F.lit("").alias("c0")), F.col(row_col)).alias("r"),
                F.count(F.lit(1)).alias("row_count")).filter(F.col("r").isNotNull())
    raw = F.col("r.c0")
    return one.select(F.when(raw == "", F.lit("-")).otherwise(raw).alias("igt_display"),
                      F.least(parse_percent_prefix(raw), F.lit(cap)).alias("igt_percent"),
                      F.col("row_count"))


# --- unreached helpers kept as data operations (F11, F12) ------------------

def readable_row_flag(headers: Sequence[str], of=cell) -> Column:
    """Rows to read: not blank, and neither formulas nor column numbers, that
    is, at least six filled cells and either two with an operator sign, or the
    first (up to eight) filled cells counting 1, 2, 3, ... (at least four of
    them).  The cells are cleaned once, whatever asks for them."""
    def readable(filled: Column) -> Column:
        formula = F.size(F.filter(filled, lambda v: v.rlike("[=+\\-*/]"))) >= 2
        first8 = F.slice(filled, 1, 8)
        counting = (F.size(first8) >= 4) & F.forall(
            F.transform(first8, lambda v, i: v.try_cast("double") == (i + 1).cast("double")),
            lambda b: F.coalesce(b, F.lit(False)))
        return (F.size(filled) > 0) & ~((F.size(filled) >= 6) & (formula | counting))
    vals = F.transform(F.array(*[of(h) for h in headers]), lambda v: clean_value(v))
    return let(F.filter(vals, lambda v: v != ""), readable)


def drop_index_rows(sheet: DataFrame, headers: Sequence[str] | None = None) -> DataFrame:
    s = Slots(sheet, [ROW])
    return s.restore(s.keep(readable_row_flag(list(headers or s.headers), of=s.cell)))


def find_data_row(sheet: DataFrame, headers: Sequence[str] | None = None, row_col: str = ROW,
                  code_pos: int = 0, name_pos: int = 1, total_pos: int = 38) -> DataFrame:
    """First row with a 4+-digit code and a name, else the first with a
    positive total column."""
    s = Slots(sheet, [row_col])
    headers = list(headers or s.headers)
    code = clean_value(s.cell(header_at(headers, code_pos)))
    name = clean_value(s.cell(header_at(headers, name_pos)))
    by_code = code.rlike("^[0-9]{4,}$") & (F.length(name) > 0)
    by_total = parse_id_number(s.cell(header_at(headers, total_pos))) > 0
    prio = F.when(by_code, F.lit(0)).when(by_total, F.lit(1))
    # The row is packed below the aggregate, which then handles one column.
    ranked = s.df.select(F.struct(*s.slots).alias("r"), F.struct(prio.alias("p"), s.own(row_col).alias("n")).alias("o"))
    best = ranked.agg(F.min_by("r", F.when(F.col("o.p").isNotNull(), F.col("o"))).alias("r"))
    return s.restore(best.filter(F.col("r").isNotNull()).select("r.*"))


# --- header uniqueness over a long header table (P10) -----------------------

def unique_headers(headers: DataFrame, keys: Sequence[str] = ("sheet",), col_col: str = "_col",
                   header_col: str = "header", passes: int = 2, bucket_rows: int | None = None) -> DataFrame:
    """Make the headers of each tab unique, in column order: a blank name
    becomes 'Kolom <n>' (n = position + 1) and the k-th repeat of a name
    gets the suffix ' k'.  Applied ``passes`` times (the widened header row
    is made unique a second time).

    Names that can meet in a later pass share a stem, the name without its
    numbers at the end ('A', 'A 2', 'A 2 2'), so all passes run over one
    exchange of the header cells by tab and stem.  Stems of more than
    ``bucket_rows`` cells of a tab (at most one for that many headers, so
    their list is small enough to be broadcast) take the bucketed running
    count instead, which deals one stem to many tasks."""
    keys = list(keys)
    br = bucket_rows or DEFAULT_BUCKET_ROWS
    cur = headers.select(*keys, col_col, F.coalesce(F.nullif(clean_header(F.col(header_col)), F.lit("")), F.concat(
        F.lit(K.GENERIC_COLUMN_PREFIX + " "), (F.col(col_col) + 1).cast("string"))).alias("__name"))
    cur = cur.withColumn("__stem", F.regexp_replace("__name", "( [0-9]+)+$", ""))
    family = [*keys, "__stem"]
    large = F.broadcast(cur.groupBy(*family).count().filter(F.col("count") > br).drop("count"))

    def suffixed(df: DataFrame, k: Column) -> DataFrame:
        return df.withColumn("__name", F.when(k == 1, F.col("__name")).otherwise(
            F.concat(F.col("__name"), F.lit(" "), k.cast("string"))))
    few, many = cur.join(large, family, "left_anti"), cur.join(large, family, "left_semi")
    few = few.repartition(*family)
    for _ in range(passes):
        few = suffixed(few.withColumn("__k", F.row_number().over(
            Window.partitionBy(*family, "__name").orderBy(col_col))), F.col("__k")).drop("__k")
        many = suffixed(running_count(many, [*keys, "__name"], col_col, out="__k", bucket_rows=br),
                        F.col("__k")).drop("__k")
    return few.unionByName(many).select(*keys, col_col, F.col("__name").alias("unique_header"))


# --- other KPI layouts (A17) ------------------------------------------------

def _kpi_select(one: DataFrame, plan: Sequence[tuple[str, str, str]]) -> DataFrame:
    cols = []
    for i, (name, _, kind) in enumerate(plan):
        c = F.coalesce(F.col(f"r.c{i}"), F.lit(""))
        cols.append((parse_id_number(c) if kind == "n" else c).alias(name))
    return one.select(*cols)


def achievement_kpis_positional(raw: DataFrame, headers: Sequence[str] | None = None, row_col: str = ROW,
                                positions: Mapping[str, int] = K.KPI_RAW_POSITIONS) -> DataFrame:
    """KPIs read by column position from the overview's data row (the first
    row with a 4+-digit code and a name, else the first with a positive
    total column), for sheets read with letter headers."""
    h = list(headers or sheet_headers(raw, row_col))
    row = find_data_row(raw, h, row_col)
    text_fields = {"total_q1", "total_pct", "hukum_q1", "hukum_pct", "penatausahaan_q1", "penatausahaan_pct",
                   "konsolidasi_q1", "konsolidasi_pct"}
    plan = [(name, header_at(h, pos), "s" if name in text_fields else "n") for name, pos in positions.items()]
    s = Slots(row, [row_col])
    one = s.df.select(F.struct(*[s.cell(src).alias(f"c{i}") for i, (_, src, _) in enumerate(plan)]).alias("r"))
    return _kpi_select(one, plan)


def achievement_kpis_last_match(capaian: DataFrame, headers: Sequence[str] | None = None, row_col: str = ROW
                                ) -> DataFrame:
    """KPIs from the first readable row (not blank, not a formula or
    column-number row), columns found by tokens - the last match for the
    K2..K4 columns - with the values next to them."""
    h = list(headers or sheet_headers(capaian, row_col))
    t = K.KPI_TOKENS
    k1 = find_header(h, ["total capaian k1"])
    k2, k3, k4 = (find_header(h, t[k], last=True) for k in ("k2_nup", "k3_nup", "k4_nup"))
    total = find_header(h, t["total"])
    groups = {g: find_header(h, t[g]) for g in ("hukum", "penatausahaan", "konsolidasi")}
    plan = [("k1_nup", k1, "n"), ("k1_bidang", offset_header(h, k1), "n"),
            ("k2_nup", k2, "n"), ("k2_bidang", offset_header(h, k2), "n"),
            ("k3_nup", k3, "n"), ("k3_bidang", offset_header(h, k3), "n"),
            ("k4_nup", k4, "n"), ("k4_bidang", offset_header(h, k4), "n"),
            ("total_bidang", total, "n"), ("total_q1", offset_header(h, total), "s"),
            ("total_pct", offset_header(h, total, 2), "s")]
    for g, src in groups.items():
        plan += [(f"{g}_bidang", src, "n"), (f"{g}_q1", offset_header(h, src), "s"),
                 (f"{g}_pct", offset_header(h, src, 2), "s")]
    readable = drop_index_rows(capaian, h)
    return _kpi_select(first_row(readable, [src for _, src, _ in plan], row_col), plan)
