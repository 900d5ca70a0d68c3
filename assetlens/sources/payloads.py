"""Spreadsheet tab payloads: landed response texts -> parsed tables -> sheets.

A payload is one response text per tab (``{status, errors, table:{cols,
rows}}`` wrapped in a callback).  Parsing and header work happen inside the
payload row with array functions; rows are then exploded and stay
distributed.  One payload is one tab, which the spreadsheet service already
bounds in size; many tabs (or pages of one) are parsed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import at, clean_header, js_trim, let
from ..session import shared_table

PAYLOAD_SCHEMA = (
    "status STRING, errors ARRAY<STRUCT<reason: STRING, message: STRING, detailed_message: STRING>>, "
    "table STRUCT<cols: ARRAY<STRUCT<id: STRING, label: STRING, type: STRING>>, "
    "rows: ARRAY<STRUCT<c: ARRAY<STRUCT<v: VARIANT, f: STRING>>>>>"
)

#: Rows of a tab that one row of the chunk table holds.
CHUNK_ROWS = 1_000

MSG_UNKNOWN_FORMAT = "Format respons Google Sheet tidak dikenali."


def value_text(v: Column) -> Column:
    """Text of a JSON cell value as a script engine prints it: strings as
    they are, numbers in their shortest form (``1.0`` -> ``1``), booleans as
    true/false, NULL as NULL.  The value is parsed as VARIANT, so the JSON
    type is known; only a double (exponent form) needs re-formatting."""
    def exponent_form(s: Column) -> Column:
        d = F.try_variant_get(v, "$", "double")
        integral = (d == F.floor(d)) & (F.abs(d) < F.lit(1e21))
        is_double = s.contains("E") & (F.schema_of_variant(v) == "DOUBLE")
        return (F.when(is_double & integral, d.cast("decimal(38,0)").cast("string"))
                .when(is_double, d.cast("string"))
                .otherwise(s))
    return let(F.try_variant_get(v, "$", "string"), exponent_form)


def cell_text(c: Column) -> Column:
    """Displayed text of a cell: formatted value, else value, else ''; trimmed."""
    return js_trim(F.coalesce(c["f"], F.when(c["v"].isNotNull(), value_text(c["v"])), F.lit("")))


def sheet_of_file(name: Column) -> Column:
    """Tab name of a landed file: the stem, without a ``__<anything>``
    suffix (``K1__20261202T1200.json`` -> ``K1``), so that every reload of a
    tab lands as a new file."""
    return F.regexp_extract(name, "^(.*?)(__[^.]*)?\\.[^.]*$", 1)


def read_payload_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Landed payload files, one row per file: (sheet, ts, text); the
    sheet name comes from the file name, ``ts`` is the file time."""
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(sheet_of_file(F.col("_metadata.file_name")).alias("sheet"),
                     F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("text"))


def parse_payloads(texts: DataFrame, sheet_col: str = "sheet", text_col: str = "text",
                   keep: Sequence[str] = ()) -> DataFrame:
    """(sheet, text) -> (sheet, ok, error, table, payload), plus the ``keep``
    columns; ``payload`` is a hash of the text.

    The JSON is the text from the first '{' to the last '}'.  A payload is
    an error when the text has no object, does not parse, has a status other
    than 'ok' (its messages are joined) or has no table."""
    body = F.regexp_extract(F.col(text_col), "(?s)(\\{.*\\})", 1)
    parsed = F.from_json(F.when(body != "", body), PAYLOAD_SCHEMA)
    d = texts.select(F.col(sheet_col).alias("sheet"), *keep, body.alias("__body"), parsed.alias("p"),
                     F.xxhash64(text_col).alias("payload"))
    msgs = F.array_join(F.transform(F.coalesce(F.col("p.errors"), F.array()),
                                    lambda e: F.coalesce(e["detailed_message"], e["message"])), " ")
    bad_status = F.col("p.status").isNotNull() & (F.col("p.status") != "ok")
    error = (F.when(F.col("__body") == "", F.lit(MSG_UNKNOWN_FORMAT))
             .when(F.col("p.table").isNull() & F.try_parse_json(F.col("__body")).isNull(), F.lit(MSG_UNKNOWN_FORMAT))
             .when(bad_status, F.when(msgs != "", msgs).otherwise(
                 F.concat(F.lit("Google Sheet "), F.col("sheet"), F.lit(" tidak dapat dibaca."))))
             .when(F.col("p.table").isNull(),
                   F.concat(F.lit("Sheet "), F.col("sheet"), F.lit(" tidak mengembalikan tabel data."))))
    return d.select("sheet", *keep, error.isNull().alias("ok"), error.alias("error"),
                    F.col("p.table").alias("table"), "payload")


def newest_payloads(parsed: DataFrame) -> DataFrame:
    """(sheet, table) of the latest good payload of each tab, by ``ts`` where
    there is one, else any single payload.

    The latest one is found on small columns (time and hash of the text), by
    an aggregate that leaves one row per tab and task; a semi join then keeps
    that payload.  Bodies of earlier versions are never moved, however many
    landed."""
    small = ["ts", "payload"] if "ts" in parsed.columns else ["payload"]
    good = parsed.filter("ok")
    newest = good.groupBy("sheet").agg(F.max(F.struct(*small)).alias("__newest"))
    newest = newest.select(F.col("sheet").alias("__sheet"), "__newest")
    kept = good.join(newest, (F.col("sheet") == F.col("__sheet")) & (F.struct(*small) == F.col("__newest")),
                     "left_semi")
    # The same text may have landed twice at one time.
    return kept.groupBy("sheet").agg(F.first("table").alias("table"))


def read_sheet_payloads(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return parse_payloads(read_payload_files(spark, path, glob), keep=["ts"])


# --- header rules -------------------------------------------------------------

def _unique_names(df: DataFrame) -> DataFrame:
    """(sheet, _col, header) -> same with unique names: blank -> 'Kolom n',
    the k-th repeat of a name gets ' k'.  One window per (tab, name) over the
    cells of one header row."""
    d = df.withColumn("header", F.coalesce(F.nullif(clean_header(F.col("header")), F.lit("")), F.concat(
        F.lit(K.GENERIC_COLUMN_PREFIX + " "), (F.col("_col") + 1).cast("string"))))
    k = F.row_number().over(Window.partitionBy("sheet", "header").orderBy("_col"))
    return d.select("sheet", "_col", F.when(k == 1, F.col("header")).otherwise(
        F.concat(F.col("header"), F.lit(" "), k.cast("string"))).alias("header"))


def row_chunks(tabs: DataFrame) -> DataFrame:
    """(sheet, table) -> (sheet, __labels, __offset, __rows): the cell texts of
    up to CHUNK_ROWS rows from row ``__offset`` on, one chunk at least; labels
    (label, else id, else NULL) with the first chunk only."""
    rows = F.coalesce(F.col("table.rows"), F.array())
    starts = F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(CHUNK_ROWS))
    chunks = F.transform(starts, lambda i: F.struct(i.alias("__offset"), F.slice(rows, i + 1, CHUNK_ROWS).alias("r")))
    labels = F.transform(F.coalesce(F.col("table.cols"), F.array()), lambda c: F.coalesce(
        F.nullif(c["label"], F.lit("")), F.nullif(c["id"], F.lit(""))))
    d = tabs.select("sheet", labels.alias("__labels"), F.explode(chunks).alias("c"))
    return d.select("sheet", F.when(F.col("c.__offset") == 0, F.col("__labels")).alias("__labels"), "c.__offset",
                    F.transform("c.r", lambda r: F.transform(F.coalesce(r["c"], F.array()), cell_text)).alias("__rows"))


def normalize_payloads(parsed: DataFrame, case_insensitive: bool = K.GENERIC_HEADER_PATTERN_CASE_INSENSITIVE
                       ) -> tuple[DataFrame, DataFrame]:
    """Parsed tabs -> (headers, rows).

    headers: (sheet, _col, header) - labels (else ids, else 'Kolom n'),
    made unique; when every label looks generic the first row becomes the
    header row; widened to the longest row and made unique again.
    rows: (sheet, _row, cells ARRAY<STRING>) without blank rows, ``_row``
    counting the data rows from 0.

    Each tab's latest good payload is parsed once, into a table of row chunks
    in the shared folder; a payload's rows are then read by as many tasks as
    its chunks need.  One aggregate over the chunks gives each tab's row count,
    widths and first row; header work runs on long header tables (one row per
    header cell).  A tab that landed several times counts once: its latest
    good payload by ``ts`` (without one, any single payload)."""
    chunks = shared_table(row_chunks(newest_payloads(parsed)), "tab-chunks")
    rows = (chunks.select("sheet", "__offset", F.posexplode("__rows").alias("__at", "cells"))
            .select("sheet", (F.col("__offset") + F.col("__at")).alias("__pos"), "cells"))
    sizes = F.transform("__rows", lambda r: F.size(r))
    later = F.when(F.col("__offset") == 0, F.slice(sizes, 2, CHUNK_ROWS)).otherwise(sizes)
    meta = chunks.groupBy("sheet").agg(
        F.sum(F.size("__rows")).alias("n_rows"), F.max(F.array_max(sizes)).alias("w_all"),
        F.max(F.array_max(later)).alias("w_rest"),
        F.first(F.when(F.col("__offset") == 0, at("__rows", 1)), ignorenulls=True).alias("row0"))
    labels = chunks.filter("__offset = 0").select("sheet", F.posexplode("__labels").alias("_col", "header"))
    labels = labels.withColumn("header", F.coalesce(F.col("header"), F.concat(
        F.lit(K.GENERIC_COLUMN_PREFIX + " "), (F.col("_col") + 1).cast("string"))))
    h1 = _unique_names(labels)

    pattern = ("(?i)" if case_insensitive else "") + K.GENERIC_HEADER_PATTERN
    generic = h1.groupBy("sheet").agg(F.bool_and(F.col("header").rlike(pattern)).alias("__generic"),
                                      F.count(F.lit(1)).alias("__n1"))
    plan = meta.join(generic, "sheet", "left")
    skip = F.coalesce("__generic", F.lit(True)) & (F.coalesce("n_rows", F.lit(0)) > 0)
    plan = plan.select("sheet", skip.alias("skip_first"), "row0", F.coalesce("__n1", F.lit(0)).alias("__n1"),
                       F.coalesce("w_all", F.lit(0)).alias("w_all"), F.coalesce("w_rest", F.lit(0)).alias("w_rest"))
    width = F.when(F.col("skip_first"), F.greatest(F.size("row0"), F.col("w_rest"))) \
        .otherwise(F.greatest(F.col("__n1"), F.col("w_all")))
    plan = plan.select("sheet", "skip_first", "row0", width.cast("int").alias("width"))

    from_row = _unique_names(plan.filter("skip_first").select(
        "sheet", F.posexplode("row0").alias("_col", "header")))
    h2 = h1.join(plan.filter(~F.col("skip_first")).select("sheet"), "sheet", "left_semi").unionByName(from_row)
    slots = plan.filter(F.col("width") > 0).select("sheet", F.explode(F.sequence(F.lit(0), F.col("width") - 1))
                                                   .alias("_col"))
    widened = slots.join(h2, ["sheet", "_col"], "left").select("sheet", "_col", F.coalesce("header", F.lit(""))
                                                                 .alias("header"))
    headers = _unique_names(widened)

    data = rows.join(plan.select("sheet", "skip_first", "width"), "sheet")
    data = data.filter(~F.col("skip_first") | (F.col("__pos") > 0))
    padded = data.withColumn("cells", F.transform(F.sequence(F.lit(1), F.greatest(F.col("width"), F.lit(1))),
                                                  lambda i: F.coalesce(at("cells", i), F.lit(""))))
    nonblank = F.exists("cells", lambda v: js_trim(v) != "")
    out_rows = padded.filter(nonblank).select(
        "sheet", (F.col("__pos") - F.when(F.col("skip_first"), 1).otherwise(0)).cast("long").alias("_row"), "cells")
    return headers, out_rows


def sheet_frame(headers: DataFrame | None, rows: DataFrame, sheet: str | None = None,
                header_list: Sequence[str] | None = None, with_sheet: bool = True) -> DataFrame:
    """Wide text sheet (sheet, _row, <headers>...).  The header list is
    metadata (one name per column), read from ``headers`` unless given; all
    selected tabs must share it."""
    if sheet is not None:
        headers = headers.filter(F.col("sheet") == sheet)
        rows = rows.filter(F.col("sheet") == sheet)
    if header_list is None:
        lists = (headers.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("_col", "header"))).alias("h"))
                 .select(F.transform("h", lambda x: x["header"]).alias("h")).distinct().limit(2).collect())
        if len(lists) > 1:
            raise ValueError("tabs with different headers cannot share one frame")
        header_list = list(lists[0]["h"]) if lists else []
    dupes = {h for h in header_list if list(header_list).count(h) > 1}
    if dupes:
        raise ValueError(f"duplicate headers after suffixing: {sorted(dupes)}")
    own = ["sheet", "_row"] if with_sheet else ["_row"]
    return rows.select(*own, *[at("cells", i + 1).alias(f"__c{i}") for i in range(len(header_list))]).toDF(
        *own, *header_list)


def sheet_with_letter_headers(parsed: DataFrame) -> DataFrame:
    """Raw tab with header rows kept as data and columns named A, B, ...;
    rows that are blank after cleaning are dropped.  Long form:
    (sheet, _row, column, value)."""
    ok = parsed.filter("ok").select("sheet", "table")
    rows = F.transform(F.coalesce(F.col("table.rows"), F.array()),
                       lambda r: F.transform(F.coalesce(r["c"], F.array()), cell_text))
    t = ok.select("sheet", F.posexplode(rows).alias("__pos", "cells"))
    t = t.filter(F.exists("cells", lambda v: clean_header(v) != ""))
    cells = t.select("sheet", F.col("__pos").cast("long").alias("_row"), F.posexplode("cells").alias("_col", "value"))
    return cells.select("sheet", "_row", column_letters(F.col("_col")).alias("column"), "value")


def cell_widths(cells: DataFrame) -> DataFrame:
    """(sheet, last) of long cells: each tab's greatest column number, written
    to the shared folder once, so that the planner knows how small it is."""
    widths = cells.filter(F.col("sheet").isNotNull()).groupBy("sheet").agg(F.max("_col").cast("int").alias("last"))
    return shared_table(widths, "tab-widths")


def scatter_cells(cells: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """Long cells (sheet, _row, _col, value) -> (sheet, _row, cells), the inverse
    of exploding rows: every row is an array as wide as the widest of its
    tab, '' where no cell is given.  Of several cells at one place the greatest
    text counts.  A row's cells meet in one task, a tab's only as their
    greatest column number (``widths``, from ``cell_widths`` unless given).

    Cells are dealt by a hash of their row once; both aggregates, by place and
    by row, read that one exchange, and the widths join needs no other."""
    if widths is None:
        widths = cell_widths(cells)
    dealt = cells.withColumn("__row", F.xxhash64("sheet", "_row")).repartition("__row")
    one = dealt.groupBy("__row", "_row", "sheet", "_col").agg(F.max("value").alias("value"))
    rows = one.groupBy("__row", "_row", "sheet").agg(
        F.map_from_entries(F.collect_list(F.struct("_col", "value"))).alias("at"))
    return rows.join(widths, "sheet").select("sheet", "_row", F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.col("at")[i], F.lit(""))).alias("cells"))


def letter_sheet(rows: DataFrame, with_sheet: bool = True, widths: DataFrame | None = None) -> DataFrame:
    """Wide sheet of rows (sheet, _row, cells) with columns A, B, ...: header
    rows stay data.  The number of columns is that of the widest row, which the
    ``widths`` that the rows were scattered to tell without another pass."""
    width = F.max(F.size("cells")) if widths is None else F.max(F.size(F.sequence(F.lit(0), F.col("last"))))
    width = (rows if widths is None else widths).agg(width).first()[0] or 0
    return sheet_frame(None, rows, None, [letters_of(i) for i in range(width)], with_sheet)


def letters_of(index: int) -> str:
    """``column_letters`` of a header's place, which is schema metadata."""
    name = ""
    while index >= 0:
        name = chr(65 + index % 26) + name
        index = index // 26 - 1
    return name


def column_letters(index: Column) -> Column:
    """Zero-based column index -> A, B, ..., Z, AA, ... (bijective base 26).
    Thirteen letters name every column that a 64-bit index can count."""
    letters, shorter = [], 0
    for place in range(13):
        # ``shorter`` names have fewer letters than this place needs.
        at_place = F.call_function("div", index.cast("long") - F.lit(shorter), F.lit(26 ** place))
        letters.append(F.when(index >= shorter, F.char(F.lit(65) + at_place % 26)).otherwise(F.lit("")))
        shorter += 26 ** (place + 1)
    return F.concat(*reversed(letters))


def to_payloads(df: DataFrame, sheet: Column, headers: Sequence[str], row_order: Column,
                numeric: Sequence[str] = ()) -> DataFrame:
    """Write rows as tab payloads (one per ``sheet`` value): the inverse of
    ``parse_payloads``, used to land test tabs and for round trips.  Cells of
    ``numeric`` columns are written as JSON numbers, the others as strings
    with a formatted copy.  The caller picks ``sheet`` so that each tab
    holds a bounded number of rows (a page)."""
    def cell(h):
        # VARIANT values keep their JSON type: numbers stay numbers.
        if h in numeric:
            return F.struct(F.col(h).cast("double").cast("variant").alias("v"), F.lit(None).cast("string").alias("f"))
        text = F.col(h).cast("string")
        return F.struct(text.cast("variant").alias("v"), text.alias("f"))
    row_json = F.to_json(F.struct(F.array(*[cell(h) for h in headers]).alias("c")))
    cols = F.to_json(F.array(*[F.struct(F.lit(f"c{i}").alias("id"), F.lit(h).alias("label"))
                               for i, h in enumerate(headers)]))
    grouped = df.groupBy(sheet.alias("sheet")).agg(
        F.sort_array(F.collect_list(F.struct(row_order.alias("o"), row_json.alias("j")))).alias("rows"))
    body = F.concat(F.lit('{"status":"ok","table":{"cols":'), cols, F.lit(',"rows":['),
                    F.array_join(F.transform("rows", lambda x: x["j"]), ","), F.lit("]}}"))
    return grouped.select("sheet", F.concat(F.lit("/*O_o*/\ngoogle.visualization.Query.setResponse("), body,
                                            F.lit(");")).alias("text"))
