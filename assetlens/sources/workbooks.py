"""Workbook (.xlsx) scans.

``binaryFile`` lists and loads the workbooks; ``mapInPandas`` decodes each
one on an executor (stdlib ``zipfile`` + streaming ``iterparse`` of the
active sheet, cached cell values only) into row batches of at most
``batch_rows`` rows.  A workbook is decoded by one task; the rows are
repartitioned right after, so later stages are spread over the cluster.

Every cell arrives as text plus a kind (``n`` number, ``s`` text, ``b``
boolean, ``d`` date, ``e`` error, ``''`` empty), so that typed casts can
follow the source types without inference.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..functions.text import at

ROWS_SCHEMA = "path string, _row long, cells array<string>, kinds array<string>"
DEFAULT_BATCH_ROWS = 50_000
UNIT_EXPORT_NAME = "Export_UAKPB.xlsx"

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
# Built-in number formats that show dates or times.
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}


def find_workbooks(spark: SparkSession, input_dir: str, fallback_dir: str | None = None,
                   exclude: Sequence[str] = (UNIT_EXPORT_NAME,), glob: str = "*.xlsx") -> DataFrame | None:
    """Scan (path, content) of the workbooks of the input folder, else of the
    fallback folder; None when neither holds one.  The unit export is never
    taken for a register file.  Paths stay in the scan: however many
    workbooks there are, one row tells whether there is any."""
    for folder in filter(None, (input_dir, fallback_dir)):
        try:
            scan = _scan(spark, folder, glob)
        except AnalysisException as e:  # a missing folder holds nothing; any other error is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        scan = scan.filter(~F.regexp_extract("path", "([^/]*)$", 1).isin(list(exclude)))
        if not scan.select("path").isEmpty():
            return scan
    return None


def _scan(spark: SparkSession, source: Sequence[str] | str, glob: str | None = None) -> DataFrame:
    """Workbooks as rows (path, content), one workbook per input partition
    (``maxPartitionBytes`` = 1 byte keeps files apart)."""
    reader = spark.read.format("binaryFile").option("maxPartitionBytes", "1")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(source) if not isinstance(source, str) else source).select("path", "content")


def discover_inputs(spark: SparkSession, input_dir: str, fallback_dir: str | None = None,
                    exclude: Sequence[str] = (UNIT_EXPORT_NAME,), glob: str = "*.xlsx") -> DataFrame:
    """Listing (path), sorted, of what ``find_workbooks`` scans; no content
    is read."""
    found = find_workbooks(spark, input_dir, fallback_dir, exclude, glob)
    return spark.createDataFrame([], "path string") if found is None else found.select("path").orderBy("path")


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if "A" <= ch <= "Z":
            n = n * 26 + (ord(ch) - 64)
        else:
            break
    return n - 1


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    out = []
    for _, el in ET.iterparse(zf.open("xl/sharedStrings.xml")):
        if el.tag == f"{_NS}si":
            parts = []
            for child in el:
                if child.tag == f"{_NS}t":
                    parts.append(child.text or "")
                elif child.tag == f"{_NS}r":
                    parts.extend(t.text or "" for t in child.iter(f"{_NS}t"))
            out.append("".join(parts))
            el.clear()
    return out


def _date_styles(zf: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format shows a date."""
    if "xl/styles.xml" not in zf.namelist():
        return set()
    root = ET.parse(zf.open("xl/styles.xml")).getroot()
    custom = {}
    fmts = root.find(f"{_NS}numFmts")
    if fmts is not None:
        for f in fmts:
            custom[int(f.get("numFmtId"))] = f.get("formatCode", "")
    out = set()
    xfs = root.find(f"{_NS}cellXfs")
    if xfs is not None:
        for i, xf in enumerate(xfs):
            fid = int(xf.get("numFmtId", "0"))
            code = custom.get(fid)
            if fid in _DATE_FORMAT_IDS or (code is not None and _is_date_code(code)):
                out.add(i)
    return out


def _is_date_code(code: str) -> bool:
    import re
    stripped = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[dmyhs]", stripped, re.IGNORECASE))


def _active_sheet_path(zf: zipfile.ZipFile) -> str:
    wb = ET.parse(zf.open("xl/workbook.xml")).getroot()
    active = 0
    views = wb.find(f"{_NS}bookViews")
    if views is not None and len(views):
        active = int(views[0].get("activeTab", "0"))
    sheets = wb.find(f"{_NS}sheets")
    sheet = list(sheets)[active]
    rid = sheet.get(f"{_REL_NS}id")
    rels = ET.parse(zf.open("xl/_rels/workbook.xml.rels")).getroot()
    target = next(r.get("Target") for r in rels.iter(f"{_PKG_NS}Relationship") if r.get("Id") == rid)
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def _excel_date(serial: float) -> str:
    if 0 < serial < 60:
        serial += 1
    return str(datetime(1899, 12, 30) + timedelta(days=serial))


def _number_text(v: str) -> str:
    # The Python text of the value a spreadsheet reader returns: int when the
    # stored number has no fraction or exponent, else float.
    if any(ch in v for ch in ".eE"):
        return repr(float(v))
    return str(int(v))


def decode_xlsx(content: bytes) -> Iterator[tuple[int, list, list]]:
    """(row number, cell texts, cell kinds) for every row stored in the
    active sheet, cells placed by their reference."""
    zf = zipfile.ZipFile(io.BytesIO(content))
    strings = _shared_strings(zf)
    dates = _date_styles(zf)
    seq_row = 0
    for _, el in ET.iterparse(zf.open(_active_sheet_path(zf))):
        if el.tag != f"{_NS}row":
            continue
        seq_row = int(el.get("r")) if el.get("r") else seq_row + 1
        texts: list = []
        kinds: list = []
        pos = -1
        for c in el.iter(f"{_NS}c"):
            ref = c.get("r")
            pos = _col_index(ref) if ref else pos + 1
            t = c.get("t", "n")
            v = c.find(f"{_NS}v")
            text, kind = None, ""
            if t == "inlineStr":
                is_ = c.find(f"{_NS}is")
                text, kind = ("".join(x.text or "" for x in is_.iter(f"{_NS}t")), "s") if is_ is not None else (None, "")
            elif v is not None and v.text is not None:
                if t == "s":
                    text, kind = strings[int(v.text)], "s"
                elif t in ("str", "d"):
                    text, kind = v.text, ("s" if t == "str" else "d")
                elif t == "b":
                    text, kind = ("True" if v.text.strip() in ("1", "true") else "False"), "b"
                elif t == "e":
                    text, kind = v.text, "e"
                else:
                    style = int(c.get("s", "0"))
                    if style in dates:
                        text, kind = _excel_date(float(v.text)), "d"
                    else:
                        text, kind = _number_text(v.text.strip()), "n"
            while len(texts) < pos:
                texts.append(None)
                kinds.append("")
            if len(texts) == pos:
                texts.append(text)
                kinds.append(kind)
            else:
                texts[pos], kinds[pos] = text, kind
        yield seq_row, texts, kinds
        el.clear()


def _decode_batches(batch_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                buf = []
                for r, texts, kinds in decode_xlsx(bytes(content)):
                    buf.append((path, r, texts, kinds))
                    if len(buf) >= batch_rows:
                        yield pd.DataFrame(buf, columns=["path", "_row", "cells", "kinds"])
                        buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=["path", "_row", "cells", "kinds"])
    return run


def read_workbooks(spark: SparkSession, source: DataFrame | Sequence[str] | str,
                   batch_rows: int = DEFAULT_BATCH_ROWS, partitions: int | None = None) -> DataFrame:
    """Rows of the active sheet of each workbook: (path, _row, cells, kinds).
    ``source`` is a scan of ``find_workbooks``, or paths.

    Workbooks are decoded one per input partition, in Arrow batches, then
    hash-repartitioned on (path, _row) so that a single huge workbook does not
    stay one task; AQE sizes those partitions unless ``partitions`` pins their
    number."""
    files = source if isinstance(source, DataFrame) else _scan(spark, source)
    rows = files.select("path", "content").mapInPandas(_decode_batches(batch_rows), ROWS_SCHEMA)
    return rows.repartition(partitions, "path", "_row") if partitions else rows.repartition("path", "_row")


def pad_to_width(rows: DataFrame, key: str = "path") -> DataFrame:
    """Pad every row to the widest row of its workbook (missing -> NULL)."""
    widths = rows.groupBy(key).agg(F.max(F.size("cells")).alias("__w"))
    j = rows.join(widths, key)
    seq = F.sequence(F.lit(1), F.greatest(F.col("__w"), F.lit(1)))
    return j.select(key, "_row",
                    F.transform(seq, lambda i: at(F.col("cells"), i)).alias("cells"),
                    F.transform(seq, lambda i: F.coalesce(at(F.col("kinds"), i), F.lit(""))).alias("kinds"),
                    "__w").drop("__w")


def read_positional(rows: DataFrame, positions: dict[str, int], width: int, first_row: int = 2) -> DataFrame:
    """Read cells by position (zero-based) from ``first_row`` on, over the
    first ``width`` columns; rows whose cells there are all empty are
    skipped.  Each picked column gives ``<name>`` (text) and ``<name>__kind``."""
    d = rows.filter(F.col("_row") >= first_row)
    window = F.slice(F.col("cells"), 1, width)
    d = d.filter(F.exists(window, lambda x: x.isNotNull()))
    return d.select("path", "_row", *[at("cells", p + 1).alias(n) for n, p in positions.items()],
                    *[F.coalesce(at("kinds", p + 1), F.lit("")).alias(n + "__kind")
                      for n, p in positions.items()])
