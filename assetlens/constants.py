"""Domain constants.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (class map, header synonyms, place maps, centres, sort order,
tokens, labels).  They are stated plainly, in their natural order, and are
only *read* by the operators; every operator also accepts its own map as an
argument so the same code serves other bindings.
"""

from __future__ import annotations

# --- FIXED VALUES: register schema -----------------------------------------

# Leading columns of the register, in output order.
FIXED_COLUMNS = [
    "nomor", "jenis_bmn", "kode_satker", "nama_satker", "kode_barang",
    "nup", "golongan_bmn",
]

# Columns the dashboard expects.
REQUIRED_COLUMNS = [
    "nomor", "jenis_bmn", "kode_satker", "nama_satker", "kode_barang",
    "nup", "golongan_bmn", "nilai_perolehan", "nilai_buku", "kab_kota",
]

# Header synonyms, keyed by the canonicalised source header.
HEADER_SYNONYMS = {
    "no": "nomor",
    "jenis_bmn": "jenis_bmn",
    "jenis": "jenis_bmn",
    "kode_satker": "kode_satker",
    "kode satker": "kode_satker",
    "nama_satker": "nama_satker",
    "nama satker": "nama_satker",
    "kode_barang": "kode_barang",
    "kode barang": "kode_barang",
    "nup": "nup",
    "nomor_urut_pendaftaran": "nup",
}

# Asset class by the first character of the item code.
CLASS_BY_PREFIX = {
    "1": "PERSEDIAAN",
    "2": "TANAH",
    "3": "PERALATAN DAN MESIN",
    "4": "GEDUNG DAN BANGUNAN",
    "5": "JALAN, IRIGASI DAN JARINGAN",
    "6": "ASET TETAP LAINNYA",
    "7": "KONSTRUKSI DALAM PENGERJAAN",
    "8": "ASET TAK BERWUJUD",
}
UNKNOWN_CLASS = "TIDAK DIKENAL"

# Display order of classes; a class missing here sorts last.
CLASS_ORDER = [
    "TANAH",
    "PERALATAN DAN MESIN",
    "GEDUNG DAN BANGUNAN",
    "JALAN, IRIGASI DAN JARINGAN",
    "ASET TETAP LAINNYA",
    "KONSTRUKSI DALAM PENGERJAAN",
    "ASET TAK BERWUJUD",
    "TIDAK DIKENAL",
]

TOTAL_LABEL = "TOTAL"

# Work-unit type suffixes counted in the unit overview.
UNIT_TYPES = ["KD", "KP", "TP", "DK", "UB"]

# Work-unit export read by position (zero-based): code, name, agency code,
# agency name, status, raw place.
UNIT_EXPORT_POSITIONS = {
    "kode_satker": 1,
    "nama_satker": 2,
    "kode_kl": 3,
    "nama_kl": 4,
    "status": 19,
    "kab_kota_raw": 22,
}
UNIT_EXPORT_WIDTH = 25
ACTIVE_STATUS = "AKTIF"

# Display names of the work-unit detail table.
UNIT_DETAIL_LABELS = {
    "kode_kl": "Kode K/L",
    "nama_kl": "Nama K/L",
    "kode_satker": "Kode Satker",
    "nama_satker": "Nama Satker",
    "kab_kota": "Kab/Kota",
}

TOP_K = 20

# --- FIXED VALUES: places ---------------------------------------------------

# Place synonyms; ORDER IS SIGNIFICANT for the "contains" cleaner, which takes
# the first pattern (in this order) that occurs in the input.
PLACE_SYNONYMS = [
    ("badung", "KAB. BADUNG"), ("kab badung", "KAB. BADUNG"), ("kabupaten badung", "KAB. BADUNG"),
    ("bangli", "KAB. BANGLI"), ("kab bangli", "KAB. BANGLI"),
    ("buleleng", "KAB. BULELENG"), ("kab buleleng", "KAB. BULELENG"),
    ("gianyar", "KAB. GIANYAR"), ("kab gianyar", "KAB. GIANYAR"),
    ("jembrana", "KAB. JEMBRANA"), ("kab jembrana", "KAB. JEMBRANA"),
    ("karangasem", "KAB. KARANGASEM"), ("kab karangasem", "KAB. KARANGASEM"),
    ("klungkung", "KAB. KLUNGKUNG"), ("kab klungkung", "KAB. KLUNGKUNG"),
    ("tabanan", "KAB. TABANAN"), ("kab tabanan", "KAB. TABANAN"),
    ("denpasar", "KOTA DENPASAR"), ("kota denpasar", "KOTA DENPASAR"),
    ("deanpasar", "KOTA DENPASAR"),
    ("semarapura", "KAB. KLUNGKUNG"),
    ("mangupura", "KAB. BADUNG"),
    ("kuta", "KAB. BADUNG"),
]

# Short names used by the exact cleaner after dropping ".", "kab ", "kota ".
PLACE_SHORT_NAMES = {
    "badung": "KAB. BADUNG", "bangli": "KAB. BANGLI",
    "buleleng": "KAB. BULELENG", "gianyar": "KAB. GIANYAR",
    "jembrana": "KAB. JEMBRANA", "karangasem": "KAB. KARANGASEM",
    "klungkung": "KAB. KLUNGKUNG", "tabanan": "KAB. TABANAN",
    "denpasar": "KOTA DENPASAR", "bali": "KOTA DENPASAR",
}

# Map centres (lat, lon) per cleaned place.
PLACE_CENTRES = {
    "KAB. BADUNG": (-8.5819, 115.1775),
    "KAB. BANGLI": (-8.4543, 115.3547),
    "KAB. BULELENG": (-8.1852, 114.9367),
    "KAB. GIANYAR": (-8.5439, 115.3268),
    "KAB. JEMBRANA": (-8.3147, 114.5901),
    "KAB. KARANGASEM": (-8.4095, 115.6114),
    "KAB. KLUNGKUNG": (-8.5627, 115.4207),
    "KAB. TABANAN": (-8.5437, 115.0576),
    "KOTA DENPASAR": (-8.6529, 115.2196),
}

MARKER_SCALE = 600.0
MARKER_BASE = 8.0
MARKER_MIN = 10.0
MARKER_FIXED = 16.0

# --- FIXED VALUES: achievement sheets --------------------------------------

SHEET_NAMES = ["Capaian", "K1", "K2", "K3", "IGT", "ActionPlan"]
# The overview sheet is never served from a stored snapshot.
NO_CACHE_SHEETS = ["Capaian"]

EMPTY_TOKEN = "__EMPTY__"
EMPTY_LABEL = "Tidak Diisi"

# Problem column of the K3 sheet: exact header, else a header containing both
# tokens, else the column at this zero-based position.
PROBLEM_COLUMN_NAME = "Permasalahan K3 2025"
PROBLEM_COLUMN_TOKENS = ["permasalahan", "k3"]
PROBLEM_COLUMN_INDEX = 10

# A row is complete when this pattern occurs in the lower-cased joined text of
# the status-like columns (or of all columns when none is status-like).
COMPLETION_HEADER_TOKENS = ["status", "capaian", "realisasi", "progress", "progres", "sertifikat"]
COMPLETION_PATTERN = "(selesai|terbit|bersertifikat|sertifikat terbit|sudah|valid|rampung|100%)"

# Headers that all look like this make the first data row the header row.
GENERIC_HEADER_PATTERN = r"^([A-Z]+|Kolom \d+|[a-z])$"
GENERIC_HEADER_PATTERN_CASE_INSENSITIVE = True
GENERIC_COLUMN_PREFIX = "Kolom"
# Letter-only headers of two or three capitals are dropped by the strict
# informative-column rule.
LETTER_HEADER_PATTERN = r"^[A-Z]{2,3}$"

# Positional labels of the overview sheet.
CAPAIAN_LABELS = [
    "K1 NUP",
    "K1 Bidang",
    "K2 NUP",
    "K2 Bidang",
    "K3 NUP",
    "K3 Bidang",
    "K4 NUP",
    "K4 Bidang",
    "Jumlah Capaian",
    "% Capaian",
    "Permasalahan Hukum",
    "% Capaian Hukum",
    "Permasalahan Penatausahaan",
    "% Capaian Penatausahaan",
    "Konsolidasi",
    "% Q2 Konsolidasi",
    "% Konsolidasi",
]
# Clean-ups applied to headers beyond the positional labels (pattern, label),
# all case-insensitive.
CAPAIAN_HEADER_REWRITES = [
    ("TOTAL CAPAIAN K1 NUP", "K1 NUP"),
    ("JUMLAH KOMPONEN A Capaian", "Jumlah Capaian"),
    ("Permasalahan hukum Bidang", "Permasalahan Hukum"),
    ("Permasalahan Penatausahaan Bidang", "Permasalahan Penatausahaan"),
    ("Konsolidasi Bidang", "Konsolidasi"),
]

# Header tokens of the overview KPIs (all tokens must occur, case-insensitive).
KPI_TOKENS = {
    "k1_nup": ["total capaian k1", "nup"],
    "k2_nup": ["k2 nup"],
    "k3_nup": ["k3 nup"],
    "k4_nup": ["k4 nup"],
    "total": ["jumlah komponen a capaian"],
    "konsolidasi": ["konsolidasi"],
    "hukum": ["permasalahan hukum"],
    "penatausahaan": ["permasalahan penatausahaan"],
}
# Zero-based positional overrides of the consolidation columns.
KPI_KONSOLIDASI_POSITIONS = (14, 15, 16)
# Zero-based positions of the raw-row KPI layout.
KPI_RAW_POSITIONS = {
    "k1_nup": 25, "k1_bidang": 26, "k2_nup": 32, "k2_bidang": 33,
    "k3_nup": 34, "k3_bidang": 35, "k4_nup": 36, "k4_bidang": 37,
    "total_bidang": 38, "total_q1": 39, "total_pct": 40,
    "hukum_bidang": 41, "hukum_q1": 42, "hukum_pct": 43,
    "penatausahaan_bidang": 44, "penatausahaan_q1": 45, "penatausahaan_pct": 46,
    "konsolidasi_bidang": 47, "konsolidasi_q1": 48, "konsolidasi_pct": 49,
}
IGT_HEADER_TOKENS = ["%", "capaian"]
PERCENT_CAP = 100.0
COMPOSITION_MIN_WIDTH = 3
