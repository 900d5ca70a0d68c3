"""Scalar Column expressions (all JVM-side, no Python UDFs)."""

from .classify import classify_by_prefix, list_position, natural_sort_key, unit_type
from .numbers import (format_count, format_id_number, format_rupiah, marker_radius,
                      metric_with_pct, parse_id_number, parse_percent_prefix)
from .places import clean_place_contains, clean_place_exact
from .text import (clean_header, clean_value, display_or_dash, filter_value,
                   joined_lower, js_trim, py_strip, text_or_blank)

__all__ = [
    "classify_by_prefix", "list_position", "natural_sort_key", "unit_type",
    "format_count", "format_id_number", "format_rupiah", "marker_radius", "metric_with_pct",
    "parse_id_number", "parse_percent_prefix",
    "clean_place_contains", "clean_place_exact",
    "clean_header", "clean_value", "display_or_dash", "filter_value",
    "joined_lower", "js_trim", "py_strip", "text_or_blank",
]
