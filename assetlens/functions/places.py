"""Place-name normalisers as native CASE expressions.

Two different cleaners exist and both are kept: the *contains* cleaner of the
work-unit ingest and the *exact* cleaner of the dashboard map.  They disagree
on purpose (``Kuta Selatan``: contains -> KAB. BADUNG, exact -> KUTA SELATAN).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import _col, at, let, py_strip


def _map(pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal map; for a repeated key the first pair wins."""
    seen: dict[str, str] = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    return F.create_map(*[F.lit(x) for kv in seen.items() for x in kv])


def _lookup(key: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Exact lookup; NULL if absent."""
    return F.try_element_at(_map(pairs), key)


def _first_contained(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Target of the first pattern (in the given order) occurring in text."""
    patterns = F.array(*[F.lit(k) for k, _ in pairs])
    first = at(F.filter(patterns, lambda p: F.instr(text, p) > 0), 1)
    return F.try_element_at(_map(pairs), first)


def clean_place_contains(c, synonyms: Sequence[tuple[str, str]] = K.PLACE_SYNONYMS) -> Column:
    """strip, lower, drop ', bali', 'kab.' -> 'kab '; exact synonym, else
    the first synonym contained; else NULL."""
    raw = _col(c)

    def body(r):
        return F.coalesce(_lookup(r, synonyms), _first_contained(r, synonyms))
    norm = F.replace(F.replace(F.lower(py_strip(raw.cast("string"))), F.lit(", bali"), F.lit("")),
                     F.lit("kab."), F.lit("kab "))
    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(let(norm, body))


def clean_place_exact(c, synonyms: Sequence[tuple[str, str]] = K.PLACE_SYNONYMS,
                      short_names: Mapping[str, str] = K.PLACE_SHORT_NAMES) -> Column:
    """strip, lower; exact synonym; else drop '.', 'kab ', 'kota ' and look
    up the short names; else the stripped input upper-cased."""
    raw = _col(c)

    def body(stripped):
        n = F.lower(stripped)
        n_norm = py_strip(F.replace(F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit("kab "), F.lit("")),
                                    F.lit("kota "), F.lit("")))
        return F.coalesce(_lookup(n, synonyms), _lookup(n_norm, list(short_names.items())), F.upper(stripped))
    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(let(py_strip(raw.cast("string")), body))
