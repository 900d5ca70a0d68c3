"""Classification and ordering expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import _col


def classify_by_prefix(c, mapping: Mapping[str, str] = K.CLASS_BY_PREFIX,
                       default: str = K.UNKNOWN_CLASS) -> Column:
    """Class from the first character of a code; ``default`` when unmatched
    or NULL."""
    first = F.substring(_col(c).cast("string"), 1, 1)
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, first), F.lit(default))


def list_position(c, values: Sequence[str]) -> Column:
    """Zero-based position in ``values``; NULL when absent (sorts last)."""
    out = None
    for i, v in enumerate(values):
        out = F.when(_col(c) == F.lit(v), F.lit(i)) if out is None else out.when(_col(c) == F.lit(v), F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def unit_type(c, width: int = 2) -> Column:
    """Type of a work unit: the last ``width`` characters of its code."""
    return F.right(_col(c).cast("string"), F.lit(width))


#: ASCII white space and punctuation in the order of the root collation; all
#: of it sorts before digits, digits before letters (fixed values).
PUNCTUATION_ORDER = "\t\n\x0b\f\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"

#: Letters that stand for two (fixed values).
DOUBLE_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}

#: Blocks whose letters are compared by their base letter: Latin with
#: diacritics, full-width forms.
FOLDED_BLOCKS = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """(characters, replacements) of ``translate``: base letters for letters
    with accents, weights below the digits for punctuation; characters beyond
    the replacements (controls, combining marks) vanish."""
    folds = {c: chr(k + 1) for k, c in enumerate(PUNCTUATION_ORDER)}
    for code in (c for block in FOLDED_BLOCKS for c in block):
        letters = [c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c)]
        if len(letters) == 1 and letters[0] != chr(code):
            folds[chr(code)] = folds.get(letters[0], letters[0])
    gone = [chr(c) for c in (*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *range(0x300, 0x370))]
    return "".join([*folds, *gone]), "".join(folds.values())


def natural_sort_key(c) -> Column:
    """Sort key of a label as bytes, so that a sort compares nothing but
    bytes.  First level: base letters without case and accents, punctuation
    before digits before letters, and digit runs behind their length ('2' <
    '10' for runs of any length).  Second level, for labels equal so far: the
    label itself.  Put the key in a column before sorting by it."""
    label = F.coalesce(_col(c).cast("string"), F.lit(""))
    base = F.translate(F.lower(label), *_folding())
    for letter, two in DOUBLE_LETTERS.items():
        base = F.replace(base, F.lit(letter), F.lit(two))
    tokens = F.regexp_extract_all(base, F.lit("[0-9]+|[^0-9]+"), 0)

    def keyed(t: Column) -> Column:
        number = F.regexp_replace(t, "^0+(?=.)", "")
        return F.when(t.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(t)
    return F.concat(F.array_join(F.transform(tokens, keyed), ""), F.lit("\0"), label).cast("binary")
