"""Positional slots for sheets with arbitrary headers.

A header may hold dots or backticks, differ from another one only in case, or
carry a name that the engine uses itself (``_row``).  Operators therefore
rename a sheet's columns by position, work on the slots, and put the headers
back at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Slots:
    """``df`` with columns named by position.  ``reserved`` names (the row
    number, the tab) take the first column of that name; every other column
    is a header, found by its exact name."""

    def __init__(self, df: DataFrame, reserved: Sequence[str] = ()):
        self.names = list(df.columns)
        self.slots = [f"__slot{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.slots)
        self.reserved = {n: self.slots[self.names.index(n)] for n in reserved if n in self.names}
        taken = set(self.reserved.values())
        self.headers = [n for n, s in zip(self.names, self.slots) if s not in taken]
        self.header_slots = [s for s in self.slots if s not in taken]

    def slot(self, header: str) -> str:
        return self.header_slots[self.headers.index(header)]

    def col(self, header: str) -> Column:
        return F.col(self.slot(header))

    def cell(self, header: str) -> Column:
        """The cell text, '' for no header or an unknown one."""
        return F.coalesce(self.col(header), F.lit("")) if header in self.headers else F.lit("")

    def own(self, name: str) -> Column:
        """A reserved column."""
        return F.col(self.reserved[name])

    def keep(self, cond: Column, df: DataFrame | None = None) -> DataFrame:
        """The rows (of ``df``) where ``cond``, which may read every column.

        The optimizer must not look into such a condition: it would restate it
        for each choice of the columns that are renamed later, 2^columns forms.
        A condition that is never the same twice (the row's number is at least
        0) is left alone."""
        rows = self.df if df is None else df
        return rows.filter(F.when(F.monotonically_increasing_id() >= 0, cond).otherwise(F.lit(False)))

    def restore(self, df: DataFrame) -> DataFrame:
        """Headers back in place (same columns, same order)."""
        return df.toDF(*self.names)
