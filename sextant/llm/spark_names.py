"""Input columns under names of our own, so that no name of an input table can clash with one that an operator uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Renamed:
    """A table with its columns as u0, u1, ...; columns that an operator's results replace are left out.

    Names are compared as Spark does, without case.
    """

    def __init__(self, df: DataFrame, replaced: Iterable[str] = ()):
        gone = {x.lower() for x in replaced}
        self.names = [c for c in df.columns if c.lower() not in gone]
        self.df = df.select(*[F.col(f"`{c}`").alias(f"u{k}") for k, c in enumerate(self.names)])

    def __getitem__(self, name: str) -> Column:
        """The column that had this name."""
        return F.col(f"u{[c.lower() for c in self.names].index(name.lower())}")

    def back(self, **changed: Column) -> list[Column]:
        """All columns under their own names, those in ``changed`` with a new value."""
        new = {k.lower(): v for k, v in changed.items()}
        return [new.get(c.lower(), F.col(f"u{k}")).alias(c) for k, c in enumerate(self.names)]
