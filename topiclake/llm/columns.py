"""Keeps the columns of a table apart from those that operators add on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shield(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The table with all columns but the ``used`` ones renamed, and what renames them back.

    The second takes the result and names of columns to add; an added column replaces one of the
    table that has its name.
    """
    names = {c: c if c in used else f"_other_{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))

    def restore(out: DataFrame, *added: str) -> DataFrame:
        back = [F.col(n).alias(c) for c, n in names.items() if c not in added and n in out.columns]
        return out.select(*back, *added)

    return renamed, restore


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, ``name`` if that is free."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
