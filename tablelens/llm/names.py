"""Column names that cannot clash with those of a table that passes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.sources.schema import quote


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to differ from every column of ``docs`` in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(quote(name))
