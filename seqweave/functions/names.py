"""Names for helper columns that a caller's table does not have, and positions cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df (whatever its case) is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[str]:
    """The names of columns so that dots in them are no paths."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def chunk_of(position: Column | str, chunk: int) -> Column:
    """The number of the chunk of a position, in whole numbers throughout: a double loses positions above 2 ** 53."""
    at = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", at, F.lit(chunk).cast("long"))
