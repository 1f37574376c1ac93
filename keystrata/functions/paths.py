"""Object locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_segments(location: Column) -> Column:
    """Segments of a location below its store's root after lexical cleaning; null stays null.

    Empty segments and ``.`` vanish, ``..`` takes the segment before it away; a ``..`` that climbs above
    the root stays in front, so such a location never equals one below the root.
    """

    def step(stack: Column, segment: Column) -> Column:
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(".."))
        up = F.when(top == "..", F.concat(stack, F.array(F.lit("..")))).otherwise(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(segment.isin("", "."), stack).when(segment == "..", up).otherwise(F.concat(stack, F.array(segment)))

    return F.aggregate(F.split(location, "/"), F.array().cast("array<string>"), step)


def clean_path(location: Column) -> Column:
    """Location relative to the store's root, cleaned; ``''`` is the root itself."""
    return F.array_join(clean_segments(location), "/")


def extension(name: Column) -> Column:
    """From the last dot of a file name to its end, ``''`` without a dot."""
    return F.regexp_extract(name, r"\.[^.]*$", 0)
