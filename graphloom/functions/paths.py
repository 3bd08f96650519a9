"""Path spelling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(c: Column) -> Column:
    """Relative path with single forward slashes, without ``.`` segments, ``..`` resolved; case is kept.

    Null stays null; a path that denotes the root becomes empty.
    """
    parts = F.filter(F.split(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(F.when(F.array_contains(parts, ".."), resolved).otherwise(parts), "/")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
