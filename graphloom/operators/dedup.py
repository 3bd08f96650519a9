"""Winner rules for repeated rows, one operator each way; partial aggregates run before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: Column, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_v"))
    return out.select(*keys, "_v.*").select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key by a unique ordinal."""
    return _pick(df, keys, F.col(order), last=False)


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _pick(df, keys, F.col(order), last=True)


def strongest(df: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """Row of largest weight; of equal ones the first."""
    return _pick(df, keys, F.struct(F.col(weight), -F.col(order)), last=True)


def last_value_first_place(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key, at the ordinal of the first."""
    rest = [c for c in df.columns if c not in [*keys, order]]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"), F.min(order).alias(order)) if rest else df.groupBy(*keys).agg(F.min(order).alias(order))
    return out.select(*keys, *(["_v.*"] if rest else []), order).select(*df.columns)


def merged_claim_edges(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Largest weight, longest description, number of agreeing rows."""
    return df.groupBy(*keys).agg(F.max("weight").alias("weight"), F.max_by("description", F.struct(F.length("description"), -F.col(order))).alias("description"), F.count("*").alias("agreed_by"))
