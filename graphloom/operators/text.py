"""Lines, headings and sections of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newline_count(c: Column) -> Column:
    """Number of line feeds, as wc -l counts."""
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def line_counts(c: Column) -> tuple[Column, Column]:
    """All lines (a final line feed ends a line, it opens none) and lines that are not blank."""
    parts = F.split(c, "\n")
    total = F.when(F.length(c) == 0, 0).when(c.endswith("\n"), F.size(parts) - 1).otherwise(F.size(parts))
    return total, F.size(F.filter(parts, lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))) != ""))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no from 1, line."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def fenced(lines: DataFrame, key: str) -> DataFrame:
    """Adds whether a line lies in a fenced block, by the parity of the fence lines up to it."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("line").rlike(r"^\s*(?:```|~~~)")
    return lines.withColumn("fence", mark).withColumn("in_code", (F.sum(F.col("fence").cast("int")).over(w) % 2 == 1) | F.col("fence"))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """Headings outside code: level, title, first line, last line (before the next heading, else the end)."""
    h = fenced(lines, key)
    last = Window.partitionBy(key)
    h = h.withColumn("n_lines", F.max("line_no").over(last)).where(~F.col("in_code") & F.col("line").rlike(r"^#{1,6} +\S"))
    order = Window.partitionBy(key).orderBy("line_no")
    return h.select(
        key, F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+ +(.*)$", 1)).alias("title"), F.col("line_no").alias("first_line"),
        F.coalesce(F.lead("line_no").over(order) - 1, "n_lines").alias("last_line"),
    )


def heading_of_lines(lines: DataFrame, key: str) -> DataFrame:
    """The heading that each line stands under, carried forward."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("line").rlike(r"^#{1,6} +\S"), F.trim(F.regexp_extract("line", r"^#+ +(.*)$", 1)))
    return lines.withColumn("heading", F.last(title, ignorenulls=True).over(w))


def wikilinks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Targets of [[target]] and [[target|label]], trimmed, with their order."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]"), F.lit(1))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(found).alias("pos", "target")).withColumn("target", F.trim("target"))


def greedy_bins(df: DataFrame, by: list[str], order: list[str], size: str, capacity: int) -> DataFrame:
    """Order-keeping bins: a bin closes when the next item would exceed the capacity; larger items stand alone.

    The rule depends on all items before, so a group is folded by one task; it streams the group's sorted rows with
    two numbers of state and holds one Arrow batch, however large the group is. Null sizes count as 0.
    """
    cols = [*by, *order, size]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", bin int"
    n_by, at_size = len(by), len(cols) - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bin_no, used = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_by)), strict=True)) if n_by else [()] * batch.num_rows
            out = []
            for key, n in zip(keys, batch.column(at_size).to_pylist(), strict=True):
                n = n or 0
                if group is None or key != group[0]:
                    group, bin_no, used = (key,), 0, n
                elif used + n <= capacity:
                    used += n
                else:
                    bin_no, used = bin_no + 1, n
                out.append(bin_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*cols, "bin"])

    rows = df.select(*cols)
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    return rows.sortWithinPartitions(*by, *order).mapInArrow(fold, schema)
