"""What changed between full snapshots (problem 6).

A bucketed key-to-hash index is kept: bucket, key, hash and the row the values are found in. New rows are probed against
the index of the snapshot before on the bucketed key; only pairs that the hashes cannot decide fetch their old and new
values; then the new rows are the index. A whole table of snapshots is indexed once, and all consecutive pairs of all
graphs are probed in one pass; a stream swaps one delivery after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import canonical_path
from graphloom.session import cut_lineage, written

#: Rows of one bucket of an index.
BUCKET_ROWS = 250_000
INDEX = "bucket int, graphId string, filePath string, hash string, fp_row long"
CHANGES = "graphId string, snapshot_no int, filePath string, change string"


def canonical_hash(c: F.Column) -> F.Column:
    """Lower-case hex without an algorithm label; blank is null."""
    h = F.regexp_replace(F.lower(F.trim(c)), r"^sha-?256:\s*", "")
    return F.when(h != "", h)


def function_set(c: F.Column) -> F.Column:
    """Digest of a set of function records: order (of the array and of parameters) and repeats mean nothing; null is empty."""
    one = F.transform(
        F.coalesce(c, F.array().cast("array<struct<name:string,params:array<string>,returnType:string,exported:boolean,lineCount:int>>")),
        lambda f: F.to_json(F.struct(f["name"].alias("n"), F.array_sort(F.coalesce(f["params"], F.array().cast("array<string>"))).alias("p"), f["returnType"].alias("r"), f["exported"].alias("e"), f["lineCount"].alias("l"))),
    )
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(one)), "\n", "null"), 256)


def keyed(deliveries: DataFrame, buckets: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The index of deliveries: the row with the latest deliveredAt (then the largest fp_row) of each file counts.

    Rows with null graphId or null path are ignored. ``by`` are further key columns.
    """
    rows = deliveries.select(
        *by, "graphId", canonical_path(F.col("filePath")).alias("filePath"), canonical_hash(F.col("contentHash")).alias("hash"), "fp_row", "deliveredAt"
    ).where(F.col("graphId").isNotNull() & F.col("filePath").isNotNull())
    bucket = F.pmod(F.xxhash64("graphId", "filePath"), F.lit(buckets)).cast("int")
    last = rows.groupBy(bucket.alias("bucket"), *by, "graphId", "filePath").agg(F.max_by(F.struct("hash", "fp_row"), F.struct("deliveredAt", "fp_row")).alias("v"))
    return last.select("bucket", *by, "graphId", "filePath", "v.hash", "v.fp_row")


def _decided(pairs: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """key, change of pairs (key, old_hash, new_hash, old_row, new_row); what hashes leave open goes to the values."""
    both = F.col("old_row").isNotNull() & F.col("new_row").isNotNull()
    open_ = both & (F.col("old_hash").isNull() | F.col("new_hash").isNull())
    change = F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "removed").when(open_, "open").when(F.col("old_hash") != F.col("new_hash"), "changed")
    # Written as a table, so that the planner knows how few bytes are open and takes them to the values, or not.
    judged = written(pairs.withColumn("change", change).where("change is not null").select(*key, "change", "old_row", "new_row"))
    sides = written(judged.where("change = 'open'").select(*key, F.explode(F.array("old_row", "new_row")).alias("fp_row")))
    values = source.select("fp_row", "functions").join(sides, "fp_row").select(*key, function_set(F.col("functions")).alias("fns"))
    by_value = values.groupBy(*key).agg(F.min("fns").alias("a"), F.max("fns").alias("b")).where("a <> b").select(*key, F.lit("changed").alias("change"))
    return judged.where("change <> 'open'").select(*key, "change").unionByName(by_value)


def snapshot_changes(fingerprints: DataFrame, buckets: int | None = None) -> DataFrame:
    """graphId, snapshot_no, filePath, change from each snapshot of a graph to its next one present.

    fingerprints: fp_row, graphId, snapshot_no, deliveredAt, filePath, contentHash, functions. Rows with null graphId,
    snapshot_no or path are ignored; the first snapshot of a graph yields no changes. Each graph has its own order of
    numbers, so all pairs of neighbours are independent and are probed together. buckets follows the number of rows.
    """
    rows = fingerprints.where("snapshot_no is not null")
    buckets = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    index = written(keyed(rows, buckets, ("snapshot_no",)))
    # One row per graph and snapshot: which snapshot follows.
    numbers = index.select("graphId", "snapshot_no").distinct()
    order = Window.partitionBy("graphId").orderBy("snapshot_no")
    steps = written(numbers.select("graphId", "snapshot_no", F.lag("snapshot_no").over(order).alias("prev"), F.lead("snapshot_no").over(order).alias("next")))
    # A row is new in its own snapshot and old in the next one.
    roles = F.array(F.struct(F.lit(True).alias("new"), F.when(F.col("prev").isNotNull(), F.col("snapshot_no")).alias("at")), F.struct(F.lit(False).alias("new"), F.col("next").alias("at")))
    met = index.join(steps, ["graphId", "snapshot_no"]).select("bucket", "graphId", "filePath", "hash", "fp_row", F.inline(roles)).where("at is not null")
    side = lambda new, c: F.max(F.when(F.col("new") == new, F.col(c)))
    pairs = met.groupBy("bucket", "graphId", "filePath", F.col("at").alias("snapshot_no")).agg(
        side(False, "hash").alias("old_hash"), side(True, "hash").alias("new_hash"), side(False, "fp_row").alias("old_row"), side(True, "fp_row").alias("new_row")
    )
    return _decided(pairs, fingerprints, ["graphId", "snapshot_no", "filePath"])


class SnapshotIndex:
    """Key-to-hash index of the last snapshot of every graph, for deliveries that come one by one.

    ``apply`` takes one delivery (rows of a single snapshot_no, any number of graphs) and returns its changes.
    Graphs without rows in a delivery keep their index. The first snapshot of a graph yields no changes.
    """

    def __init__(self, spark: SparkSession, source: DataFrame, buckets: int = 64, index: DataFrame | None = None):
        self.source, self.buckets = source, buckets
        self.index = index if index is not None else spark.createDataFrame([], INDEX)

    def apply(self, delivery: DataFrame, snapshot_no: int) -> DataFrame:
        new = cut_lineage(keyed(delivery, self.buckets))
        graphs = new.select("graphId").distinct()
        old = self.index.join(graphs, "graphId", "left_semi")
        known = self.index.select("graphId").distinct()
        o, n = old.alias("o"), new.join(known, "graphId", "left_semi").alias("n")
        pairs = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in ("bucket", "graphId", "filePath")], "full_outer").select(
            F.coalesce("o.graphId", "n.graphId").alias("graphId"), F.coalesce("o.filePath", "n.filePath").alias("filePath"),
            F.col("o.hash").alias("old_hash"), F.col("n.hash").alias("new_hash"), F.col("o.fp_row").alias("old_row"), F.col("n.fp_row").alias("new_row"),
        )
        changes = cut_lineage(_decided(pairs, self.source, ["graphId", "filePath"]))  # the rounds' plans must not pile up
        kept = self.index.join(graphs, "graphId", "left_anti")
        self.index = cut_lineage(kept.unionByName(new).repartition("bucket"))
        return changes.select("graphId", F.lit(snapshot_no).cast("int").alias("snapshot_no"), "filePath", "change")


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per graph, snapshot and kind."""
    return changes.groupBy("graphId", "snapshot_no", "change").agg(F.count("*").alias("n_files"))
