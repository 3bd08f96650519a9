"""Session helpers: table access, lineage cuts that survive the loss of an executor, tables prepared once."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned by the reader once a query selects them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names it and is used as it is; without it there is an error, as executors
    would write to disks of their own. Only a local master, as in tests, gets a temporary folder.
    """
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    if set_dir:
        return set_dir
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        target = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table of its own in the shared folder; unlike a checkpoint it tells the planner its size."""
    target = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def _delivery(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files below the paths with their sizes and times: another delivery has another one."""
    jvm, seen = spark._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = list(fs.listStatus(p))
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo.extend(fs.listStatus(s.getPath()))
            else:
                seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def prepared(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the source paths, written once per delivery to the shared folder and read from there.

    The folder is that of the session's checkpoints, so it goes with them. A table that was not written to its end
    has no mark of success and is written again.
    """
    target = f"{ensure_checkpoint_dir(spark)}/prepared/{name}-{_delivery(spark, sources)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that no plan reads any more; a missing one is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
