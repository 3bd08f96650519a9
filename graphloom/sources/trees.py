"""Source trees and data folders: files, formats, raw sources, project metadata, persisted tables, subdomain graphs."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import basename
from graphloom.sources.ignore import DEFAULTS, is_ignored
from graphloom.sources.languages import category, language

#: Characters kept of a project's metadata files; other files are not kept.
METADATA_LIMITS = {"package.json": 4000, "pyproject.toml": 3000, "Cargo.toml": 3000, "go.mod": 2000, "README.md": 3000, "pom.xml": 4000, "build.gradle": 3000, "composer.json": 3000}


def tree_files(spark: SparkSession, root: str, extra: list[str] = ()) -> DataFrame:
    """path, size, modified, language, category of every file below a folder that no ignore rule excludes; paths are relative."""
    base = os.path.abspath(root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base, -1)
    f = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.where(~is_ignored(F.col("path"), DEFAULTS, list(extra))).select("*", language(F.col("path")).alias("language"), category(F.col("path")).alias("category"))


def tree_texts(spark: SparkSession, root: str, extra: list[str] = ()) -> DataFrame:
    """path, content of the text files of tree_files; files with a zero byte are left out."""
    base = os.path.abspath(root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base, -1)
    f = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~F.contains(F.col("content"), F.lit(b"\x00")))
    return f.where(~is_ignored(F.col("path"), DEFAULTS, list(extra)))


def wiki_format(files: DataFrame) -> str:
    """``wiki`` for a folder with an index page and at least three Markdown files, ``markdown`` for one with any, else ``none``."""
    r = files.where("lower(path) like '%.md'").agg(F.count("*").alias("n"), F.bool_or(F.lower(basename(F.col("path"))).isin("index.md", "home.md", "readme.md")).alias("index")).first()
    return "none" if not r["n"] else "wiki" if r["index"] and r["n"] >= 3 else "markdown"


def raw_sources(files: DataFrame) -> DataFrame:
    """Source nodes of the files below raw/: id, name, summary with ending and size in KB."""
    f = files.where("path like 'raw/%'")
    name = basename(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return f.select(F.concat(F.lit("source:"), F.regexp_replace("path", "^raw/", "")).alias("id"), F.lit("source").alias("type"), name.alias("name"), F.concat(F.when(ext == "", "file").otherwise(ext), F.lit(", "), F.round(F.col("size") / 1024, 1).cast("string"), F.lit(" KB")).alias("summary"))


def metadata_files(texts: DataFrame) -> DataFrame:
    """path, content of the project's metadata files, each cut to its limit."""
    limit = F.create_map(*[F.lit(x) for k, v in METADATA_LIMITS.items() for x in (k, v)])[basename(F.col("path"))]
    return texts.select("path", F.substring(F.col("content"), F.lit(1), limit).alias("content"), (F.length("content") > limit).alias("cut")).where(limit.isNotNull())


def data_dir(root: str, name: str = ".graphloom", legacy: str = ".graph") -> str:
    """Folder of a project's data: the former one if it is there, else the present one."""
    old = os.path.join(root, legacy)
    return old if os.path.isdir(old) else os.path.join(root, name)


def load_json(path: str, default: dict) -> dict:
    """A small settings or state file; the default where it is missing, broken or no object, its keys filled up from the default."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return dict(default)
    return default | got if isinstance(got, dict) else dict(default)


def save_json(path: str, value: dict) -> None:
    """Written beside its place and moved there, so that no reader sees half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    Path(path + ".part").write_text(json.dumps(value, ensure_ascii=False, sort_keys=True), encoding="utf-8")
    os.replace(path + ".part", path)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A persisted table, an empty one of the schema where it is missing."""
    return spark.read.schema(schema).parquet(path) if os.path.isdir(path) else spark.createDataFrame([], schema)


def graph_files(folder: str, output: str = "graph.json", base: str = "base-graph.json") -> list[str]:
    """Subdomain graph files of a folder in merging order: the base first, the others by name, the output left out."""
    names = sorted(n for n in os.listdir(folder) if n.endswith("-graph.json") and n != output)
    return [os.path.join(folder, n) for n in sorted(names, key=lambda n: (n != base, n))]
