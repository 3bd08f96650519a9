"""Source files that do not parse (problem 5).

Each file is lexed once; what comes out as rows are its distinct adjacent token pairs, the brackets that are left
after matched groups cancelled inside the file, the statement shapes that no production yields, and the clause heads of
Python blocks that hold a clause which needs another before it. Pairs are anti-joined with the pairs that follow from
the language's productions, left-over brackets are judged by a running depth over the file, clauses by the head before
and after them in their block. Cancelling and deriving before rows leave the lexer keeps the windows small and lets
the whole job pass once over the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import grammar as G

LANGUAGES = ("py", "js", "ts", "go", "java", "json")
#: Below this, an empty file is a file of no statements; the others need at least a clause or a value.
EMPTY_IS_INVALID = ("go", "json")

_FOUND = "graphId string, path string, lang string, found array<struct<kind:string,item:string,block:int,pos:int,step:int>>"


def file_language(path: F.Column) -> F.Column:
    """Language by the ending of the path, null for endings that are not checked."""
    return F.nullif(F.regexp_extract(path, r"\.(py|js|ts|go|java|json)$", 1), F.lit(""))


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string()), ("block", pa.int32()), ("pos", pa.int32()), ("step", pa.int32())]))
    for batch in batches:
        found = []
        for lang, content in zip(batch.column("lang").to_pylist(), batch.column("content"), strict=True):
            letters = G.lex(lang, content.as_py())
            pairs = G.pair_set(letters)
            if lang not in EMPTY_IS_INVALID and not letters.strip("N"):
                pairs = set()
            left, shapes = G.reduce_groups(lang, letters)
            brackets = [(i, 1 if c in G.OPEN else -1) for i, c in enumerate(left) if c in G.OPEN or c in G.CLOSE]
            if pairs and not brackets:
                shapes.update(G.statements(lang, left))
            # Statements that a production yields end here; pairs are left to the anti-join.
            found.append(
                [{"kind": "pair", "item": p, "block": 0, "pos": 0, "step": 0} for p in pairs]
                + [{"kind": "statement", "item": digest(x), "block": 0, "pos": 0, "step": 0} for x in shapes if not G.produces(lang, x)]
                + [{"kind": "nesting", "item": "", "block": 0, "pos": i, "step": s} for i, s in brackets]
                + [{"kind": "clause", "item": h, "block": b, "pos": i, "step": 0} for b, i, h in (G.clauses(left) if lang == "py" and not brackets else ())]
            )
        yield pa.RecordBatch.from_arrays([batch.column("graphId"), batch.column("path"), batch.column("lang"), pa.array(found, item)], names=["graphId", "path", "lang", "found"])


def digest(shape: str) -> str:
    """A shape of any length as a short item."""
    return hashlib.blake2b(shape.encode(), digest_size=12).hexdigest()


def clause_chains(rows: list[tuple[int, int, str]]) -> bool:
    """Whether every clause of these Python blocks follows the head it needs; what the window over blocks does, in one place."""
    last: dict[int, str] = {}
    for block, _, head in sorted(rows):
        if (head in G.CLAUSE_AFTER and last.get(block, "") not in tuple(G.CLAUSE_AFTER[head])) or (last.get(block) == "T" and head not in "XZ"):
            return False
        last[block] = head
    return "T" not in last.values()


def parse_failures(files: DataFrame) -> DataFrame:
    """graphId, path, lang, reasons of each file that is not valid in the language of its path.

    files: graphId, path, content. Files with other endings and null content are not judged; a file delivered
    twice is reported once. reasons holds ``pair``, ``nesting``, ``statement`` and ``clause``. The language column and
    earlier verdicts play no part. Empty .py, .js, .ts and .java files are valid, empty .go and .json are not.
    """
    spark = files.sparkSession
    known = files.select("graphId", "path", file_language(F.col("path")).alias("lang"), "content").where("lang is not null and content is not null")
    rows = known.mapInArrow(_lex, _FOUND).select("graphId", "path", "lang", F.explode("found").alias("f")).select("graphId", "path", "lang", "f.*")
    grammar = [(lang, "pair", p) for lang in LANGUAGES for p in sorted(G.permitted_pairs(lang))]  # fixed by the grammars: some thousand rows
    permitted = F.broadcast(spark.createDataFrame(grammar, "lang string, kind string, item string"))
    off = rows.join(permitted, ["lang", "kind", "item"], "left_anti")
    # Running depth of the brackets left over, and the head before each clause of a block. Copies of a file are one.
    order = Window.partitionBy("graphId", "path", "kind", "block").orderBy("pos", "step")
    judged = off.distinct().withColumns({"depth": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "before": F.lag("item").over(order), "after": F.lead("item").over(order)})
    needs = F.create_map(*[F.lit(x) for k, v in G.CLAUSE_AFTER.items() for x in (k, v)])[F.col("item")]
    lonely = (needs.isNotNull() & ~F.coalesce(F.contains(needs, F.col("before")), F.lit(False))) | ((F.col("item") == "T") & ~F.coalesce(F.col("after").isin("X", "Z"), F.lit(False)))
    per_file = judged.where((F.col("kind") != "clause") | lonely).groupBy("graphId", "path", "lang").agg(
        F.array_sort(F.collect_set("kind")).alias("reasons"), F.min("depth").alias("lowest"), F.sum("step").alias("open_end")
    )
    return per_file.select(
        "graphId", "path", "lang", "reasons",
        F.when(~F.array_contains("reasons", "nesting"), None).when(F.col("lowest") < 0, "unexpected close").when(F.col("open_end") > 0, "unclosed").otherwise("mismatched").alias("nesting"),
    )


def parse_rates(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Per graphId and language: files (each once), those that do not parse, and their share."""
    once = files.select("graphId", "path", file_language(F.col("path")).alias("language"), "content").where("language is not null and content is not null").select("graphId", "path", "language").distinct()
    bad = failures.select("graphId", "path", F.lit(1).alias("bad")).distinct()
    joined = once.join(bad, ["graphId", "path"], "left")
    counted = joined.groupBy("graphId", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_bad"))
    return counted.withColumn("rate", F.round(F.col("n_bad") / F.col("n_files"), 6))
