"""Documentation units of Python sources: docstrings, their parts, their fields, and checks of fields against signatures."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest part of a docstring in characters, and the least a part of its own has.
PART, SLIVER = 1800, 300

_FIELD = re.compile(r"^[ \t]*:(param|parameter|arg|argument|type|raises?|except|exception|returns?|rtype|yields?|ytype)\b([^:\n]*):[ \t]*(.*)$", re.M)
_KINDS = {"parameter": "param", "arg": "param", "argument": "param", "raise": "raises", "except": "raises", "exception": "raises", "return": "returns", "rtype": "returns", "yield": "yields", "ytype": "yields", "type": "param"}


def parts_of(text: str, most: int = PART, least: int = SLIVER) -> list[str]:
    """A docstring in parts of whole paragraphs, as full as they fit; a last sliver joins the part before it, a longer paragraph stays whole."""
    out: list[str] = []
    for p in re.split(r"\n[ \t]*\n", text.strip()):
        if out and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += "\n\n" + last
    return [p for p in out if p.strip()]


def fields_of(text: str) -> list[tuple[str, str, str]]:
    """(kind, name, text) of the reST fields: param, raises, returns, yields."""
    out = []
    for kind, name, rest in _FIELD.findall(text):
        k = _KINDS.get(kind, kind)
        words = name.split()
        out.append((k, words[-1] if words and k in ("param", "raises") else "", rest.strip()))
    return out


def symbols_of(text: str) -> list[dict]:
    """Module, classes and functions of a source with their docstrings and what their signatures and bodies tell; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[dict] = []

    def own(node):
        """Nodes of a body without those of inner functions and classes."""
        todo = list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop()
            yield x
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo.extend(ast.iter_child_nodes(x))

    def visit(node, qual: str, parent: str) -> None:
        fn = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        inner = list(own(node)) if fn else []
        a = node.args if fn else None
        params = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))] if fn else []
        raised = {n.exc.func.id if isinstance(n.exc, ast.Call) and isinstance(n.exc.func, ast.Name) else n.exc.id for n in inner if isinstance(n, ast.Raise) and (isinstance(n.exc, ast.Name) or isinstance(n.exc, ast.Call) and isinstance(n.exc.func, ast.Name))}
        calls = sorted({n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in inner if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))})
        doc = ast.get_docstring(node, clean=True)
        first = node.body[0] if doc is not None else None
        out.append({
            "qualname": qual, "kind": "function" if fn else "class" if qual else "module", "parent": parent, "line": getattr(node, "lineno", 1), "doc": doc, "doc_start": first.lineno if first else None, "doc_end": first.end_lineno if first else None,
            "params": [p for k, p in enumerate(params) if not (k == 0 and p in ("self", "cls"))], "returns": any(isinstance(n, ast.Return) and n.value is not None for n in inner),
            "yields": any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in inner), "raises": sorted(raised), "calls": calls,
        })
        for child in own(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child, f"{qual}.{child.name}" if qual else child.name, qual)

    visit(tree, "", "")
    # Of overloads of one name the last counts.
    return list({s["qualname"]: s for s in out}.values())


_SYMBOLS = "graphId string, path string, qualname string, kind string, parent string, line int, doc string, doc_start int, doc_end int, params array<string>, returns boolean, yields boolean, raises array<string>, calls array<string>"


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (graphId, path, content), one row each, as symbols_of tells them; files that do not parse have none."""
    text, texts = pa.string(), pa.list_(pa.string())
    kinds = {"qualname": text, "kind": text, "parent": text, "line": pa.int32(), "doc": text, "doc_start": pa.int32(), "doc_end": pa.int32(), "params": texts, "returns": pa.bool_(), "yields": pa.bool_(), "raises": texts, "calls": texts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, content in enumerate(batch.column("content")):
                got = symbols_of(content.as_py())
                at.extend([i] * len(got))
                rows.extend(got)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("graphId").take(take), batch.column("path").take(take), *[pa.array([r[k] for r in rows], t) for k, t in kinds.items()]], names=["graphId", "path", *kinds])

    return files.where("path like '%.py' and content is not null").select("graphId", "path", "content").mapInArrow(run, _SYMBOLS)


_PARTS = "array<string>"


def doc_units(symbols: DataFrame) -> DataFrame:
    """graphId, path, qualname, part, unit, text: docstrings in parts; unit is a digest of place and text, so equal text keeps its id."""
    cut = F.udf(lambda t: parts_of(t), _PARTS)
    u = symbols.where("doc is not null").select("graphId", "path", "qualname", F.posexplode(cut("doc")).alias("part", "text"))
    return u.select("graphId", "path", "qualname", "part", F.sha2(F.concat_ws("\n", "path", "qualname", "text"), 256).alias("unit"), "text")


def unit_id(path: str, qualname: str, text: str) -> str:
    return hashlib.sha256(f"{path}\n{qualname}\n{text}".encode()).hexdigest()


def doc_fields(symbols: DataFrame) -> DataFrame:
    """graphId, path, qualname, field, name, text of every field of the docstrings."""
    read = F.udf(fields_of, "array<struct<field:string,name:string,text:string>>")
    return symbols.where("doc is not null").select("graphId", "path", "qualname", F.inline(read("doc")))


def field_findings(symbols: DataFrame) -> DataFrame:
    """graphId, path, qualname, finding, name: fields that the signature or body denies, and parameters left out where others are told.

    Findings: param-unknown, param-omitted, raises-unknown, returns-unknown, yields-unknown. What is inherited or raised by
    calls cannot be seen; raises are only judged where the body raises anything by name.
    """
    f = doc_fields(symbols).join(symbols.where("kind = 'function'").select("graphId", "path", "qualname", "params", "returns", "yields", "raises"), ["graphId", "path", "qualname"])
    plain = F.regexp_replace("name", r"^\*+", "")
    wrong = (
        F.when((F.col("field") == "param") & ~F.array_contains("params", plain), "param-unknown").when((F.col("field") == "raises") & (F.size("raises") > 0) & ~F.array_contains("raises", F.col("name")), "raises-unknown")
        .when((F.col("field") == "returns") & ~F.col("returns") & ~F.col("yields"), "returns-unknown").when((F.col("field") == "yields") & ~F.col("yields"), "yields-unknown")
    )
    told = f.where("field = 'param'").groupBy("graphId", "path", "qualname").agg(F.collect_set(plain).alias("told"), F.first("params").alias("params"))
    omitted = told.select("graphId", "path", "qualname", F.lit("param-omitted").alias("finding"), F.explode(F.array_except("params", "told")).alias("name"))
    return f.select("graphId", "path", "qualname", wrong.alias("finding"), plain.alias("name")).where("finding is not null").union(omitted).distinct()


def call_coverage(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """graphId, path, n_calls, n_covered: names called in functions of a file, and those that an edge (graphId, path, name) has."""
    c = symbols.where("kind = 'function'").select("graphId", "path", F.explode("calls").alias("name")).distinct()
    have = calls.select("graphId", "path", "name").distinct().withColumn("have", F.lit(1))
    return c.join(have, ["graphId", "path", "name"], "left").groupBy("graphId", "path").agg(F.count("*").alias("n_calls"), F.count("have").alias("n_covered"))


def without_docstrings(text: str, marker: str = '"""stripped"""') -> str:
    """A Python source whose docstrings are a marker on as many lines; comments and code stay as they are. Unparsable text stays whole."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text
    kinds = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    found = [n.body[0] for n in ast.walk(tree) if isinstance(n, kinds) and ast.get_docstring(n, clean=False) is not None]
    lines = text.encode().split(b"\n")
    for x in sorted(found, key=lambda x: -x.lineno):
        lo, hi = x.lineno - 1, x.end_lineno - 1
        lines[lo : hi + 1] = [lines[lo][: x.col_offset] + marker.encode() + lines[hi][x.end_col_offset :], *[b""] * (hi - lo)]
    return b"\n".join(lines).decode()
