"""Entities of file contents: one table-valued function over all languages.

Most formats are read by a rule table: a pattern that finds the head of an entity, and how far the entity reaches.
Python is read by its own parser, nested symbols and calls included. Other languages with braces are read by
patterns; what a full parser would add (types of calls, overloads) is not claimed.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

ENTITIES = "graphId string, path string, kind string, name string, parent string, first_line int, last_line int, fields array<string>, exported boolean"


@dataclass
class Entity:
    kind: str
    name: str
    first: int
    last: int
    parent: str | None = None
    fields: list[str] = field(default_factory=list)
    exported: bool = False


@dataclass(frozen=True)
class Rule:
    kind: str
    head: re.Pattern
    reach: str = "line"  # line, braces, semicolon, next (to the next entity of the rule)
    inner: re.Pattern | None = None
    name: str = r"\g<name>"


def _r(kind: str, head: str, reach: str = "line", inner: str | None = None, name: str = r"\g<name>", flags: int = re.M) -> Rule:
    return Rule(kind, re.compile(head, flags), reach, re.compile(inner, flags) if inner else None, name)


_WORD = r"(?P<name>\w+)"
_PROTO_FIELD = r"^\s*(?:repeated\s+|optional\s+|required\s+)?(?:map<[^>]+>|[\w.]+)\s+(\w+)\s*=\s*\d"
# Heads of entities by language.
RULES: dict[str, list[Rule]] = {
    "sql": [
        _r("table", rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?{_WORD}[`\"]?", "semicolon", r"^\s*[`\"]?(?!(?:PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|INDEX|KEY)\b)(\w+)[`\"]?\s+\w", flags=re.I | re.M),
        _r("view", rf"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+[`\"]?{_WORD}[`\"]?", flags=re.I | re.M), _r("index", rf"CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?{_WORD}[`\"]?", flags=re.I | re.M),
    ],
    "config": [_r("variable", r"^[ \t]*(?P<name>[A-Za-z_][A-Za-z0-9_]*)=")],
    "yaml": [_r("section", r"^(?P<name>[A-Za-z_][\w.-]*)\s*:(?=\s|$)", "next")],
    "toml": [_r("section", r"^[ \t]*\[\[(?P<name>[^\[\]\n]+)\]\]", "next", name=r"[[\g<name>]]"), _r("section", r"^[ \t]*\[(?P<name>[^\[\]\n]+)\]", "next")],
    "makefile": [_r("target", r"^(?P<name>[a-zA-Z_][a-zA-Z0-9_.-]*)(?:[ \t]+[^\n:=?]*)?:(?![:=])(?![^\n]*[:?]=)")],
    "dockerfile": [_r("step", r"^(?i:(?P<name>FROM|RUN|COPY|ADD|WORKDIR|CMD|ENTRYPOINT|ENV|ARG|EXPOSE|VOLUME|USER|HEALTHCHECK))\s[^\n]*"), _r("stage", r"^(?i:FROM)\s+(?:\S+\s+(?i:AS)\s+)?(?P<name>[^\s:]+)", "next")],
    "graphql": [_r("query", r"^type\s+(?P<name>Query|Mutation|Subscription)\s*\{", "braces", r"^\s*(\w+)"), _r("type", r"^(?:type|input|enum|interface|union|scalar)\s+(?!(?:Query|Mutation|Subscription)\b)(?P<name>\w+)", "braces", r"^\s*(\w+)")],
    "protobuf": [_r("message", rf"^message\s+{_WORD}\s*\{{", "braces", _PROTO_FIELD), _r("enum", rf"^enum\s+{_WORD}\s*\{{", "braces", r"^\s*(\w+)\s*="), _r("service", rf"^service\s+{_WORD}\s*\{{", "braces", r"\brpc\s+(\w+)\s*\(")],
    "terraform": [_r("resource", r'^(?P<t>resource|data)\s+"(?P<k>[^"]+)"\s+"(?P<name>[^"]+)"\s*\{', "braces", name=r"\g<k>.\g<name>"), _r("block", r'^(?P<t>module|variable|output)\s+"(?P<name>[^"]+)"\s*\{', "braces", name=r"\g<t>.\g<name>")],
    "shell": [_r("function", rf"^(?:function\s+{_WORD}\s*(?:\(\s*\))?|(?P<n2>\w+)\s*\(\s*\))\s*(?=\n?\s*\{{)", "braces")],
    "markdown": [_r("section", r"^(?P<h>#{1,6})[ \t]+(?P<name>\S[^\n]*?)[ \t]*#*$", "next")],
    "go": [_r("function", rf"^func\s+(?:\([^)]*\)\s*)?{_WORD}\s*(?:\[[^\]]*\])?\(", "braces"), _r("class", rf"^type\s+{_WORD}\s+(?:struct|interface)\s*\{{", "braces", r"^\s+(\w+)\s+[\w*\[\].]+"), _r("import", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<name>[\w./-]+)"\s*$')],
    "java": [_r("class", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+{_WORD}", "braces"), _r("function", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\],.? ]+?\s+{_WORD}\s*\([^;{{]*\)[^;{{]*\{{", "braces"), _r("import", r"^import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;")],
    "typescript": [_r("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+{_WORD}", "braces"), _r("function", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_WORD}\s*[<(]", "braces"),
                   _r("method", r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\([^;\n]*\)\s*(?::[^{;\n]+)?\{", "braces"),
                   _r("import", r"^import\b[^;'\"]*?(?:from\s+)?['\"](?P<name>[^'\"]+)['\"]"), _r("import", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)")],
    "rust": [_r("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+{_WORD}", "braces"), _r("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+{_WORD}", "braces"), _r("import", r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[\w:{}*, ]+);")],
    "kotlin": [_r("function", r"^[ \t]*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(", "braces"), _r("class", rf"^[ \t]*(?:\w+\s+)*(?:class|interface|object)\s+{_WORD}", "braces"), _r("import", r"^import\s+(?P<name>[\w.*]+)")],
    "scala": [_r("function", rf"^[ \t]*(?:\w+\s+)*def\s+{_WORD}", "braces"), _r("class", rf"^[ \t]*(?:\w+\s+)*(?:class|trait|object)\s+{_WORD}", "braces"), _r("import", r"^[ \t]*import\s+(?P<name>[\w.{}_, *=>]+)")],
    "csharp": [_r("class", rf"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|enum|record)\s+{_WORD}", "braces"), _r("function", rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)+[\w<>\[\],.? ]+?\s+{_WORD}\s*\([^;{{]*\)\s*\{{", "braces"), _r("import", r"^[ \t]*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;")],
    "ruby": [_r("class", r"^[ \t]*(?:class|module)\s+(?P<name>[\w:]+)"), _r("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"), _r("import", r"^[ \t]*require(?:_relative)?\s+['\"](?P<name>[^'\"]+)['\"]")],
    "php": [_r("class", rf"^[ \t]*(?:(?:abstract|final)\s+)*(?:class|interface|trait|enum)\s+{_WORD}", "braces"), _r("function", rf"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?{_WORD}\s*\(", "braces"), _r("import", r"^[ \t]*use\s+(?P<name>[\w\\]+)")],
    "swift": [_r("function", rf"^[ \t]*(?:\w+\s+)*func\s+{_WORD}", "braces"), _r("class", rf"^[ \t]*(?:\w+\s+)*(?:class|struct|enum|protocol|extension)\s+{_WORD}", "braces"), _r("import", r"^import\s+(?P<name>\w+)")],
    "dart": [_r("class", rf"^[ \t]*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+{_WORD}", "braces"), _r("function", rf"^[ \t]*(?:[\w<>?\[\], ]+\s+)?{_WORD}\s*\([^;{{]*\)\s*(?:async\s*)?\{{", "braces"), _r("import", r"^import\s+['\"](?P<name>[^'\"]+)['\"]")],
    "c": [_r("function", rf"^(?![ \t]|#|typedef|return|else)[\w*\s]+?\b{_WORD}\s*\([^;{{]*\)\s*\{{", "braces"), _r("class", rf"^(?:typedef\s+)?(?:struct|enum|union|class)\s+{_WORD}\s*[^;{{]*\{{", "braces"), _r("import", r"^[ \t]*#\s*include\s*[<\"](?P<name>[^>\"]+)[>\"]")],
}
RULES["javascript"] = RULES["typescript"]
RULES["cpp"] = RULES["c"]
RULES["jenkinsfile"] = RULES["shell"]


def entities(lang: str, text: str) -> list[Entity]:
    """Entities of one text; unknown languages have none."""
    text = text.replace("\r\n", "\n")
    if lang == "python":
        return python_entities(text)
    if lang in ("json", "jsonc"):
        return json_entities(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    total = len(starts) - text.endswith("\n")
    fence = _fenced(text) if lang == "markdown" else ()
    out: list[Entity] = []
    for rule in RULES.get(lang, ()):
        found = []
        for m in rule.head.finditer(text):
            if any(a <= m.start() < b for a, b in fence):
                continue
            name = m.groupdict().get("name") or m.groupdict().get("n2") or ""
            name = name if rule.name == r"\g<name>" else m.expand(rule.name)
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            stop, body = _reach(text, m, rule.reach)
            fields = [x if isinstance(x, str) else x[0] for x in rule.inner.findall(body)] if rule.inner and body else []
            exported = m[0].lstrip().startswith("export") or bool(re.match(r"\s*(?:pub|public)\b", m[0])) or (lang == "go" and name[:1].isupper())
            found.append(Entity(rule.kind, name.strip(), _line(starts, at), _line(starts, max(at, stop - 1)), None, fields, exported))
        if rule.reach == "next":
            for a, b in zip(found, [*found[1:], None], strict=True):
                a.last = b.first - 1 if b else total
        out += found
    out.sort(key=lambda e: (e.first, -e.last, e.kind, e.name))
    for i, e in enumerate(out):  # the innermost class around a function is its parent
        holders = [c for c in out[:i] if c.kind == "class" and c.first <= e.first and e.last <= c.last and c is not e]
        if e.kind in ("function", "method") and holders:
            e.parent = holders[-1].name
    return out


def _fenced(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", text, re.M | re.S)]


def _line(starts: list[int], at: int) -> int:
    lo, hi = 0, len(starts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
    return lo + 1


_SKIP = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[{}]", re.S)


def _reach(text: str, m: re.Match, how: str) -> tuple[int, str]:
    """End of an entity and its body; braces in texts and comments do not count."""
    if how == "semicolon":
        end = text.find(");", m.end())
        return (end + 2, text[text.find("(", m.end()) + 1 : end].replace(",", ",\n")) if end >= 0 else (m.end(), "")
    if how != "braces":
        return m.end(), ""
    depth, opened = 0, -1
    at = m.end() - 1 if m[0].rstrip().endswith("{") else m.end()
    at = m.start() + m[0].rstrip().rfind("{") if m[0].rstrip().endswith("{") else at
    for t in _SKIP.finditer(text, at):
        if t[0] == "{":
            opened = t.end() if not depth else opened
            depth += 1
        elif t[0] == "}":
            depth -= 1
            if depth <= 0:
                return t.end(), text[max(opened, 0) : t.start()] if opened >= 0 else ""
    return len(text), text[opened:] if opened >= 0 else ""


def json_entities(text: str) -> list[Entity]:
    """Top-level keys and $ref targets; comments and trailing commas are allowed."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    try:
        data = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    except ValueError:
        return []
    out = []
    if isinstance(data, dict):
        at = 0
        for k in data:
            at = max(at, plain.find(json.dumps(k), at), plain.find(json.dumps(k, ensure_ascii=False), at))
            out.append(Entity("key", k, plain.count("\n", 0, at) + 1, plain.count("\n", 0, at) + 1))
    out += [Entity("ref", r, 1, 1) for r in sorted(set(re.findall(r'"\$ref"\s*:\s*"([^"]+)"', plain)))]
    return out


def python_entities(text: str) -> list[Entity]:
    """Functions, methods, classes (nested ones with their parents), imports and calls."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[Entity] = []

    def walk(node: ast.AST, scope: list[str], in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            inner, cls = scope, in_class
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if in_class else "function"
                args = [] if kind == "class" else [a.arg for a in (*c.args.posonlyargs, *c.args.args, *c.args.kwonlyargs)]
                out.append(Entity(kind, ".".join([*scope, c.name]), c.lineno, c.end_lineno or c.lineno, ".".join(scope) or None, args, not c.name.startswith("_")))
                inner, cls = [*scope, c.name], kind == "class"
            elif isinstance(c, ast.Import):
                out.extend(Entity("import", a.name, c.lineno, c.lineno) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                out.append(Entity("import", "." * c.level + (c.module or ""), c.lineno, c.lineno, None, [a.name for a in c.names]))
            elif isinstance(c, ast.Call):
                name = ast.unparse(c.func) if isinstance(c.func, (ast.Name, ast.Attribute)) else ""
                if name and len(name) < 200:
                    out.append(Entity("call", name, c.lineno, c.lineno, ".".join(scope) or None))
            walk(c, inner, cls)

    walk(tree, [], False)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ents = [], []
        for i, (lang, content) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("content"), strict=True)):
            found = entities(lang, content.as_py())
            rows += [i] * len(found)
            ents += found
        if not ents:
            continue
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("graphId").take(at), batch.column("path").take(at), pa.array([e.kind for e in ents]), pa.array([e.name for e in ents]), pa.array([e.parent for e in ents], pa.string()),
             pa.array([e.first for e in ents], pa.int32()), pa.array([e.last for e in ents], pa.int32()), pa.array([e.fields for e in ents], pa.list_(pa.string())), pa.array([e.exported for e in ents], pa.bool_())],
            names=["graphId", "path", "kind", "name", "parent", "first_line", "last_line", "fields", "exported"],
        )


def extract_entities(files: DataFrame) -> DataFrame:
    """Entities of each file (graphId, path, lang, content). Null content has none; no shuffle."""
    return files.select("graphId", "path", "lang", "content").where("content is not null").mapInArrow(_extract, ENTITIES)
