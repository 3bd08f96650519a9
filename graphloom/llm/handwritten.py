"""Generated, minified, vendored and data files among source files (problem 4).

Each file is lexed and printed again in canonical layout: a line ends behind each statement and brace, tokens stand one
blank apart, lines are indented by depth. The layout it has is compared with that one, line by line. Where nearly all
canonical gaps are missing and canonical lines far outnumber the written ones, the file is minified. Where the layout
agrees throughout and the lines repeat few shapes, it is generated, and bulk data if the lines hold little but
literals. Literal dominance alone marks data. Uniform layout alone does not decide: formatters make hand-written code as
uniform as generated code. Banners and tool-made names are evidence of its own kind, as are library headers,
dependency folders and bodies equal to those of known library files; which evidence decided is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

#: Share of canonical gaps that minified code leaves out, and canonical lines per written line it has at least.
TIGHT, EXPANSION, STATEMENTS = 0.8, 2.0, 4
#: Lines in canonical layout, share of lines whose shape occurs at least three times, and lines, of a template's output.
UNIFORM, REPEATED, TEMPLATE_LINES = 0.98, 0.97, 40
#: Share of literals among names and literals, and of long literals without white space among characters, of data files.
LITERAL_SHARE, LITERAL_TOKENS, BLOB_SHARE = 0.9, 60, 0.7
#: A library body has at least so many lines of code; shorter ones could be equal by chance.
BODY_LINES = 5

# Lock files, dependency folders, endings of generated names.
LOCK_FILES = {
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "cargo.lock", "poetry.lock", "pipfile.lock", "uv.lock", "pdm.lock",
    "composer.lock", "gemfile.lock", "go.sum", "mix.lock", "pubspec.lock", "packages.lock.json", "flake.lock", "podfile.lock", "deno.lock", "gradle.lockfile",
}
_DEPENDENCY_DIR = re.compile(r"(?i)(?:^|/)(?:_?vendor|third[-_]?party|3rd[-_]?party|node_modules|bower_components|jspm_packages|godeps|site-packages|_deps)/|^(?:(?!(?:src|lib|app|internal|pkg)/)[^/]+/)*extern(?:al)?/|(?:^|/)extern(?:al)?/[^/]+/[^/]+/")
_GENERATED_NAME = re.compile(r"(?i)(?:[._](?:g|gen|generated|pb|pb2|pb2_grpc|designer|autogen)\.[a-z]+|_pb2(?:_grpc)?\.[a-z]+|\.pb\.[a-z]+\.[a-z]+)$")
_MIN_NAME = re.compile(r"(?i)(?:[.-]min|\.bundle|\.[0-9a-f]{8,})\.(?:js|css|mjs)$")

_GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated\b(?!.{0,40}\b(?:once|template)\b)|\bautomatically (?:generated|created|produced)\b|\bcode generated (?:by|from|with)\b"
    r"|\b(?:this|file|code|source|module|class) (?:file |module |class |code |was |is |has been )*(?:generated|produced|emitted|created) (?:by|from|with) .{0,80}(?:do not|don't|overwrit|lost|regenerat)"
    r"|\bgenerated (?:by|from|with|using) (?!.{0,80}\b(?:by hand|once|freely)\b).{0,80}|\boutput of \S+.{0,60}(?:lost|overwrit|do not)|\bdo not (?:edit|modify|change)(?: (?:this file|it|by hand|manually|directly))*\s*(?:[.!;,*/#-]|$)"
    r"|\b(?:changes|edits|modifications?) (?:\S+ ){0,4}(?:will be|are|is|get) (?:overwritten|lost)|\bany manual (?:change|modification|edit)s?\b"
    # A tool with its version, or a name as tools have it.
    r"|\b(?:produced|emitted|built|compiled|created|written) (?:by|with) \S+ (?:v(?:ersion )?)?\d+(?:\.\d+)+|\b(?:produced|emitted|created|written) (?:by|with) \S*(?:gen|codegen|compiler)\b"
    # The same said in other languages.
    r"|\bautomatisch (?:generiert|erzeugt|erstellt)\b|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b|\bautomatiquement g[ée]n[ée]r[ée]|\bne pas (?:modifier|éditer)\b"
    r"|\bgenerado autom[áa]ticamente\b|\bno (?:editar|modificar)\b|\bgerado automaticamente\b|\bn[ãa]o (?:editar|edite|modificar)\b|\bgenerato automaticamente\b|\bnon modificare\b|自动生成|自動生成|請勿|请勿(?:编辑|修改|手动)|編集しないで"
)
_BY_HAND = re.compile(r"(?i)maintained by hand|edit(?:ed)? (?:it )?(?:freely|by hand)|hand[- ]written|generated once|scaffold")
_VENDORED = re.compile(
    r"(?i)\bvendored (?:copy|from|version|in from)\b|\bcopied (?:unmodified|verbatim|unchanged|as is|without changes)? ?from the \S+ (?:distribution|project|library|source|package|release)"
    r"|^[\s/#*!-]*\S+ (?:-|–) version \d+(?:\.\d+)+\s*$|^[\s/#*!]*\S+ v\d+(?:\.\d+)+ ?\|.*\|?|\breleased under the \S+ licen[cs]e by the\b|\bupstream bugs go there\b|\bthird[- ]party (?:copy|library|code|source) (?:of|from)\b"
    r"|^[\s/#*!]*!? ?\S+ v?\d+\.\d+\.\d+ ?\| ?(?:\(c\)|©|license|mit)"
)
# The name of a library with its version on one line, its license or origin on others.
_VERSION_LINE = re.compile(r"(?i)^[\s/#*!]*(?:[\w.-]+ ){1,5}v?\d+\.\d+(?:\.\d+)+\S*\s*$")
_ORIGIN_LINE = re.compile(r"(?i)\b(?:released|licensed|distributed|dual[- ]licensed) under\b|@license\b|\blicen[cs]e: \S+|\bhttps?://\S+/(?:license|LICENSE)\b")
_LEAD = re.compile(
    r"\A﻿?(?:\#! ?/[^\n]*\n)?(?P<lead>(?:[ \t]*(?:\r?\n|//[^\n]*(?:\n|\Z)|\#[^\n]*(?:\n|\Z)|--[^\n]*(?:\n|\Z)|;[^\n]*(?:\n|\Z)|/\*(?:[^*]|\*(?!/))*\*/|<!--.*?-->|<\?[^\n]*\n))*)", re.S
)
_LONG = re.compile(r"[\"'`]([^\s\"'`]{150,})[\"'`]|\b(?:[0-9a-fA-F]{2}[ ,]?){100,}")
_SIMPLE_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|^[ \t]*(?://|\#|--)[^\n]*$", re.M)
_LEXED_AS = {"py": "py", "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go"}
_BRACES = {"css", "scss", "less", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "scala", "swift", "php", "dart"}
_CODE = set(_LEXED_AS) | _BRACES

# Tokens as far as layout goes: comments, strings, names, numbers, operators, marks.
_TOKEN = re.compile(
    r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<n>\d[\w.]*)|(?P<w>[^\W\d]\w*|[@#$][\w]+)|(?P<o>=>|->|::|[-+*/%&|^<>=!?~]+)|(?P<m>[()\[\]{},;:.])", re.S
)
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_QUOTED = {
    "c": re.compile(rf"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|{_STRINGS}|`(?:\\.|[^`\\])*`", re.S),
    "py": re.compile(rf"\#[^\n]*|\b[rbuRBUfF]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|{_STRINGS})|{_STRINGS}", re.S),
}
_NUMBER, _NAME = re.compile(r"(?<![\w.])\d[\w.]*"), re.compile(r"(?<!\w)[^\W\d]\w*")
_WORD_OR_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\w+")
_INDENT, _LOOSE = re.compile(r"(?m)^([ \t]+)(?=\S)"), re.compile(r"(?<=\S)[ \t]{2,}(?=\S)|[ \t]+(?=\r?$)", re.M)


class Layout:
    """What lexing and printing one file again tells."""

    __slots__ = ("written", "canonical", "tight", "uniform", "repeated", "literals", "names", "blob", "expansion", "width")

    def __init__(self, ext: str, text: str):
        lines = [x for x in text.split("\n") if x.strip()]
        self.written = max(1, len(lines))
        self.width = len(text) / self.written
        lang = _LEXED_AS.get(ext)
        self.names, self.literals = 1, 0
        if lang:
            # Comments and strings are lexed first, so that numbers and names are only those of the code between them.
            quoted = _QUOTED["py" if lang == "py" else "c"]
            strings = sum(1 for x in quoted.findall(text) if x[-1] in "\"'`")
            code = quoted.sub(" ", text)
            self.literals = strings + len(_NUMBER.findall(code))
            self.names = len(_NAME.findall(code))
        # Each canonical line but the first has a mark before it: a text of few marks needs no printing to be told from minified code.
        self.canonical, self.tight = 1 + text.count(";") + text.count("{") + text.count("}"), None
        if ext == "py" or ext not in _CODE:
            self.canonical = self.written + (code.count(";") if lang else 0)
        elif self.canonical >= EXPANSION * self.written:
            self.canonical, self.tight = self._printed(ext, text)
        self.expansion = self.canonical / self.written
        self.uniform, self.repeated = self._lines(text, self.written)
        self.blob = sum(len(m[0]) for m in _LONG.finditer(text)) / max(1, len(text))

    @staticmethod
    def _printed(ext: str, text: str) -> tuple[int, float]:
        """Lines of the canonical print, and the share of its gaps that the text leaves out.

        The print breaks the line behind ``;`` ``{`` ``}``, but for the heads of loops, and sets blanks around operators
        and behind commas and colons.
        """
        lines, gaps, missing, depth = 1, 0, 0, 0
        for m in _TOKEN.finditer(text):
            k = m.lastgroup
            if k == "m":
                c = m[0]
                depth += (c == "(") - (c == ")")
                ends = c in ";{}" and depth <= 0
                if ends or c == ",":
                    lines += ends
                    gaps += 1
                    missing += text[m.end() : m.end() + 1] not in " \t\r\n);,]}" or (ends and text[m.end() : m.end() + 1] == "}")
            elif k == "o" and ext not in ("css", "scss", "less") and m[0] in ("=", "==", "===", "=>", "+", "&&", "||", "+=", "?", "!=", "!==", "<=", ">="):
                gaps += 1
                missing += not text[m.start() - 1 : m.start()].isspace() and not text[m.end() : m.end() + 1].isspace()
        return lines, missing / gaps if gaps else 0.0

    @staticmethod
    def _lines(text: str, written: int) -> tuple[float, float]:
        """Share of lines that stand as a printer would set them, and share of lines whose shape occurs three times or more.

        Lines are indented by multiples of one unit, end without blanks and have no wider gaps inside.
        """
        steps = Counter(len(d.replace("\t", "    ")) for d in _INDENT.findall(text))
        unit = min(steps) if steps else 4
        odd = sum(n for d, n in steps.items() if d % unit) + len(_LOOSE.findall(text))
        shapes = Counter(s for x in _WORD_OR_LITERAL.sub("w", text).split("\n") if (s := x.strip()))
        return max(0.0, 1 - odd / written), sum(n for n in shapes.values() if n >= 3) / written


def evidence(path: str, text: str) -> tuple[str | None, str | None, Layout]:
    """generated, lock, minified, vendored, data or None for one file, what tells so (name, folder, banner, header, layout), and its layout."""
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    layout = Layout(ext, text)
    lead = _LEAD.match(text)["lead"]
    if name.lower() in LOCK_FILES:
        return "lock", "name", layout
    if _DEPENDENCY_DIR.search(path):
        return "vendored", "folder", layout
    head = lead.split("\n")
    if any(_VENDORED.search(x) for x in head) or (any(_VERSION_LINE.search(x) for x in head) and any(_ORIGIN_LINE.search(x) for x in head)):
        return "vendored", "header", layout
    if _GENERATED_NAME.search(name):
        return "generated", "name", layout
    if any(_GENERATED.search(x) for x in head) and not _BY_HAND.search(lead):
        return "generated", "banner", layout
    code = ext in _CODE
    if code and layout.tight is not None and layout.tight >= TIGHT and layout.expansion >= EXPANSION and layout.canonical >= STATEMENTS:
        return "minified", "layout", layout
    if code and _MIN_NAME.search(name) and layout.expansion >= EXPANSION:
        return "minified", "name", layout
    if ext in _LEXED_AS and (layout.blob >= BLOB_SHARE or (layout.literals >= LITERAL_TOKENS and layout.literals >= LITERAL_SHARE * (layout.literals + layout.names))):
        return "data", "layout", layout
    if layout.written >= TEMPLATE_LINES and layout.uniform >= UNIFORM and layout.repeated >= REPEATED:
        if ext == "sql" and re.search(r"(?im)^\s*(?:insert\s|\()", text):
            return "data", "layout", layout
        if code:
            return "generated", "layout", layout
    return None, None, layout


def classify(path: str, text: str) -> tuple[str | None, Layout]:
    """The kind of one file, and its layout."""
    kind, _, layout = evidence(path, text)
    return kind, layout


def body_digest(text: str) -> bytes | None:
    """Digest of the code lines without comments, indentation and blank lines; None for short bodies."""
    lines = [s for x in _SIMPLE_COMMENT.sub("", text).split("\n") if (s := x.strip())]
    return hashlib.blake2b("\n".join(lines).encode(), digest_size=16).digest() if len(lines) >= BODY_LINES else None


_OUT = "graphId string, path string, kind string, told_by string, expansion double, tight double, uniform double, repeated double, literals int, names int, body binary"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[] for _ in range(9)]
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            text = content.as_py()
            kind, by, x = evidence(path, text)
            for col, v in zip(cols, (kind, by, x.expansion, x.tight, x.uniform, x.repeated, x.literals, x.names, body_digest(text)), strict=True):
                col.append(v)
        types = (pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(cols, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("graphId"), batch.column("path"), *arrays], names=["graphId", "path", "kind", "told_by", "expansion", "tight", "uniform", "repeated", "literals", "names", "body"])


def classify_files(files: DataFrame) -> DataFrame:
    """One row per file (delivered twice: once) with its kind, null for hand-written, what tells it, and the layout figures.

    files: graphId, path, content; rows with null path or content are left out, an empty file is hand-written.
    A file whose body equals that of a file known as vendored is vendored too (told by ``body``). A body that many files
    share is one row on the known side, so the join repeats nothing.
    """
    seen = files.select("graphId", "path", "content").where("path is not null and content is not null").mapInArrow(_classify, _OUT)
    # One pass over the texts; everything later reads these few narrow columns.
    seen = cut_lineage(seen)
    # One row per file; of two deliveries, equal in content, any will do.
    rest = ["kind", "told_by", "expansion", "tight", "uniform", "repeated", "literals", "names", "body"]
    once = seen.groupBy("graphId", "path").agg(F.max(F.struct(*rest)).alias("v")).select("graphId", "path", "v.*")
    known = seen.where((F.col("kind") == "vendored") & F.col("body").isNotNull()).select("body").distinct().withColumn("library", F.lit(True))
    figures = [F.round(c, 6).alias(c) for c in ("expansion", "tight", "uniform", "repeated")]
    copied = F.col("kind").isNull() & F.col("library")
    return once.join(known, "body", "left").select(
        "graphId", "path", F.when(copied, "vendored").otherwise(F.col("kind")).alias("kind"), F.when(copied, "body").otherwise(F.col("told_by")).alias("told_by"), *figures, "literals", "names"
    )
