"""Markup residue in article text (problem 2).

A text is read as a tree: code and formulas are set aside first (their content is never markup), HTML tags build
elements with implied end tags and visibility, and lines of Markdown, wiki text and LaTeX become blocks. The
renderer emits all visible text: headings and paragraphs with blank lines around them, list items with a bullet or
number at their depth, code indented, formulas as they are, table cells padded to aligned columns. The families
are those of the nodes that the builder made.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "latex", "markdown", "wiki")

# HTML elements by what they do to the layout.
_BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header html main nav p section summary".split())
_INLINE = set("a abbr acronym b bdi bdo big cite data del dfn em font i img ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup svg time tt u var wbr input button area map picture source video audio track canvas iframe link meta base".split())
_STRUCT = set("h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot tr td th caption colgroup col br hr select option optgroup".split())
_HIDDEN = set("script style template head title noscript textarea object embed math".split())
_ELEMENTS = _BLOCK | _INLINE | _STRUCT | _HIDDEN
_VOID = set("br hr img input wbr area base col embed link meta source track".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead"}, "thead": {"tr"}}

_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*|[A-Z][A-Z0-9]*)((?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>|<\?xml[^>]*\?>", re.S | re.I)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_HINT = re.compile(r"[<>&#*_`~|=\[\]{}'\\$!^+-]|^[ \t]*(?:\d+[.)]|[:;])\s", re.M)

_FENCE = re.compile(r"^(?P<in>[ ]{0,3}(?:>[ ]?)*)(?P<f>`{3,}|~{3,})[ \t]*(?P<lang>[^\n`]*)\n(?P<body>.*?)(?:^[ ]{0,3}(?:>[ ]?)*(?P=f)[`~]*[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<(pre|PRE|xmp|listing|syntaxhighlight|source)\b([^<>]*)>(.*?)(?:</\1\s*>|\Z)", re.S)
_CODE = re.compile(r"<(code|CODE|kbd|samp|tt)\b([^<>]*)>(.*?)</\1\s*>", re.S)
_NOWIKI = re.compile(r"<nowiki>(.*?)</nowiki>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\sA-Za-z*{])(.*?)\1")
_SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.S)
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)\*?)\}(.*?)\\end\{\3\}", re.S)
_MATHML = re.compile(r"<math\b[^<>]*>(.*?)</math>", re.S | re.I)
_FORMULA = re.compile(r"(?<![\\$\w])\$(?=[^\s$])((?:\\.|[^\\$\n])*?[^\s\\$])\$(?![\d$A-Za-z])|\\\((.+?)\\\)")

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_WIKI_H = re.compile(r"^(={1,6})[ \t]*([^=\n].*?[^=\n]|[^=\s])[ \t]*\1[ \t]*$")
_TEX_H = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]]*\])?\{")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^([ \t]*)([-+*]|\d{1,9}[.)])[ \t]+(?:\[([ xX])\][ \t]+)?(.*)$")
_WIKI_ITEM = re.compile(r"^(\*{2,}|#{1,}|[*#:;]{2,}|:+|;)[ \t]+([^\s*#:;|].*)$")
_QUOTE = re.compile(r"^ {0,3}((?:>[ ]?)+)(.*)$")
_MD_DELIM = re.compile(r"^[ \t]*\|?[ \t]*:?-{1,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)*\|?[ \t]*$")
_REFDEF = re.compile(r"^ {0,3}\[([^\]\n^]+)\]:[ \t]+(<?\S+>?)(?:[ \t]+[\"'(].*[\"')])?[ \t]*$")
_NOTEDEF = re.compile(r"^ {0,3}\[\^([^\]\n]+)\]:[ \t]+(.*)$")
_TEX_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?")
_TEX_ITEM = re.compile(r"\\item\b(?:\[([^\]\n]*)\])?[ \t]*")

_INLINE_MD = [
    (re.compile(r"!\[([^\]\n]*)\]\(([^()\n]*(?:\([^()\n]*\)[^()\n]*)*)\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n]+(?:\n[^\[\]\n]+)?)\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\n]*\)[^()\s]*)*)(?:\s+[\"'][^\n]*?[\"'])?\)"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]\n^]+)\]\[[^\[\]\n]*\](?!\])"), r"\1"),
    (re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*\*\*(?=\S)(.+?)(?<=[^\s*])\*\*\*(?![\w*])", re.S), r"\1"),
    (re.compile(r"(?<![*\\])\*\*(?=[^\s*])((?:(?!\n\s*\n).)+?)(?<=[^\s*\\])\*\*(?!\*)", re.S), r"\1"),
    (re.compile(r"(?<![\w_\\])__(?=[^\s_])((?:(?!\n\s*\n).)+?)(?<=[^\s_\\])__(?![\w_])", re.S), r"\1"),
    (re.compile(r"(?<![\w*\\])\*(?=[^\s*])((?:(?!\n\s*\n)[^*])+?)(?<=[^\s*\\])\*(?![\w*])", re.S), r"\1"),
    (re.compile(r"(?<![\w_\\/.-])_(?=[^\s_])((?:(?!\n\s*\n)[^_])+?)(?<=[^\s_\\])_(?![\w_])", re.S), r"\1"),
    (re.compile(r"(?<![~\\])~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)"), r"\1"),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
    (re.compile(r"==(?=\S)([^=\n]+?)(?<=\S)=="), r"\1"),
]
_INLINE_WIKI = [
    (re.compile(r"\[\[(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo)\s*:[^\[\]]*?(?:\|([^\[\]|]*))?\]\]", re.I), r"\1"),
    (re.compile(r"\[\[([^\[\]|\n]+)\|([^\[\]|\n]*)\]\]"), r"\2"),
    (re.compile(r"\[\[([^\[\]|\n]+)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]"), r"\1"),
    (re.compile(r"\[((?:https?|ftp)://[^\s\]]+)\](?!\()"), r"\1"),
    (re.compile(r"(?<!')'''''(?=[^'\s])(.+?)'''''(?!')"), r"\1"),
    (re.compile(r"(?<!')'''(?=[^'\s])(.+?)(?<=[^\s'])'''(?!')"), r"\1"),
    (re.compile(r"(?<!')''(?=[^'\s])(.+?)(?<=[^\s'])''(?!')"), r"\1"),
    (re.compile(r"^__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|STATICREDIRECT)__[ \t]*$", re.M), ""),
    (re.compile(r"^#(?:REDIRECT|WEITERLEITUNG)\b[ \t]*", re.I | re.M), ""),
    (re.compile(r"(?<!~)~{3,5}(?!~)"), ""),
]
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?references\b[^<>]*/?>|</?(?:gallery|includeonly|noinclude|onlyinclude|poem)\b[^<>]*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_TEX_DROP = re.compile(r"[ ]?\\(?:label|index|vspace\*?|hspace\*?|usepackage|documentclass|bibliographystyle|bibliography|input|include|newcommand|setlength|pagestyle|includegraphics)(?:\[[^\]\n]*\])*(?:\{[^{}\n]*\})+")
_TEX_REF = re.compile(r"\\(?:ref|pageref|eqref|autoref|cref|Cref|cite|citep|citet|citeauthor|nocite|footcite|parencite|textcite)\*?(?:\[[^\]\n]*\])*\{([^{}\n]*)\}")
_TEX_LINK = re.compile(r"\\href\{([^{}\n]*)\}\{([^{}\n]*)\}")
_TEX_ARG = re.compile(r"\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")
_TEX_WORD = re.compile(
    r"\\(?:LaTeX|TeX|ldots|dots|cdots|textbackslash|maketitle|tableofcontents|newpage|clearpage|noindent|centering|hline|toprule|midrule|bottomrule|small|large|Large|footnotesize|bfseries|itshape|ttfamily|appendix|par|quad|qquad|today|item|alpha|beta|gamma|delta|lambda|mu|sigma|times|leq|geq|rightarrow|infty|sum|frac)\b(?![\\/])\*?(?:\{\})?"
)
_TEX_ESC = re.compile(r"(?<![\w\\])\\([%&_#{}])|(?<=[\w.)])\\([%&_#])(?=[\s\w])")
_TEX_QUOTE = re.compile(r"``([^`'\n]+)''")
_PATH = re.compile(r"[A-Za-z]:\\")


@dataclass
class Block:
    kind: str  # heading, paragraph, item, quote, code, formula, table, rule
    text: str = ""
    level: int = 0
    marker: str = ""
    rows: list = field(default_factory=list)


class Builder:
    """Builds the blocks of one text and collects the families of what it meets."""

    def __init__(self, text: str):
        self.families: set[str] = set()
        self.kept: list[tuple[str, str]] = []
        self.blocks: list[Block] = []
        if text and _HINT.search(text):
            self._build(text.replace("\r\n", "\n").replace("\r", "\n"))
        elif text and text.strip():
            self.blocks = [Block("paragraph", p.strip()) for p in re.split(r"\n[ \t]*\n", text) if p.strip()]

    # -- code and formulas
    def _keep(self, kind: str, body: str, block: bool) -> str:
        self.kept.append((kind, body))
        mark = f"\ue000{len(self.kept) - 1}\ue001"
        return f"\n\n{mark}\n\n" if block else mark

    def _build(self, t: str) -> None:
        fam = self.families

        def hold(family: str, kind: str, block: bool, pick):
            def f(m: re.Match) -> str:
                fam.add(family)
                return self._keep(kind, pick(m), block)

            return f

        t = _FENCE.sub(hold("markdown", "code", True, lambda m: re.sub(r"(?m)^ {0,3}(?:> ?)+", "", m["body"]).rstrip("\n") if ">" in m["in"] else m["body"].rstrip("\n")), t)
        t = _VERBATIM.sub(hold("latex", "code", True, lambda m: m[2].strip("\n")), t)
        t = _NOWIKI.sub(hold("wiki", "span", False, lambda m: m[1]), t)

        def pre(m: re.Match) -> str:
            fam.add("wiki" if m[1].lower() in ("syntaxhighlight", "source") else "html")
            inner = re.sub(r"\A\s*<code\b[^<>]*>|</code\s*>\s*\Z", "", m[3])
            return self._keep("code", html.unescape(_TAG.sub("", inner)).strip("\n"), True)

        t = _PRE.sub(pre, t)
        t = _CODE.sub(hold("html", "span", False, lambda m: html.unescape(_TAG.sub("", m[3]))), t)
        t = _TEX_QUOTE.sub(lambda m: (fam.add("latex"), "“" + m[1] + "”")[1], t)
        t = _SPAN.sub(hold("markdown", "span", False, lambda m: m[2].strip()), t)
        t = _VERB.sub(hold("latex", "span", False, lambda m: m[2]), t)
        t = _DISPLAY.sub(hold("latex", "formula", True, lambda m: (m[1] or m[2] or m[4] or "").strip()), t)
        t = _MATHML.sub(hold("wiki", "math", False, lambda m: m[1].strip()), t)
        t = _FORMULA.sub(self._formula, t)
        t = _REF.sub(lambda m: (fam.add("wiki"), "")[1], t)
        if _COMMENT.search(t):
            fam.add("html")
            t = _COMMENT.sub("", t)
        if "<" in t:
            t = self._elements(t)
        if "\\" in t:
            t = self._tex_structure(t)
        t = self._templates(t)
        self._lines(t)

    def _formula(self, m: re.Match) -> str:
        body = m[1] if m[1] is not None else m[2]
        if m[1] is not None and not re.search(r"[\\^_=+*/<>()]|^[A-Za-z]$|^\d+(?:\.\d+)?[A-Za-z]?$|^[A-Za-z]['\d]$", body):
            return m[0]
        self.families.add("latex")
        return self._keep("math", body.strip(), False)

    # -- HTML
    def _elements(self, t: str) -> str:
        """Walks the tags as a tree and leaves layout marks where elements begin and end."""
        out: list[str] = []
        stack: list[tuple[str, bool]] = []
        at, hidden = 0, 0
        for m in _TAG.finditer(t):
            name = m[2].lower()
            if name not in _ELEMENTS:
                continue
            self.families.add("html")
            if not hidden:
                out.append(t[at : m.start()])
            at = m.end()
            if m[1]:
                if name in _VOID or all(n != name for n, _ in stack):
                    continue
                while stack:
                    n, h = stack.pop()
                    hidden -= h
                    if not hidden:
                        out.append(self._end(n))
                    if n == name:
                        break
                continue
            while stack and stack[-1][0] in _CLOSES.get(name, ()):
                n, h = stack.pop()
                hidden -= h
                if not hidden:
                    out.append(self._end(n))
            if (name in _BLOCK or name in ("ul", "ol", "table") or name[0] == "h" and name[1:].isdigit()) and stack and stack[-1][0] == "p":
                stack.pop()
            h = name in _HIDDEN or re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", m[3]) is not None
            if not hidden and not h:
                out.append(self._start(name, m[3], stack))
            if name not in _VOID and not m[4]:
                stack.append((name, h))
                hidden += h
        if not hidden:
            out.append(t[at:])
        return "".join(out)

    @staticmethod
    def _start(name: str, attrs: str, stack: list) -> str:
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return f"\n\n\ue002h{name[1]} "
        if name == "li":
            lists = [n for n, _ in stack if n in ("ul", "ol")]
            return f"\n\ue002{'o' if lists and lists[-1] == 'ol' else 'u'}{min(9, max(1, len(lists)))} "
        if name == "tr":
            return "\n\ue002r0 "
        if name in ("td", "th"):
            return ""
        if name == "br":
            return "\n"
        if name == "hr":
            return "\n\n\ue002-0 \n\n"
        if name == "img":
            alt = re.search(r"(?i)\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", attrs)
            return next((x for x in alt.groups() if x), "") if alt else ""
        if name in ("dt", "dd", "option"):
            return "\n"
        return "\n\n" if name in _BLOCK or name in ("table", "ul", "ol", "caption", "select") else ""

    @staticmethod
    def _end(name: str) -> str:
        if name in ("td", "th"):
            return "\ue003"
        if name in ("li", "tr", "dt", "dd"):
            return "\n"
        return "\n\n" if name in _BLOCK or name in ("table", "ul", "ol", "caption", "select") or name[0] == "h" and name[1:].isdigit() else ""

    # -- LaTeX
    def _tex_structure(self, t: str) -> str:
        def heading(m: re.Match) -> str:
            level = {"title": 1, "part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(m[1], 5)
            body, end = _braced(t2, m.end() - 1)
            ends.append(end)
            self.families.add("latex")
            return f"\n\n\ue002h{level} {body}\n\n"

        while m := _TEX_H.search(t):
            t2, ends = t, []
            text = heading(m)
            t = t[: m.start()] + text + t[ends[0] :]
        envs: list[str] = []
        out, at = [], 0
        for m in re.finditer(f"{_TEX_ENV.pattern}|{_TEX_ITEM.pattern}", t):
            out.append(t[at : m.start()])
            at = m.end()
            self.families.add("latex")
            if m[1] == "begin":
                envs.append(m[2])
                out.append("\n\ue004\n" if m[2].startswith("tabular") else "\n")
            elif m[1] == "end":
                if m[2] in envs:
                    while envs and envs.pop() != m[2]:
                        pass
                out.append("\n\ue005\n" if m[2].startswith("tabular") else "\n")
            else:
                depth = sum(e.rstrip("*") in ("itemize", "enumerate", "description") for e in envs)
                ordered = next((e == "enumerate" for e in reversed(envs) if e in ("itemize", "enumerate", "description")), False)
                out.append(f"\n\ue002{'o' if ordered else 'u'}{min(9, max(1, depth))} {(m[3] + ' ') if m[3] else ''}")
        out.append(t[at:])
        t = "".join(out)

        def rows(m: re.Match) -> str:
            body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m[1])
            return "\n" + "\n".join("\ue002r0 " + "\ue003".join(c.strip() for c in re.split(r"(?<!\\)&", r)) + "\ue003" for r in re.split(r"\\\\", body) if r.strip()) + "\n"

        return re.sub("\ue004(.*?)(?:\ue005|\\Z)", rows, t, flags=re.S)

    # -- wiki
    def _templates(self, t: str) -> str:
        while "{{" in t:
            new = _TEMPLATE.sub(self._template, t)
            if new == t:
                break
            t = new
        if "{|" in t:
            t = re.sub(r"^[ \t]*\{\|(.*?)(?:^[ \t]*\|\}|\Z)", self._wiki_table, t, flags=re.S | re.M)
        return t

    def _template(self, m: re.Match) -> str:
        if not re.match(r"\s*[#A-Za-z0-9_!]", m[1]):
            return m[0].replace("{{", "\ue006").replace("}}", "\ue007")
        self.families.add("wiki")
        args = [a.split("=", 1)[-1].strip() for a in m[1].split("|")[1:]]
        return " ".join(a for a in args if a)

    def _wiki_table(self, m: re.Match) -> str:
        self.families.add("wiki")
        out = []
        for chunk in re.split(r"^[ \t]*\|-.*$", m[1], flags=re.M):
            cells = []
            for line in chunk.split("\n"):
                s = line.strip()
                if s.startswith("|+"):
                    out.append(s[2:].strip())
                elif s[:1] in ("|", "!"):
                    cells += [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|", "", c).strip() for c in re.split(r"\|\||!!", s[1:])]
            if cells:
                out.append("\ue002r0 " + "\ue003".join(cells) + "\ue003")
        return "\n\n" + "\n".join(out) + "\n\n"

    # -- lines
    def _lines(self, t: str) -> None:
        lines, para, i = t.split("\n"), [], 0
        fam, blocks = self.families, self.blocks

        def flush() -> None:
            if para:
                text = self._inline("\n".join(para))
                if text.strip():
                    blocks.append(Block("paragraph", text.strip()))
                para.clear()

        while i < len(lines):
            line = lines[i]
            s = line.strip()
            if not s:
                flush()
            elif s[0] == "\ue002":
                flush()
                self._marked(s)
            elif re.fullmatch("\ue000\\d+\ue001", s) and self.kept[int(s[1:-1])][0] in ("code", "formula"):
                flush()
                kind, body = self.kept[int(s[1:-1])]
                blocks.append(Block(kind, body))
            elif m := _ATX.match(line):
                flush()
                fam.add("markdown")
                blocks.append(Block("heading", self._inline(m[2]).strip(), len(m[1])))
            elif m := _WIKI_H.match(line):
                flush()
                fam.add("wiki")
                blocks.append(Block("heading", self._inline(m[2]).strip(), len(m[1])))
            elif (m := _SETEXT.match(line)) and para and (len(s) >= 2 or s == "="):
                fam.add("markdown")
                title = para.pop()
                flush()
                blocks.append(Block("heading", self._inline(title).strip(), 1 if s[0] == "=" else 2))
            elif _RULE.match(line):
                flush()
                fam.add("markdown")
                blocks.append(Block("rule"))
            elif "|" in line and i + 1 < len(lines) and _MD_DELIM.match(lines[i + 1]) and "-" in lines[i + 1] and ("|" in lines[i + 1]):
                flush()
                fam.add("markdown")
                rows = [self._cells(line)]
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(self._cells(lines[i]))
                    i += 1
                blocks.append(Block("table", rows=rows))
                continue
            elif m := _QUOTE.match(line):
                flush()
                fam.add("markdown")
                inner = m[2]
                it = _ITEM.match(inner)
                blocks.append(Block("quote", self._inline(it[4] if it else re.sub(r"^#{1,6} ", "", inner)).strip(), m[1].count(">")))
            elif m := _NOTEDEF.match(line):
                flush()
                fam.add("markdown")
                blocks.append(Block("paragraph", self._inline(m[2]).strip()))
            elif _REFDEF.match(line):
                flush()
                fam.add("markdown")
            elif m := _ITEM.match(line):
                if not (m[2][0].isdigit() and para):
                    flush()
                    fam.add("markdown")
                    depth = len(m[1].expandtabs(4)) // 2 + 1
                    text = [m[4]]
                    while i + 1 < len(lines) and lines[i + 1].startswith("  ") and lines[i + 1].strip() and not _ITEM.match(lines[i + 1]):
                        i += 1
                        text.append(lines[i].strip())
                    box = {"x": "[x] ", " ": "[ ] "}.get((m[3] or "").lower(), "") if m[3] else ""
                    blocks.append(Block("item", box + self._inline("\n".join(text)).strip(), depth, m[2] if m[2][0].isdigit() else "-"))
                else:
                    para.append(line)
            elif (m := _WIKI_ITEM.match(line)) and not line.startswith("#!"):
                flush()
                fam.add("wiki")
                blocks.append(Block("item", self._inline(m[2]).strip(), len(m[1]), "1." if m[1][-1] == "#" else "-"))
            else:
                para.append(line)
            i += 1
        flush()

    def _marked(self, s: str) -> None:
        kind, level, text = s[1], int(s[2]) if s[2].isdigit() else 0, s[4:]
        if kind == "h":
            self.blocks.append(Block("heading", self._inline(text).strip(), level))
        elif kind in "uo":
            self.blocks.append(Block("item", self._inline(text).strip(), level, "1." if kind == "o" else "-"))
        elif kind == "-":
            self.blocks.append(Block("rule"))
        else:
            cells = [self._inline(c).strip() for c in text.split("\ue003")]
            cells = cells[:-1] if cells and not cells[-1] else cells
            if self.blocks and self.blocks[-1].kind == "table":
                self.blocks[-1].rows.append(cells)
            else:
                self.blocks.append(Block("table", rows=[cells]))

    def _cells(self, line: str) -> list[str]:
        body = line.strip()
        body = body[1:] if body.startswith("|") else body
        body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
        return [self._inline(c).strip() for c in re.split(r"(?<!\\)\|", body)]

    # -- inline text
    def _inline(self, t: str) -> str:
        fam = self.families
        if "[" in t or "'" in t or "~" in t or "__" in t or t.startswith("#"):
            for rx, to in _INLINE_WIKI:
                t, n = rx.subn(to, t)
                if n:
                    fam.add("wiki")
        if "\\" in t:
            t = self._tex_inline(t)
        if re.search(r"[*_\[<~=]", t):
            for rx, to in _INLINE_MD:
                t, n = rx.subn(to, t)
                if n:
                    fam.add("markdown")
        if "&" in t and (found := [e for e in _ENTITY.findall(t) if html.unescape(e) != e]):
            fam.add("html")
            for e in set(found):
                t = t.replace(e, html.unescape(e))
        t = t.replace("\ue006", "{{").replace("\ue007", "}}").replace("\ue003", " ")
        while "\ue000" in t:
            t = re.sub("\ue000(\\d+)\ue001", lambda m: self._kept_text(int(m[1])), t)
        return t

    def _kept_text(self, k: int) -> str:
        kind, body = self.kept[k]
        return f"${body}$" if kind in ("math", "formula") else body

    def _tex_inline(self, t: str) -> str:
        n = 0
        t, k = _TEX_DROP.subn("", t)
        n += k
        t, k = _TEX_LINK.subn(r"\2", t)
        n += k
        t, k = _TEX_REF.subn(r"[\1]", t)
        n += k
        for _ in range(6):
            t, k = _TEX_ARG.subn(lambda m: m[0] if _PATH.search(t[max(0, m.start() - 40) : m.start() + 1]) else m[2], t)
            n += k
            if not k or not _TEX_ARG.search(t):
                break
        if not _PATH.search(t):
            t, k = _TEX_WORD.subn(lambda m: {"\\LaTeX": "LaTeX", "\\TeX": "TeX", "\\ldots": "…", "\\dots": "…"}.get(m[0].rstrip("{}"), ""), t)
            n += k
            t, k = _TEX_ESC.subn(lambda m: m[1] or m[2], t)
            n += k
        if n:
            self.families.add("latex")
            t = re.sub(r"(?<!\\)~", " ", t).replace("\\\\", "\n")
        else:
            t = re.sub(r"\\([*_`#\[\]|>])(?=\S)", r"\1", t) if not _PATH.search(t) else t
        return t

    # -- output
    def render(self) -> str:
        out: list[str] = []
        last = ""
        for b in self.blocks:
            if b.kind == "item":
                part = "  " * (b.level - 1) + f"{b.marker} " + b.text.replace("\n", "\n" + "  " * b.level)
            elif b.kind == "code":
                part = "\n".join("    " + x if x else "" for x in b.text.split("\n"))
            elif b.kind == "formula":
                part = f"$${b.text}$$"
            elif b.kind == "table":
                part = _aligned(b.rows)
            elif b.kind == "quote":
                part = "  " * b.level + b.text
            elif b.kind == "rule":
                continue
            elif b.kind == "heading":
                part = "#" * min(max(b.level, 1), 6) + " " + " ".join(b.text.split())
            else:
                part = b.text
            tight = b.kind == last and b.kind in ("item", "quote")
            out.append(("\n" if tight else "\n\n") + part)
            last = b.kind
        return "".join(out).strip("\n")


def _braced(t: str, at: int) -> tuple[str, int]:
    """The text in the braces that open at ``at`` and the place behind them."""
    depth = 0
    for i in range(at, len(t)):
        depth += (t[i] == "{") - (t[i] == "}")
        if not depth:
            return t[at + 1 : i], i + 1
    return t[at + 1 :], len(t)


def _aligned(rows: list[list[str]]) -> str:
    width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows), default=0))]
    return "\n".join("  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows)


_SCHEMA = "node_row long, text string, families array<string>, blocks array<struct<kind:string,level:int,text:string>>"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        texts, fams, blocks = [], [], []
        for content in batch.column("content"):
            raw = content.as_py()
            if raw is None:
                texts.append(None)
                fams.append([])
                blocks.append([])
                continue
            b = Builder(raw)
            texts.append(b.render())
            fams.append(sorted(b.families))
            blocks.append([{"kind": x.kind, "level": x.level, "text": _aligned(x.rows) if x.kind == "table" else x.text} for x in b.blocks])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node_row"), pa.array(texts, pa.string()), pa.array(fams, pa.list_(pa.string())), pa.array(blocks, kind)], names=["node_row", "text", "families", "blocks"]
        )


def clean_articles(nodes: DataFrame, content: str = "knowledgeMeta.content") -> DataFrame:
    """node_row, text, families, blocks of each article row.

    Rows without content are left out; empty content gives empty text, no family and no block. Each delivery of
    an article counts. No shuffle; memory of a task is one Arrow batch.
    """
    rows = nodes.select("node_row", F.col(content).alias("content")).where(F.col("content").isNotNull())
    return rows.mapInArrow(_clean, _SCHEMA)


def markup_found(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("node_row", F.explode("families").alias("family"))
