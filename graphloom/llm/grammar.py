"""Token classes, permissible adjacent pairs and statement productions of the checked languages.

A file becomes a string with one letter per token. Bracket groups are reduced from the inside out to one letter
each (``P`` for round, ``K`` for square, ``B`` for curly), so what is left of a statement is a flat string that a
regular production decides.

Letters: i name, n number, s string, r regular expression, t template, o binary operator, + sign, ! unary operator,
p increment, = assignment, A arrow, ~ spread, * star, . member access, N line end, E error; the rest are keywords.
"""

from __future__ import annotations

import re
import re._parser as _sre
from functools import lru_cache

ERROR = "E"
OPEN, CLOSE = "([{", ")]}"
PAIR_OF = {"(": ")", "[": "]", "{": "}"}
REDUCED = {"(": "P", "[": "K", "{": "B"}
BOF, EOF = "^", "$"

_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t][^\n]*)?$"
_IDENT = r"[^\W\d][\w$]*|\$[\w$]*"

# Keyword to letter.
JS_WORDS = (
    dict.fromkeys(("let", "var"), "v") | dict.fromkeys(("return", "throw"), "R")
    | dict.fromkeys(("await", "typeof", "void", "delete", "new"), "u") | dict.fromkeys(("in", "instanceof"), "o")
    | dict.fromkeys(("while", "with"), "W") | dict.fromkeys(("break", "continue", "debugger"), "b")
    | dict.fromkeys(("static", "get", "set", "public", "private", "protected", "readonly", "abstract", "declare", "override"), "j")
    | dict.fromkeys(("of", "from", "as", "type", "interface", "namespace", "implements", "keyof", "infer", "is", "satisfies", "asserts", "unique"), "w")
    | {"yield": "Y", "const": "q", "if": "I", "switch": "Q", "do": "D", "try": "T", "finally": "Z", "function": "f", "class": "c", "extends": "x", "for": "F", "else": "L", "catch": "C", "case": "a", "default": "d", "import": "m", "export": "X", "async": "y", "enum": "e"}
)
JAVA_WORDS = (
    dict.fromkeys(("public", "private", "protected", "static", "final", "abstract", "native", "transient", "volatile", "strictfp", "sealed"), "j")
    | dict.fromkeys(("class", "interface", "enum"), "c") | dict.fromkeys(("extends", "implements", "throws"), "x")
    | dict.fromkeys(("while", "synchronized"), "W") | {"if": "I", "switch": "Q", "do": "D", "try": "T", "finally": "Z", "yield": "Y"}
    | dict.fromkeys(("return", "throw", "assert"), "R") | dict.fromkeys(("break", "continue"), "b") | dict.fromkeys(("const", "goto"), "E")
    | dict.fromkeys(("int", "long", "short", "byte", "char", "boolean", "float", "double", "void"), "z")
    | {"for": "F", "else": "L", "catch": "C", "case": "a", "default": "d", "new": "u", "instanceof": "O", "package": "k", "import": "m"}
)
GO_WORDS = dict.fromkeys(("break", "continue", "goto", "fallthrough"), "b") | {
    "func": "f", "package": "k", "import": "m", "type": "y", "var": "v", "const": "v", "struct": "S", "interface": "S", "map": "M", "chan": "H",
    "if": "I", "for": "F", "switch": "W", "select": "W", "case": "a", "default": "d", "else": "L", "return": "R", "go": "D", "defer": "D", "range": "u",
}
PY_WORDS = (
    dict.fromkeys(("and", "or", "in", "is"), "o") | {"if": "I", "while": "W", "for": "F", "with": "V", "elif": "q", "class": "c", "except": "X", "else": "L", "try": "T", "finally": "Z"}
    | dict.fromkeys(("return", "raise", "del", "assert", "global", "nonlocal"), "R")
    | dict.fromkeys(("pass", "break", "continue"), "b") | {"def": "f", "lambda": "l", "not": "!", "await": "u", "async": "y", "yield": "Y", "import": "m", "from": "M", "as": "a"}
)

_OPS = {
    "js": [("A", "=>"), ("~", r"\.\.\."), ("p", r"\+\+|--"), ("=", r"(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])?=(?!=)"), ("o", r"===?|!==?|<=|>=|<<|>>>?|&&|\|\||\?\?|\*\*|[/%<>&|^]"), ("*", r"\*"), ("+", r"[-+]"), ("!", r"[!~]"), ("l", r"\?\.(?!\d)"), (".", r"\.")],
    "java": [("A", "->"), ("~", r"\.\.\."), ("E", r"===|!==|=>"), (".", r"::|\."), ("p", r"\+\+|--"), ("=", r"(?:<<|>>>?|[-+*/%&|^])?=(?!=)"), ("o", r"==|!=|<=|>=|<<|>>>?|&&|\|\||[/%<>&|^]"), ("*", r"\*"), ("+", r"[-+]"), ("!", r"[!~]")],
    "go": [("~", r"\.\.\."), ("E", r"===|!==|=>"), ("p", r"\+\+|--"), ("=", r":=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=)"), ("o", r"==|!=|<=|>=|<-|<<|>>|&\^|&&|\|\||[/%<>|]"), ("*", r"\*"), ("+", r"[-+]"), ("!", r"[!^&]"), (".", r"\."), ("o", r"~")],
    "py": [("A", "->"), ("~", r"\.\.\."), ("w", ":="), ("=", r"(?:\*\*|//|<<|>>|[-+*/%&|^@])?=(?!=)"), ("o", r"==|!=|<=|>=|<<|>>|//|[/%<>&|^]"), ("*", r"\*\*?"), ("+", r"[-+]"), ("!", r"~"), (".", r"\.")],
}

_REGEX = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}`]*\}|`[^`]*`)*\})*`"
_DQ, _SQ = r'"(?:\\(?:\r\n|.|\n)|[^"\\\n])*"', r"'(?:\\(?:\r\n|.|\n)|[^'\\\n])*'"
_ANGLE = r"<[\w$\s,.|&?\[\]@]*>"
for _ in range(4):  # generics nest; each level holds the one below
    _ANGLE = rf"<(?>[\w$\s,.|&?\[\]@]+|{_ANGLE})*+>"
_GENERIC = rf"[A-Za-z_$][\w$]*{_ANGLE}(?=[\s(){{}},;=.\[\]>:|&?]|$)"
_NUM = r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.(?!\.))?(?:[eE][-+]?\d+)?)[a-zA-Z]{0,3}(?![\w])"


def _master(lang: str) -> re.Pattern:
    """One pattern per language; the name of the group that matched is the kind of token."""
    ops = "|".join(f"(?P<op{i}>{p})" for i, (_, p) in enumerate(_OPS[lang]))
    conflict = f"(?P<conflict>(?m:{_CONFLICT}))"
    c_comment = r"(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<bad>/\*)"
    tail = r"|(?P<br>[()\[\]{},;:?@#])|(?P<nl>\n)|(?P<ws>[ \t\r\f ﻿]+)|(?P<other>.)"
    if lang == "js":
        body = (
            rf"{c_comment}|(?P<hash>\A\#![^\n]*)|(?P<opre>(?:=>|&&|\|\||return\b|typeof\b|case\b|[=(,:;!&|?{{}}\[+\-*%~^<>])[ \t\r\n]*{_REGEX})"
            rf"|(?P<s>{_DQ}|{_SQ})|(?P<t>{_TEMPLATE})|(?P<mem>\??\.[ \t\r\n]*\#?(?:{_IDENT}))|(?P<gen>{_GENERIC})|(?P<n>{_NUM})|(?P<id>\#?(?:{_IDENT}))|{ops}"
        )
    elif lang == "java":
        body = (
            rf'{c_comment}|(?P<s>"""[ \t]*\n(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\u+[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.|[^\'\\\n])\')'
            rf"|(?P<mem>(?:\.|::)[ \t\r\n]*(?:<[\w\s,.<>?]*>)?(?:{_IDENT}))|(?P<gen>{_GENERIC})|(?P<n>{_NUM})|(?P<id>{_IDENT})|(?P<ann>@(?!interface)[A-Za-z_][\w.]*)|{ops}"
        )
    elif lang == "go":
        body = (
            rf'{c_comment}|(?P<s>"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\(?:[xuU]?[0-9a-fA-F]+|.)|[^\'\\\n])\')'
            rf"|(?P<mem>\.[ \t\r\n]*(?:{_IDENT}))|(?P<n>{_NUM})|(?P<id>{_IDENT})|{ops}"
        )
    else:
        prefix = r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?"
        body = (
            rf'(?P<comment>\#[^\n]*|\\\r?\n)|(?P<s>{prefix}(?:"""(?:\\(?:.|\n)|[^\\])*?"""|\'\'\'(?:\\(?:.|\n)|[^\\])*?\'\'\'|{_DQ}|{_SQ}))'
            rf"|(?P<mem>\.[ \t]*(?!import\b)(?:{_IDENT}))|(?P<n>{_NUM})|(?P<id>{_IDENT})|{ops}"
        )
    return re.compile(f"{conflict}|{body}{tail}", re.S)


_MASTER = {k: _master(k) for k in _OPS}
_WORDS = {"js": JS_WORDS, "java": JAVA_WORDS, "go": GO_WORDS, "py": PY_WORDS}
_OP_LETTER = {lang: {f"op{i}": letter for i, (letter, _) in enumerate(ops)} for lang, ops in _OPS.items()}
# Words that are keywords only before what follows: records, directives of modules.
_JAVA_CONTEXT = {"record": (re.compile(r"\s+[A-Z]\w*\s*(?:<[^>{;]*>\s*)?\("), "c")} | dict.fromkeys(("requires", "exports", "opens", "uses", "provides"), (re.compile(r"[ \t]+[A-Za-z]"), "h"))
_JSON = re.compile(r'(?P<s>"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]))|(?P<l>true|false|null)|(?P<br>[()\[\]{},:])|(?P<ws>[ \t\r\n]+)|(?P<other>.)', re.S)


def lex(lang: str, text: str) -> str:
    """The letters of a text; line ends are kept where the language gives them meaning."""
    if lang == "json":
        return "".join({"s": "s", "n": "n", "l": "l", "other": ERROR, "ws": ""}.get(m.lastgroup, m[0]) for m in _JSON.finditer(text.removeprefix("﻿")))
    if lang == "py":
        return _lex_python(text)
    base = "js" if lang in ("js", "ts") else lang
    words, ops, out = _WORDS[base], _OP_LETTER[base], []
    for m in _MASTER[base].finditer(text):
        k = m.lastgroup
        if k == "ws":
            continue
        if k == "id":
            letter = words.get(m[0], "i")
            if base == "java" and letter == "i" and m[0] in _JAVA_CONTEXT and _JAVA_CONTEXT[m[0]][0].match(text, m.end()):
                letter = _JAVA_CONTEXT[m[0]][1]
            out.append(letter)
        elif k == "br":
            out.append(m[0] if m[0] != "#" else ERROR)
        elif k == "mem":
            out.append(".i")
        elif k in ("s", "n", "t"):
            out.append(k)
        elif k == "nl":
            out.append("N")
        elif k == "comment":
            if "\n" in m[0]:
                out.append("N")
        elif k == "gen":
            out.append("i")
        elif k == "ann":
            out.append("@")
        elif k == "opre":
            head = m[0][: m[0].index("/")].strip()
            out.append((words.get(head) or {"=>": "A", "&&": "o", "||": "o", "=": "=", "+": "+", "-": "+", "*": "*", "!": "!", "~": "!"}.get(head) or (head if head in "(,:;?{}[" else "o")) + "r")
        elif k == "hash":
            continue
        elif k in ("conflict", "bad", "other"):
            out.append(ERROR)
        else:
            out.append(ops[k])
    s = "".join(out)
    if lang == "java":
        return s.replace("N", "")
    if lang == "go":
        return re.sub(r"(?<![ins)\]}bRpEt])N+", "", s)
    return s


def _lex_python(text: str) -> str:
    """As lex; > opens an indented block, < closes one, N ends a logical line."""
    out: list[str] = []
    depth, levels, line_start, words, ops = 0, [0], True, _WORDS["py"], _OP_LETTER["py"]
    src = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    pos, master, n = 0, _MASTER["py"], len(src)
    indent = re.compile(r"[ \t\f]*")
    blank = re.compile(r"[ \t\f]*(?:#[^\n]*)?(?:\n|\Z)")
    soft = re.compile(r"(?:match|case)\b(?=[ \t]+[^=\s.,:)\]]|[ \t]*[\[({\"'])[^\n]*:[ \t]*(?:#[^\n]*)?(?:\n|\Z)")
    while pos < n:
        if line_start and not depth:
            b = blank.match(src, pos)
            if b and b.end() > pos:
                pos = b.end()
                continue
            ws = indent.match(src, pos)[0]
            width = len(ws.expandtabs(8))
            if width > levels[-1]:
                levels.append(width)
                out.append(">")
            else:
                while width < levels[-1]:
                    levels.pop()
                    out.append("<")
                if width != levels[-1]:
                    out.append(ERROR)
                    levels.append(width)
            pos += len(ws)
            line_start = False
            continue
        m = master.match(src, pos)
        pos = m.end()
        k = m.lastgroup
        if k in ("ws", "comment"):
            continue
        if k == "id":
            begins = not out or out[-1] in "N><"
            out.append("h" if begins and not depth and soft.match(src, m.start()) else words.get(m[0], "i"))
        elif k == "mem":
            out.append(".i")
        elif k in ("s", "n"):
            out.append(k)
        elif k == "br":
            c = m[0]
            if c in OPEN:
                depth += 1
            elif c in CLOSE:
                depth = max(0, depth - 1)
            out.append(ERROR if c in "?#" else "o" if c == "@" and out and out[-1] not in "N><" else c)
        elif k == "nl":
            if not depth:
                out.append("N")
                line_start = True
        elif k in ("conflict", "other"):
            out.append(ERROR)
        else:
            out.append(ops[k])
    if out and out[-1] != "N":
        out.append("N")
    out.extend("<" * (len(levels) - 1))
    return "".join(out)


# --- productions ------------------------------------------------------------------------------------------------


def _grammar_js(ts: bool) -> dict[str, str]:
    nm = "[iwjy]"
    typ_atom = rf"(?:[wujo+]*(?:{nm}|[nst]|B|K|P(?:A)?|u|m)(?:\.i|K|P)*)"
    typ = rf"(?:{typ_atom}(?:[oA?:wx]{typ_atom})*)" if ts else r"(?!)"
    ann = rf"(?:!?\??:{typ})?" if ts else ""
    head_of_fn = rf"y?f\*?"
    fn = rf"(?:{head_of_fn}{nm}?P{ann}B)"
    fn_named = rf"(?:{head_of_fn}{nm}P{ann}(?:B{'|(?=[;N]|$)' if ts else ''}))"
    heritage = rf"(?:[xw]{nm}(?:\.i)*P?(?:,{nm}(?:\.i)*)*|x(?:P|m)(?:\.i|P)*)*"
    deco = rf"(?:@(?:{nm}(?:\.i)*P?|P)N*)*"
    cls, cls_named = rf"(?:{deco}j*c{nm}?{heritage}B)", rf"(?:{deco}j*c{nm}{heritage}B)"
    prim = rf"(?:{fn}|{cls}|{nm}|[nsrt]|P{ann + '(?=A)' if ts else ''}|P|K|B|u\.i|Y(?=[;N)\],}}:]|$)|m(?=[P.]))"
    bang = "!?" if ts else ""
    cast = rf"(?:w{typ})*" if ts else ""
    angle = rf"(?:o(?:q|{typ_atom})(?:[x,]{typ_atom})*o(?=[inP(BK]))?" if ts else ""
    operand = rf"(?:{angle}(?:Y\*|[u+!py~Y])*{prim}{bang}(?:(?:\.i|l?K|l?P|t){bang})*p?{cast})"
    e = rf"(?:{operand}(?:[o+*=A]{operand})*(?:\?{operand}(?:[o+*=A]{operand})*(?:\?{operand}:{operand})?:{operand}(?:[o+*=A]{operand})*)*)"
    bind = rf"(?:(?:{nm}|[KB](?={ann}=)){ann}(?:={e})?)"
    cbind = rf"(?:(?:{nm}|K|B){ann}={e})"
    dbind = rf"(?:{nm}{ann})"
    variables = rf"(?:v{bind}(?:,{bind})*|q{cbind}(?:,{cbind})*" + (rf"|j[vq]{dbind}(?:,{dbind})*)" if ts else ")")
    param = rf"(?:{deco}j*~?(?:{nm}|K|B)\??{ann}(?:={e})?)"
    member_name = rf"(?:{nm}|[snK]|[vqRuoIWQDTZbfcxFLCadmXeY])"
    member = rf"(?:{deco}(?:[jyw](?=[^P=,;:?!N]))*\*?{member_name}[?!]?(?:P{ann}(?:B|(?=[;N]|$))|{ann}(?:={e})?(?=[;N]|$))|j?B)"
    prop = rf"(?:~{e}|(?:[jy](?=[^P:,]))*\*?{member_name}(?:P{ann}B|:{e}|={e})?)"
    ts_block = rf"(?:j*(?:w{nm}(?:\.i)*(?:x{nm}(?:\.i)*(?:,{nm}(?:\.i)*)*)?B|q?e{nm}B|[iw]sB|jiB))" if ts else r"(?!)"
    ts_decl = rf"(?:j*(?:w{nm}={typ}|[iw]s))" if ts else r"(?!)"
    names = rf"(?:mw?(?:{nm}|B|\*w{nm})(?:,(?:B|\*w{nm}))?ws|m{nm}={e}|ms(?:[wW]B)?|Xw?B(?:ws)?|X\*(?:w{nm})?ws|X={e})"
    # An expression statement starts with no function, class, block or declaration.
    free = rf"(?:(?:R|Xd|(?!y?f|j*c|@|B|v|q|X|m)|(?=m[P.])){e}(?:,{e})*|R)"
    simple = rf"(?:{names}|(?:Xj*)?(?:{variables}|{ts_decl})|b{nm}?|{free})"
    head = rf"(?:IP|WP|Fu?P|L|{nm}:(?!:))"
    declared = rf"(?:{deco}(?:Xd?j*)?(?:{fn_named}|{cls_named}|{ts_block})|Xd(?:{fn}|{cls}))"
    body = rf"(?:;N*|B|TB(?:CP?B(?:ZB)?|ZB)|D(?:B|{e};?)N*WP;?|QP[GB]|{declared}|{simple}(?:;N*|N+|(?=L)|$))"
    arg = rf"(?>(?:{e}|{param}|{typ if ts else '(?!)'})(?=N*(?:,|$)))"
    item = rf"(?>(?:{e}|{bind}|{typ + '[?]?' if ts else '(?!)'})(?=N*(?:,|$)))"
    name = rf"(?:w?{member_name}(?:w{member_name})?)"
    out = {
        "(": rf"(?:N*(?:{arg}(?:,N*{arg})*+,?)?N*)",
        "F(": rf"(?:N*(?:(?:{variables}|{e}(?:,{e})*)?;N*(?:{e}(?:,{e})*)?;N*(?:{e}(?:,{e})*)?|[vq](?:{nm}|K|B){ann}[wo]{e}|{operand}[wo]{e})N*)",
        "[": rf"(?:N*(?:,|{item}?(?:,N*{item}?)*+{'|' + nm + 'o?' + typ + '|' + nm + ':' + typ if ts else ''})N*)",
        "{": rf"(?:N*(?:(?>{prop})(?:,N*(?>{prop}))*+,?)?N*|(?>[;N]+|{member})*+|N*(?:{name}(?:,N*{name})*,?)?N*"
        + (rf"|(?>N*(?:{deco}j*(?:{member_name}|K)[?!]?P?(?::{typ})?|u?P(?::{typ})?)[;,N]+|N*(?:j*(?:{member_name}|K)[?!]?P?(?::{typ})?|u?P(?::{typ})?)$)*+" if ts else "")
        + ")",
        "unit": rf"(?P<heads>{head}*){body}", "gap": "N+", "label": rf"(?:a{e}(?:,{e})*:|d:)N*",
    }
    if ts:  # mapped types: { [K in T]?: U }
        out["{"] = out["{"][:-1] + rf"|N*[+]?j?K[+]?\??(?::{typ})?[;,N]*)"
    return out


def _grammar_java() -> dict[str, str]:
    ann = r"(?:@P?)"
    typ = rf"(?:{ann}*(?:i(?:\.i)*|z)(?:K)*)"
    lam = r"(?:(?:i|P)A)"
    prim = r"(?:i|[ns]|P|u(?:i(?:\.i)*|z)(?:PB?|K+B?)|QP[GB]|B|zK*(?=\.))"
    operand = rf"(?:(?:[+!p]|P(?=[insPu!]))*{lam}*(?:{prim})(?:\.i|K|P|\.u|\.c)*p?)"
    record = rf"(?:{typ}P(?:i)?)"
    chain = rf"(?:{operand}(?:[o+*=]+{operand}|Oj?(?:{record}|{typ}(?:i(?=[o)?:;,]|$))?))*)"
    e = rf"(?:{chain}(?:\?{chain}:{chain})*)"
    var = rf"(?:(?:j|{ann})*{typ}i(?:K)*(?:={e})?(?:,i(?:K)*(?:={e})?)*)"
    tparams = rf"(?:o{ann}*i(?:x{typ}(?:o{typ})*)?(?:,i(?:x{typ}(?:o{typ})*)?)*o)"
    typedecl = rf"(?:(?:j|{ann})*@?ci(?:{tparams})?P?(?:x{typ}(?:,{typ})*|i{typ}(?:,{typ})*)*B)"
    head = r"(?:IP|WP|FP|L|i:)"
    simple = rf"(?:R(?:{e})?(?::{e})?|Y{e}|bi?|{var}|(?!B){e})"
    body = rf"(?:;|B|T(?:PB(?:CPB)*(?:ZB)?|B(?:(?:CPB)+(?:ZB)?|ZB))|D(?:B|{simple};)WP;|QP[GB]|{typedecl}|{simple};)"
    member = rf"(?>;|{typedecl}|(?:j|{ann}|d)*{tparams}?(?:j|{ann})*(?:{typ})?iP(?:K)*(?:x{typ}(?:,{typ})*)?(?:d{e})?(?:B|;)|(?:j|{ann})*iB|{var};|j?B)"
    enum = rf"(?:(?:{ann}*iP?B?)(?:,{ann}*iP?B?)*,?(?:;{member}*+)?|;{member}*+)"
    directive = r"(?:hj*i(?:\.i)*(?:i?i(?:\.i)*(?:,i(?:\.i)*)*)?;)"
    param = rf"(?:(?:j|{ann})*{typ}~?(?:i|\.i)(?:K)*)"
    arg = rf"(?>(?:{e}|{param})(?=,|$))"
    pattern = rf"(?:{record}|(?:j|{ann})*{typ}i|{e}|d)"
    return {
        "(": rf"(?:{arg}(?:,{arg})*+|{typ}(?:o{typ})*i?|(?:j|{ann})*{typ}(?:o{typ})*i|i={e}(?:,i={e})*|{pattern}(?:,{pattern})*)?",
        "F(": rf"(?:(?:{var}|{e}(?:,{e})*)?;(?:{e})?;(?:{e}(?:,{e})*)?|(?:j|{ann})*{typ}i:{e})",
        "T(": rf"(?:(?:{var}|{e})(?:;(?:{var}|{e}))*;?)",
        "[": rf"(?:{e})?",
        "{": rf"(?:{member}*+|{enum}|(?:(?:{e}|B|{ann})(?:,(?:{e}|B|{ann}))*,?)?|{directive}*)",
        "": rf"(?:{ann}*ki(?:\.i)*;)?(?:mj?i(?:\.i|\.\*)*;|;)*(?:(?:{typedecl}|;)*|i?ii(?:\.i)*B)",
        "unit": rf"(?P<heads>{head}*){body}", "gap": r"(?!)", "label": rf"(?:a{pattern}(?:,{pattern})*(?:i{e})?|d)[:A]",
    }


def _grammar_go() -> dict[str, str]:
    base = r"(?:i(?:\.i)*(?:K(?=[^N]|$))?|SB|fP(?:P|[*K]*i(?:\.i)*)?|P)"
    typ = rf"(?:(?:\*|K|MK|o|H|~)*{base})"
    lit = rf"(?:(?:\*|K|MK)*(?:i(?:\.i)*K?|SB)B|(?:K|MK)+fP(?:{typ})?B)"
    func = rf"(?:fP(?:{typ})?B)"
    prim = rf"(?:{func}|{lit}|i|[ns]|P|(?:K|MK|H)+{base}(?=[P,)]|$)|(?:K|MK|H)+{typ}|SB|MK{typ})"
    operand = rf"(?:(?:[+!*ou])*{prim}(?:\.i|\.P|K|P)*)"
    e = rf"(?:{operand}(?:[o+*!]{operand})*)"
    es = rf"(?:{e}(?:,{e})*~?)"
    assign = rf"(?:{es}=(?:u?{es})|u{e})"
    simple = rf"(?:{assign}|{es}p?|{e}o{e})"
    spec = rf"(?:i(?:,i)*(?:{typ})?(?:={es})?)"
    tspec = rf"(?:iK?=?{typ})"
    decl = rf"(?:v(?:{spec}|P)|y(?:{tspec}|P))"
    short, cond = rf"(?:(?:{simple}?;)?{simple}?)", rf"(?:(?:{simple}?;)?{simple})"
    loop = rf"(?:(?:{simple})?|(?:{simple})?;(?:{simple})?;(?:{simple})?)"
    chain = rf"I{cond}B(?:LI{cond}B)*(?:LB)?"
    body = rf"(?:{decl}|R(?:{es})?|D{e}|bi?|{chain}|F{loop}B|W{short}[GB]|B|{simple})"
    fdecl = rf"(?:fP?iK?P(?:{typ})?B?)"
    elem = rf"(?>(?:(?:{e}|B):(?:{e}|B)|{e}|B)(?=N*(?:,|$)))"
    param = rf"(?>(?:i~?{typ}|~?{typ}|i)(?=N*(?:,|$)))"
    return {
        "(": rf"(?:N*(?:{es}|{param}(?:,N*{param})*+),?N*|[N;]*(?:{spec}|{tspec}|[i.]?s)?(?:[N;]+(?:{spec}|{tspec}|[i.]?s))*[N;]*|y)?",
        "[": rf"(?:{e}|{e}?:{e}?(?::{e})?|~|i{typ}(?:,i{typ})*|{typ}(?:,{typ})*)?",
        "{": rf"(?:N*(?:{elem}(?:,N*{elem})*+,?)?N*)",
        "S{": rf"(?:(?>[;N]+|(?:(?:i(?:,i)*)?{typ}s?|iP(?:{typ})?|{typ}(?:o{typ})*)(?=[;N]|$))*+)",
        "": rf"[;N]*ki(?:[;N]+(?:m(?:[i.]?s|P))?)*(?>[;N]+|(?:{fdecl}|{decl})(?=[;N]|$))*+",
        "unit": rf"(?P<heads>(?:i:N*)*)(?:{body}(?:[;N]+|$)|(?=$))", "gap": "[;N]+", "label": rf"(?:(?:a{es}|a{assign}|d):)[N;]*",
    }


def _grammar_py() -> dict[str, str]:
    prim = r"(?:i|n|s+|P|K|B|~)"
    bare = rf"(?:[+!u*]*{prim}(?:\.i|P|K)*)"
    ops = r"(?:[+*]|o!?o?|!o)"
    default = rf"(?:={bare}(?:{ops}{bare})*)?"
    lam = rf"(?:l(?:(?:\*?\*?i{default}|\*|o)(?:,(?:\*?\*?i{default}|\*|o))*,?)?:)"
    operand = rf"(?:(?:{lam}|[+!u*])*{prim}(?:\.i|P|K)*)"
    e = rf"(?:(?:Y(?:M)?)?{operand}(?:(?:{ops}|w){operand})*(?:I{operand}(?:{ops}{operand})*L(?:{operand}(?:{ops}{operand})*))*)"
    comp = rf"(?:y?F{operand}(?:,{operand})*,?o{operand}(?:{ops}{operand})*(?:I{operand}(?:(?:{ops}|w){operand})*)*)"
    es = rf"(?:{e}(?:,{e})*,?)"
    simple = rf"(?:{es}(?::{e})?(?:={es})*(?:=Y(?:M?{es})?)?|Y(?:M?{es})?|b|R(?:{es}(?:M{e})?)?|m(?:i(?:\.i)*(?:ai)?)(?:,i(?:\.i)*(?:ai)?)*|M(?:[.~]*i(?:\.i)*|[.~]+(?:\.i)*|(?:\.i)+)m(?:P|\*|i(?:ai)?(?:,i(?:ai)?)*)|ii={e})"
    line = rf"{simple}(?:;{simple})*;?"
    item = rf"{e}(?:a{operand})?"
    pattern = rf"(?:{es}(?:ai)?(?:I{e})?|i={e})"
    compound = (
        rf"(?:[IqW]{e}|y?F{es}o{es}|y?V(?:{item}(?:,{item})*,?)|X\*?(?:{es}(?:ai)?)?|[LTZ]|ciK?P?|y?fiK?P(?:A{e})?|h{pattern}):"
    )
    arg = rf"(?>(?:{e}{comp}*|i={e}|i:{e}(?:={e})?|\*?\*?i(?::{e})?|o|\*|i(?:ai)?|{e}a(?:{operand}))(?=,|$))"
    index = rf"(?>(?:{e}{comp}*|(?:{e})?:(?:{e})?(?::(?:{e})?)?)(?=,|$))"
    entry = rf"(?>(?:{e}:{e}{comp}*|\*?{e}{comp}*)(?=,|$))"
    return {
        "(": rf"(?:{arg}(?:,{arg})*+,?|Y(?:M?{es})?)?", "[": rf"(?:{index}(?:,{index})*+,?)?", "{": rf"(?:{entry}(?:,{entry})*+,?)?",
        "": rf"<*(?:@{e}N|{line}N|{compound}(?:{line}N|N>)|N)<*",
    }


_GRAMMAR_JSON = {"{": r"(?:s:[snlBK](?:,s:[snlBK])*)?", "[": r"(?:[snlBK](?:,[snlBK])*)?", "(": r"(?!)", "": "[snlBK]"}


@lru_cache(maxsize=None)
def grammar(lang: str) -> dict[str, str]:
    """Patterns of what a group may hold, by its opening bracket (and the letter before it, where that matters).

    ``unit`` is one statement with its heads, ``label`` a case label, ``gap`` what may lie between statements, and the
    empty key a file that is more than a list of statements.
    """
    return {"js": lambda: _grammar_js(False), "ts": lambda: _grammar_js(True), "java": _grammar_java, "go": _grammar_go, "py": _grammar_py, "json": lambda: _GRAMMAR_JSON}[lang]()


@lru_cache(maxsize=None)
def production(lang: str, key: str) -> re.Pattern:
    return re.compile(grammar(lang)[key])


# --- adjacent pairs, derived from the productions ----------------------------------------------------------------

_LEFT_OF, _RIGHT_OF = {"P": "(", "K": "[", "B": "{", "G": "{"}, {"P": ")", "K": "]", "B": "}", "G": "}"}
_ALPHABET = "inwsrto+!p=A~*.N"


class _Ends:
    """First and last letters of what a pattern matches, whether it matches nothing, and the pairs inside."""

    __slots__ = ("first", "last", "empty")

    def __init__(self, first: frozenset, last: frozenset, empty: bool):
        self.first, self.last, self.empty = first, last, empty


_NOTHING = _Ends(frozenset(), frozenset(), True)


def _ends(tree, pairs: set) -> _Ends:
    out = _NOTHING
    for op, av in tree:
        out = _then(out, _ends_of(op, av, pairs), pairs)
    return out


def _then(a: _Ends, b: _Ends, pairs: set) -> _Ends:
    pairs.update(x + y for x in a.last for y in b.first)
    return _Ends(a.first | b.first if a.empty else a.first, a.last | b.last if b.empty else b.last, a.empty and b.empty)


def _ends_of(op, av, pairs: set) -> _Ends:
    name = str(op)
    if name == "LITERAL":
        letters = frozenset(chr(av))
    elif name == "IN":
        letters = frozenset(chr(c) for o, c in av if str(o) == "LITERAL") if str(av[0][0]) != "NEGATE" else frozenset(_ALPHABET)
    elif name in ("ANY", "NOT_LITERAL"):
        letters = frozenset(_ALPHABET)
    elif name == "BRANCH":
        parts = [_ends(p, pairs) for p in av[1]]
        return _Ends(frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), any(p.empty for p in parts))
    elif name == "SUBPATTERN":
        return _ends(av[3], pairs)
    elif name == "ATOMIC_GROUP":
        return _ends(av, pairs)
    elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = av
        one = _ends(inner, pairs)
        if high > 1:
            _then(one, one, pairs)
        return _Ends(one.first, one.last, one.empty or low == 0)
    else:  # assertions and anchors match no letters
        return _NOTHING
    return _Ends(frozenset(_LEFT_OF.get(c, c) for c in letters), frozenset(_RIGHT_OF.get(c, c) for c in letters), False)


@lru_cache(maxsize=None)
def permitted_pairs(lang: str) -> frozenset[str]:
    """Pairs of letters that some production of the language puts side by side.

    They are read off the parsed patterns of the productions: the letters that may end one part and begin the next.
    Where line ends may stand almost anywhere (JavaScript, TypeScript), they permit every neighbour.
    """
    pairs: set[str] = set()
    rules = {k: _ends(_sre.parse(v), pairs) for k, v in grammar(lang).items()}
    if "unit" in rules:
        parts = [rules["unit"], rules["label"], rules["gap"]]
        for a in parts:
            for b in parts:
                _then(a, b, pairs)
        unit = _Ends(frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), True)
        rules["{ "] = unit
        if "" not in rules:
            rules[""] = unit
    if lang == "py":  # a file is a list of lines
        _then(rules[""], rules[""], pairs)
    for k, r in rules.items():
        bracket = k.strip()[-1:] if k else ""
        left, right = (bracket, PAIR_OF[bracket]) if bracket in PAIR_OF else (BOF, EOF) if not k else ("", "")
        if left:
            pairs.update(left + x for x in r.first)
            pairs.update(x + right for x in r.last)
            if r.empty:
                pairs.add(left + right)
    if lang in ("js", "ts"):
        seen = {c for p in pairs for c in p} | {BOF, EOF}
        pairs |= {c + "N" for c in seen} | {"N" + c for c in seen}
    return frozenset(pairs)


def pair_set(letters: str) -> set[str]:
    s = BOF + letters + EOF
    return set(map("".join, zip(s, s[1:], strict=False)))


# --- nesting ----------------------------------------------------------------------------------------------------

_GROUP = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
#: Letters before a bracket that decide what it may hold.
_BEFORE = {"F(": "F", "T(": "T", "S{": "S"}
_CASES = {"js": re.compile(r"\{N*(?:a(?!:)|d:)"), "java": re.compile(r"\{(?:a|d[:A])"), "go": re.compile(r"\{[N;]*(?:a|d:)")}
_CASES["ts"] = _CASES["js"]


def reduce_groups(lang: str, letters: str) -> tuple[str, set[str]]:
    """Reduces matched groups from the inside out; what they held, and the text with the unmatched brackets left.

    A shape is the group with its brackets, behind the letter before it where that decides what it may hold. A block that
    begins with a case label becomes a letter of its own, as it can only follow a switch.
    """
    shapes: set[str] = set()
    rules, cases = grammar(lang), _CASES.get(lang)

    def one(m: re.Match) -> str:
        g, at = m[0], m.start()
        before = m.string[at - 1 : at]
        if before == "u" and g[0] == "(" and m.string[at - 2 : at - 1] == "F":
            before = "F"  # for await (
        shapes.add(before + g if before + g[0] in rules else g)
        return "G" if cases and g[0] == "{" and cases.match(g) else REDUCED[g[0]]

    while True:
        letters, n = _GROUP.subn(one, letters)
        if not n:
            return letters, shapes


# --- statements -------------------------------------------------------------------------------------------------


def statements(lang: str, reduced: str) -> list[str]:
    """What the productions of a file are asked of: its logical lines in Python, else the file as a whole."""
    if lang == "py":
        return re.findall(r"[^N]*N>?", reduced.rstrip("<"))
    return [reduced]


def clauses(reduced: str) -> list[tuple[int, int, str]]:
    """(block, place, head letter) of the statements of those Python blocks that hold a clause which needs another before it.

    The heads that matter are kept; every other statement is ``.``, since it ends a chain.
    """
    rows: list[tuple[int, int, str]] = []
    blocks, at = [0], 0
    for k, line in enumerate(re.findall(r"[^N]*N>?", reduced)):
        back = len(line) - len(line.lstrip("<"))
        del blocks[len(blocks) - min(back, len(blocks) - 1) :]
        body = line.lstrip("<").removeprefix("y")
        if body.rstrip("N>"):
            rows.append((blocks[-1], k, body[0] if body[0] in "IqLTXZFW" and ":" in body else "."))
        if line.endswith(">"):
            at += 1
            blocks.append(at)
    wanted = {b for b, _, h in rows if h in "qLTXZ"}
    return [r for r in rows if r[0] in wanted]


#: Heads that may stand directly before a clause in its block, and what may end a block or come before another statement.
CLAUSE_AFTER = {"q": "Iq", "L": "IqFWX", "X": "TX", "Z": "TXL"}


def _fold(lang: str, body: str, labels: bool) -> bool:
    """Whether a text is a list of statements; an ``else`` needs an ``if`` that is still open before it."""
    unit, gap, label = (production(lang, k) for k in ("unit", "gap", "label"))
    at, ifs = 0, 0
    while at < len(body):
        if (m := gap.match(body, at)) and m.end() > at:
            at = m.end()
            continue
        if labels and (m := label.match(body, at)) and m.end() > at:
            at, ifs = m.end(), 0
            continue
        m = unit.match(body, at)
        if not m or m.end() == at:
            return False
        heads = m["heads"]
        if "L" in heads[1:] or (heads[:1] == "L" and not ifs):
            return False
        ifs = (ifs - 1 if heads[:1] == "L" else 0) + heads.count("I")
        at = m.end()
    return True


_JS_GAPS = [
    (re.compile(r"([oA=?:,.+~!u(l])N+"), r"\1"), (re.compile(r"N+([oA=?:.l])"), r"\1"), (re.compile(r"([)PBKinst])N+(?=[L]|[CZ][PB])"), r"\1"), (re.compile(r"([IWFC]P|Fu?P|[LDXTZ])N+"), r"\1"), (re.compile(r"(?<=[;])N+(?=L)"), ""),
]


@lru_cache(maxsize=200_000)
def produces(lang: str, shape: str) -> bool:
    """Whether a production yields the shape: a group with its brackets, or the reduced file."""
    rules = grammar(lang)
    key = shape[:2] if shape[:2] in rules and shape[:2].strip() and shape[1:2] in OPEN else shape[:1] if shape[:1] in OPEN and shape[:1] else ""
    body = shape[len(key) : -1] if key else shape
    if lang in ("js", "ts"):
        for pattern, by in _JS_GAPS:
            body = pattern.sub(by, body)
    cases = key == "{" and lang in _CASES and _CASES[lang].match(shape) is not None
    if key in rules and not cases and production(lang, key).fullmatch(body):
        return True
    return "unit" in rules and (key == "{" or key not in rules) and _fold(lang, body, cases)
