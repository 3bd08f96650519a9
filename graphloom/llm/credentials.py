"""Credentials embedded in source code (problem 7).

All token formats, key armor, connection strings, header schemes and credential names are anchors of one
deterministic automaton (Aho-Corasick). Files are scanned in overlapping chunks, anchors are deduplicated by
their absolute place, and the grammar that belongs to an anchor is checked at that place, as far as it reaches. Accepted spans are absolute byte spans; overlapping ones are merged to the longest, and redaction
splices a placeholder of the same line structure into each.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 16, 1 << 9

_W = rb"[A-Za-z0-9_-]"
#: Token formats: anchor (lower case) and grammar.
TOKENS = {
    b"akia": rb"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", b"asia": rb"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    b"ghp_": rb"ghp_[A-Za-z0-9]{30,255}", b"gho_": rb"gho_[A-Za-z0-9]{30,255}", b"ghu_": rb"ghu_[A-Za-z0-9]{30,255}",
    b"ghs_": rb"ghs_[A-Za-z0-9]{30,255}", b"ghr_": rb"ghr_[A-Za-z0-9]{30,255}", b"github_pat_": rb"github_pat_[A-Za-z0-9_]{22,255}",
    b"glpat-": rb"glpat-[A-Za-z0-9_-]{20,64}", b"sk_live_": rb"sk_live_[A-Za-z0-9]{10,99}", b"rk_live_": rb"rk_live_[A-Za-z0-9]{10,99}",
    b"sk_test_": rb"sk_test_[A-Za-z0-9]{10,99}", b"sk-": rb"sk-[A-Za-z0-9_-]{20,200}", b"xoxb-": rb"xoxb-[A-Za-z0-9-]{20,200}",
    b"xoxp-": rb"xoxp-[A-Za-z0-9-]{20,200}", b"xoxa-": rb"xoxa-[A-Za-z0-9-]{20,200}", b"xoxs-": rb"xoxs-[A-Za-z0-9-]{20,200}",
    b"xoxr-": rb"xoxr-[A-Za-z0-9-]{20,200}", b"aiza": rb"AIza[A-Za-z0-9_-]{32,40}", b"npm_": rb"npm_[A-Za-z0-9]{36}",
    b"hf_": rb"hf_[A-Za-z0-9]{30,60}", b"sg.": rb"SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64}", b"dop_v1_": rb"dop_v1_[a-f0-9]{64}",
    b"hooks.slack.com/services/": rb"hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{16,}", b"discord.com/api/webhooks/": rb"discord\.com/api/webhooks/[0-9]{10,}/[A-Za-z0-9_-]{30,}",
    b"eyj": rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
}
NAMES = (
    b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer",
    b"clave", b"contrasen", b"kennwort", b"geheimnis", b"schluessel", b"mot_de_pass", b"motdepass", b"senha", b"jeton",
)
COMMENTS = (b"// ", b"# ", b"* ", b"-- ")
AUTH, URL, ARMOR, USER, SSHPASS = b"authorization", b"://", b"-----begin ", b"-u ", b"sshpass -p"
#: Beginnings of account names; a literal that begins so and a secret in the next one are an account with its password.
ACCOUNTS = tuple(q + name for q in (b"'", b'"') for name in (b"svc", b"user", b"usr", b"admin", b"root", b"service", b"deploy", b"bot", b"account", b"login"))

_TOKEN_RE = {a: re.compile(g) for a, g in TOKENS.items()}
_ARMOR_RE = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_END = re.compile(rb"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_LINES = re.compile(rb"(?:(?:\\n|\s|[#/*+'\",]){0,40}[A-Za-z0-9+/=]{16,})*")
_ARMOR_BODY = re.compile(rb"[A-Za-z0-9+/=]{16,}")
_URL_RE = re.compile(rb"://([^\s:/@'\"`<>]*):([^\s/@'\"`]+(?:/[^\s@'\"`/]*)?)@[A-Za-z0-9\[$.{_-]")
_AUTH_RE = re.compile(rb"(?i)authorization['\"]?\s*[:=,]\s*['\"]?(basic|bearer|token)\s+([A-Za-z0-9+/=._~-]{8,})")
_USER_RE = re.compile(rb"-u ['\"]?([A-Za-z0-9_.@-]+):([^\s'\"]{6,})")
_ACCOUNT_RE = re.compile(rb"(['\"])[A-Za-z][\w.@-]*\1[ \t]*,[ \t]*(['\"])((?:\\.|(?!\2)[^\\\n \t])+)\2")
_SSHPASS_RE = re.compile(rb"(?i)sshpass -p[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|([^\s'\"]+))")
_TAG_VALUE = re.compile(rb">[ \t]*([^<>\n]+?)[ \t]*</")
_IDENT = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_IDENT_AFTER = re.compile(rb"[A-Za-z0-9_.-]*")
# Between a name and its value: closing quote or bracket, a type, the sign, a literal's prefix.
_ASSIGN = re.compile(rb"(\\?['\"`]?\]?)[ \t]*(?::[ \t]*(?:str|string|String|\*string|Optional\[str\]|&(?:'static )?str)[ \t]*(?==))?(:=|=>|==|=|:|,[ \t]*(?=['\"]))[ \t]*(?:\r?\n[ \t]*)?(?:[rbu]?(?=['\"]))?")
_QUOTED = {q: re.compile(rb"(?:\\.|[^\\\n" + q + rb"])*") for q in (b"'", b'"', b"`")}
_BARE = re.compile(rb"[^\s'\"`,;(){}\[\]<>]+")
# A remark that ends with a colon and one long token; what the remark says the token is, if it is none.
_REMARK = re.compile(rb"([^\n:=]*)[:=][ \t]?([A-Za-z0-9+/=_.~-]{20,})[ \t]*(?=\r?\n|\Z|\*/)")
_SIGN = re.compile(rb"[:=\n]")
_NO_SECRET = re.compile(rb"(?i)\b(?:sha\d*|md5|digest|checksum|hash|etag|commit|integrity|uuid|guid|id|public|fingerprint|revision)\b")
_WORD = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Last words of a name that make it a credential, and words that take the meaning away again.
CREDENTIAL_WORDS = {b"password", b"passwd", b"pwd", b"pass", b"passphrase", b"secret", b"token", b"credential", b"credentials", b"bearer", b"apikey", b"secretkey",
    b"clave", b"contrasena", b"contrasenya", b"passwort", b"kennwort", b"geheimnis", b"motdepasse", b"passe", b"senha", b"jeton",
}
KEY_OWNERS = {b"api", b"signing", b"access", b"private", b"secret", b"encryption", b"auth", b"service", b"master", b"account", b"client", b"deploy"}
PLACEHOLDER_WORDS = {
    b"your", b"example", b"sample", b"changeme", b"change", b"placeholder", b"dummy", b"redacted", b"todo", b"fixme", b"insert", b"replace", b"enter", b"fake", b"here", b"xxx",
}
_REFERENCE = re.compile(
    rb"(?i)^(?:\$|%|\{\{|<|@|!|#\{|env[:.(]|vault:|secret:|secrets?[./]|ssm:|arn:|sm://|op://|kv:|file:|ref[:+]|keyring:|process\.|os\.|config\.|settings\.|system\.|import\.|getenv|environ|none$|null$|true$|false$|undefined$|nil$)"
)


def _placeholder(v: bytes) -> bool:
    """Whether a value stands for a credential rather than being one."""
    if len(v) < 6 or _REFERENCE.match(v) or b"${" in v or b"{{" in v or b"..." in v or "…".encode() in v:
        return True
    body = re.sub(rb"^[A-Za-z]{2,6}[_-](?:live_|test_)?", b"", v) if b"_" in v[:9] or b"-" in v[:7] else v
    if len(set(body.lower())) < 4 or re.search(rb"(?i)x{6,}|\*{3,}|0{8,}|(?:12345678|abcdefgh)", v):
        return True
    words = [w.lower() for w in _WORD.findall(v)]
    return any(w in PLACEHOLDER_WORDS for w in words)


def _plain_words(v: bytes) -> bool:
    """Prose, names and paths: words of one case without digits, however they are joined."""
    return re.fullmatch(rb"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[\s_./:-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[.!?]?|[a-z]+(?:[A-Z][a-z]+){0,3}", v) is not None


def _random(v: bytes) -> bool:
    """Long and mixed enough to be a secret on its own."""
    kinds = (re.search(rb"[a-z]", v) is not None) + (re.search(rb"[A-Z]", v) is not None) + (re.search(rb"[0-9]", v) is not None)
    return len(set(v)) >= 10 and (kinds == 3 or (kinds == 2 and re.fullmatch(rb"[0-9a-f]{32,}", v) is not None))


def credential_name(ident: bytes) -> bool:
    """Whether an identifier names a credential by its last words; digits at its end do not count."""
    words = [w.lower() for w in _WORD.findall(ident) if not w.isdigit()]
    if not words:
        return False
    if words[-1] in CREDENTIAL_WORDS:
        return True
    return words[-1] == b"key" and len(words) > 1 and words[-2] in KEY_OWNERS


class Scanner:
    """The automaton and the grammars behind its anchors."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for a in [*TOKENS, *NAMES, *COMMENTS, *ACCOUNTS, AUTH, URL, ARMOR, USER, SSHPASS]:
            self.automaton.add_word(a.decode(), a)
        self.automaton.make_automaton()

    def spans(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every credential, in order, without overlaps; bytes, end exclusive."""
        anchors: set[tuple[int, bytes]] = set()
        for lo in range(0, max(1, len(data)), CHUNK - OVERLAP):
            chunk = data[lo : lo + CHUNK].lower().decode("latin-1")
            anchors.update((lo + end - len(a) + 1, a) for end, a in self.automaton.iter(chunk))
            if lo + CHUNK >= len(data):
                break
        found: list[tuple[int, int, str]] = []
        done = -1
        self._read = 0
        for at, a in sorted(anchors):
            if at >= done and (s := self._check(data, at, a)):
                found.append(s)
                done = s[1] if s[2] == "private-key" else done
        merged: list[tuple[int, int, str]] = []
        for s in sorted(found, key=lambda s: (s[0], -s[1])):
            if merged and s[0] < merged[-1][1]:
                if s[1] > merged[-1][1]:
                    merged[-1] = (merged[-1][0], s[1], merged[-1][2])
                continue
            merged.append(s)
        return merged

    def _check(self, data: bytes, at: int, anchor: bytes) -> tuple[int, int, str] | None:
        if anchor in TOKENS:
            m = _TOKEN_RE[anchor].match(data, at)
            if not m or re.match(_W, data[at - 1 : at]) or _placeholder(m[0]):
                return None
            return at, m.end(), "token"
        if anchor == ARMOR:
            m = _ARMOR_RE.match(data, at)
            if not m:
                return None
            # The block ends before the next one begins, so each stretch of a file is searched once.
            other = data.find(b"-----BEGIN ", m.end())
            end = _ARMOR_END.search(data, m.end(), other if other >= 0 else len(data))
            stop = end.end() if end else _ARMOR_LINES.match(data, m.end()).end()
            body = data[m.end() : end.start() if end else stop]
            return (at, stop, "private-key") if any(not _placeholder(b) for b in _ARMOR_BODY.findall(body)) else None
        if anchor == URL:
            m = _URL_RE.match(data, at)
            if not m or _placeholder(m[2]) or _REFERENCE.match(m[1]) or m[2].lower() in (b"password", b"secret", b"passwd"):
                return None
            return (m.start(2), m.end(2), "connection") if re.match(rb"[A-Za-z0-9+.-]", data[at - 1 : at]) and at else None
        if anchor == AUTH:
            m = _AUTH_RE.match(data, at)
            if not m:
                return None
            v = m[2]
            if m[1].lower() == b"basic":
                try:
                    plain = base64.b64decode(v + b"=" * (-len(v) % 4), validate=True)
                except (binascii.Error, ValueError):
                    return None
                secret = plain.partition(b":")[2]
                return (m.start(2), m.end(2), "header") if secret and not _placeholder(secret) else None
            return (m.start(2), m.end(2), "header") if _random(v) and not _placeholder(v) else None
        if anchor == USER:
            m = _USER_RE.match(data, at)
            return (m.start(2), m.end(2), "user") if m and not _placeholder(m[2]) and not _plain_words(m[2]) else None
        if anchor == SSHPASS:
            m = _SSHPASS_RE.match(data, at)
            k = m.lastindex if m else 0
            return (m.start(k), m.end(k), "command") if m and not _placeholder(m[k]) else None
        if anchor in ACCOUNTS:
            m = _ACCOUNT_RE.match(data, at)
            return (m.start(3), m.end(3), "account") if m and self._chosen(m[3]) else None
        if anchor in COMMENTS:
            # Of the remarks that end at one sign the first decides, so a line is read once however many begin in it.
            if at < self._read:
                return None
            m = _REMARK.match(data, at + len(anchor))
            sign = _SIGN.search(data, at)
            self._read = sign.start() if sign else len(data)
            if not m or not _random(m[2]) or re.fullmatch(rb"[0-9a-fA-F-]+", m[2]) or _NO_SECRET.search(m[1]) or _placeholder(m[2]) or re.match(rb"sha\d+-", m[2]):
                return None
            return m.start(2), m.end(2), "comment"
        return self._named(data, at, anchor)

    def _named(self, data: bytes, at: int, anchor: bytes) -> tuple[int, int, str] | None:
        first = at
        while first and data[first - 1] in _IDENT:
            first -= 1
        tail = _IDENT_AFTER.match(data, at + len(anchor))
        ident = data[first : tail.end()]
        if not credential_name(ident):
            return None
        if data[first - 1 : first] == b"<" and (m := _TAG_VALUE.match(data, tail.end())):
            return None if _placeholder(m[1]) or _plain_words(m[1]) or b" " in m[1] else (m.start(1), m.end(1), "element")
        if (m := _ASSIGN.match(data, tail.end())) and m[2] != b"==":
            q = data[m.end() : m.end() + 1]
            if q in _QUOTED and q:
                fence = data[m.end() : m.end() + 3] == q * 3
                start = m.end() + (3 if fence else 1)
                v = _QUOTED[q].match(data, start)
                if data[v.end() : v.end() + 1] != q:
                    return None
                value, kind = v, "named"
            else:
                if m[2] in (b":=",) or b"\n" in m[0]:
                    return None
                value, kind = _BARE.match(data, m.end()), "named"
                if value is None or not self._bare_allowed(data, at, value):
                    return None
            text = value[0]
            scheme = re.match(rb"(?i)(?:bearer|basic|token) ", text)
            if scheme:
                text = text[scheme.end() :]
            if _URL_RE.search(text) or text.startswith(b"-----BEGIN"):
                return None  # the other grammars judge these
            phrase = b" " in text and not ident.lower().rstrip(b"0123456789_-").endswith(b"passphrase")
            if _placeholder(text) or (_plain_words(text) and b" " not in text) or phrase or re.match(rb"[a-z]+://", text):
                return None
            return value.end() - len(text), value.end(), kind
        return None

    @staticmethod
    def _chosen(v: bytes) -> bool:
        """Whether a literal looks like a password: at least eight characters of both cases with digits or marks, or in no order of cases."""
        both = re.search(rb"[a-z]", v) and re.search(rb"[A-Z]", v)
        if len(v) < 8 or not both or _placeholder(v) or _plain_words(v) or re.search(rb"[/\\:(){}\[\]<>,;]", v):
            return False
        return re.search(rb"[0-9!%+*#$&=?^~]", v) is not None and not re.fullmatch(rb"(?:[A-Za-z]?[a-z]+[._-]?)+[0-9]{0,4}", v) or _mixed(v)

    @staticmethod
    def _bare_allowed(data: bytes, at: int, value: re.Match) -> bool:
        """Unquoted values are literals in settings files, shell, comments and inside connection strings, not in code."""
        if re.search(rb"[(\[]|\.[a-z]+\(", data[value.end() : value.end() + 1]):
            return False
        v = value[0]
        return not re.fullmatch(rb"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+", v) and re.search(rb"[0-9]|[^A-Za-z_]", v) is not None or _mixed(v)


def _mixed(v: bytes) -> bool:
    """Letters in an order of cases that no naming convention has."""
    return len(v) >= 8 and len(re.findall(rb"[A-Z]", v)) >= 3 and not re.fullmatch(rb"[A-Z_]+", v)


def line_of(data: bytes, at: int) -> int:
    return data.count(b"\n", 0, at) + 1


def lines_of(data: bytes, places: list[int]) -> list[int]:
    """Line numbers of ascending places, counted in one pass."""
    out, line, done = [], 1, 0
    for at in places:
        line += data.count(b"\n", done, at)
        done = at
        out.append(line)
    return out


def redact(data: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """Splices ``REDACTED`` into each span; line breaks inside a span (key blocks) and armor lines stay."""
    out, done = [], 0
    for lo, hi, kind in spans:
        out.append(data[done:lo])
        old = data[lo:hi]
        if kind == "private-key":
            head, foot = _ARMOR_RE.match(old)[0], _ARMOR_END.search(old)
            stop = foot.start() if foot else len(old)
            out.append(head + re.sub(rb"[A-Za-z0-9+/=]{8,}", b"REDACTED", old[len(head) : stop]) + old[stop:])
        else:
            out.append(b"REDACTED")
        done = hi
    return b"".join([*out, data[done:]])


def _scan(batches: Iterator[pa.RecordBatch], redacted: bool) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        graph, path, content = (batch.column(i) for i in range(3))
        where, lines, kinds, texts, counts = [], [], [], [], []
        for i, text in enumerate(content.cast(pa.binary())):
            data = text.as_py()
            if data is None:
                spans = []
            else:
                spans = scanner.spans(data)
            if redacted:
                where.append(i)
                texts.append(None if data is None else redact(data, spans).decode("utf-8", "replace") if spans else data.decode("utf-8", "replace"))
                counts.append(len(spans))
            else:
                where.extend([i] * len(spans))
                lines.extend(lines_of(data, [s[0] for s in spans]) if spans else [])
                kinds.extend(s[2] for s in spans)
        at = pa.array(where, pa.int32())
        if redacted:
            yield pa.RecordBatch.from_arrays([graph.take(at), path.take(at), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["graphId", "path", "content", "n_redacted"])
        elif where:
            yield pa.RecordBatch.from_arrays([graph.take(at), path.take(at), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=["graphId", "path", "line_no", "kind"])


def find_credentials(files: DataFrame) -> DataFrame:
    """graphId, path, line_no, kind of each credential; line_no counts from 1 at line feeds.

    files: graphId, path, content. Null or empty content has none; files delivered twice are reported once.
    Memory of a task: one Arrow batch; a text of any length is scanned in chunks. No shuffle but for the
    few results.
    """
    return files.select("graphId", "path", "content").mapInArrow(
        lambda b: _scan(b, False), "graphId string, path string, line_no int, kind string"
    ).groupBy("graphId", "path", "line_no").agg(F.min("kind").alias("kind"))


def redact_credentials(files: DataFrame) -> DataFrame:
    """graphId, path, content with every credential replaced, n_redacted. One row per row; null content stays null."""
    return files.select("graphId", "path", "content").mapInArrow(lambda b: _scan(b, True), "graphId string, path string, content string, n_redacted int")
