"""Credentials in source code and configuration: where they stand, and the code with them redacted.

Configuration formats are parsed into key paths with offsets of their values, source lines into string literals with the
name, key or argument that each one belongs to; neighbouring literals that the code joins are one value. A value is a
credential by its shape alone (key formats of known issuers, signed tokens, authorization values, passwords in URLs,
private keys) or by a sensitive name together with a value that looks like one. Redactions replace the values' bytes and
nothing else.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.configuration import PARSERS

MASK = "REDACTED"

# Names of passwords, and of other secrets, as they stand in names without separators and in lower case.
PASSWORDS = r"passw|passphrase|pwd|kennwort|contrase|motdepasse|senha|pass$|passe$"
SECRETS = (
    r"secret|apikey|servicekey|accesskey|signing|encrypt\w*key|privatekey|masterkey|credential|token|auth|session|bearer"
    r"|key$|hook$|^bot$|dsn$|^conn$|cookie"
)
#: Names of things that look like secrets but are none.
HARMLESS = (
    r"url$|uri$|header$|pattern|regex|sha\d|sha$|digest|hash|integrity|checksum|fingerprint|public|commit|traceid|alphabet"
    r"|column|count|path|file|field|name$|length|size|prefix|suffix|format|type$|santa|blob|icon|nonce|expir|ttl|limit"
)
_PASSWORD, _SECRET, _HARMLESS = re.compile(PASSWORDS), re.compile(SECRETS), re.compile(HARMLESS)

# Shapes of credentials that are told by their form.
SHAPES = {
    "aws_key_id": r"(?<![A-Za-z0-9+/_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9+/_])",
    "vcs_token": r"(?<![A-Za-z0-9+/_])gh[pousr]_[A-Za-z0-9]{30,}|(?<![A-Za-z0-9+/_])glpat-[\w-]{20,}",
    "payment_key": r"(?<![A-Za-z0-9+/_])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "chat_token": r"(?<![A-Za-z0-9+/_])xox[abeprs]-[0-9A-Za-z-]{20,}",
    "signed_token": r"(?<![A-Za-z0-9+/_])eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{16,}",
    "mail_key": r"(?<![A-Za-z0-9+/_])SG\.[\w-]{16,}\.[\w-]{24,}",
    "map_key": r"(?<![A-Za-z0-9+/_])AIza[\w-]{35}(?![\w-])",
}
_SHAPES = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items()))
_AUTHORIZATION = re.compile(r"\b(Basic|Bearer)\s+([A-Za-z0-9._~+/-]{8,}={0,2})")
_URL_PASSWORD = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s/:@'\"`]*:([^\s/'\"`]+)@(?=[\w\[])")
_URL_KEY = re.compile(r"[?&](?:api_?key|key|access_?token|token|auth|sig|signature|secret|password|pwd)=([\w.~+/%-]{12,})", re.I)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?=(?:\\[nr]|[\"'`+.,\s\\])*[A-Za-z0-9+/=:-]{16})")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")

_PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|%\(|<[\w .:-]+>|^\$\w+$|^%\w+%$|^env[:.]|^vault[:/]|^secret[:/]|^arn:|^\W*$|^(.)\1+$|x{4,}|\*{3,}|\.{3}"
    r"|^(?:change_?me|todo|fixme|tbd|none|null|nil|example|sample|dummy|test|testing|placeholder|redacted|password|secret|foo"
    r"|bar|your|my|insert|replace|enter|put|default|undefined|true|false|unset|empty|changeit|hunter2)(?:[\W_].*)?$"
    r"|^(?:process\.env|os\.environ|getenv|System\.)",
    re.I,
)

# Lines with a shape outside literals have one of these; lines that may name a secret have a stem of the names above.
_SHAPE_TEXT = (
    r"akia[0-9a-z]|asia[0-9a-z]|gh[pousr]_|glpat-|[sr]k_(?:live|test)_|xox[abeprs]-|eyj[\w-]|sg\.[\w-]|aiza|\bbasic\s"
    r"|\bbearer\s|://[^\s/:@'\"`]*:[^\s/'\"`]+@|[?&](?:api_?key|key|access_?token|token|auth|sig|signature|secret|password|pwd)="
)
_SHAPE, _SHAPE_ANY = re.compile(_SHAPE_TEXT), re.compile(_SHAPE_TEXT, re.I)
_STEM = re.compile(re.sub(r"[$^]", "", f"{PASSWORDS}|{SECRETS}"))
#: Characters of the shortest value with a shape: a URL with a password.
LEAST_SHAPE = 7
_LITERAL = re.compile(r"\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`", re.S)
_JOIN = re.compile(r"\s*(?:\+|\.\.|\.|\\)?\s*(?:\\?\r?\n\s*(?:\+|\.\.|\.)?\s*)?")
_NAME_BEFORE = re.compile(
    r"([A-Za-z_$][\w$.-]*)[\"'`\]]*\s*(?:(?::(?!:)\s*&?[\w:.<>\[\]*' ]+?)?\s*(?::=|=>|=)|:)\s*(?:\(\s*)?(?:[urbfURBF]{1,2}|String\.raw|new\s+\w+\(\s*)?$"
)
_SETTER = re.compile(r"(?i)(?:set|with|use|assign|update|change|reset)_?[a-z]")
_APART = re.compile(r"[;{},)]")
#: Words between a literal and the name before it, operators and types included.
WORDS_BEFORE = 64
_BARE = re.compile(
    r"(?<![\w.-])(?=([A-Za-z_][\w.-]*)\s*(?::=|=>|=|:|\s(?:was|is)\s|\s)\s*([A-Za-z0-9+/_=!@#%^&*~.?-]{6,})(?=$|[\s\"'`,;)]))"
)
#: Users and passwords among a command's arguments.
_USER_ARGUMENT = re.compile(r"(?<![\w-])(?:-u|--user|--proxy-user)(?:[ \t]+|=)[\"']?[\w.@+-]+:([^\s\"']+)")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--|;|\*|/\*)")


@dataclass(frozen=True)
class Finding:
    """A credential: 1-based line, offsets of its value in the text, the path or name it stands under, and its kind."""

    line_no: int
    start: int
    end: int
    path: str
    kind: str


def _plain(name: str) -> str:
    """A name in lower case without separators and numbering."""
    last = re.split(r"[.\[]", name.rstrip("]"))[-1] if "." in name else name
    return re.sub(r"[_-]?\d+$|_[A-Z]$", "", last).replace("_", "").replace("-", "").lower()


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value))


def _password_like(value: str) -> bool:
    if len(value) < 6 or placeholder(value) or re.search(r"\s|^/|://|^[\w.-]+\(", value):
        return False
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9_]"))
    return kinds >= 2 or bool(re.search(r"\d", value)) and len(value) >= 8


def _opaque(value: str, least: int = 16) -> bool:
    """Whether a value has the form of a random key: long, letters and digits mixed, hardly repeated."""
    if len(value) < least or placeholder(value) or not re.fullmatch(r"[A-Za-z0-9+/_=.~!@#%^&*-]+", value):
        return False
    digits = sum(c.isdigit() for c in value)
    if not digits or digits == len(value) or re.match(r"(?:sha\d+-|data:|/|\d[\d.-]*$)", value):
        return False
    if re.search(r"[A-Za-z]{3,}[._-][A-Za-z]{3,}[._-]?[a-z]{0,}\d{0,4}$", value) and digits <= 4 and not re.search(r"[A-Z]", value):
        return False
    counts, n = Counter(value), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) >= 3.0


def named_credential(name: str, value: str) -> str | None:
    """Kind of a credential if ``name`` is sensitive and ``value`` looks like its secret."""
    plain = _plain(name)
    if _HARMLESS.search(plain):
        return None
    if _PASSWORD.search(plain):
        return "password" if _password_like(value) else None
    if _SECRET.search(plain):
        return "secret" if _opaque(value) else None
    return None


def shaped(value: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the credentials within a value that their form alone tells."""
    found = [(m.start(), m.end(), m.lastgroup or "") for m in _SHAPES.finditer(value)]
    for m in _AUTHORIZATION.finditer(value):
        token = m[2]
        if m[1] == "Basic":
            try:
                text = base64.b64decode(token + "=" * (-len(token) % 4)).decode("utf-8")
            except (binascii.Error, UnicodeDecodeError):
                continue
            if ":" in text and not placeholder(text.split(":", 1)[1]):
                found.append((m.start(2), m.end(2), "basic_authorization"))
        elif not placeholder(token) and len(token) >= 16 and re.search(r"\d", token):
            found.append((m.start(2), m.end(2), "bearer_authorization"))
    for m in _URL_PASSWORD.finditer(value):
        if not placeholder(m[1]) and not re.fullmatch(r"[\$%{<*].*|pass(word)?|pwd|secret", m[1], re.I):
            found.append((m.start(1), m.end(1), "url_password"))
    for m in _URL_KEY.finditer(value):
        if not placeholder(m[1]) and re.search(r"\d", m[1]):
            found.append((m.start(1), m.end(1), "url_key"))
    return found


def _joined(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The literals of a text, each with those that the code joins to it: ``(start, end, value)``."""
    at = 0
    while m := _LITERAL.search(text, at):
        parts = []
        while True:
            which = m.lastindex or 1
            parts.append((m.start(which), m.end(which), m[which]))
            glue = _JOIN.match(text, m.end())
            at = m.end()
            n = _LITERAL.match(text, glue.end())
            # Literals that only touch (as in a list without commas) are joined if a mark or a line end is between.
            if not n or not glue.group().strip() and "\n" not in glue.group():
                break
            m = n
        yield parts


def _named(text: str, end: int) -> str:
    """The name that the literal beginning at ``end`` is assigned to, looked for as far back as one can stand."""
    width = 160
    while True:
        start = max(0, end - width)
        m = _NAME_BEFORE.search(text, start, end)
        # A longer look helps where the name goes on before the window, or white space fills it.
        if start == 0 or (m.start() > start + 1 if m else _APART.search(text, start, end) or len(text[start:end].split()) > WORDS_BEFORE):
            return m[1] if m else ""
        width *= 4


def _called(text: str, end: int) -> str:
    """The name of the function whose first argument begins at ``end``."""
    while end and text[end - 1].isspace():
        end -= 1
    if not end or text[end - 1] != "(":
        return ""
    start = end = end - 1
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return text[start:end]


def _in_literals(text: str, add) -> None:
    previous: tuple[int, int, str] | None = None
    for parts in _joined(text):
        value = "".join(p[2] for p in parts)
        if len(parts) == 1 and value[:1].isspace() | value[-1:].isspace():
            value = value.strip()
            lead = parts[0][0] + len(parts[0][2]) - len(parts[0][2].lstrip())
            begin = parts[0][0] - (3 if text[parts[0][0] - 3 : parts[0][0]] in ('"""', "'''") else 1)
            parts = [(lead, lead + len(value), value)]
        else:
            begin = parts[0][0] - (3 if text[parts[0][0] - 3 : parts[0][0]] in ('"""', "'''") else 1)
        first = parts[0][0]
        last, previous = previous, (begin + 1, parts[-1][1], value)
        found = shaped(value) if len(value) >= LEAST_SHAPE else []
        # The names cost more than the value: they are looked up for values that can be a secret.
        if not found and not (_password_like(value) or _opaque(value)):
            continue
        spans, at = [], 0
        for a, b, v in parts:
            spans.append((at, a, b))
            at += len(v)

        def place(s: int, e: int, spans=spans) -> list[tuple[int, int]]:
            return [(max(a, a + s - o), min(b, a + e - o)) for o, a, b in spans if o < e and o + b - a > s]

        name = _named(text, begin)
        for s, e, kind in found:
            add(first, place(s, e), name, kind)
        if found:
            continue
        if not name and _SETTER.match(own := _called(text, begin)):
            name = own
        opened = _called(text, last[0] - 1) if last else ""
        # A pair of arguments may stand on several lines; in lists and the like it stands on one.
        pair = last and re.search(r",\s*$", text[last[1] : begin]) and (
            "\n" not in text[last[1] : begin] or opened and not text[last[1] + 1 : begin].strip(" \t\r\n,\"'`")
        )
        if (name and (kind := named_credential(name, value))) or (pair and (kind := named_credential(last[2], value))):
            add(first, place(0, len(value)), name or last[2], kind)
        elif pair:
            if re.match(r"(?i)(connect|log_?in|auth|sign_?in)", opened) and re.fullmatch(r"[A-Za-z][\w.@-]{1,31}", last[2]) \
                    and len(value) >= 8 and _password_like(value) and not _HARMLESS.search(_plain(last[2])):
                add(first, place(0, len(value)), last[2], "password")


def _in_configuration(text: str, ext: str, add) -> None:
    """The values of a configuration text, by their key paths."""
    for entry in PARSERS[ext](text):
        value = entry.value(text)
        found = shaped(value) if len(value) >= LEAST_SHAPE else []
        bare = value.strip()
        if not found and (kind := named_credential(entry.name, bare)):
            found = [(value.find(bare), value.find(bare) + len(bare), kind)]
        for s, e, kind in found:
            places, at = [], 0
            for a, b in entry.spans:
                if at < e and at + b - a > s:
                    places.append((max(a, a + s - at), min(b, a + e - at)))
                at += b - a + len(entry.glue)
            if places:
                add(places[0][0], places, entry.path, kind)


def _commented(text: str, start: int, end: int) -> bool:
    """Whether a line of a configuration is a comment."""
    return bool((c := _COMMENT.search(text, start, end)) and c.start() <= start + 2)


def find(text: str, ext: str) -> list[Finding]:
    """The credentials of a text, whose format ``ext`` (an extension in lower case) names, by place."""
    config = ext in PARSERS
    spans: list[tuple[int, int, int, str, str]] = []  # by place, none within another

    def add(first: int, places: list[tuple[int, int]], path: str, kind: str) -> None:
        for a, b in places:
            k = bisect.bisect_left(spans, (a,))
            if b > a and (k == 0 or spans[k - 1][1] <= a) and (k == len(spans) or b <= spans[k][0]):
                spans.insert(k, (a, b, first, path, kind))

    def line_end(at: int) -> int:
        end = text.find("\n", at)
        return len(text) if end < 0 else end

    for p in _PRIVATE.finditer(text):
        stop = _PRIVATE_END.search(text, p.end())
        add(p.start(), [(p.end(), stop.start() if stop else line_end(p.end()))], "", "private_key")
    if config:
        _in_configuration(text, ext, add)
    _in_literals(text, add)
    # What stands outside literals: comments, shell words, headers in commands.
    lower = text.lower()
    trigger, where = (_SHAPE, lower) if len(lower) == len(text) else (_SHAPE_ANY, text)
    done = -1
    for m in trigger.finditer(where):
        if m.start() < done:
            continue
        start, done = text.rfind("\n", 0, m.start()) + 1, line_end(m.start())
        if not config or _commented(text, start, done):
            for s, e, kind in shaped(text[start:done]):
                add(start + s, [(start + s, start + e)], "", kind)
    # Names without separators, line by line: lines keep their number in it.
    plain = lower.replace("_", "").replace("-", "")
    if _STEM.search(plain):
        start = 0
        for line, names in zip(text.split("\n"), plain.split("\n"), strict=True):
            comment = _COMMENT.search(line)
            if (comment or ext in ("sh", "bash")) and _STEM.search(names) and (not config or comment.start() <= 2):
                for b in _BARE.finditer(line, comment.end() if comment else 0):
                    if kind := named_credential(b[1], b[2]):
                        add(start + b.start(2), [(start + b.start(2), start + b.end(2))], b[1], kind)
            start += len(line) + 1
    for m in _USER_ARGUMENT.finditer(text):
        if not config and not placeholder(m[1]) and _password_like(m[1]):
            add(m.start(1), [m.span(1)], "", "user_argument")
    lines = [0, *(m.end() for m in re.finditer("\n", text))] if spans else []
    return [Finding(bisect.bisect_right(lines, first), a, b, path, kind) for a, b, first, path, kind in spans]


def redact(text: str, findings: list[Finding]) -> str:
    """``text`` with the value of each finding replaced; everything else stays byte for byte, line ends in a value too."""
    out, at = [], 0
    for f in findings:
        hidden = re.sub(r"[^\r\n]+", MASK, text[f.start : f.end], count=1)
        head, *rest = re.split(r"(?<=\n)", hidden)
        out += [text[at : f.start], head, *("\r\n" if line.endswith("\r\n") else "\n" for line in rest if line.endswith("\n"))]
        at = f.end
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, ext in batch.itertuples(index=False, name=None):
            for f in find(text, ext):
                start = len(text[: f.start].encode())
                rows.append((key, f.line_no, start, start + len(text[f.start : f.end].encode()), f.path, f.kind))
        yield pd.DataFrame(rows, columns=["request_id", "line_no", "byte_start", "byte_end", "key_path", "kind"])


def _redacted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [find(t, e) for t, e in zip(batch["code"], batch["ext"], strict=True)]
        code = [redact(t, f) for t, f in zip(batch["code"], found, strict=True)]
        yield pd.DataFrame({"request_id": batch["request_id"], "code": code, "n_redacted": [len(f) for f in found]})


def _id() -> Column:
    """Ids go through pandas as strings, where numbers beside nulls would lose digits."""
    return F.col("request_id").cast("string").alias("request_id")


def find_credentials(records: DataFrame) -> DataFrame:
    """``(request_id, line_no, byte_start, byte_end, key_path, kind)`` of each credential in ``code``, each once.

    ``records`` has ``request_id``, ``code`` and ``ext``; null and empty code has none; a null extension counts as source
    code, a null id stays null. A record that stands twice gives its rows once. Offsets count bytes of the UTF-8 text from 0. Other columns are
    ignored.
    """
    texts = records.filter(F.length("code") > 0).select(_id(), "code", F.coalesce("ext", F.lit("")).alias("ext"))
    schema = "request_id string, line_no bigint, byte_start bigint, byte_end bigint, key_path string, kind string"
    return texts.mapInPandas(_found, schema).withColumn("request_id", F.col("request_id").cast("bigint")).dropDuplicates()


def redact_credentials(records: DataFrame) -> DataFrame:
    """``(request_id, code, n_redacted)`` of each record as it stands; null code stays null with nothing redacted."""
    texts = records.select(_id(), "code", F.coalesce("ext", F.lit("")).alias("ext"))
    done = texts.filter("code IS NOT NULL").mapInPandas(_redacted, "request_id string, code string, n_redacted bigint")
    rows = done.unionByName(texts.filter("code IS NULL").select("request_id", "code", F.lit(0).cast("bigint").alias("n_redacted")))
    return rows.withColumn("request_id", F.col("request_id").cast("bigint"))
