"""Parsers of configuration formats that keep where each value stands: key paths with the offsets of their values.

All go on after what they can't read, as files may be broken or hold templates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Span = tuple[int, int]


@dataclass(frozen=True)
class Entry:
    """A value: its key path, the last name in it, and the places of its parts, which the format joins by ``glue``."""

    path: str
    name: str
    spans: tuple[Span, ...]
    glue: str = ""

    def value(self, text: str) -> str:
        return self.glue.join(text[a:b] for a, b in self.spans)


def _entry(names: list[str], *spans: Span, glue: str = "") -> Entry:
    path = "".join(n if n.startswith("[") else f".{n}" for n in names).lstrip(".")
    return Entry(path, next((n for n in reversed(names) if not n.startswith("[")), ""), spans, glue)


_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.|'')*)'", re.S)


def _inner(m: re.Match[str]) -> Span:
    return m.span(m.lastindex or 1)


def _flow(text: str, at: int, names: list[str], marks: str) -> tuple[list[Entry], int]:
    """Entries of nested maps and lists in brackets from ``at`` on, and where they end. ``marks`` separate keys from values."""
    found: list[Entry] = []
    stack: list[list] = []  # [closing bracket, key or None, index]
    plain = re.compile(rf"[^\s,\[\]{{}}\"'#{marks}](?:[^,\[\]{{}}\n#{marks}]|[{marks}](?!\s|$)|(?<=\S)#)*")
    size = len(text)

    def here() -> list[str]:
        return names + [k for _, key, i in stack for k in ([key] if key is not None else [f"[{i}]"] if i is not None else [])]

    while at < size:
        c = text[at]
        if c in "{[":
            stack.append(["}" if c == "{" else "]", None, None if c == "{" else 0])
            at += 1
            continue
        if not stack:
            break
        if c in "}]":
            stack.pop()
            at += 1
            if not stack:
                break
            continue
        if c == ",":
            if stack[-1][2] is None:
                stack[-1][1] = None
            else:
                stack[-1][2] += 1
            at += 1
            continue
        if c == "#" or text.startswith("//", at):
            end = text.find("\n", at)
            at = size if end < 0 else end
            continue
        m = _QUOTED.match(text, at) if c in "\"'" else plain.match(text, at)
        if not m:
            at += 1
            continue
        span = _inner(m) if c in "\"'" else (m.start(), m.start() + len(m.group().rstrip()))
        at = m.end()
        after = re.compile(rf"\s*[{marks}]").match(text, at)
        if stack[-1][2] is None and stack[-1][1] is None and after:
            stack[-1][1] = text[span[0] : span[1]]
            at = after.end()
        else:
            found.append(_entry(here(), span))
    return found, at


def json_entries(text: str) -> Iterator[Entry]:
    """Values of a JSON text."""
    start = re.compile(r"[{\[]").search(text)
    if start:
        yield from _flow(text, start.start(), [], ":")[0]


_YAML_KEY = re.compile(r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\n]|'')*)'|([^\s#\[\]{},|>@`\"'&*!%][^\n#]*?|[&*!%]?[\w.-]+))[ \t]*:(?=[ \t\r\n]|\Z)")
_YAML_TAG = re.compile(r"(?:[&!]\S*[ \t]+)*")
_PLAIN_END = re.compile(r"(?:[ \t]+#[^\n]*)?\r?(?:\n|\Z)")


def _plain(text: str, at: int, mark: str = r"[ \t]#") -> Span:
    """A plain value up to a comment or the line's end."""
    m = re.compile(rf"[^\n]*?(?=[ \t]*(?:{mark}|\r?\n|\r?\Z))").match(text, at)
    return (at, m.end()) if m else (at, at)


def yaml_entries(text: str) -> Iterator[Entry]:
    """Values of a YAML text: block and flow style, quoted, plain and block scalars over several lines."""
    stack: list[tuple[int, str]] = []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    number, last = 0, len(starts)
    counts: dict[int, int] = {}
    while number < last:
        start = starts[number]
        end = starts[number + 1] - 1 if number + 1 < last else len(text)
        line = text[start:end]
        bare = line.strip()
        number += 1
        if not bare or bare.startswith("#"):
            continue
        if bare in ("---", "..."):
            stack, counts = [], {}
            continue
        at = start + len(line) - len(line.lstrip(" \t"))
        indent = at - start
        while text.startswith(("- ", "-\t"), at) or text[at:end].strip() == "-":
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][1].startswith("[")):
                stack.pop()
            counts = {k: v for k, v in counts.items() if k <= indent}
            counts[indent] = counts.get(indent, -1) + 1
            stack.append((indent, f"[{counts[indent]}]"))
            at += 1
            while at < end and text[at] in " \t":
                at += 1
            indent = at - start
        key = _YAML_KEY.match(text, at, end + 1)
        if key:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            counts = {k: v for k, v in counts.items() if k < indent}
            stack.append((indent, key[key.lastindex or 1]))
            at = key.end()
            while at < end and text[at] in " \t":
                at += 1
        elif not line[: at - start].strip():
            while stack and stack[-1][0] >= indent:
                stack.pop()
        names = [k for _, k in stack]
        parent = stack[-1][0] if stack else -1
        at = min(_YAML_TAG.match(text, at).end(), end)  # type: ignore[union-attr]
        rest = text[at:end].strip()
        if not rest or rest.startswith("#"):
            continue
        if rest[0] in "|>" and re.fullmatch(r"[|>][-+\d]*(?:\s+#.*)?", rest):
            spans = []
            while number < last:
                a = starts[number]
                b = starts[number + 1] - 1 if number + 1 < last else len(text)
                inner = text[a:b]
                deep = len(inner) - len(inner.lstrip(" \t"))
                if inner.strip() and deep <= parent:
                    break
                if inner.strip():
                    spans.append((a + deep, a + len(inner.rstrip())))
                number += 1
            if spans:
                yield _entry(names, *spans, glue="\n" if rest[0] == "|" else " ")
            continue
        if rest[0] in "{[":
            found, at = _flow(text, at, names, ":")
            yield from found
        elif rest[0] in "\"'" and (m := _QUOTED.match(text, at)):
            yield _entry(names, _inner(m))
            at = m.end()
        else:
            spans = [_plain(text, at)]
            while number < last:  # deeper lines without a key go on with a plain value
                a = starts[number]
                b = starts[number + 1] - 1 if number + 1 < last else len(text)
                inner = text[a:b]
                deep = len(inner) - len(inner.lstrip(" \t"))
                if not inner.strip() or deep <= parent or inner.lstrip().startswith(("#", "- ")) or _YAML_KEY.match(text, a + deep, b + 1):
                    break
                spans.append(_plain(text, a + deep))
                number += 1
            yield _entry(names, *spans, glue=" ")
            continue
        while number < last and starts[number] <= at:
            number += 1


_TOML_KEY = re.compile(r"[ \t]*((?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*'))*)[ \t]*=[ \t]*")
_TOML_SECTION = re.compile(r"[ \t]*\[+([^\]\n]+)\]+")
_LONG = re.compile(r"\"\"\"((?:[^\\]|\\.)*?)\"\"\"|'''(.*?)'''", re.S)


def _line_after(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end + 1


def toml_entries(text: str) -> Iterator[Entry]:
    """Values of a TOML text."""
    section: list[str] = []
    at = 0
    while at < len(text):
        if m := _TOML_KEY.match(text, at):
            names = section + [p.strip().strip("\"'") for p in re.findall(r"\"[^\"]*\"|'[^']*'|[^.]+", m[1])]
            at = m.end()
            if long := _LONG.match(text, at):
                yield _entry(names, _inner(long))
                at = long.end()
            elif at < len(text) and text[at] in "{[":
                found, at = _flow(text, at, names, "=")
                yield from found
            elif quoted := _QUOTED.match(text, at):
                yield _entry(names, _inner(quoted))
                at = quoted.end()
            else:
                yield _entry(names, _plain(text, at, r"#"))
        elif m := _TOML_SECTION.match(text, at):
            section = [p.strip().strip("\"'") for p in m[1].split(".")]
        at = _line_after(text, at)


def _quoted_or_plain(text: str, at: int, names: list[str], mark: str) -> tuple[Entry, int]:
    if (m := _QUOTED.match(text, at)) and re.compile(rf"[ \t]*(?:{mark}|\r?\n|\r?\Z)").match(text, m.end()):
        return _entry(names, _inner(m)), m.end()
    span = _plain(text, at, mark)
    return _entry(names, span), span[1]


_INI_KEY = re.compile(r"([^\s=:;#\[][^=:\n]*?)[ \t]*[=:][ \t]*")


def ini_entries(text: str) -> Iterator[Entry]:
    """Values of an INI text; indented lines go on with the value above."""
    section: list[str] = []
    at = 0
    while at < len(text):
        if m := _TOML_SECTION.match(text, at):
            section = [m[1].strip()]
        elif m := re.compile(r"[ \t]*").match(text, at):
            if key := _INI_KEY.match(text, m.end()):
                entry, end = _quoted_or_plain(text, key.end(), [*section, key[1]], r"[ \t][;#]")
                spans = list(entry.spans)
                at = _line_after(text, end)
                while (deep := re.compile(r"[ \t]+(?=[^\s;#])").match(text, at)) and not _INI_KEY.match(text, deep.end()):
                    spans.append(_plain(text, deep.end(), r"[ \t][;#]"))
                    at = _line_after(text, spans[-1][1])
                yield _entry([*section, key[1]], *spans)
                continue
        at = _line_after(text, at)


_PROPERTY = re.compile(r"[ \t]*((?:[^\s=:#!\\]|\\.)(?:[^\s=:\\]|\\[^\n])*)(?:[ \t]*[=:][ \t]*|[ \t]+)")


def properties_entries(text: str) -> Iterator[Entry]:
    """Values of a properties text; a line that ends with a backslash goes on."""
    at = 0
    while at < len(text):
        m = _PROPERTY.match(text, at)
        if not m:
            at = _line_after(text, at)
            continue
        spans, at = [], m.end()
        while True:
            end = _line_after(text, at)
            stop = len(text[at:end].rstrip("\r\n")) + at
            more = (stop - at - len(text[at:stop].rstrip("\\"))) % 2 == 1 and end < len(text)
            spans.append((at, stop - more))
            at = end
            if not more:
                break
            at = re.compile(r"[ \t]*").match(text, at).end()  # type: ignore[union-attr]
        yield _entry([m[1].replace("\\", "")], *spans)


_VARIABLE = re.compile(r"[ \t]*(?:export[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*=[ \t]*")


def env_entries(text: str) -> Iterator[Entry]:
    """Values of a file of environment variables."""
    at = 0
    while at < len(text):
        if m := _VARIABLE.match(text, at):
            entry, at = _quoted_or_plain(text, m.end(), [m[1]], r"[ \t]#")
            yield entry
        at = _line_after(text, at)


PARSERS: dict[str, Callable[[str], Iterator[Entry]]] = {
    "json": json_entries, "yaml": yaml_entries, "yml": yaml_entries, "toml": toml_entries, "ini": ini_entries, "properties": properties_entries, "env": env_entries,
}
