"""Scalar functions over identifiers, paths and chat texts, as column expressions.

Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that continue an identifier.
WORD = r"\p{L}\p{N}_"

# Names of languages by extension, in exports and in code fences, and the languages of a map's legend.
EXPORT_LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "jsx": "React", "tsx": "React TypeScript", "java": "Java", "cs": "C#", "go": "Go",
    "rs": "Rust", "c": "C", "cpp": "C++",
}
FENCE_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java",
    "cs": "csharp", "cpp": "cpp", "c": "c", "rb": "ruby", "php": "php",
}
PASTE_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java",
    "cs": "csharp", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash",
    "lua": "lua", "r": "r", "kt": "kotlin", "swift": "swift", "ex": "elixir", "exs": "elixir", "zig": "zig",
}
# Words by which a question asks for a failure or for the design.
BUG_WORDS = (
    r"fail|crash|bug|error|wrong|break|edge\s*cases?|exception|undefined|null|infinite|race\s+condition|race(?!\w)|leak|off-by|incorrect|fix|track"
    r"|simulate|step\s*through|trace|will\s+(?:this|it)\s+(?:fail|crash|break|error|work)"
)
DESIGN_WORDS = (
    r"architecture|design|relate|depend|module|structure|pattern|connect|who\s+calls|what\s+calls|relationship|coupling|cohesion|refactor|compare"
    r"|difference|how\s+does\s+.+\s+fit"
)
# Patterns by which a pasted text looks like code, and those that name its language, in order.
CODE_PATTERNS = (
    r"^\s*(def |async def |class |import |from .+ import)", r"^\s*(function |const |let |var |class |import |export |=>)",
    r"^\s*(fn |pub fn |use |impl |struct |enum |mod )", r"^\s*(func |package |import \()", r"^\s*(public|private|protected|static)\s+\w",
    r"[{};]$", r"#include|#define|#pragma", r"^\s*(sub |my \$|use )", r"^\s*(def |end$|require )",
)
PASTE_PATTERNS = (
    ("python", r"^\s*(def |async def |class .+:|from .+ import|import \w)"), ("rust", r"^\s*(fn |pub fn |use |impl |struct |enum )"),
    ("go", r"^\s*(func |package main|import \()"), ("javascript", r"^\s*(function |const |let |var |=>|import .+ from|export )"),
    ("java", r"^\s*(public|private|void|class .+\{)"), ("cpp", r"#include|#define"), ("perl", r"^\s*(sub |my \$|use strict)"),
    ("ruby", r"^\s*(def .+|end$|require ['\"]\w)"),
)


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def name_from_label(label: Column) -> Column:
    """A label without call marks and without the decorator before it."""
    return F.element_at(F.split(F.replace(label, F.lit("()"), F.lit("")), r"\] "), -1)


def path_of_id(node_id: Column) -> Column:
    """The path within an id ``type:path:name``; null for an id of one part."""
    return F.try_element_at(F.split(node_id, ":"), F.lit(2))


def unified_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def last_part(path: Column) -> Column:
    """The last component of a path, trailing slashes aside."""
    return F.element_at(F.split(F.regexp_replace(unified_path(path), "/+$", ""), "/"), -1)


def short_path(path: Column) -> Column:
    """A path cut to its last two components; null and empty give empty."""
    parts = F.split(unified_path(path), "/")
    short = F.when(F.size(parts) <= 2, F.array_join(parts, "/")).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(short)


def extension(name: Column) -> Column:
    """The extension in lower case with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(last_part(name), r"[^.].*(\.[^.]*)$|^[^.](\.[^.]*)$", 1))


def clone_url(text: Column) -> Column:
    """The text from its last ``https://`` on, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)^.*(https://)", "$1"))


def export_language(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(EXPORT_LANGUAGES), ext), F.upper(ext))


def fence_language(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(FENCE_LANGUAGES), ext), F.when(ext == "", "text").otherwise(ext))


def question_kind(text: Column) -> Column:
    """``bug``, ``architecture`` or ``explain``; null counts as no question, which is ``explain``."""
    asked = F.lower(F.coalesce(text, F.lit("")))
    return F.when(asked.rlike(rf"\b(?:{BUG_WORDS})\b"), "bug").when(asked.rlike(rf"\b(?:{DESIGN_WORDS})\b"), "architecture").otherwise("explain")


def looks_like_code(text: Column) -> Column:
    """Whether a text of several lines is code: two indented lines or a structural pattern. Null is none."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")) != "")
    indented = F.size(F.filter(lines, lambda line: line.rlike(r"^[ \t]+\S")))
    pattern = text.rlike("(?m)" + "|".join(f"(?:{p})" for p in CODE_PATTERNS))
    return F.coalesce(text.contains("\n") & (F.size(lines) >= 2) & ((indented >= 2) | pattern), F.lit(False))


def paste_language(text: Column, selected_id: Column) -> Column:
    """The language of a pasted text: of the selected node's extension, else by patterns in order, else empty."""
    chosen = F.try_element_at(_map(PASTE_LANGUAGES), F.lower(F.element_at(F.split(F.coalesce(path_of_id(selected_id), F.lit("")), r"\."), -1)))
    guess = F.lit("")
    for language, pattern in reversed(PASTE_PATTERNS):
        guess = F.when(text.rlike(f"(?m){pattern}"), language).otherwise(guess)
    return F.coalesce(chosen, guess)


def without_math(text: Column) -> Column:
    """Block formulas as fenced code, inline formulas as code spans."""
    block = F.regexp_replace(text, r"\$\$\s*([\s\S]+?)\s*\$\$", "```\n$1\n```")
    return F.regexp_replace(block, r"\$([^$\n]+?)\$", "`$1`")


def rolling_hash(text: Column) -> Column:
    """The 32-bit hash ``h * 31 + c`` over UTF-16 units, its absolute value in base 36.

    Units come from the big-endian encoding, so characters beyond the first plane count as their two surrogates.
    """
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0))

    def step(h: Column, unit: Column) -> Column:
        low = F.pmod(h * 31 + F.conv(unit, 16, 10).cast("bigint"), F.lit(1 << 32))
        return low

    h = F.aggregate(units, F.lit(0).cast("bigint"), step)
    signed = F.when(h >= (1 << 31), h - (1 << 32)).otherwise(h)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))


def node_colour(kind: Column) -> Column:
    """Presentation: a colour by node type."""
    return F.when(kind == "root", "#ffffff").when(kind == "file", "#2492ce").when(kind == "class", "#ffb347").otherwise("#a3ff5c")


def node_radius(kind: Column) -> Column:
    return F.when(kind == "root", 20).when(kind == "file", 15).otherwise(12)
