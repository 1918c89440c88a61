"""Grammars over token classes: rules in text, permissible pairs derived from them, and reduction of bracketed windows.

A language has token classes of one character each. A rule is a regular expression over classes, written with names:
``( ) | * + ?`` are operators, ``! X`` is a negative lookahead, names in capitals with a prefix ``P_ K_ B_ I_`` are
bracketed groups of a kind (round, square, curly, block), other names are earlier rules or token classes. As every bracketed group stands in
for one symbol, rules need no recursion: a text is reduced from its innermost brackets outwards, each window to a symbol
that names all kinds whose rule its content fulfils. A kind with a star (``B_BLOCK*``) is a sequence of items.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import regex

#: Besides the usual brackets, a pair of marks for blocks told by indentation or by words.
BRACKETS = {"(": "P", "[": "K", "{": "B", "\u27e6": "I"}
CLOSERS = {")": "(", "]": "[", "}": "{", "\u27e7": "\u27e6"}
#: First code points for groups of each bracket and for token classes.
_GROUPS = {"P": 0xE000, "K": 0xE200, "B": 0xE400, "I": 0xE600}
_CLASSES = 0xF000
#: Start and end of a text, and a token that no rule has.
START, END, UNKNOWN = "^", "$", "?"
_MARKS = {"semi": ";", "n": "n", "num": "0", "str": "s", "nl": "N", "line": "H", "unknown": UNKNOWN}
_RULE = re.compile(r"\w+|[()|*+?!]")


#: Rules that nest in themselves: what they matched once is not parsed anew when what follows fails, only left out.
ATOMIC = ("TARGS", "GEN")


@dataclass(frozen=True)
class Ends:
    """Whether an expression can be empty, and its first and last symbols."""

    empty: bool
    first: frozenset[str]
    last: frozenset[str]


_NOTHING = Ends(True, frozenset(), frozenset())


class Grammar:
    """The rules of a language: a pattern for each kind of bracketed group, and the pairs that all of them permit."""

    def __init__(self, rules: dict[str, str], kinds: dict[str, str], top: str) -> None:
        self.rules = rules
        self.chars: dict[str, str] = {}
        self.bits: dict[str, int] = {}
        per = dict.fromkeys(_GROUPS, 0)
        for kind in kinds:
            name = kind.rstrip("*")
            self.bits[name] = 1 << per[name[0]]
            per[name[0]] += 1
        self.sizes = {p: 1 << n for p, n in per.items()}
        self.kinds = {k.rstrip("*"): (rule, k.endswith("*")) for k, rule in kinds.items()} | {"TOP": (top, True)}
        self.text = {name: self._regex(rule) for name, rule in rules.items()}
        self.items: dict[str, list[tuple[int, bool, regex.Pattern[str], re.Pattern[str]]]] = {p: [] for p in _GROUPS}
        for name, (rule, many) in self.kinds.items():
            pattern = self._pattern(rule)
            if name == "TOP":
                self.whole = pattern
            else:
                self.items[name[0]].append((self.bits[name], many, pattern, self._alphabet(rule)))
        self.known: dict[tuple[str, str], str] = {}
        self.statements: dict[tuple[int, str], int] = {}

    def char(self, name: str) -> str:
        """The character of a token class."""
        if name in _MARKS:
            return _MARKS[name]
        if name not in self.chars:
            self.chars[name] = chr(_CLASSES + len(self.chars))
        return self.chars[name]

    def _regex(self, rule: str) -> str:
        out, negate = [], False
        for token in _RULE.findall(rule):
            if token == "!":
                negate = True
                continue
            if token == "(":
                piece = "(?:"
            elif token in "|*+?)":
                piece = token
            elif token in self.bits:
                base, bit = _GROUPS[token[0]], self.bits[token]
                piece = "[" + "".join(chr(base + m) for m in range(self.sizes[token[0]]) if m & bit) + "]"
            elif token in self.rules:
                piece = f"(?>(?&{token}))" if token in ATOMIC else f"(?&{token})"
            elif token == "EOT":
                piece = r"\Z"
            else:
                piece = regex.escape(self.char(token))
            out.append(f"(?!{piece})" if negate else piece)
            negate = False
        return "".join(out)

    def _used(self, rule: str) -> dict[str, None]:
        """The rules that a rule leads to."""
        used: dict[str, None] = {}
        todo = [rule]
        while todo:
            for token in _RULE.findall(todo.pop()):
                if token in self.rules and token not in used:
                    used[token] = None
                    todo.append(self.rules[token])
        return used

    def _alphabet(self, rule: str) -> re.Pattern[str]:
        """Texts of the symbols that a rule can have: what is cheap to test before the rule is."""
        symbols = set()
        for part in (rule, *(self.rules[name] for name in self._used(rule))):
            for token in _RULE.findall(part):
                if token in self.bits:
                    base, bit = _GROUPS[token[0]], self.bits[token]
                    symbols |= {chr(base + m) for m in range(self.sizes[token[0]]) if m & bit}
                elif token not in self.rules and token not in "()|*+?!" and token != "EOT":
                    symbols.add(self.char(token))
        return re.compile(f"[{re.escape(''.join(sorted(symbols)))}]*" if symbols else "")

    def _pattern(self, rule: str) -> regex.Pattern[str]:
        used = self._used(rule)
        define = "".join(f"(?P<{name}>{self.text[name]})" for name in used)
        return regex.compile(f"(?(DEFINE){define})(?:{self._regex(rule)})" if define else f"(?:{self._regex(rule)})")

    def reduce(self, bracket: str, content: str) -> str:
        """The symbol of a bracketed group, or UNKNOWN if its content fulfils no rule.

        How often a list repeats an item does not matter to any rule, so long lists are shortened first.
        """
        if len(content) > _LONG:
            content = self.repeats.sub(r"\1", content)
        found = self.known.get((bracket, content))
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            mask, prefix = 0, BRACKETS[bracket]
            for bit, many, pattern, alphabet in self.items[prefix]:
                if alphabet.fullmatch(content) and (self._sequence(pattern, content) if many else pattern.fullmatch(content)):
                    mask |= bit
            found = chr(_GROUPS[prefix] + mask) if mask else UNKNOWN
            self.known[bracket, content] = found
        return found

    def _sequence(self, item: regex.Pattern[str], content: str) -> bool:
        """Whether ``content`` is a sequence of items. Windows that end where an item may end are judged first, as they repeat."""
        at = 0
        while at < len(content):
            end = done = at
            for _ in range(_WINDOWS):
                end = _WINDOW.match(content, end).end()
                judged = self._judged(item, content[at:end])
                if judged == _WHOLE:
                    done = end
                    if not self._goes_on(content, end):
                        break
                elif judged != _OPEN:
                    done = done if done > at else at + judged
                    break
                if end == len(content):
                    break
            if done == at:  # a longer window was hoped for in vain
                m = item.match(content, at)
                done = m.end() if m else at
            if done == at:
                return False
            at = done
        return True

    def _judged(self, item: regex.Pattern[str], window: str) -> int:
        """_WHOLE if a window is an item, _OPEN if a longer one may be, else how long an item at its beginning is."""
        key, known = (id(item), window), self.statements
        found = known.get(key)
        if found is None:
            if item.fullmatch(window):
                found = _WHOLE
            elif item.fullmatch(window, partial=True):
                found = _OPEN
            else:
                m = item.match(window)
                found = m.end() if m else 0
            if len(known) > 200_000:
                known.clear()
            known[key] = found
        return found

    @cached_property
    def repeats(self) -> re.Pattern[str]:
        comma = re.escape(self.char("comma"))
        return re.compile(f"([^{comma}]{{1,6}}{comma})\\1+")

    def _goes_on(self, content: str, at: int) -> bool:
        """Whether the next symbol may belong to a statement that could also end here."""
        end, after_group = len(content), content[at - 1] not in ";N"
        if at < end and ("\ue600" <= content[at] < "\ue800" or after_group and content[at] in self.direct):
            return True
        while at < end and content[at] == "N":
            at += 1
        return at < end and content[at] in self.clauses

    def _chars_of(self, *words: str) -> frozenset[str]:
        return frozenset(self.chars[w] for w in words if w in self.chars)

    @cached_property
    def clauses(self) -> frozenset[str]:
        """Symbols that go on with a statement after its end, also on a later line."""
        return self._chars_of("else", "elif", "except", "catch", "finally", "dot", "qdot")

    @cached_property
    def direct(self) -> frozenset[str]:
        """Symbols that go on with a statement directly after a group."""
        words = (
            "comma", "assign", "bin", "plus", "quest", "star", "pipe", "and", "or", "amp", "redir", "if", "unless", "until", "rescue",
            "colon", "lt", "gt", "arrow", "thin", "do", "while", "as", "satisfies", "instanceof", "in", "set", "range",
        )
        return self._chars_of(*words) | frozenset(map(chr, range(0xE000, 0xE600))) | {"s"}

    def accepts(self, tokens: str) -> bool:
        """Whether a text's token classes nest and fulfil the rules."""
        frames: list[list[str]] = [[]]
        opened: list[str] = []
        at = 0
        for m in _ANY_BRACKET.finditer(tokens):
            frames[-1].append(tokens[at : m.start()])
            at = m.end()
            c = m.group()
            if c in BRACKETS:
                opened.append(c)
                frames.append([])
            else:
                if not opened or opened[-1] != CLOSERS[c]:
                    return False
                symbol = self.reduce(opened.pop(), "".join(frames.pop()))
                if symbol == UNKNOWN:
                    return False
                frames[-1].append(symbol)
        if opened:
            return False
        frames[0].append(tokens[at:])
        return self._sequence(self.whole, "".join(frames[0]))

    def pairs(self) -> frozenset[str]:
        """Adjacent pairs of token classes that the rules permit, with START and END."""
        out: set[str] = set()
        memo = dict.fromkeys(self.rules, Ends(False, frozenset(), frozenset()))
        before = None
        while before != memo:  # rules may refer to each other
            before = dict(memo)
            for name, rule in self.rules.items():
                memo[name] = self._ends(rule, memo, out)
        for name, (rule, many) in self.kinds.items():
            ends = self._ends(rule, memo, out)
            if many:
                out |= {a + b for a in ends.last for b in ends.first}
            a, b = (START, END) if name == "TOP" else next((o, c) for c, o in CLOSERS.items() if BRACKETS[o] == name[0])
            out |= {a + x for x in ends.first} | {x + b for x in ends.last}
            if many or ends.empty:
                out.add(a + b)
        return frozenset(out)

    def _ends(self, rule: str, memo: dict[str, Ends], out: set[str]) -> Ends:
        tokens = [*_RULE.findall(rule), ")"]
        at = 0

        def choice() -> Ends:
            nonlocal at
            parts, whole = [], _NOTHING
            while tokens[at] != ")":
                if tokens[at] == "|":
                    parts.append(whole)
                    whole, at = _NOTHING, at + 1
                    continue
                if tokens[at] == "!":
                    at += 2
                    continue
                if tokens[at] == "(":
                    at += 1
                    part = choice()
                else:
                    part = self._token_ends(tokens[at], memo, out)
                at += 1
                while tokens[at] in ("*", "+", "?"):
                    if tokens[at] != "?":
                        out.update(a + b for a in part.last for b in part.first)
                    part = Ends(part.empty or tokens[at] != "+", part.first, part.last)
                    at += 1
                out.update(a + b for a in whole.last for b in part.first)
                whole = Ends(
                    whole.empty and part.empty,
                    whole.first | part.first if whole.empty else whole.first,
                    whole.last | part.last if part.empty else part.last,
                )
            parts.append(whole)
            return Ends(any(p.empty for p in parts), frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)))

        return choice()

    def _token_ends(self, token: str, memo: dict[str, Ends], out: set[str]) -> Ends:
        if token == "EOT":
            return _NOTHING
        if token in self.rules:
            return memo[token]
        if token in self.bits:
            bracket = next(o for o, p in BRACKETS.items() if p == token[0])
            return Ends(False, frozenset(bracket), frozenset(c for c, o in CLOSERS.items() if o == bracket))
        c = frozenset(self.char(token))
        return Ends(False, c, c)


_ANY_BRACKET = re.compile("[()\\[\\]{}\u27e6\u27e7]")


#: So many windows are tried as one item before the item's whole pattern is.
_WINDOWS = 64
_WHOLE, _OPEN = -1, -2
#: Symbols of a group's content from which its lists are shortened.
_LONG = 100
#: A window: up to a mark that ends statements, a line end or a curly group, or what is left.
_WINDOW = re.compile("[^;N\ue400-\ue5ff]*(?:[;N\ue400-\ue5ff]|\\Z)")


class _ClassOf(dict):
    """Class of each token seen so far. Emptied when large, so that it holds no vocabulary of the corpus."""

    def __init__(self, base: dict[str, str], bad: str) -> None:
        super().__init__(base)
        self.base, self.bad = base, re.compile(bad)

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
            self.update(self.base)
        first = token[0]
        if first.isdigit() or first == "." and len(token) > 1:
            found = UNKNOWN if self.bad.fullmatch(token) else "0"
        else:
            found = "n" if first.isalpha() or first in "_$@" or not first.isascii() and token.isidentifier() else UNKNOWN
        self[token] = found
        return found


@dataclass
class Lexer:
    """Cuts a language's text into token classes.

    ``opaque`` matches comments (group ``c``), strings (``s``), numbers with marks (``k``) and whole lines such as directives
    (``l``); where the first pattern of ``deep`` is found, the second, which may be recursive, stands for it. What is left is cut
    into names, numbers (with ``dotted`` also those that begin with a dot) and operators, whose class is looked up; with
    ``members`` a keyword behind a dot is a name.
    """

    grammar: Grammar
    opaque: str
    keywords: str
    operators: dict[str, str]
    newlines: bool = False
    bad_number: str = r"(?!)"
    name: str = r"[^\W\d]\w*"
    members: bool = True
    dotted: bool = True
    deep: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        words = self.keywords.split()
        self.skip = re.compile(self.opaque, re.S | re.M)
        self.nested = (re.compile(self.deep[0]), regex.compile(self.deep[1], re.S | re.M)) if self.deep else None
        spelled = {o: self.grammar.char(name) for name, ops in self.operators.items() for o in ops.split()}
        classes = spelled | {w: self.grammar.char(w) for w in words} | {c: c for c in "()[]{}"}
        self.known = _ClassOf(classes | {"\x01": "s", "\x02": "H", "\x04": UNKNOWN, "\n": "N"}, self.bad_number)
        number = r"0[xX][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*" + (r"|(?<![\w.)\]])\.\d\w*" if self.dotted else "")
        ops = sorted((o for o in spelled if not o.isalnum() and len(o) > 1), key=len, reverse=True)
        self.tokens = re.compile(rf"{self.name}|[\n\x01(){{}}\[\],;]|{number}|{'|'.join(map(re.escape, ops))}|\S")
        dots = "".join(self.grammar.char(d) for d in ("dot", "qdot") if d in self.operators)
        keys = "".join(map(self.grammar.char, words))
        self.member = re.compile(f"(?<=[{re.escape(dots)}])[{re.escape(keys)}]" if dots and self.members else "(?!)")

    @staticmethod
    def _opaque(m: re.Match[str]) -> str:
        if m.lastgroup == "c":
            return "\n" if "\n" in m.group() else " "
        if m.lastgroup == "l":
            return "\x02\n"
        if m.lastgroup == "k":
            return "0"
        return "\x01"

    def bare(self, text: str) -> str:
        """The text without comments, with marks for strings."""
        return self.skipping(text).sub(self._opaque, text)

    def skipping(self, text: str) -> re.Pattern[str] | regex.Pattern[str]:
        """The pattern of what is no token: the recursive one where a string may hold expressions with strings."""
        return self.nested[1] if self.nested and self.nested[0].search(text) else self.skip

    def classes(self, bare: str) -> str:
        """Token classes of a text without comments and strings, all line ends as ``N``."""
        return self.member.sub("n", "".join(map(self.known.__getitem__, self.tokens.findall(bare))))

    def lex_bare(self, bare: str) -> str:
        """As ``lex``, of a text without comments and strings."""
        found = self.classes(bare)
        return found if self.newlines else found.replace("N", "")

    def lex(self, text: str) -> str:
        """Token classes of a text; line ends are ``N`` where they matter."""
        return self.lex_bare(self.bare(text))
