"""Python, Ruby and shell: languages whose blocks are told by indentation or by words, in the notation of ``grammar``."""

from __future__ import annotations

import re

from graphmill.llm.grammar import UNKNOWN, Grammar, Lexer

OPEN, CLOSE = "⟦", "⟧"

# --- Python ------------------------------------------------------------------------------------------------------------

_PY_WORDS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda"
    " nonlocal not or pass raise return try while with yield"
)
_PY_OPERATORS = {
    "assign": "=", "thin": "->", "plus": "+ -", "star": "*", "power": "**", "lt": "<", "gt": ">", "pipe": "|", "tilde": "~", "colon": ":",
    "semi": ";", "comma": ",", "dot": ".", "dots": "...", "at": "@", "define": ":=", "slash": "/",
    "bin": "// % ^ & == != <= >= << >>", "set": "+= -= *= /= //= %= &= |= ^= <<= >>= **= @=",
}
_PY_RULES = {
    "PRIM": "n | num | str + | dots | P_TUPLE | K_LIST | B_DICT",
    "POST": "dot n | P_ARGS | K_INDEX",
    "LAMBDA": "lambda ( LPARAM ( comma LPARAM ) * comma ? ) ? colon",
    "LPARAM": "n ( assign EXPR ) ? | star n ? | power n | slash",
    "PRE": "plus | tilde | not | await | LAMBDA",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | power | slash | lt | gt | pipe | at | and | or | not ? in | is not ? | define",
    "CHAIN": "UNARY ( ( OP ) UNARY ) *",
    "EXPR": "CHAIN ( if CHAIN else CHAIN ) * | yield from EXPR | yield ( EXPRS ) ?",
    "ITEM": "star ? EXPR",
    "EXPRS": "ITEM ( comma ITEM ) * comma ?",
    "TARGETS": "star ? UNARY ( comma star ? UNARY ) * comma ?",
    "COMP": "( async ? for TARGETS in CHAIN ( if CHAIN ) * ) +",
    "PARAM": "n ( colon EXPR ) ? ( assign EXPR ) ? | star ( n ( colon EXPR ) ? ) ? | power n ( colon EXPR ) ? | slash",
    "NAMES": "n ( dot n ) * ( as n ) ? ( comma n ( dot n ) * ( as n ) ? ) *",
    "SIMPLE": "EXPRS ( assign EXPRS ) * | UNARY colon EXPR ( assign EXPRS ) ? | UNARY set EXPRS | return EXPRS ? | raise ( EXPR ( from EXPR ) ? ) ? | import NAMES"
    " | from ( dot | dots ) * ( n ( dot n ) * ) ? import ( star | P_NAMES | n ( as n ) ? ( comma n ( as n ) ? ) * ) | pass | break | continue | del TARGETS"
    " | assert EXPR ( comma EXPR ) ? | ( global | nonlocal ) n ( comma n ) *",
    "LINE": "SIMPLE ( semi SIMPLE ) * semi ? nl",
    "SUITE": "nl I_BLOCK | LINE",
    "AS": "EXPR ( as UNARY ) ?",
    "STMT": "( at EXPR nl ) * ( async ? def n P_PARAMS ( thin EXPR ) ? colon SUITE | class n P_ARGS ? colon SUITE ) | if EXPR colon SUITE ( elif EXPR colon SUITE ) * ( else colon SUITE ) ?"
    " | while EXPR colon SUITE ( else colon SUITE ) ? | async ? for TARGETS in EXPRS colon SUITE ( else colon SUITE ) ?"
    " | try colon SUITE ( except star ? ( EXPR ( comma EXPR ) * ( as n ) ? ) ? colon SUITE ) * ( else colon SUITE ) ? ( finally colon SUITE ) ?"
    " | async ? with ( AS ( comma AS ) * | P_AS ) colon SUITE | n EXPRS ( as n ) ? ( if EXPR ) ? colon nl I_BLOCK | LINE",
}
_PY_KINDS = {
    "P_TUPLE": "( EXPRS | EXPR COMP ) ?",
    "P_ARGS": "( ( star | power ) ? ( n assign ) ? EXPR ( comma ( star | power ) ? ( n assign ) ? EXPR ) * comma ? | EXPR COMP ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * comma ? ) ?",
    "P_NAMES": "n ( as n ) ? ( comma n ( as n ) ? ) * comma ?",
    "P_AS": "AS ( comma AS ) * comma ?",
    "K_LIST": "( EXPRS | EXPR COMP ) ?",
    "K_INDEX": "( ITEM | EXPR ? colon EXPR ? ( colon EXPR ? ) ? ) ( comma ( ITEM | EXPR ? colon EXPR ? ( colon EXPR ? ) ? ) ) * comma ?",
    "B_DICT": "( EXPRS | EXPR COMP | ( EXPR colon EXPR | power EXPR ) ( comma ( EXPR colon EXPR | power EXPR ) ) * comma ? | EXPR colon EXPR COMP ) ?",
    "I_BLOCK*": "STMT",
}
_PY_OPAQUE = (
    r"(?P<c>\#[^\n]*)|(?P<s>[rbufRBUF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''"
    r"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))"
)


class PythonLexer(Lexer):
    """Adds blocks by indentation: logical lines end with ``N``, blocks stand between marks."""

    def lex(self, text: str) -> str:
        if "\\\n" in text or "\\\r\n" in text:
            text = re.sub(r"\\\r?\n", " ", text)
        out: list[str] = []
        stack, depth = [0], 0
        bare = self.bare(text.expandtabs(8) if "\t" in text else text)
        for line, cut in zip(bare.split("\n"), self.classes(bare).split("N"), strict=True):
            if not cut:
                continue
            if depth == 0:
                indent = len(line) - len(line.lstrip(" \f"))
                if indent > stack[-1]:
                    stack.append(indent)
                    out.append(OPEN)
                else:
                    while indent < stack[-1]:
                        stack.pop()
                        out.append(CLOSE)
                    if indent != stack[-1]:
                        out.append(UNKNOWN)
            if depth or "(" in cut or "[" in cut or "{" in cut:
                depth = max(0, depth + sum(map(cut.count, "([{")) - sum(map(cut.count, ")]}")))
            out.append(cut)
            if depth == 0:
                out.append("N")
        if depth:
            out.append(UNKNOWN)
        return "".join([*out, *[CLOSE] * (len(stack) - 1)])


def python_lexer() -> Lexer:
    bad = r"0[0-9_]*[1-9][0-9_]*"
    return PythonLexer(Grammar(_PY_RULES, _PY_KINDS, "STMT"), _PY_OPAQUE, _PY_WORDS, _PY_OPERATORS, bad_number=bad, members=False)


# --- Ruby --------------------------------------------------------------------------------------------------------------

_RB_WORDS = (
    "alias and begin break case class def do else elsif end ensure for if in module next not or redo rescue retry return then"
    " undef unless until when while yield"
)
_RB_OPERATORS = {
    "assign": "=", "arrow": "=>", "thin": "->", "plus": "+ -", "star": "* **", "lt": "<", "gt": ">", "amp": "&", "pipe": "|", "not": "! ~",
    "quest": "?", "colon": ":", "scope": "::", "semi": ";", "comma": ",", "dot": ". &.", "range": ".. ...", "shift": "<<",
    "bin": "/ % ^ == != === =~ !~ <= >= <=> && || >>", "set": "+= -= *= /= %= &= |= ^= <<= >>= **= &&= ||=",
}
_RB_RULES = {
    "END": "( semi | nl ) + | EOT",
    "PRIM": "n | num | str + | P_ARGS | K_LIST | B_HASH | I_ANY | thin P_PARAMS ? ( B_BODY | I_ANY ) | colon n | colon str | scope n | yield | return | next | break | redo | retry",
    "POST": "dot ( n | P_ARGS ) | scope n | P_ARGS | K_LIST | B_BODY | I_ANY",
    "PRE": "plus | not | star | amp | range",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | shift | amp | pipe | assign | set | range | and | or | arrow | in",
    "ARG": "( n | str ) colon EXPR ? | EXPR",
    "COMMAND": "( n | yield | return | next | break ) ( dot n | scope n ) * | ( UNARY ) dot n",
    "CALL": "( COMMAND ) ARG ( comma nl * ARG ) * ( I_ANY ) ?",
    "EXPR": "( not ) * ( CALL | UNARY ( ( OP ) nl ? ( not ) * UNARY ) * ( quest EXPR colon EXPR ) * ( ( OP ) nl ? CALL ) ? ) ( range ) ?",
    "EXPRS": "ARG ( comma nl * ARG ) *",
    "MODS": "( ( if | unless | while | until | rescue ) EXPR ) *",
    "STMT": "nl | semi | EXPRS ( assign EXPRS ) * MODS END | ENDLESS END | alias ( n | colon n ) ( n | colon n ) END | undef n END",
    "ENDLESS": "( n ) * def NAME P_PARAMS ? assign nl ? EXPRS MODS",
    "FORMAL": "( star | amp ) ? n ( assign EXPR | colon EXPR ? ) ? | star | P_ARGS",
    "FORMALS": "FORMAL ( comma FORMAL ) *",
    "NAME": "n ( ( dot | scope ) ( n | class ) ) * ( assign ) ? | bin | plus | star | K_LIST | lt | gt | shift | class | end | in",
    "CLAUSE": "else | ensure | elsif EXPR ( then | END ) | when EXPRS ( then | END ) | rescue ( n ( scope n ) * ( comma n ( scope n ) * ) * ) ? ( arrow n ) ? ( then | END ) | in EXPRS MODS ( then | END )",
    "OPEN": "def NAME ( P_PARAMS END ? | ( FORMALS ) ? END ) | class ( shift n | n ( scope n ) * ( lt EXPR ) ? ) END | module n ( scope n ) * END | begin | case EXPR ? END"
    " | ( if | unless ) EXPR ( then | END ) | ( while | until ) EXPR ( do | END ) | for n ( comma n ) * in EXPR ( do | END ) | do ( pipe ( FORMALS ) ? ( semi n ) ? pipe ) ?",
}
_RB_KINDS = {
    "P_ARGS": "nl * ( ( ARG | amp | star ) ( comma nl * ARG ) * comma ? nl * | ( STMT ) + ) ?",
    "P_PARAMS": "nl * ( FORMAL ( comma nl * FORMAL ) * nl * ) ?",
    "K_LIST": "nl * ( ARG ( comma nl * ARG ) * comma ? nl * ) ?",
    "B_HASH": "nl * ( ARG ( comma nl * ARG ) * comma ? nl * ) ?",
    "B_BODY*": "pipe ( FORMALS ) ? pipe | STMT",
    "I_ANY*": "OPEN | CLAUSE | STMT | EXPRS ( assign EXPRS ) * MODS CLAUSE",
}
_RB_OPAQUE = (
    r"(?P<c>\#[^\n]*|^=begin\b.*?^=end[^\n]*)"
    r"|(?P<h><<[~-]?(?P<q>['\"]?)(?P<d>[A-Z]\w*)(?P=q)[^\n]*\n(?:.*?\n)??[ \t]*(?P=d)[ \t\r]*$)"
    r"|(?P<s>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`\n]*`|%[wWiIqQrsx]?(?:\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)|\{(?:[^{}]|\{[^{}]*\})*\}))"
    r"|(?P<x>(?:(?<=[=(,:\[!&|?{};~])|(?<=[=(,:\[!&|?{};~] )|(?<=return )|(?<=when )|(?<=if )|(?<=^))/(?![*/\n])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
)


# A string within a string's expression needs recursion.
_RB_DEEP = (
    r"\#\{[^}\"]*\"",
    _RB_OPAQUE.replace(r"(?P<s>\"(?:[^\"\\]|\\.)*\"", r"(?P<s>(?P<t>\"(?:[^\"\\#]|\\.|\#(?!\{)|\#(?P<b>\{(?:[^{}\"']|'(?:[^'\\]|\\.)*'|(?&b)|(?&t))*\}))*\")"),
)


class RubyLexer(Lexer):
    """Adds marks around the blocks that words open and ``end`` closes; a definition by ``=`` opens none."""

    def lex(self, text: str) -> str:
        marked: dict[str, str] = self.__dict__.setdefault("marked", {})
        if len(marked) > 200_000:
            marked.clear()
        return "N".join([marked[line] if line in marked else marked.setdefault(line, self._blocks(line)) for line in self.classes(self.bare(text)).split("N")])

    def _blocks(self, line: str) -> str:
        char = self.grammar.char
        always = {char(w) for w in ("def", "class", "module", "begin", "case")}
        leading = {char(w) for w in ("if", "unless", "while", "until", "for")}
        loops = {char(w) for w in ("while", "until", "for")}
        before = {"", ";", "(", *map(char, ("assign", "set", "then", "do", "else", "shift"))}
        out, previous, loop = [], "", False
        endless = re.search(rf"{char('def')}(?:n{char('dot')})?n(?:\((?:[^()]|\([^()]*\))*\){char('assign')}|{char('assign')}(?!\())", line)
        for at, c in enumerate(line):
            if previous == char("dot") or c in always and previous == char("colon") or endless and at == endless.start():
                out.append(c)
            elif c in always or c in leading and previous in before:
                out += [OPEN, c]
                loop = loop or c in loops
            elif c == char("do"):
                out += [c] if loop else [OPEN, c]
                loop = False
            elif c == char("end"):
                out.append(CLOSE)
            else:
                out.append(c)
            previous = c
        return "".join(out)


def ruby_lexer() -> tuple[Lexer, re.Pattern[str]]:
    name = r"(?:@{1,2}|\$)?[^\W\d]\w*[?!]?(?![=\w])|(?:@{1,2}|\$)?[^\W\d]\w*|\$\d+|\$-\w|\$\W"
    lexer = RubyLexer(Grammar(_RB_RULES, _RB_KINDS, "STMT"), _RB_OPAQUE, _RB_WORDS, _RB_OPERATORS, name=name, bad_number=r"0\d*[89]\d*", deep=_RB_DEEP)
    join = re.escape("".join(map(lexer.grammar.char, ("bin", "assign", "set", "comma", "arrow", "dot", "and", "or"))))
    return lexer, re.compile(rf"(?<=[{join}])N+|N+(?=[{re.escape(lexer.grammar.char('dot'))}])|(?<=N)N+")


# --- Shell -------------------------------------------------------------------------------------------------------------

_SH_RULES = {
    "REDIR": "redir n",
    "COMMAND": "( n | list P_ARRAY | REDIR ) +",
    "GROUP": "( I_IF | I_LOOP | I_CASE | I_GROUP | P_SUB ) ( REDIR ) *",
    "FUNCTION": "n P_EMPTY nl * GROUP | function n P_EMPTY ? nl * GROUP",
    "PART": "bang * ( FUNCTION | GROUP | COMMAND )",
    "ANDOR": "PART ( ( pipe | and ) nl * PART ) *",
    "STMT": "ANDOR ( nl | semi nl * | amp nl * | EOT ) | nl",
    "LIST": "nl * ( ANDOR ( nl | semi | amp ) nl * ) +",
}
_SH_KINDS = {
    "P_SUB*": "STMT",
    "P_ARRAY": "( n | nl ) *",
    "P_EMPTY": "EOT",
    "P_PATTERN": "n ( pipe n ) *",
    "I_IF": "if LIST then LIST ( elif LIST then LIST ) * ( else LIST ) ? fi",
    "I_LOOP": "( ( while | until ) LIST | ( for | select ) n ( nl * in n * ) ? ( semi | nl ) nl * | for n semi ? nl * ) do LIST done",
    "I_CASE": "case n nl * in nl * ( P_PATTERN nl * ( LIST | ANDOR ) ? nl * ( ANDOR ) ? ( dsemi nl * | ! n ) ) * esac",
    "I_GROUP": "open LIST ( ANDOR ) ? close",
}
SHELL_OPAQUE = re.compile(
    r"(?P<c>(?:^|(?<=[\s;&|(]))#[^\n]*)"
    r"|(?P<h><<-?[ \t]*(?P<q>['\"]?)(?P<d>\w+)(?P=q)(?P<rest>[^\n]*)\n(?:.*?\n)??[ \t]*(?P=d)[ \t\r]*(?=\n|\Z))"
    r"|(?P<w>\$'(?:[^'\\]|\\.)*'|'[^']*'|\$?\"(?:[^\"\\]|\\.)*\"|\$\(\((?:[^()]|\([^()]*\))*\)\)|`(?:[^`\\]|\\.)*`"
    r"|\$\{(?:[^{}]|\{[^{}]*\})*\}|(?:^|(?<=[\s;!]))\[\[\s.*?\s\]\]|(?:^|(?<=[\s;]))\(\((?:[^()]|\([^()]*\))*\)\)|\\[^\n])"
    r"|(?P<j>\\\r?\n)",
    re.S | re.M,
)
_SH_TOKENS = re.compile(r";;&?|;&|&&|\|\||\|&|<<<|<<-?|\d?>>|\d?[<>]&\d?-?|&>>?|<>|>\||\d?[<>]|[;&|()\n'\"`]|\$\(|[^\s;&|<>()'\"`]+")
#: A case within a command substitution, whose patterns close brackets that none opens.
_CASE_WITHIN = re.compile(r"(\$\([^()`]*?)\bcase\s(?:(?!\bcase\b|\besac\b)[^`])*?\besac\b")
_SH_RESERVED = {"if", "then", "elif", "else", "fi", "for", "while", "until", "select", "do", "done", "case", "esac", "function"}


class ShellLexer:
    """Token classes of shell text: words are reserved by their place, so lines can't be cut on their own."""

    def __init__(self) -> None:
        self.grammar = Grammar(_SH_RULES, _SH_KINDS, "STMT")

    @staticmethod
    def _opaque(m: re.Match[str]) -> str:
        if m.lastgroup == "c":
            return ""
        if m.lastgroup == "j":
            return " "
        return f"<S{m['rest']}" if m["h"] else "S"

    def lex(self, text: str) -> str:
        char, out = self.grammar.char, []
        start, nested, words = True, 0, []
        cases: list[int] = []
        bare = SHELL_OPAQUE.sub(self._opaque, text)
        previous = ""
        while previous != bare:  # a command substitution is a word, and what is within must nest
            previous, bare = bare, re.sub(r"[$<>]\([^()`]*\)", "S", _CASE_WITHIN.sub(r"\1 S", bare))
        for t in _SH_TOKENS.findall(bare):
            if t in ("\n", ";", "&", "|", "|&", "&&", "||", ";;", ";&", ";;&"):
                out.append("N" if t == "\n" else char({";": "semi", "&": "amp", "|": "pipe", "|&": "pipe", "&&": "and", "||": "and"}.get(t, "dsemi")))
                start, words = True, []
            elif t in "()":
                if t == ")" and cases and cases[-1] == nested:  # the end of a pattern that had no opening mark
                    k = len(out)
                    while k and out[k - 1] in ("n", char("pipe")):
                        k -= 1
                    out.insert(k, "(")
                else:
                    nested += 1 if t == "(" else -1
                out.append(t)
                start, words = True, []
            elif t in "'\"`" or t == "$(":
                out.append(UNKNOWN)
            elif re.match(r"\d?[<>]|&>", t):
                if not re.fullmatch(r"\d?[<>]&(?:\d-?|-)", t):
                    out.append(char("redir"))
            elif start and t in _SH_RESERVED or len(words) == 2 and (t == "in" and words[0] in ("for", "case", "select") or t == "do" and words[0] == "for"):
                if t in ("if", "while", "until", "for", "select", "case"):
                    out.append(OPEN)
                if t == "case":
                    cases.append(nested)
                if t == "esac" and cases:
                    cases.pop()
                out.append(char(t))
                if t in ("fi", "done", "esac"):
                    out.append(CLOSE)
                words = [t] if t in ("for", "select", "case", "function") else []
                start = t not in ("for", "select", "case", "in", "function", "fi", "done", "esac") or t == "in" and bool(cases)
            elif start and t == "{":
                out += [OPEN, char("open")]
            elif start and t == "}":
                out += [char("close"), CLOSE]
                start = False
            elif start and t == "!":
                out.append(char("bang"))
            else:
                out.append(char("list") if t.endswith("=") else "n")
                words.append(t)
                # After a function's name its body may follow on the same line.
                start = words[:1] == ["function"]
        return re.sub(rf"{re.escape(char('list'))}(?!\()", "n", re.sub(r"N+", "N", "".join(out)))
