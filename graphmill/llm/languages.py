"""Lexical rules and grammars of the languages that ``syntax_check`` knows, in the notation of ``grammar``."""

from __future__ import annotations

import re
from functools import lru_cache

from graphmill.llm.block_languages import ShellLexer, python_lexer, ruby_lexer
from graphmill.llm.grammar import Grammar, Lexer

_STRING = r"(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
_CHAR = r"(?P<s>L?\"(?:[^\"\\\n]|\\.)*\"|L?'(?:[^'\\\n]|\\[^\n])[^'\n]{0,8}')"
_C_COMMENT = r"(?P<c>//[^\n]*|/\*.*?\*/)"
_DIRECTIVE = r"(?P<l>^[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\|//[^\n]*|/\*.*?\*/|/)*(?:\n|\Z))"
_REGEX = r"(?P<x>(?:(?<=[=(,:\[!&|?{};>\n])[ \t]*|(?<=return )|(?<=typeof )|(?<=case )|\A)/(?![*/\n])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"

_OPERATORS = {
    "inc": "++ --", "assign": "=", "arrow": "=>", "thin": "->", "plus": "+ -", "star": "*", "lt": "<", "gt": ">", "amp": "&",
    "pipe": "|", "not": "! ~", "quest": "?", "colon": ":", "scope": "::", "semi": ";", "comma": ",", "dot": ".", "qdot": "?.",
    "spread": "...", "at": "@", "hash": "#",
    "bin": "/ % ^ ** == != === !== <= >= && || ?? <<", "set": "+= -= *= /= %= &= |= ^= <<= >>= **= &&= ||= ??=",
}
#: Those of the languages without powers and the like, where two stars are two tokens.
_C_OPERATORS = _OPERATORS | {"bin": "/ % ^ == != <= >= && || <<", "set": "+= -= *= /= %= &= |= ^= <<= >>="}

# --- JavaScript and TypeScript -----------------------------------------------------------------------------------------

_JS_WORDS = (
    "async await break case catch class const continue debugger default delete do else export extends finally for from"
    " function if import in instanceof let new of return static switch throw try typeof var void while with yield get set as"
)
_JS_RULES = {
    "ID": "n | from | of | as | get | set | async | static {more}",
    "END": "( semi | nl ) + | EOT",
    "TITEM": "spread ? ( ID quest ? colon ) ? TYPE quest ?",
    "TPARAM": "const ? in ? ID ( extends TYPE ) ? ( assign TYPE ) ?",
    "KEY": "{keys} ID | str | num | K_LIST | await | break | case | catch | class | const | continue | default | delete | do | else"
    " | export | extends | finally | for | function | if | import | in | let | new | return | switch | throw | try | typeof"
    " | var | void | while | with | yield",
    "TNAME": "( ID | import P_ARGS ) ( dot ID ) *",
    "TARGS": "lt TYPE ( comma TYPE ) * comma ? gt",
    "TONE": "( {readonly} | typeof ) * ( TNAME | str | num | plus num | B_SHAPE | K_TYPES | P_TYPES | void ) ( TARGS ) ? ( K_TYPES ) *",
    "TALL": "( pipe | amp ) ? ( TFUNC | TONE ( ( pipe | amp ) TONE ) * ( ( pipe | amp ) TFUNC ) ? )",
    "TFUNC": "abstract ? new ? GEN P_PARAMS arrow ( asserts ? ID is ) ? TYPE",
    "TYPE": "TALL ( extends TALL quest TYPE colon TYPE ) ?",
    "DECO": "at TNAME {targs} P_ARGS ? nl *",
    "HERIT": "( ID | P_ARGS ) ( dot ID | P_ARGS | K_LIST ) * {targs}",
    "FSIG": "async ? function star ? ID GEN P_PARAMS RET END",
    "ANN": "{ann}",
    "RET": "{ann}",
    "GEN": "{gen}",
    "FUNC": "async ? function star ? ID ? GEN P_PARAMS RET B_BLOCK",
    "NAMED": "async ? function star ? ID GEN P_PARAMS RET B_BLOCK | ( DECO ) * {abstract} class ID GEN ( extends HERIT ) ? {implements} B_CLASS",
    "HEAD": "async ? ( ID | GEN P_PARAMS RET ) arrow",
    "CLASS": "( DECO ) * {abstract} class ID ? GEN ( extends HERIT ) ? {implements} B_CLASS",
    "PRIM": "FUNC | CLASS | HEAD B_BLOCK | ID | num | str | P_ARGS | K_LIST | B_OBJ | import ( P_ARGS | dot n ) | new dot n | yield",
    "POST": "( dot | qdot ) ID | qdot ? P_ARGS | qdot ? K_LIST | str | inc {bang} | ( dot | qdot ) hash n",
    "PRE": "plus | not | inc | typeof | void | delete | await | yield star ? | new | spread | HEAD {cast} | hash n in",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) * {asserts}",
    "OP": "bin | plus | star | lt | gt | gt gt | gt gt gt | gt set | amp | pipe | assign | set | in | instanceof",
    "CHAIN": "UNARY ( ( OP ) UNARY ) *",
    "EXPR": "CHAIN ( quest EXPR colon EXPR ) ?",
    "EXPRS": "EXPR ( comma EXPR ) *",
    "BIND": "ID | B_OBJ | K_LIST",
    "PARAM": "( DECO ) * {access} spread ? ( BIND ) {opt} ANN ( assign EXPR ) ?",
    "DECL": "( BIND ) {sure} ANN ( assign EXPR ) ?",
    "DECLS": "( const | let | var ) nl * DECL ( comma DECL ) *",
    "LOOP": "if P_ARGS nl * | for await ? P_FOR nl * | while P_ARGS nl * | ID colon nl *",
    "TRY": "try B_BLOCK ( nl * catch P_PARAMS ? B_BLOCK ) ? ( nl * finally B_BLOCK ) ?",
    "IMPORT": "import str END | import {type} ( ID comma ) ? ( ID | star as ID | B_NAMES ) from str END {requires}",
    "EXPORT": "( DECO ) * export ( {type} star ( as ( ID | default | str ) ) ? from str END | {type} B_NAMES ( from str ) ? END | default ( FUNC | CLASS {iface} ) END ? {deflt} | default EXPR END"
    " | DECLS END | NAMED END ? {exports} )",
    "PLAIN": "B_BLOCK | semi | DECLS END | NAMED END ? | return EXPRS ? END | throw EXPRS END | ( break | continue ) ID ? END"
    " | TRY | switch P_ARGS B_SWITCH | debugger END | ! B_OBJ ! class ! function EXPRS END {types}",
    "CORE": "( LOOP ) * ( PLAIN | do ( LOOP ) * ( PLAIN ) nl * while P_ARGS END )",
    "STMT": "( LOOP ) * if P_ARGS nl * CORE ( nl * else nl * CORE ) + | CORE | nl",
    "BOUND": "{type} ( ID | default | str ) ( as KEY ) ?",
    "PROP": "KEY colon EXPR | ID ( assign EXPR ) ? | spread CHAIN | METHOD",
    "MOD": "static | async | get | set | star {mods}",
    "METHOD": "( MOD ) * ( hash ? KEY ) {opt} GEN P_PARAMS RET B_BLOCK",
    "MEMBER": "( DECO ) * ( METHOD {sig} | ( MOD ) * hash ? KEY {opt} ANN ( assign EXPR ) ? END | static B_BLOCK )",
}
_JS_KINDS = {
    "P_ARGS": "( EXPR ( comma EXPR ) * comma ? ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * comma ? ) ?",
    "P_TYPES": "TYPE",
    "P_FOR": "( DECLS | EXPRS ) ? semi EXPRS ? semi EXPRS ? | ( const | let | var ) ? ( BIND ) ( of | in ) EXPR",
    "K_LIST": "comma * ( EXPR ( comma + EXPR ) * comma * ) ?",
    "K_TYPES": "( TITEM ( comma TITEM ) * comma ? ) ?",
    "B_BLOCK*": "STMT",
    "B_OBJ": "( PROP ( comma PROP ) * comma ? ) ? nl ?",
    "B_CLASS*": "MEMBER | semi | nl",
    "B_NAMES": "( BOUND ( comma BOUND ) * comma ? ) ? nl ?",
    "B_SWITCH*": "case EXPRS colon | default colon | STMT",
    "B_SHAPE*": "( ( plus ? readonly ) ? ( get | set ) ? ( KEY | K_TYPES | K_PARAM ) ( plus ? quest ) ? GEN P_PARAMS ? ( colon ( asserts ? ID is ) ? TYPE ) ? | new ? GEN P_PARAMS ANN ) ( ( semi | comma | nl ) + | EOT ) | nl | semi",
    "K_PARAM": "n colon TYPE | n in TYPE ( as TYPE ) ?",
    "B_MOD*": "IMPORT | EXPORT | STMT",
}
_JS_FILL = dict(
    more="", readonly="readonly", ann="( nl nl nl nl nl ) ?", gen="( nl nl nl nl nl ) ?", targs="", cast="", requires="", iface="", keys="", deflt="", sure="", abstract="", implements="", bang="", asserts="",
    access="", opt="", type="", exports="", types="", mods="", sig="",
)
_INTERFACE = "declare ? interface n GEN ( extends TYPE ( comma TYPE ) * ) ? B_SHAPE"
_TS_DECLARED = (
    f" | {_INTERFACE} END ? | declare ? type n GEN assign nl * TYPE END | declare ? const ? enum n B_OBJ END ? | declare DECLS END | declare ? FSIG"
    " | declare ? ( namespace | module ) ( TNAME | str ) B_MOD | declare ? n B_MOD"
)
_TS_FILL = dict(
    more="| type | interface | namespace | declare | abstract | readonly | module | is | asserts | infer | keyof | unique | override | satisfies",
    readonly="readonly | keyof | unique | infer | asserts", targs="( TARGS ) ?", cast="| lt TYPE gt", requires="| import type ? ID assign EXPR END",
    iface=f"| {_INTERFACE}", sure="not ?", keys="private | public | protected | enum | implements |", deflt="| default async ? function star ? ID ? GEN P_PARAMS RET END", ann="( colon ( asserts ? ID is ) ? TYPE | colon asserts ID ) ?", gen="( lt TPARAM ( comma TPARAM ) * comma ? gt ) ?", abstract="declare ? abstract ?",
    implements="( implements TYPE ( comma TYPE ) * ) ?", bang="| not | TARGS ( P_ARGS | str )", asserts="( ( as | satisfies ) ( TYPE | const ) ( POST ) * ) *",
    access="( public | private | protected | readonly | override ) *", opt="( quest | not ) ?", type="type ?",
    exports=_TS_DECLARED + " | assign EXPR END | import ID assign EXPR END | as namespace ID END", types=_TS_DECLARED,
    mods="| public | private | protected | readonly | abstract | override | declare",
    sig="| ( MOD ) * KEY quest ? GEN P_PARAMS RET END | ( MOD ) * K_PARAM ANN END",
)


def _script(typed: bool) -> tuple[Lexer, str]:
    fill = _TS_FILL if typed else _JS_FILL

    def filled(rule: str) -> str:
        for key, value in fill.items():
            rule = rule.replace("{" + key + "}", value)
        return rule

    rules = {k: filled(v) for k, v in _JS_RULES.items()}
    kinds = {k: filled(v) for k, v in _JS_KINDS.items()}
    if not typed:
        for name in ("P_TYPES", "K_TYPES", "K_PARAM", "B_SHAPE*", "B_MOD*"):
            kinds.pop(name)
        rules = {k: v for k, v in rules.items() if k not in ("TARGS", "TONE", "TALL", "TFUNC", "TYPE", "FSIG", "TITEM", "TPARAM")}
    words = _JS_WORDS + (
        " abstract asserts declare enum implements infer interface is keyof module namespace override private protected public"
        " readonly satisfies type unique" if typed else " enum"
    )
    grammar = Grammar(rules, kinds, "IMPORT | EXPORT | STMT | line")
    strings = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    opaque = rf"(?P<l>\A\#![^\n]*\n)|{_C_COMMENT}|(?P<s>{strings}|`(?:[^`\\]|\\.)*`)|{_REGEX}"
    # A template within a template's expression needs recursion.
    braces = rf"(?P<b>\{{(?:[^{{}}`\"']|{strings}|(?&b)|(?&t))*\}})"
    deep = rf"(?P<l>\A\#![^\n]*\n)|{_C_COMMENT}|(?P<s>{strings}|(?P<t>`(?:[^`\\$]|\\.|\$(?!\{{)|\${braces})*`))|{_REGEX}"
    lexer = Lexer(grammar, opaque, words, _OPERATORS, newlines=True, name=r"[^\W\d][\w$]*|\$[\w$]*", deep=(r"\$\{[^}`]*`", deep))
    join = "bin plus star lt gt amp pipe assign set in instanceof arrow comma dot qdot quest colon spread not".split()
    # A line may end with the type that a closing mark ends.
    before = "".join(grammar.char(c) for c in join if not (typed and c == "gt")) + "(["
    after = "".join(grammar.char(c) for c in "bin star lt gt amp pipe assign set instanceof arrow comma dot qdot quest colon".split()) + ")]"
    return lexer, rf"N+(?=[{re.escape(after)}])|(?<=[{re.escape(before)}{{])N+|(?<=N)N+"


# --- Java --------------------------------------------------------------------------------------------------------------

_JAVA_WORDS = (
    "abstract assert break case catch class continue default do else enum extends final finally for if implements import"
    " instanceof interface native new package private protected public record return static strictfp switch synchronized"
    " super throw throws transient try volatile while permits sealed yield"
)
_JAVA_RULES = {
    "ID": "n | record | permits | sealed | yield | super",
    "NAME": "ID ( dot ID ) *",
    "TARGS": "lt ( TARG ( comma TARG ) * ) ? gt",
    "TARG": "( ANN ) * ( TYPE | quest ( ( extends | super ) TYPE ) ? )",
    "TYPE": "( ANN ) * NAME ( TARGS ( dot ID ( dot ID ) * ( TARGS ) ? ) * ) ? ( K_DIM ) *",
    "PATTERN": "( final | ANN ) * TYPE ( ID | P_PATS ID ? )",
    "LABEL": "PATTERN ( n EXPR ) ? | EXPR | default",
    "VALUE": "EXPR | B_INIT | ANN",
    "ANN": "at NAME P_ANN ?",
    "MOD": "public | private | protected | static | final | abstract | synchronized | native | default | transient | volatile | strictfp | sealed | n plus sealed | ANN",
    "GPARAM": "( ANN ) * ID ( extends TYPE ( amp TYPE ) * ) ?",
    "GEN": "lt GPARAM ( comma GPARAM ) * gt",
    "PRIM": "ID | num | str | P_ARGS | new TYPE ( P_ARGS B_CLASS ? | K_LIST + ( K_DIM ) * B_INIT ? | B_INIT ) | switch P_ARGS B_SWITCH | ( ID | P_LAMBDA ) thin B_BLOCK | TYPE scope ( ID | new ) | NAME K_DIM + dot class",
    "POST": "dot ( ( TARGS ) ? ID | class | new TYPE P_ARGS B_CLASS ? ) | P_ARGS | K_LIST | inc | scope ( ID | new )",
    "PRE": "plus | not | inc | P_TYPE | ( ID | P_LAMBDA ) thin",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | gt gt | gt gt gt | gt set | amp | pipe | assign | set",
    "CHAIN": "UNARY ( ( OP ) UNARY | instanceof ( PATTERN | TYPE ) ) *",
    "EXPR": "CHAIN ( quest EXPR colon EXPR ) ?",
    "VAR": "ID ( K_DIM ) * ( assign ( EXPR | B_INIT ) ) ?",
    "LOCAL": "( final | ANN ) * TYPE VAR ( comma VAR ) *",
    "PARAM": "( final | ANN ) * TYPE spread ? ID ( K_DIM ) *",
    "LOOP": "if P_ARGS | for P_FOR | while P_ARGS | ID colon",
    "TRY": "try P_RES ? B_BLOCK ( catch P_CATCH B_BLOCK ) * ( finally B_BLOCK ) ?",
    "PLAIN": "B_BLOCK | semi | LOCAL semi | return EXPR ? semi | throw EXPR semi | ( break | continue ) ID ? semi | TRY | switch P_ARGS B_SWITCH"
    " | synchronized P_ARGS B_BLOCK | assert EXPR ( colon EXPR ) ? semi | yield EXPR semi | EXPR semi",
    "CORE": "( LOOP ) * ( PLAIN | do ( LOOP ) * ( PLAIN ) while P_ARGS semi )",
    "KIND": "( MOD ) * ( class | interface | enum | record | at interface ) ID GEN ? P_PARAMS ? ( extends TYPE ( comma TYPE ) * ) ? ( implements TYPE ( comma TYPE ) * ) ? ( permits TYPE ( comma TYPE ) * ) ? B_CLASS",
    "STMT": "( LOOP ) * if P_ARGS CORE ( else CORE ) + | KIND | CORE",
    "THROWS": "throws TYPE ( comma TYPE ) *",
    "MEMBER": "( MOD ) * GEN ? TYPE ID P_PARAMS ( K_DIM ) * THROWS ? ( B_BLOCK | ( default ( VALUE ) ) ? semi ) | ( MOD ) * GEN ? ID P_PARAMS ? THROWS ? B_BLOCK"
    " | ( MOD ) * TYPE VAR ( comma VAR ) * semi | KIND | static ? B_BLOCK | semi | ID P_ARGS ? B_CLASS ? ( comma ID P_ARGS ? B_CLASS ? ) * comma ? ( semi | EOT )",
}
_JAVA_KINDS = {
    "P_ARGS": "( EXPR ( comma EXPR ) * ) ?",
    "P_ANN": "( ( ID assign ) ? ( VALUE ) ( comma ID assign ( VALUE ) ) * ) ?",
    "P_PATS": "( PATTERN ( comma PATTERN ) * ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * ) ?",
    "P_LAMBDA": "( ID ( comma ID ) * | PARAM ( comma PARAM ) * ) ?",
    "P_TYPE": "TYPE ( amp TYPE ) *",
    "P_FOR": "( LOCAL | EXPR ( comma EXPR ) * ) ? semi EXPR ? semi ( EXPR ( comma EXPR ) * ) ? | ( final | ANN ) * TYPE ID colon EXPR",
    "P_RES": "( LOCAL | EXPR ) ( semi ( LOCAL | EXPR ) ) * semi ?",
    "P_CATCH": "( final | ANN ) * TYPE ( pipe TYPE ) * ID",
    "K_DIM": "EOT",
    "K_LIST": "EXPR",
    "B_BLOCK*": "STMT",
    "B_CLASS*": "MEMBER",
    "B_INIT": "( ( VALUE ) ( comma ( VALUE ) ) * comma ? ) ?",
    "B_SWITCH*": "case LABEL ( comma LABEL ) * ( colon | thin ) | default ( colon | thin ) | STMT",
}

# --- C and C++ ---------------------------------------------------------------------------------------------------------

_C_WORDS = (
    "break case const continue default do else enum extern for goto if inline register return sizeof static struct switch"
    " typedef union unsigned signed volatile while restrict"
)
_C_RULES = {
    "SPEC": "const | static | extern | inline | register | volatile | unsigned | signed | typedef | restrict",
    "BASE": "( SPEC ) * ( n ( n | SPEC ) * | ( struct | union | enum ) n ( SPEC ) * | ( struct | union ) n ? B_FIELDS ( n P_ARGS ) * | enum n ? B_ENUM | ( unsigned | signed ) ( SPEC ) * )",
    "TYPE": "( SPEC ) * ( n n ? | ( struct | union | enum ) n | ( unsigned | signed ) n * ) ( SPEC ) * ( star ( const ) ? ) * K_DIM *",
    "PTR": "( star ( const | restrict | volatile ) ? ) *",
    "PRIM": "n | num | str + | P_ARGS | P_TYPE B_INIT | sizeof ( P_TYPE | P_ARGS | n )",
    "POST": "( dot | thin ) n | P_ARGS | K_LIST | inc",
    "PRE": "plus | not | inc | star | amp | P_TYPE | sizeof",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | gt gt | amp | pipe | assign | set",
    "CHAIN": "UNARY ( ( OP ) UNARY ) *",
    "EXPR": "CHAIN ( quest EXPR colon EXPR ) ?",
    "DIMS": "( K_DIM | K_LIST | P_PARAMS ( n ( P_ARGS ) ? ) * ) *",
    "DECLR": "PTR ( n | P_DECL ) DIMS",
    "VAR": "DECLR ( n P_ARGS ) * ( assign ( EXPR | B_INIT ) ) ?",
    "FIELD": "VAR ( colon EXPR ) ? | colon EXPR",
    "LOCAL": "( SPEC ) * ( n ( SPEC ) * | ( struct | union | enum ) n ( SPEC ) * | ( unsigned | signed ) ( SPEC ) * n ? n ? | n n ) VAR ( comma VAR ) *",
    "PARAM": "TYPE PTR ( n | P_DECL ) ? DIMS | spread",
    "LOOP": "if P_ARGS | for P_FOR | while P_ARGS | n colon | case EXPR colon | default colon",
    "PLAIN": "B_BLOCK | semi | LOCAL semi | ( struct | union ) n ? B_FIELDS PTR n semi | return EXPR ? semi | goto n semi | ( break | continue ) semi | switch P_ARGS B_BLOCK | EXPR ( comma EXPR ) * semi | line",
    "CORE": "( LOOP ) * ( PLAIN | do ( LOOP ) * ( PLAIN ) while P_ARGS semi )",
    "STMT": "( LOOP ) * if P_ARGS CORE ( else CORE ) + | CORE",
    "TOP": "line | semi | BASE ( VAR ( comma VAR ) * ) ? semi | BASE PTR ( n P_PARAMS | P_DECL DIMS ) ( n P_ARGS ) * B_BLOCK | n P_ARGS semi ?",
}
_C_KINDS = {
    "P_ARGS": "( ( EXPR | TYPE ) ( comma ( EXPR | TYPE ) ) * ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * ) ?",
    "P_TYPE": "TYPE",
    "P_DECL": "DECLR | PTR DIMS",
    "P_FOR": "( LOCAL | EXPR ( comma EXPR ) * ) ? semi EXPR ? semi ( EXPR ( comma EXPR ) * ) ?",
    "K_DIM": "( SPEC ) * ( num | n | star ) ?",
    "K_LIST": "EXPR",
    "B_BLOCK*": "STMT",
    "B_FIELDS*": "BASE ( FIELD ( comma FIELD ) * ) ? semi | line",
    "B_ENUM": "line * n ( assign EXPR ) ? ( comma line * n ( assign EXPR ) ? line * ) * comma ? line *",
    "B_INIT": "( ( ( dot n | K_LIST ) + assign ) ? ( EXPR | B_INIT ) ( comma ( ( dot n | K_LIST ) + assign ) ? ( EXPR | B_INIT ) ) * comma ? ) ?",
}
_CPP_WORDS = _C_WORDS + (
    " class namespace template typename using public private protected virtual override final noexcept explicit friend new"
    " delete throw try catch constexpr consteval mutable operator static_cast dynamic_cast reinterpret_cast const_cast decltype"
    " co_await co_return co_yield static_assert thread_local concept requires"
)
_CPP_RULES = {
    "SPEC": "const | static | extern | inline | register | volatile | typedef | virtual | explicit P_ARGS ? | friend | constexpr | consteval | mutable | thread_local | K_ATTR",
    "PART": "n ( TARGS ) ?",
    "Q": "scope ? PART ( scope ( template ) ? PART ) *",
    "TARGS": "lt ( TARG ( comma TARG ) * ) ? gt",
    "TARG": "( TYPE PTR ( P_DECL | P_PARAMS | P_ARGS | B_INIT ) * | TFIRST ) ( ( plus | star | bin | not ) TVAL ) * spread ?",
    "TFIRST": "( plus | not | sizeof spread ? | amp ) + TVAL | ( num | str | P_ARGS ) ( P_ARGS | B_INIT ) *",
    "TVAL": "( plus | not | sizeof spread ? | amp ) * ( num | str | Q | P_ARGS ) ( P_ARGS | B_INIT ) *",
    "BASE": "( SPEC ) * ( typename ? Q | ( struct | class | union | enum ) Q | ( unsigned | signed ) n ? n ? | n n n ? | decltype P_ARGS ) ( SPEC ) *",
    "TYPE": "( BASE ) ( star ( const | volatile ) ? ) * ( amp | bin ) ? ( K_DIM ) *",
    "PRIM": "Q | num | str + | P_ARGS | ( typename ? Q | decltype P_ARGS ) B_INIT | typename Q P_ARGS | sizeof spread ? ( P_ARGS | P_TYPE ) | new P_ARGS ? TYPE ( P_ARGS | B_INIT | K_LIST ) * | LAMBDA"
    " | ( static_cast | dynamic_cast | reinterpret_cast | const_cast ) lt TARG gt P_ARGS",
    "LAMBDA": "( K_CAPTURE | K_DIM ) ( lt TPARAMS gt ) ? P_PARAMS ? ( mutable | constexpr | noexcept P_ARGS ? ) * ( thin TYPE ) ? B_BLOCK",
    "POST": "( dot | thin ) ( ( template ) ? Q | not Q | star Q | OPER ) | P_ARGS | K_LIST | inc | spread",
    "PRE": "plus | not | inc | star | amp | P_TYPE | sizeof | delete K_DIM ? | co_await | throw",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | gt gt | amp | pipe | assign | set",
    "CHAIN": "UNARY ( ( OP ) UNARY ) *",
    "EXPR": "CHAIN ( quest EXPR colon EXPR ) ?",
    "PTR": "( star ( const | volatile ) ? | Q scope star ) * ( amp | bin ) ? spread ?",
    "CAPT": "( amp | assign | star | amp ? spread ? n ( assign ( EXPR | B_INIT ) | B_INIT | spread | P_ARGS ) ? )",
    "DIMS": "( K_DIM | K_LIST | P_PARAMS ) *",
    "DECLR": "PTR ( n | K_CAPTURE | P_DECL ) DIMS",
    "TEMPL": "( template lt ( TPARAMS ) ? gt ( requires EXPR ) ? ) *",
    "VAR": "PTR ( Q | K_CAPTURE | K_LIST | P_DECL ) DIMS ( assign ( EXPR | B_INIT ) | B_INIT | P_ARGS ) ?",
    "LOCAL": "( BASE ) VAR ( comma VAR ) *",
    "PARAM": "TYPE PTR ( n | P_DECL ) ? DIMS ( assign ( EXPR | B_INIT ) ) ? | spread",
    "LOOP": "K_ATTR | if constexpr ? P_ARGS | if P_FOR | for P_FOR | while P_ARGS | n colon | case EXPR colon | default colon",
    "TRY": "try B_BLOCK ( catch P_PARAMS B_BLOCK ) +",
    "USING": "TEMPL using ( namespace Q | typename ? Q | n assign TYPE PTR ( P_DECL | P_PARAMS ) * ) semi",
    "PLAIN": "B_BLOCK | semi | LOCAL semi | USING | return ( EXPR | B_INIT ) ? semi | throw EXPR ? semi | goto n semi | ( break | continue ) semi | switch P_ARGS B_BLOCK | TRY"
    " | ( co_return | co_yield ) EXPR ? semi | KIND | EXPR ( comma EXPR ) * semi | line",
    "CORE": "( LOOP ) * ( PLAIN | do ( LOOP ) * ( PLAIN ) while P_ARGS semi )",
    "STMT": "( LOOP ) * if constexpr ? ( P_ARGS | P_FOR ) CORE ( else CORE ) + | CORE",
    "BASES": "colon ( public | private | protected | virtual ) * Q spread ? ( comma ( public | private | protected | virtual ) * Q spread ? ) *",
    "KIND": "TEMPL ( SPEC ) * ( class | struct | union ) ( K_ATTR | n P_ARGS ) * Q ? final ? ( BASES ) ? B_CLASS ( VAR ( comma VAR ) * ) ? semi | ( SPEC ) * enum ( class | struct ) ? n ? ( colon TYPE ) ? B_ENUM ( VAR ) ? semi"
    " | TEMPL ( class | struct | union | enum ( class | struct ) ? ) ( K_ATTR ) * Q ( colon TYPE ) ? semi | template lt TPARAMS gt concept n assign EXPR semi",
    "TPARAMS": "TPARAM ( comma TPARAM ) *",
    "TPARAM": "( template lt ( TPARAMS ) ? gt ) ? ( typename | class ) spread ? n ? ( assign TYPE ) ? | TYPE spread ? n ? ( assign TVAL ) ?",
    "OPER": "operator ( P_ARGS | K_DIM | new K_DIM ? | delete K_DIM ? | bin gt | gt gt | gt set | str n | bin | plus | star | lt | gt | amp | pipe | assign | set | not | inc | thin | comma | TYPE )",
    "QUAL": "( const | volatile | noexcept P_ARGS ? | override | final | amp | bin | thin TYPE | requires EXPR | K_ATTR ) *",
    "INITS": "colon Q ( P_ARGS | B_INIT ) spread ? ( comma Q ( P_ARGS | B_INIT ) spread ? ) *",
    "FUNC": "TEMPL ( SPEC ) * ( TYPE ) ? ( Q | not n | Q scope not n | OPER | Q scope OPER ) P_PARAMS QUAL ( ( INITS ) ? ( B_BLOCK | TRY ) | assign ( default | delete | num ) semi | semi )",
    "TOP": "line | semi | USING | KIND | FUNC | TEMPL LOCAL semi | BASE DECLR QUAL B_BLOCK | inline ? namespace Q ? B_TOP | namespace n assign Q semi | extern str ( B_TOP | TOP ) | static_assert P_ARGS semi | n P_ARGS semi ?"
    " | template ( class | struct ) ? Q semi",
}
_CPP_KINDS = {
    "P_ARGS": "default | ( ( EXPR | TYPE | B_INIT ) ( comma ( EXPR | TYPE | B_INIT ) ) * ) ? | ( EXPR ( OP ) | EXPR comma ) ? spread ( ( OP ) EXPR ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * ) ?",
    "P_TYPE": "TYPE",
    "P_DECL": "DECLR | PTR DIMS",
    "P_FOR": "( LOCAL | EXPR ( comma EXPR ) * ) ? semi EXPR ? ( semi ( EXPR ( comma EXPR ) * ) ? ) ? | TYPE PTR ( n | K_CAPTURE ) colon ( EXPR | B_INIT )",
    "K_DIM": "EOT",
    "K_LIST": "EXPR",
    "K_ATTR": "K_LIST | K_CAPTURE | K_DIM",
    "K_CAPTURE": "CAPT ( comma CAPT ) *",
    "B_BLOCK*": "STMT",
    "B_CLASS*": "( public | private | protected ) colon | FUNC | KIND | USING | TEMPL LOCAL ( colon EXPR ( assign EXPR ) ? ) ? semi | BASE colon EXPR semi | static_assert P_ARGS semi | friend ( class | struct ) Q semi | semi | line | n P_ARGS semi ?",
    "B_ENUM": "n ( assign EXPR ) ? ( comma n ( assign EXPR ) ? ) * comma ?",
    "B_INIT": "( ( dot n assign ) ? ( EXPR | B_INIT ) ( comma ( dot n assign ) ? ( EXPR | B_INIT ) ) * comma ? ) ?",
    "B_TOP*": "TOP",
}

# --- Go ----------------------------------------------------------------------------------------------------------------

_GO_WORDS = (
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range"
    " return select struct switch type var"
)
_GO_RULES = {
    "END": "( semi | nl ) + | EOT",
    "NAME": "n ( dot n ) ?",
    "TYPE": "( star | K_DIM | K_IDX | map K_TYPES | receive ? chan receive ? ) * ( NAME ( K_TYPES ) ? | interface B_IFACE | struct B_FIELDS | func P_PARAMS RESULT | P_TYPE )",
    "TERM": "not ? TYPE ( pipe not ? TYPE ) *",
    "FUNC": "func P_PARAMS RESULT B_BLOCK",
    "PRIM": "n | num | str | P_ARGS | FUNC | ( K_DIM | K_IDX | map K_TYPES ) TYPE ( B_LIT | P_ARGS ) | struct B_FIELDS B_LIT | func P_PARAMS RESULT | interface B_IFACE | map K_TYPES TYPE | K_DIM TYPE | chan receive ? TYPE",
    "POST": "dot ( n | P_ARGS | P_KIND ) | P_ARGS | K_IDX | K_TYPES | K_SLICE",
    "PRE": "plus | not | star | amp | receive | hat",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) * ( B_LIT ( POST ) * ) ?",
    "BARE": "( PRE ) * ( PRIM ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | gt gt | amp | pipe | hat",
    "EXPR": "UNARY ( ( OP ) UNARY ) *",
    "COND": "BARE ( ( OP ) ( let PAT assign ) ? BARE ) * range ?",
    "EXPRS": "EXPR ( comma EXPR ) *",
    "CONDS": "COND ( comma COND ) *",
    "SIMPLE": "EXPRS ( ( define | assign | set ) EXPRS | inc | receive EXPR ) ?",
    "CSIMPLE": "CONDS ( ( define | assign | set ) CONDS | inc ) ?",
    "VARSPEC": "n ( comma n ) * ( TYPE ) ? ( assign EXPRS ) ?",
    "PARAM": "( n ( comma n ) * ) ? spread ? TYPE",
    "RESULT": "( P_PARAMS | TYPE ) ?",
    "IF": "if ( CSIMPLE semi ) ? CSIMPLE B_BLOCK",
    "FOR": "for ( range COND | CONDS ( define | assign ) range COND | CSIMPLE ? semi COND ? semi CSIMPLE ? | COND ) ? B_BLOCK",
    "SWITCH": "( switch | select ) ( CSIMPLE semi ) ? CSIMPLE ? B_SWITCH",
    "STMT": "nl | semi | IF ( else ( IF ) ) * ( else B_BLOCK ) ? END | FOR END | SWITCH END | B_BLOCK END | return EXPRS ? END | ( go | defer ) EXPR END | ( break | continue | goto ) n ? END | fallthrough END"
    " | ( var | const ) ( VARSPEC | P_SPECS ) END | type n assign ? TYPE END | n colon | SIMPLE END",
    "TOP": "nl | semi | func P_PARAMS ? n ( K_TPARAMS ) ? P_PARAMS RESULT B_BLOCK ? END | ( var | const ) ( VARSPEC | P_SPECS ) END | type n ( K_TPARAMS ) ? assign ? TYPE END | type P_SPECS END"
    " | import ( ( n | dot ) ? str | P_SPECS ) END | package n END",
}
_GO_KINDS = {
    "P_ARGS": "( ( EXPR | TYPE ) ( comma ( EXPR | TYPE ) ) * spread ? comma ? ) ?",
    "P_PARAMS": "( PARAM ( comma PARAM ) * comma ? ) ?",
    "P_TYPE": "TYPE",
    "P_KIND": "type",
    "P_SPECS": "( ( nl | semi ) * ( VARSPEC | ( n | dot ) ? str | n assign ? TYPE ) ( ( nl | semi ) + | EOT ) ) *",
    "K_DIM": "( num | spread | n ) ?",
    "K_IDX": "EXPR",
    "K_SLICE": "EXPR ? colon EXPR ? ( colon EXPR ) ?",
    "K_TYPES": "TYPE ( comma TYPE ) *",
    "K_TPARAMS": "n ( comma n ) * TERM ( comma n ( comma n ) * TERM ) * comma ?",
    "B_BLOCK*": "STMT",
    "B_FIELDS*": "nl | semi | ( n ( comma n ) * TYPE | star ? NAME ( K_TYPES | K_IDX ) ? ) str ? END",
    "B_IFACE*": "nl | semi | n P_PARAMS RESULT END | TERM END",
    "B_LIT": "( ( EXPR | B_LIT ) ( colon ( EXPR | B_LIT ) ) ? ( comma ( EXPR | B_LIT ) ( colon ( EXPR | B_LIT ) ) ? ) * comma ? ) ?",
    "B_SWITCH*": "case ( SIMPLE | TYPE ( comma TYPE ) * | ( EXPR | TYPE ) ( comma ( EXPR | TYPE ) ) * ) colon | default colon | STMT",
}

# --- Rust --------------------------------------------------------------------------------------------------------------

_RUST_WORDS = (
    "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref"
    " return self static struct super trait type union unsafe use where while"
)
_RUST_RULES = {
    "ID": "n | self | super | crate | union",
    "PATH": "scope ? ID ( scope ID ) *",
    "SEG": "ID ( scope ? TARGS | P_TYPES ( thin TYPE ) ? ) ?",
    "QPATH": "( lt TYPE ( as TYPE ) ? gt scope | scope ) ? SEG ( scope SEG ) *",
    "TARGS": "lt ( TARG ( comma TARG ) * comma ? ) ? gt",
    "TARG": "TYPE ( ( assign | colon ) TYPE ) ? | plus ? num | str | B_BLOCK",
    "TPART": "( amp life ? mut ? | bin life ? mut ? | star ( const | mut ) | dyn | impl | quest | for GEN ) * ( QPATH | P_TYPES | K_TYPE | ( unsafe | extern str ? ) * fn P_TYPES ( thin TYPE ) ? | life | not | MACRO )",
    "TYPE": "TPART ( plus TPART ) * plus ?",
    "GPARAM": "( ATTR ) * ( life ( colon life ( plus life ) * ) ? | const n colon TYPE ( assign ( plus ? num | B_BLOCK | n ) ) ? | n ( colon ( TYPE ) ? ) ? ( assign TYPE ) ? )",
    "GEN": "lt ( GPARAM ( comma GPARAM ) * comma ? ) ? gt",
    "LITERAL": "plus ? num | str | QPATH",
    "PATONE": "( amp | bin | ref | mut ) * ( n at PATONE | LITERAL ( range ( LITERAL ) ? ) ? | range ( LITERAL ) ? | QPATH ( P_PATS | B_PATS ) | P_PATS | K_PATS | MACRO )",
    "FPAT": "( ATTR ) * ( ( n | num ) colon PAT | ( ref | mut ) * n | range )",
    "PAT": "pipe ? PATONE ( pipe PATONE ) *",
    "MACRO": "PATH not ( P_TREE | K_TREE | B_TREE )",
    "CLOSURE": "move ? ( pipe ( ( PATONE ) ( colon TYPE ) ? ( comma ( PATONE ) ( colon TYPE ) ? ) * comma ? ) ? pipe | bin ) ( thin TYPE ) ?",
    "TEST": "let PAT assign COND | COND",
    "BLOCKS": "( life colon ) ? ( unsafe ? B_BLOCK | async move ? B_BLOCK | const B_BLOCK | loop B_BLOCK | while TEST B_BLOCK | for PAT in COND B_BLOCK ) | match COND B_MATCH"
    " | if TEST B_BLOCK ( else if TEST B_BLOCK ) * ( else B_BLOCK ) ?",
    "PLAIN": "MACRO | EPATH | num | str | P_ARGS | K_LIST | unsafe B_BLOCK",
    "EPATH": "( lt TYPE ( as TYPE ) ? gt scope | scope ) ? ID ( scope ( ID | TARGS ) ) *",
    "PRIM": "BLOCKS | MACRO | EPATH B_LIT | PLAIN",
    "POST": "dot ( n | num | await | union ) ( scope TARGS ) ? | P_ARGS | K_LIST | quest | as TYPE",
    "PRE": "plus | not | star | amp mut ? | bin mut ? | CLOSURE | return | break life ? | range",
    "UNARY": "( PRE ) * ( PRIM ) ( POST ) *",
    "BARE": "( PRE ) * ( PLAIN ) ( POST ) *",
    "OP": "bin | plus | star | lt | gt | gt gt | amp | pipe | assign | set | range",
    "EXPR": "UNARY ( ( OP ) UNARY ) * range ? | range | ( return | break | continue ) life ? | CLOSURE ( return | break | continue )",
    "COND": "BARE ( ( OP ) BARE ) *",
    "ATTR": "hash not ? K_TREE",
    "PUB": "pub P_VIS ?",
    "FN": "( const | async | unsafe | extern str ? ) * fn ( n | union ) GEN ? P_PARAMS ( thin TYPE ) ? WHERE ? ( B_BLOCK | semi )",
    "WHERE": "where ( TYPE colon ( TYPE ) ? ( comma TYPE colon ( TYPE ) ? ) * comma ? ) ?",
    "USE": "use scope ? ( B_USE | star ) semi | use PATH ( as n ) ? ( scope ( B_USE | star ) ) ? semi",
    "ITEM": "ATTR | PUB ? ( USE | FN | ( struct | union ) n GEN ? ( WHERE ? B_FIELDS | P_FIELDS ? WHERE ? semi ) | enum n GEN ? WHERE ? B_ENUM | unsafe ? trait n GEN ? ( colon ( TYPE ) ? ) ? WHERE ? B_ITEMS"
    " | ( const | static ) mut ? n colon TYPE ( assign EXPR ) ? semi | type n GEN ? ( colon TYPE ) ? WHERE ? ( assign TYPE ) ? semi | mod n ( semi | B_ITEMS ) | extern crate n ( as n ) ? semi | unsafe ? extern str ? B_ITEMS )"
    " | unsafe ? impl GEN ? not ? TYPE ( for TYPE ) ? WHERE ? B_ITEMS | PATH not n ? ( B_TREE semi ? | ( P_TREE | K_TREE ) semi )",
    "STMT": "semi | ITEM | let PAT ( colon TYPE ) ? ( assign EXPR ( else B_BLOCK ) ? ) ? semi | BLOCKS semi ? | return EXPR ? semi | ( break | continue ) life ? EXPR ? semi | EXPR ( semi | EOT ) | ( return | break | continue ) life ? EOT",
}
_RUST_KINDS = {
    "P_ARGS": "( EXPR ( comma EXPR ) * comma ? ) ?",
    "P_PARAMS": "( ( ATTR ) * ( amp life ? mut ? self | mut ? self ( colon TYPE ) ? | PAT colon TYPE | spread ) ( comma ( ATTR ) * ( PAT colon TYPE | spread ) ) * comma ? ) ?",
    "P_TYPES": "( ( n colon ) ? TYPE ( comma ( n colon ) ? TYPE ) * comma ? ) ?",
    "P_FIELDS": "( ( ATTR ) * PUB ? TYPE ( comma ( ATTR ) * PUB ? TYPE ) * comma ? ) ?",
    "P_PATS": "( PAT ( comma PAT ) * comma ? ) ?",
    "K_PATS": "( PAT ( comma PAT ) * comma ? ) ?",
    "P_VIS": "crate | super | self | in PATH",
    "K_LIST": "( ( ATTR ) * EXPR ( comma ( ATTR ) * EXPR ) * comma ? | EXPR semi EXPR ) ?",
    "K_TYPE": "TYPE ( semi EXPR ) ?",
    "B_BLOCK*": "STMT",
    "B_LIT": "( ( ATTR ) * ( n | num ) ( colon EXPR ) ? ( comma ( ATTR ) * ( n | num ) ( colon EXPR ) ? ) * comma ? ( comma range EXPR ) ? | range EXPR ) ?",
    "B_PATS": "( FPAT ( comma FPAT ) * comma ? ) ?",
    "B_MATCH*": "comma | ( ATTR ) * PAT ( if ( TEST ) ) ? arrow ( BLOCKS comma ? | EXPR ( comma | EOT ) )",
    "B_FIELDS": "( ATTR * PUB ? n colon TYPE ( comma ATTR * PUB ? n colon TYPE ) * comma ? ) ?",
    "B_ENUM": "( ATTR * n ( P_FIELDS | B_FIELDS | assign EXPR ) ? ( comma ATTR * n ( P_FIELDS | B_FIELDS | assign EXPR ) ? ) * comma ? ) ?",
    "B_USE": "( PATH | star ) ( as n | scope ( B_USE | star ) ) ? ( comma PATH ( as n | scope ( B_USE | star ) ) ? ) * comma ?",
    "B_ITEMS*": "ITEM | semi",
    "P_TREE*": "{any}",
    "K_TREE*": "{any}",
    "B_TREE*": "{any}",
}


def _plain(rules, kinds, top, words, opaque, operators=_OPERATORS, **lexer) -> Lexer:
    return Lexer(Grammar(rules, kinds, top), opaque, words, operators, **lexer)


@lru_cache(maxsize=16)
def lexer_of(lang: str) -> tuple[Lexer | ShellLexer, re.Pattern[str] | None]:
    """The lexer of a language and the pattern of line ends that mean nothing."""
    if lang in ("js", "ts"):
        lexer, dropped = _script(lang == "ts")
        return lexer, re.compile(dropped)
    if lang == "java":
        opaque = rf"{_C_COMMENT}|(?P<s>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]+?)')"
        return _plain(_JAVA_RULES, _JAVA_KINDS, "package NAME semi | import static ? NAME ( dot star ) ? semi | KIND | semi | ANN", _JAVA_WORDS, opaque, _C_OPERATORS, members=False), None
    if lang in ("c", "cpp"):
        raw = r"(?P<r>R\"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)\")|" if lang == "cpp" else ""
        digits = r"(?P<k>\b\d\w*(?:'\w+)+)|" if lang == "cpp" else ""
        opaque = rf"{_C_COMMENT}|{_DIRECTIVE}|{digits}{raw}{_CHAR}"
        args = (_C_RULES, _C_KINDS, "TOP", _C_WORDS) if lang == "c" else (_CPP_RULES, _CPP_KINDS, "TOP", _CPP_WORDS)
        return _plain(*args, opaque, _C_OPERATORS, members=False), None
    if lang == "go":
        opaque = rf"{_C_COMMENT}|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)')"
        lexer = _plain(_GO_RULES, _GO_KINDS, "TOP", _GO_WORDS, opaque, _C_OPERATORS | {"define": ":=", "receive": "<-", "hat": "^ &^", "bin": "/ % == != <= >= && || <<", "set": _C_OPERATORS["set"] + " &^="}, newlines=True, bad_number=r"0\d*[89]\d*", members=False)
        ends = "".join(lexer.grammar.char(w) for w in ("break", "continue", "fallthrough", "return", "inc")) + "n0s)]}"
        return lexer, re.compile(rf"(?<![{re.escape(ends)}])N+|(?<=N)N+")
    if lang == "rs":
        opaque = rf"{_C_COMMENT}|(?P<r>b?r(?P<d>\#{{0,3}})\".*?\"(?P=d))|(?P<s>b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n']{{1,10}}|\\')')"
        operators = _C_OPERATORS | {"range": ".. ..="}
        operators = {k: v for k, v in operators.items() if k not in ("inc", "qdot")} | {"life": "'", "dollar": "$"}
        # What a macro is given is any sequence of tokens whose brackets nest.
        names = dict.fromkeys([*operators, *_RUST_WORDS.split(), "n", "num", "str", "P_TREE", "K_TREE", "B_TREE"])
        kinds = {k: v.replace("{any}", " | ".join(names)) for k, v in _RUST_KINDS.items()}
        lexer = _plain(_RUST_RULES, kinds, "ITEM | semi | line", _RUST_WORDS, opaque, operators, members=False, name=r"(?:r\#)?[^\W\d]\w*", dotted=False)
        # A lifetime is a mark and a name.
        words = "".join(map(lexer.grammar.char, _RUST_WORDS.split()))
        return lexer, re.compile(rf"(?<={re.escape(lexer.grammar.char('life'))})[n{re.escape(words)}]")
    if lang == "py":
        return python_lexer(), None
    if lang == "rb":
        return ruby_lexer()
    if lang == "sh":
        return ShellLexer(), None
    raise KeyError(lang)
