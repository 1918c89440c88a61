"""Files that do not parse: valid and broken texts of each language, the grammar's pairs, and the operator's edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from snippets import INVALID
from snippets import VALID as SNIPPETS

from graphmill.llm import syntax_check
from graphmill.llm.languages import lexer_of

VALID = {
    "py": "import os\n@d.x(1)\nasync def f(a, *b, c: int = 2, **k) -> int:\n    '''doc'''\n    if a:\n        return [x for x in b if x]\n    else:\n        pass\nclass K(B): x = {1: 2, **y}\ntry:\n    f()\nexcept E as e:\n    raise\n",
    "js": "import a, { b as c } from './x';\nexport default class K extends B { static async f({ a }, ...r) { for (const x of a) { if (x) y(); else z() } } }\nconst f = async (x) => ({ ...x, k: `t${1}` });\nlet r = /a[/]b/g, q = a ? b : c;\nswitch (a) { case 1: b(); break; default: c() }\n",
    "ts": "import { a } from 'x';\nexport interface I { a?: string; f(x: number): void; [k: string]: any }\ntype T = A | { b: Map<string, number[]> };\nfunction f<T>(a: T, b?: string): Promise<T> { return a as any; }\nclass K implements I { private x: number = 1; constructor(private y: string) {} }\n",
    "java": "package a.b;\nimport java.util.*;\n@A(x = 1)\npublic class K<T> extends B implements C {\n private final Map<String, List<T>> m = new HashMap<>();\n public <U> int f(final int... a) throws E { for (int i = 0; i < 3; i++) { a[i] += (int) 2; } return m.stream().map(x -> x + 1).count(); }\n}\n",
    "go": "package p\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\ta, b int\n\tm map[string][]int\n}\n\nfunc (t *T) F(x int, y ...string) (int, error) {\n\tif v, ok := t.m[\"k\"]; ok && x > 1 {\n\t\treturn len(v), nil\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tgo func() { fmt.Println(i) }()\n\t}\n\treturn 0, nil\n}\n",
    "rs": "use std::io::{self, Read};\n#[derive(Debug)]\npub struct S<'a> { pub a: &'a str, b: Vec<u8> }\nimpl<'a> S<'a> {\n  pub fn f(&self, mut x: i64) -> Option<String> {\n    let y = match x { 1 | 2 => \"a\", _ => \"b\" };\n    for i in 0..3 { x += i; }\n    println!(\"{}\", y);\n    Some(y.to_string())\n  }\n}\n",
    "c": "#include <a.h>\nstruct s { int a; char *b; };\nstatic const char *names[] = { \"a\", \"b\" };\nint f(struct s *p, unsigned long n)\n{\n  for (int i = 0; i < n; i++) { if (p->a == 'x') return *p->b; else continue; }\n  return (int) n;\n}\n",
    "cpp": "#include <vector>\nnamespace n {\ntemplate <typename T> class K : public B {\npublic:\n  K(int a) : a_(a) {}\n  std::vector<int> f(const std::string &s) const override { for (auto &x : v) { x += 1; } return {}; }\nprivate:\n  int a_ = 0;\n};\n}\n",
    "rb": "require 'x'\nmodule M\n  class K < B\n    def f(a, b = 1, *c)\n      a.each do |x|\n        puts \"#{x}\" if x > 1\n      end\n      return unless b\n      case a\n      when 1 then 2\n      else 3\n      end\n    end\n  end\nend\n",
    "sh": "#!/bin/bash\nset -eu\nf() {\n  local x=\"$1\"\n  if [ \"$x\" -gt 3 ]; then\n    echo \"a $(date)\" >&2\n  else\n    for i in a b; do echo $((i + 1)); done\n  fi\n  case $x in\n    a|b) echo c ;;\n    *) ;;\n  esac\n}\narr=(a b)\nf x | grep y && true\n",
}
FOREIGN = ["2024-07-18 08:12:11 INFO a took 3 ms\n", "<!DOCTYPE html>\n<head><title>x</title></head>\n", "{\n  \"a\": {\"b\": 1},\n  \"c\": 2\n}\n"]


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_and_cut_off(lang):
    text = VALID[lang]
    assert syntax_check.parses(text, lang)
    pairs = lexer_of(lang)[0].grammar.pairs()
    assert set(syntax_check.token_pairs(syntax_check.tokens_of(text, lang))) <= pairs  # the pairs of what reduces are permitted
    cut = text[: text.rstrip().rfind("\n", 0, len(text) * 3 // 4)] + "\n  (\n"
    assert not syntax_check.parses(cut, lang)
    assert not syntax_check.parses(text + "\n<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", lang)


@pytest.mark.parametrize("lang", sorted(set(VALID) - {"sh", "py", "rb"}))
@pytest.mark.parametrize("text", FOREIGN)
def test_foreign_texts(lang, text):
    assert not syntax_check.parses(text, lang)


@pytest.mark.parametrize("lang", sorted(SNIPPETS))
def test_snippets(lang):
    """Not three in a hundred of the snippets may be judged wrongly; the pairs of valid ones must be permitted."""
    pairs = lexer_of(lang)[0].grammar.pairs()
    wrong = [t for t in SNIPPETS[lang] if not syntax_check.parses(t, lang)] + [t for t in INVALID[lang] if syntax_check.parses(t, lang)]
    if lang != "py":
        wrong += [t for t in SNIPPETS[lang] if not set(syntax_check.token_pairs(syntax_check.tokens_of(t, lang))) <= pairs]
    assert len(SNIPPETS[lang]) >= 15 and len(INVALID[lang]) >= 10 and len(wrong) * 100 < 3 * (len(SNIPPETS[lang]) + len(INVALID[lang])), wrong


def test_generics_nest_to_any_depth():
    deep = "A" + "<A" * 40 + ">" * 40
    assert syntax_check.parses(f"let x: {deep};\n", "ts") and syntax_check.parses(f"class K {{ {deep} x; }}\n", "java")
    assert syntax_check.parses(f"{deep} x;\n", "cpp") and syntax_check.parses(f"type X = {deep};\n", "rs")
    assert not syntax_check.parses(f"let x: {deep}>;\n", "ts") and not syntax_check.parses(f"class K {{ {deep[:-1]} x; }}\n", "java")


def test_what_decides(spark):
    """A pair alone, and a production whose pairs are all permitted."""
    rows = [(1, "java", "class A { int x = ; }\n"), (2, "java", "class A { void f() { for (int i = 0; i < 5) { } } }\n"), (3, "java", "class A { }\n"), (4, "py", "f(a=1, 2)\n")]
    got = {r["request_id"]: (r["by"], r["n_pairs"] > 0) for r in syntax_check.unparsable(spark.createDataFrame(rows, "request_id bigint, lang string, code string")).collect()}
    assert got == {1: ("pairs", True), 2: ("reduction", False), 4: ("reduction", False)}


def test_languages_differ():
    assert not syntax_check.parses(VALID["ts"], "js")
    assert not syntax_check.parses(VALID["cpp"], "c")
    assert not syntax_check.parses("print 'x'\n", "py")
    assert syntax_check.parses("s = '''\n<<<<<<< HEAD\n'''\n", "py")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(VALID)))
def test_any_text_is_judged(text, lang):
    assert isinstance(syntax_check.parses(text, lang), bool)
    assert syntax_check.token_pairs(syntax_check.tokens_of(text, lang))


def test_operator_cases(spark):
    rows = [(1, "r", "py", "def f(:\n", "x"), (1, "r", "py", "def f(:\n", "x"), (2, "r", "py", "x = 1\n", "x"), (3, None, "js", None, "x"), (4, None, "js", "  \n", "x"), (5, "r", None, "(", "x"), (6, "r", "go", "package p\n", "x")]
    df = spark.createDataFrame(rows, "request_id bigint, repo string, lang string, code string, pair string")
    assert [r["request_id"] for r in syntax_check.unparsable(df).collect()] == [1]
    rates = {(r["repo"], r["lang"]): (r["n_files"], r["n_invalid"]) for r in syntax_check.unparsable_rates(df).collect()}
    assert rates[("r", "py")] == (2, 1) and rates[(None, "js")] == (2, 0)
    assert syntax_check.unparsable(df.limit(0)).count() == 0
