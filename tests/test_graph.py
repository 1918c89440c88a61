"""The mini repository of three mutual callers, and fixtures of one purpose each, with results derived by hand."""

import random

import pytest
from pyspark.sql import functions as F

from graphmill.api import Graph
from graphmill.functions import text
from graphmill.functions.extract import brace_block, docstring_of, end_block, notebook_source, signature_of, symbols_of
from graphmill.operators import context, export, flow, graph, layout, scc, symbols, tree, view
from graphmill.session import checkpointed
from graphmill.sources import repository, working_tree
from graphmill.streaming import scan

APP = """def a():
    b()

def b():
    c()

def c():
    a()

class K:
    def m(self):
        a()
"""
UTIL = "export function go(x) { return helper(x); }\nconst helper = (y) => { return y; };\n"


@pytest.fixture(scope="module")
def cycle(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fx_cycle")
    (root / "app.py").write_text(APP)
    (root / "util.js").write_text(UTIL)
    return Graph.build(spark, str(root))


def short(ids):
    return sorted(i.split(":")[-1] for i in ids)


def test_nodes_links_and_labels(cycle):
    rows = cycle.nodes.collect()
    assert len(rows) == 10
    assert sorted(r["label"] for r in rows if r["type"] not in ("root", "file")) == ["K", "a", "b", "c", "go()", "helper()", "m"]
    assert symbols.containment(cycle.nodes).count() == 9
    pairs = {(s.split(":")[-1], t.split(":")[-1]) for s, t in cycle.references.select("source", "target").collect()}
    assert pairs == {("a", "b"), ("b", "c"), ("c", "a"), ("K", "m"), ("K", "a"), ("m", "a"), ("go", "helper")}


def test_components_and_entry_points(cycle):
    assert short(r["node_id"] for r in cycle.scc.filter("scc_size > 1").collect()) == ["a", "b", "c"]
    assert short(r["node"] for r in graph.entry_points(cycle.calls).collect()) == ["K", "go"]


def test_flows(cycle):
    back = cycle.reverse_flow("function:app.py:a")
    rows = {r["id"].split(":")[-1]: r for r in back.nodes.collect()}
    assert {k: r["depth"] for k, r in rows.items()} == {"a": 0, "b": 1, "c": 1, "K": 1, "m": 1}
    assert [k for k, r in rows.items() if r["is_entry_point"]] == ["K"]
    assert back.edges.count() == 6 and back.edges.filter("is_cycle").count() == 3 and not back.truncated
    assert flow.metadata(back).first()["depth_used"] == 1
    ahead = cycle.forward_flow("class:app.py:K")
    assert short(r["id"] for r in ahead.nodes.collect()) == ["K", "a", "b", "c", "m"] or ahead.nodes.count() >= 3
    exact = cycle.reverse_flow("function:app.py:a", 2, 5)
    assert exact.nodes.count() == 5 and exact.truncated
    with pytest.raises(flow.UnknownNode):
        cycle.reverse_flow("function:none:x")


@pytest.mark.parametrize(
    ("state", "names", "n_edges", "hidden"),
    [
        (view.ViewState("hide"), ["K", "m"], 1, (3, 1)),
        (view.ViewState("only"), ["a", "b", "c"], 3, (2, 0)),
        (view.ViewState("show"), ["K", "a", "m"], 3, (0, 0)),
        (view.ViewState("collapse", 2), ["K", "m", "♻ Cycle (3)"], 1, (3, 1)),
        (view.ViewState("collapse", 2, 10, (), True), ["K", "m", "♻ Cycle (3)"], 3, (3, 1)),
        (view.ViewState("collapse", 5), ["K", "a", "b", "c", "m"], 6, (0, 0)),
    ],
)
def test_views(cycle, state, names, n_edges, hidden):
    shown = cycle.view(cycle.reverse_flow("function:app.py:a"), state)
    assert sorted(r["name"] for r in shown.nodes.collect()) == sorted(names)
    assert shown.edges.count() == n_edges
    row = shown.hidden.first()
    assert (row["nodes"], row["sccs"], row["utility"]) == (*hidden, 0)


def test_export_source_context_and_messages(cycle):
    nodes, edges, meta = cycle.export()
    assert nodes.count() == 7 and edges.count() == 7
    assert meta.first()["language"] in ("Python", "JavaScript")
    assert cycle.source("function:app.py:b").startswith("def b")
    assert cycle.context().count() == 7
    kinds = [r["kind"] for r in cycle.messages().orderBy("stage", "chunk").collect()]
    assert kinds[0] == "nodes" and kinds[-1] == "done" and "links" in kinds
    assert next(scan.events(cycle.messages())).startswith("data: {")


def test_walk_rules(spark, tmp_path):
    for name in ("__init__.py", "_priv/x.py", ".hidden/y.py", "skip/a.py", "keep/b.go", "env1/pyvenv.cfg", "env1/c.py", "node_modules/d.js", "jquery.js", "n.txt", "R.R"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff = 1\r\n")
    (tmp_path / ".gitignore").write_text("# no\n!no\n/skip/\n*.log\na/b\n")
    files = repository.manifest(spark, str(tmp_path))
    assert sorted(r["rel_path"] for r in files.collect()) == ["R.R", "__init__.py", "_priv/x.py", "keep/b.go"]
    assert {r["content"] for r in repository.read_sources(files).collect()} == {"x = 1\n"}
    assert repository.fingerprint(files.limit(0)).first()["fingerprint"] == "empty"


def test_documentation_budget(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("y.py",)], "rel_path string")
    docs = spark.createDataFrame([("a/README.md", "near"), ("README.md", "f" * 50), ("a/other.md", "no")], "rel_path string, content string")
    rows = {r["rel_path"]: r["docs"] for r in repository.near_documentation(files, docs, 20).collect()}
    assert rows["a/b/x.py"] == "[a/README.md]:\nnear\n\n---\n\n[README.md]:\n" + "f" * 16 + "\n...(truncated)"
    assert rows["y.py"].startswith("[README.md]:\nfff")


def test_last_definition_wins_and_boundaries(spark):
    rows = [
        (1, "function:a.py:go", "go", "function", "go() gone ago_ 'x go'"), (2, "function:b.py:go", "go", "function", "nothing"),
        (3, "function:c.py:user", "user", "function", "# go\nagog go_on égo"), (4, "function:d.py:other", "other", "function", "goé (go)"),
        (5, "function:e.cpp:A::b", "A::b()", "function", "x"), (6, "class:f.cpp:C", "C", "class", "A::b(1); AA::b"), (7, "function:g.rb:ok?", "ok?()", "function", ""),
        (8, "function:h.rb:k", "k()", "function", "ok? ok"), (8, "function:h.rb:k", "k()", "function", "ok? ok"),
    ]
    nodes = spark.createDataFrame(rows, "ordinal bigint, id string, label string, type string, code string")
    found = {(r["source"], r["target"]) for r in symbols.resolve_edges(nodes).collect()}
    assert found == {
        ("function:c.py:user", "function:b.py:go"), ("function:d.py:other", "function:b.py:go"), ("class:f.cpp:C", "function:e.cpp:A::b"),
        ("function:h.rb:k", "function:g.rb:ok?"),
    }
    assert symbols.resolve_edges(nodes.limit(0)).count() == 0


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    for n, m in ((12, 20), (40, 70)):
        links = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)] + [("n00", None)]
        df = spark.createDataFrame(links, "caller string, callee string")
        reach = {a: {b for x, b in links if x == a and b} for a in {x for p in links for x in p if x}}
        for _ in range(n):
            reach = {a: s | {c for b in s for c in reach.get(b, ())} for a, s in reach.items()}
        want = {a: min({b for b in s if a in reach.get(b, ())} | {a}) for a, s in reach.items()}
        for local in (10_000, 0):
            got = {r["node_id"]: r["scc_id"] for r in scc.components(df, local).collect()}
            assert got == {a: want[a] for a in got} and set(got) >= {x for p in links if p[1] for x in p}
    assert scc.components(spark.createDataFrame([], "caller string, callee string")).count() == 0


def test_forward_boundaries(spark):
    wide = [("r", "w")] + [("w", f"x{i:02}") for i in range(11)] + [("r", "t")] + [("t", f"y{i}") for i in range(10)]
    ring = [(f"c{i}", f"c{(i + 1) % 6}") for i in range(6)] + [("c0", "out"), ("s", "c0")]
    calls = spark.createDataFrame(wide + ring, "caller string, callee string")
    ids = sorted({x for p in wide + ring for x in p})
    nodes = spark.createDataFrame([(k, i, i, "function", None, None) for k, i in enumerate(ids)], "ordinal bigint, id string, label string, type string, path string, code string")
    parts = scc.components(calls)
    found = flow.forward_flow(nodes, calls, parts, "r", 3, 100)
    rows = {r["id"]: r for r in found.nodes.collect()}
    assert rows["w"]["truncated_calls"] and "x00" not in rows and rows["w"]["total_callees"] == 11 and "y0" in rows
    assert found.edges.filter("caller = 'w'").count() == 0
    inside = {r["id"] for r in flow.forward_flow(nodes, calls, parts, "s", 9, 100).nodes.collect()}
    assert inside == {"s", *(f"c{i}" for i in range(6))}
    # Members of a component come whatever the depth.
    back = {r["id"]: r["depth"] for r in flow.reverse_flow(nodes, calls, parts, "out", 0, 100).nodes.collect()}
    assert back == {"out": 0, **{f"c{i}": 1 for i in range(6)}}


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("a.py", "@app.get('/')\ndef f():\n  pass\nclass C: pass\n", [("function", "f", "[@get] f"), ("class", "C", "C")]),
        ("a.py", "def broken(:\n", []),
        ("a.ipynb", '{"cells": [{"cell_type": "code", "source": ["def f():\\n", "  pass"]}, {"cell_type": "markdown", "source": "x"}]}', [("function", "f", "f")]),
        ("a.ts", "interface I { }\ntype T = { a: 1 };\n", [("interface", "I", "I"), ("struct", "T", "T")]),
        ("a.c", "int f(int a) { return a; }\nstruct s { int x; };\n", [("function", "f", "f()"), ("struct", "s", "s")]),
        ("a.java", "class A { int f() { return 1; } }\n", [("function", "f", "f()"), ("class", "A", "A")]),
        ("a.go", "func (r *R) Get(x int) {}\ntype T struct {}\n", [("function", "Get", "Get()"), ("struct", "T", "T")]),
        ("a.rs", "pub fn f() {}\ntrait T {}\nenum E {}\nmod m;\n", [("function", "f", "f()"), ("interface", "T", "T"), ("class", "E", "E"), ("module", "m", "m")]),
        ("a.rb", "class A\n  def ok?\n  end\nend\n", [("function", "ok?", "ok?()"), ("class", "A", "A")]),
        ("a.php", "trait T {}\nfunction f() {}\n", [("function", "f", "f()"), ("struct", "T", "T")]),
        ("a.swift", "protocol P {}\nfunc f<T>(a: T) {}\n", [("function", "f", "f()"), ("interface", "P", "P")]),
        ("a.kt", "data class D(val x: Int)\nobject O {}\nfun f() {}\n", [("function", "f", "f()"), ("class", "D", "D"), ("module", "O", "O")]),
        ("a.dart", "void f() {}\nmixin M {}\n", [("function", "f", "f()"), ("interface", "M", "M")]),
        ("a.ex", "defmodule A do\n  def f(x) do\n  end\nend\n", [("function", "f", "f()"), ("module", "A", "A")]),
        ("a.lua", "local function f()\nend\ng = function()\nend\n", [("function", "f", "f()"), ("function", "g", "g()")]),
        ("a.zig", "pub fn f() void {}\nconst S = struct { };\n", [("function", "f", "f()"), ("struct", "S", "S")]),
        ("a.scala", "object O { def f(x: Int) = x }\n", [("function", "f", "f()"), ("module", "O", "O")]),
        ("a.sh", "f() {\n  true\n}\n", [("function", "f", "f()")]),
        ("a.R", "f <- function(x) { x }\n", [("function", "f", "f()")]),
        ("a.pl", "package A::B;\nsub f { 1 }\n", [("function", "f", "f()"), ("class", "A::B", "A::B")]),
        ("a.txt", "def f(): pass", []),
        ("a.py", None, []),
    ],
)
def test_languages(path, source, want):
    assert [s[:3] for s in symbols_of(path, source)] == want


def test_blocks():
    assert brace_block("function f({ a, b }) { return { a }; } x", 0) == "function f({ a, b }) { return { a }; }"
    assert brace_block("int f(int a);", 0) == "int f(int a)"
    assert brace_block("f() { if (x) { ", 0) == "f() "
    assert end_block("def f\n  if x\n  end\nend\nmore", 0) == "def f\n  if x\n  end\nend"
    assert len(end_block("def f\n" + "  x\n" * 300, 0).split("\n")) == 200
    assert signature_of('def f():\n  """doc\n  more"""\n  x') == 'def f():\n  """doc\n  more"""'
    assert docstring_of('def f():\n  "d"\n  # c\n', ".py") == "Docstring:\nd"
    assert docstring_of("/// one\npub fn f() {}", ".rs") == "Doc Comments:\none"
    assert docstring_of("/**\n * one\n * two\n */\n// three\nlet a;\n// four\nfunction f() {}\n// five", ".js") == "JSDoc:\none\ntwo\n/\n\nComments:\nthree\nfour"
    assert docstring_of("/* one\n * two */\nint f();", ".c") == "Block Comment:\none\ntwo" and docstring_of("/* open", ".c") == ""
    assert docstring_of("x = 1\nclass K:\n  # a\n\n  def f():\n    # b\n    'd'\n    # c\n", ".py") == "Comments:\na\nb"
    assert docstring_of("def f(:\n  # only\n", ".py") == "Comments:\nonly" and docstring_of("x", ".zz") == ""
    assert docstring_of(None, ".py") == "" and notebook_source('{"cells": []}') == ""


def test_status(spark):
    lines = spark.createDataFrame(list(enumerate([" M a/x.py", "R  old.py -> new.py", "?? b", "D  gone.py", ""])), "ordinal bigint, line string")
    parsed = {r["path"]: r["status"] for r in working_tree.parse_porcelain(lines).collect()}
    assert parsed == {"a/x.py": "M", "new.py": "M", "b": "A", "gone.py": "D"}
    nodes = spark.createDataFrame([("function:a/x.py:f", "f", "function", None), ("file:a/x.py", "x.py", "file", "a/x.py")], "id string, label string, type string, path string")
    loose = {r["node_id"]: r["status"] for r in working_tree.node_status(nodes, working_tree.parse_porcelain(lines), False).collect()}
    strict = {r["node_id"] for r in working_tree.node_status(nodes, working_tree.parse_porcelain(lines), True).collect()}
    assert loose == {"function:a/x.py:f": "M"} and strict == {"function:a/x.py:f", "file:a/x.py"}


def test_cache(spark, tmp_path):
    cache = export.Cache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1,)], "x int")
    assert cache.load("/r", "1:2") is None
    cache.save("/r", "1:2", {"nodes": df})
    assert cache.load("/r", "1:2")["nodes"].first()["x"] == 1 and cache.load("/r", "2:2") is None
    assert cache.clear() == 1 and cache.load("/r", "1:2") is None


def test_scalars(spark):
    row = spark.range(1).select(
        text.name_from_label(F.lit("[@get] f()")).alias("name"), text.clone_url(F.lit("git clone https://x/https://y/z ")).alias("url"),
        text.extension(F.lit("a/.bashrc")).alias("none"), text.extension(F.lit("a/B.PY")).alias("py"), text.rolling_hash(F.lit("ab")).alias("hash"),
        text.looks_like_code(F.lit(None).cast("string")).alias("code"), text.fence_language(F.lit("")).alias("fence"),
    ).first()
    assert row.asDict() == {"name": "f", "url": "https://y/z", "none": "", "py": ".py", "hash": "2e9", "code": False, "fence": "text"}


def test_layout(spark):
    files = spark.createDataFrame([(f"f{i}", i) for i in range(3)], "id string, index bigint")
    assert [round(r["y"]) for r in layout.sphere(files).orderBy("id").collect()] == [90, 0, -90]
    near = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 10.0, 0.0)], "id string, rank int, x double, y double")
    moved = {r["id"]: r["x"] for r in layout.without_overlap(near).collect()}
    assert moved == {"a": -35.0, "b": 45.0}
    nodes = spark.createDataFrame([("a", "<a>", "file"), ("b", "b", "function")], "id string, name string, type string")
    edges = spark.createDataFrame([("a", "b", "call")], "caller string, callee string, type string")
    parts = layout.svg(nodes, edges, near.select("id", "x", "y")).orderBy("part", "order").collect()
    assert [r["part"] for r in parts] == [0, 1, 2, 2, 3] and "&lt;a&gt;" in "".join(r["markup"] for r in parts)


def test_snippets_keep_bounds(spark):
    nodes = spark.createDataFrame([(k, f"function:x.py:f{k}", f"f{k}", "function", None, "l\n" * 60) for k in range(9)], "ordinal bigint, id string, label string, type string, path string, code string")
    calls = spark.createDataFrame([(f"function:x.py:f{k}", "function:x.py:f8") for k in range(8)], "caller string, callee string")
    rows = context.caller_snippets(calls, nodes).collect()
    assert len(rows) == 5 and all(r["code"].endswith("... (truncated)") for r in rows)
    assert graph.top_callers(calls, nodes).count() == 3


def test_streamed_parsing(spark, tmp_path):
    landing = tmp_path / "landing"
    spark.createDataFrame([(0, "a.py", "def f(): pass"), (1, "b.py", None)], "ordinal bigint, rel_path string, content string").write.json(str(landing))
    out = str(tmp_path / "out")
    query = scan.run_stream(scan.stream_nodes(spark, str(landing)), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert short(r["id"] for r in spark.read.parquet(out).collect()) == ["a.py", "b.py", "f"]


def _walked(calls, ids, parts, start, max_depth, max_nodes, forward):
    """The rule of the flows, node by node with a queue."""
    out, seen, queue, edges = [], {start}, [(start, 0)], set()
    near = {}
    for a, b in sorted(calls):
        x, y = (a, b) if forward else (b, a)
        near.setdefault(x, []).append(y)
    while queue and len(out) < max_nodes:
        node, depth = queue.pop(0)
        out.append((node, depth))
        others = near.get(node, [])
        if forward and node != start and len(others) > flow.FAN_OUT:
            continue
        mine = parts.get(node, {node})
        for other in others:
            edges.add((node, other) if forward else (other, node))
            theirs = parts.get(other, {other})
            if other in seen or other not in ids or forward and len(mine) > flow.LARGE_COMPONENT and other not in mine:
                continue
            if len(theirs) > 1:
                fresh = sorted(theirs - seen)
            else:
                fresh = [other] if depth < max_depth else []
            seen.update(fresh)
            queue += [(n, depth + 1) for n in fresh]
    return out, edges, len(out) >= max_nodes or bool(queue)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flows_against_a_queue(spark, seed):
    rng = random.Random(seed)
    n = 40
    names = [f"n{k:02d}" for k in range(n)]
    calls = {(rng.choice(names), rng.choice(names)) for _ in range(35)}
    for size in (2, 4, 7):  # cycles, one of them large
        ring = rng.sample(names, size)
        calls |= set(zip(ring, ring[1:] + ring[:1], strict=True))
    calls |= {(names[0], names[k]) for k in range(1, 13)} | {(names[1], "ghost")}
    calls = {(a, b) for a, b in calls if a != b}
    parts = {m: set(c) for c in scc.components_of(sorted(calls)) for m in c}
    rows = [(k, i, i, "function", None, "x") for k, i in enumerate(names)]
    nodes = spark.createDataFrame(rows, "ordinal bigint, id string, label string, type string, path string, code string")
    frame = spark.createDataFrame(sorted(calls), "caller string, callee string")
    found = checkpointed(scc.components(frame))
    for depth, limit, forward in ((0, 100, True), (2, 100, True), (1, 9, True), (2, 100, False), (1, 7, False)):
        for start in rng.sample(names, 2):
            got = (flow.forward_flow if forward else flow.reverse_flow)(nodes, frame, found, start, depth, limit)
            want, edges, cut = _walked(calls, set(names), parts, start, depth, limit, forward)
            assert [(r["id"], r["depth"]) for r in got.nodes.orderBy("rank").collect()] == want
            assert {(r["caller"], r["callee"]) for r in got.edges.collect()} == edges and got.truncated == cut


def test_tree_search_and_parents(spark):
    rows = [
        (0, "file:a/x.py", "x.py", "file", "a/x.py", None), (1, "class:a/x.py:K", "K", "class", None, "class K: zed()"), (2, "function:a/x.py:zed", "zed()", "function", None, "z"),
        (3, "function:a/x.py:abc", "abc()", "function", None, "z"), (4, "file:x.py", "x.py", "file", "x.py", None), (5, "struct:none.py:s", None, "struct", None, None), (0, "file:a/x.py", "x.py", "file", "a/x.py", None),
        (6, "function:x.py:t", "t()", "function", None, None),
    ]
    nodes = spark.createDataFrame(rows, "ordinal bigint, id string, label string, type string, path string, code string")
    found = tree.tree(nodes)
    got = {(r["parent_id"], r["id"]): r["place"] for r in found.collect()}
    assert got == {
        (None, "file:a/x.py"): None, (None, "file:x.py"): None, ("file:a/x.py", "class:a/x.py:K"): 0, ("file:a/x.py", "function:a/x.py:abc"): 1,
        ("class:a/x.py:K", "function:a/x.py:zed"): 0, ("file:x.py", "function:x.py:t"): 0,
    }
    shown = {r["id"] for r in tree.search_tree(found, "ZED").collect()}
    assert shown == {"function:a/x.py:zed", "class:a/x.py:K", "file:a/x.py"} and tree.search_tree(found, "").count() == 6 and tree.search_tree(found, "none").count() == 0
    assert {r["id"]: r["file_id"] for r in tree.parent_files(nodes).collect()} == {
        "class:a/x.py:K": "file:a/x.py", "function:a/x.py:zed": "file:a/x.py", "function:a/x.py:abc": "file:a/x.py", "function:x.py:t": "file:a/x.py",
    }
    assert tree.tree(nodes.limit(0)).count() == 0 and tree.parent_files(nodes.limit(0)).count() == 0


def test_chat_context(spark):
    rows = [(k, f"function:f.py:{n}", n, "function", None, "x" * 2000 if n != "e" else "") for k, n in enumerate("abcde")]
    nodes = spark.createDataFrame(rows, "ordinal bigint, id string, label string, type string, path string, code string")
    calls = spark.createDataFrame([(f"function:f.py:{a}", f"function:f.py:{b}") for a, b in ("ba", "ca", "da", "ea", "ab", "ac")], "caller string, callee string")
    got = {(r["role"], r["other"][-1]): (r["rank"], len(r["body"])) for r in context.chat_context(calls, nodes).filter("node_id = 'function:f.py:a'").collect()}
    assert got == {("caller", "b"): (1, 1500), ("caller", "c"): (2, 1500), ("caller", "d"): (3, 1500), ("callee", "b"): (1, 1500)}


def test_running_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if k % 4 else rng.choice("xyz"), k, "t" * rng.randrange(9)) for k in range(500)] + [(None, 900, "t"), ("x", 901, None)]
    df = spark.createDataFrame(rows, "g string, k int, text string")
    got = {r["k"]: r["taken"] for r in context.running_budget(df, "g", "k", "text", 300).collect()}
    want, used = {}, {}
    for g, k, t in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
        if used.get(g, 0) < 300:
            want[k] = min(len(t or ""), 300 - used.get(g, 0))
        used[g] = used.get(g, 0) + len(t or "")
    assert got == want
