"""Queries of the graph operators over the node and edge tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions.text import extension, last_part, name_from_label, path_of_id, rolling_hash, short_path
from graphmill.operators import context, export, flow, graph, layout, scc, symbols, tree, view
from graphmill.plans.flow_sql import CALLS, COMPONENTS, flow_levels
from graphmill.session import checkpointed, table
from graphmill.sources import repository, working_tree

#: A core symbol and a caller that the flows start from.
FLOW_DEPTH, FLOW_NODES = 2, 60
#: A cap on call links that is reached, and a word to search for.
SMALL_CAP, WORD = 5_000, "ledger"


def all_nodes(spark, sf_dir):
    """Nodes with the shared symbols behind them."""
    own = table(spark, sf_dir, "nodes").select("ordinal", "repo", "id", "label", "type", "path", "code")
    core = table(spark, sf_dir, "core_symbols").select(
        (F.lit(1 << 40) + F.abs(F.xxhash64("id")) % (1 << 30)).alias("ordinal"), F.lit(None).cast("string").alias("repo"), "id", "label", "type", "path", "code"
    )
    return own.unionByName(core)


def calls(spark, sf_dir):
    return graph.distinct_calls(table(spark, sf_dir, "edges"))


def links(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").dropDuplicates(["id"])
    own = calls(spark, sf_dir).select(F.lit(0).cast("bigint").alias("ordinal"), F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("call").alias("type"))
    return symbols.containment(nodes).unionByName(own)


def symbol_table_last_wins(spark, sf_dir):
    return symbols.symbol_table(table(spark, sf_dir, "nodes"))


def edge_resolution(spark, sf_dir):
    return symbols.resolve_edges(all_nodes(spark, sf_dir)).select("source", "target")


def link_cap_and_chunks(spark, sf_dir):
    edges = calls(spark, sf_dir).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit(0).alias("ordinal"), F.lit(0).alias("position"))
    return symbols.capped_links(edges).select("source", "target", "number", F.col("chunk").cast("bigint").alias("chunk"))


def link_cap_reached(spark, sf_dir):
    """Links capped below their number, in the order of their callers' places."""
    places = table(spark, sf_dir, "nodes").groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    edges = calls(spark, sf_dir).join(places.withColumnRenamed("id", "caller"), "caller")
    edges = edges.select(F.col("caller").alias("source"), F.col("callee").alias("target"), "ordinal", F.lit(0).alias("position"))
    return symbols.capped_links(edges, SMALL_CAP).select("source", "target", "number", F.col("chunk").cast("bigint").alias("chunk"))


def containment_links(spark, sf_dir):
    return symbols.containment(table(spark, sf_dir, "nodes")).select("source", "target").distinct()


def sibling_index(spark, sf_dir):
    return graph.siblings(symbols.containment(table(spark, sf_dir, "nodes")))


def sidebar_tree(spark, sf_dir):
    """The whole tree; files, which have no place, show -1."""
    return tree.tree(table(spark, sf_dir, "nodes")).fillna(-1, ["place"])


def tree_search(spark, sf_dir):
    return tree.search_tree(tree.tree(table(spark, sf_dir, "nodes")), WORD).select("file_id", "parent_id", "id", "kind")


def parent_navigation(spark, sf_dir):
    return tree.parent_files(table(spark, sf_dir, "nodes"))


def forward_adjacency(spark, sf_dir):
    return graph.callees_of(calls(spark, sf_dir))


def reverse_adjacency(spark, sf_dir):
    return graph.callers_of(calls(spark, sf_dir))


def in_degree(spark, sf_dir):
    return graph.in_degrees(table(spark, sf_dir, "edges").filter("caller IS NOT NULL"))


def entry_points(spark, sf_dir):
    return graph.entry_points(calls(spark, sf_dir))


def induced_subgraph(spark, sf_dir):
    ids = table(spark, sf_dir, "nodes").filter("repo LIKE 'quarry%'").select("id").distinct()
    return graph.induced(calls(spark, sf_dir), ids)


def call_links(spark, sf_dir):
    return links(spark, sf_dir).filter(symbols.is_call(F.col("type"))).select("source", "target")


def structural_links(spark, sf_dir):
    return links(spark, sf_dir).filter(~symbols.is_call(F.col("type"))).select("source", "target")


def scannable_bodies(spark, sf_dir):
    return symbols.scannable(all_nodes(spark, sf_dir)).select("id", "own_name", F.length("code").cast("bigint").alias("size")).distinct()


def map_filter(spark, sf_dir):
    kept = graph.map_filter(table(spark, sf_dir, "nodes"), "ledger", (".java",), ("struct",))
    return kept.select("id", "label", "type").distinct()


def map_drilldown(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").select("id", "type").distinct()
    return graph.drill_down(nodes, links(spark, sf_dir)).select("id")


def present_languages(spark, sf_dir):
    return table(spark, sf_dir, "nodes").filter("type = 'file'").select(extension(F.col("label")).alias("ext")).distinct()


def primary_language(spark, sf_dir):
    return graph.primary_language(table(spark, sf_dir, "nodes").filter("repo IS NOT NULL"), "repo")


def method_nesting(spark, sf_dir):
    return graph.class_members(table(spark, sf_dir, "nodes")).distinct()


def top_callers(spark, sf_dir):
    return graph.top_callers(calls(spark, sf_dir), all_nodes(spark, sf_dir))


def related_links(spark, sf_dir):
    return graph.related(calls(spark, sf_dir), "function:core/config.py:collapse_ledger_fragment")


def export_nodes(spark, sf_dir):
    return export.export_nodes(table(spark, sf_dir, "nodes").dropDuplicates(["ordinal", "id"])).distinct()


def export_edges(spark, sf_dir):
    return export.export_edges(links(spark, sf_dir))


def export_subgraph(spark, sf_dir):
    ids = table(spark, sf_dir, "nodes").filter("repo LIKE 'quarry%'").select("id")
    return export.export_edges(links(spark, sf_dir), ids)


def node_names(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").select("id", "label").distinct()
    return nodes.select("id", name_from_label(F.col("label")).alias("name"), path_of_id(F.col("id")).alias("file"), short_path(path_of_id(F.col("id"))).alias("short"))


def workspace_names(spark, sf_dir):
    return table(spark, sf_dir, "detail_requests").select("file_path", last_part(F.col("file_path")).alias("name")).distinct()


def member_hash(spark, sf_dir):
    return table(spark, sf_dir, "nodes").select("id").distinct().select("id", rolling_hash(F.col("id")).alias("hash"))


def folder_components(spark, sf_dir):
    """Components of calls between directories."""
    found = scc.components(folded_calls(spark, sf_dir))
    return found.filter("scc_size > 1").select("node_id", "scc_id", F.col("scc_size").cast("bigint").alias("scc_size"))


def components(spark, sf_dir):
    """Components of all calls."""
    found = scc.components(calls(spark, sf_dir))
    return found.filter("scc_size > 1").select("node_id", "scc_id", F.col("scc_size").cast("bigint").alias("scc_size"))


def folded_calls(spark, sf_dir):
    """Calls between directories (the first two parts of paths): a small dense graph with cycles."""

    def folder(c: str):
        return F.array_join(F.slice(F.split(path_of_id(F.col(c)), "/"), 1, 2), "/")

    return calls(spark, sf_dir).select(folder("caller").alias("caller"), folder("callee").alias("callee")).filter("caller <> '' AND callee <> ''").distinct()


def cycle_edges(spark, sf_dir):
    pairs = checkpointed(calls(spark, sf_dir))
    return scc.cycle_edges(pairs, scc.components(pairs))


def _flow_graph(spark, sf_dir):
    nodes, pairs = all_nodes(spark, sf_dir), checkpointed(calls(spark, sf_dir))
    return nodes, pairs, scc.components(pairs)


def _start(pairs, forward: bool) -> str:
    """The node to start from: by number of callees or callers, then by id."""
    by = "caller" if forward else "callee"
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).first()[by]


def reverse_flow_nodes(spark, sf_dir):
    return _folded_flow(spark, sf_dir).nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def reverse_flow_edges(spark, sf_dir):
    return _folded_flow(spark, sf_dir).edges.select("caller", "callee")


def reverse_flow_calls(spark, sf_dir):
    nodes, pairs, parts = _flow_graph(spark, sf_dir)
    found = flow.reverse_flow(nodes, pairs, parts, _start(pairs, False), FLOW_DEPTH, FLOW_NODES).nodes
    return found.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("depth", "rank")], "in_cycle", "scc_id")


def reverse_flow_cut(spark, sf_dir):
    nodes, pairs, parts = _flow_graph(spark, sf_dir)
    found = flow.reverse_flow(nodes, pairs, parts, _start(pairs, False), FLOW_DEPTH, 5)
    return flow.metadata(found).select("source_id", *[F.col(c).cast("bigint").alias(c) for c in ("node_count", "edge_count", "depth_used")], "truncated", "has_cycles")


def forward_flow_nodes(spark, sf_dir):
    nodes, pairs, parts = _flow_graph(spark, sf_dir)
    found = flow.forward_flow(nodes, pairs, parts, _start(pairs, True), FLOW_DEPTH, FLOW_NODES).nodes
    return found.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("depth", "rank", "total_callees")], "truncated_calls", "in_cycle", "scc_id")


def _folded_flow(spark, sf_dir):
    pairs = folded_calls(spark, sf_dir)
    ids = pairs.select(F.col("caller").alias("id")).union(pairs.select("callee")).distinct()
    nodes = ids.select(F.lit(0).cast("bigint").alias("ordinal"), "id", F.col("id").alias("label"), F.lit("module").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("code"))
    start = ids.agg(F.min("id")).first()[0]
    return flow.reverse_flow(nodes, pairs, scc.components(pairs), start, 2, 400)


def _view(mode: str, size: int = 5, remap: bool = False):
    def query(spark, sf_dir):
        found = _folded_flow(spark, sf_dir)
        shown = view.apply_view(found.nodes, found.edges, view.ViewState(mode, size, 10, (), remap))
        return shown.nodes.select("id", "name", "type", F.col("depth").cast("bigint").alias("depth"))

    query.__name__ = f"view_{mode}"
    return query


def _calls_view(spark, sf_dir, **state):
    nodes, pairs, parts = _flow_graph(spark, sf_dir)
    found = flow.reverse_flow(nodes, pairs, parts, _start(pairs, False), FLOW_DEPTH, FLOW_NODES)
    return view.apply_view(found.nodes, found.edges, view.ViewState(**state))


def view_depth_limit(spark, sf_dir):
    """The flow of all calls with all cycles expanded, cut at a depth that leaves only its start."""
    ids = [r["scc_id"] for r in scc.components(calls(spark, sf_dir)).filter("scc_size > 1").select("scc_id").distinct().orderBy("scc_id").limit(FLOW_NODES).collect()]
    shown = _calls_view(spark, sf_dir, cycle_mode="show", max_depth=1, expanded=tuple(ids))
    return shown.nodes.select("id", F.col("depth").cast("bigint").alias("depth"))


def view_hidden_cycles(spark, sf_dir):
    """What is hidden of the flow of all calls without its cycles: nodes and components."""
    return _calls_view(spark, sf_dir, cycle_mode="hide").hidden.select("nodes", "sccs")


def map_selection(spark, sf_dir):
    """The file with most symbols and what it holds."""
    nodes = table(spark, sf_dir, "nodes").select("id", "type").distinct()
    held = symbols.containment(nodes.withColumn("ordinal", F.lit(0)))
    chosen = held.filter("source <> 'repo-root'").groupBy("source").agg(F.count_distinct("target").alias("n")).orderBy(F.desc("n"), "source").first()["source"]
    return graph.drill_down(nodes, held, chosen).select("id")


def depth_layout(spark, sf_dir):
    found = _folded_flow(spark, sf_dir)
    placed = layout.layers(flow.ranked_siblings(found.nodes))
    return placed.select("id", F.round("across", 6).alias("across"), F.round("along", 6).alias("along"))


def _rounded(name: str):
    """A coordinate to four digits, without negative zeros."""
    r = F.round(name, 4)
    return F.when(r == 0, 0.0).otherwise(r)


def sphere_layout(spark, sf_dir):
    files = table(spark, sf_dir, "nodes").filter("type = 'file'").select("id").distinct()
    placed = layout.sphere(layout.global_index(files, "id"))
    return placed.select("id", *[_rounded(c).alias(c) for c in ("x", "y", "z")])


def ring_layout(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes")
    files = nodes.filter("type = 'file'").select("id").distinct()
    ring = graph.siblings(symbols.containment(nodes).filter("source <> 'repo-root'"))
    n = files.agg(F.count(F.lit(1)).alias("n_files")).withColumn("_one", F.lit(1))
    placed = ring.withColumn("_one", F.lit(1)).join(n, "_one")
    none = files.limit(0).select("id", *[F.lit(0.0).alias(c) for c in ("x", "y", "z")])
    return layout.rings(placed, none, F.col("n_files")).select("id", *[_rounded(c).alias(c) for c in ("x", "z")])


def fingerprint(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return repository.fingerprint(events.select((F.col("us") / 1e6).alias("mtime"), "event_id")).select("fingerprint")


def history_trim(spark, sf_dir):
    turns = table(spark, sf_dir, "detail_requests").filter("repo IS NOT NULL AND requested_at IS NOT NULL").select("repo", "request_id", "requested_at").distinct()
    last = working_tree.last_turns(turns.withColumn("turn", F.struct("requested_at", "request_id")), "repo", "turn")
    return last.select("repo", "request_id")


def recent_repos(spark, sf_dir):
    return graph.recent(table(spark, sf_dir, "detail_requests").filter("repo IS NOT NULL AND requested_at IS NOT NULL"), "repo", "requested_at")


def doc_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> '' AND repo IS NOT NULL")
    return context.running_budget(docs, "repo", "doc_id", "text", 4000).select("doc_id", "taken")


def _porcelain(spark, sf_dir):
    """A porcelain line for each file node, its code by the node's ordinal."""
    files = table(spark, sf_dir, "nodes").filter("type = 'file' AND path IS NOT NULL")
    code = F.expr("CASE ordinal % 5 WHEN 0 THEN ' M ' WHEN 1 THEN '?? ' WHEN 2 THEN 'D  ' WHEN 3 THEN 'A  ' ELSE 'R  old.x -> ' END")
    return files.select("ordinal", F.concat(code, "path").alias("line")).distinct()


def status_join(spark, sf_dir):
    return working_tree.node_status(table(spark, sf_dir, "nodes"), working_tree.parse_porcelain(_porcelain(spark, sf_dir)))


def caller_snippets(spark, sf_dir):
    found = context.caller_snippets(calls(spark, sf_dir), all_nodes(spark, sf_dir))
    return found.select("callee", "caller", "rank", F.length("code").cast("bigint").alias("size"))


def callee_signatures(spark, sf_dir):
    found = context.callee_signatures(calls(spark, sf_dir), all_nodes(spark, sf_dir))
    return found.select("caller", "callee", "rank", "label", F.substring_index("signature", "\n", 1).alias("first_line"))


def chat_context(spark, sf_dir):
    found = context.chat_context(calls(spark, sf_dir), all_nodes(spark, sf_dir))
    return found.select("node_id", "role", "other", "rank", F.length("body").cast("bigint").alias("size"))


def context_sizes(spark, sf_dir):
    found = context.context(all_nodes(spark, sf_dir), calls(spark, sf_dir))
    sizes = [F.greatest(F.size(c), F.lit(0)).cast("bigint").alias(f"n_{c}") for c in ("callers", "callees")]
    return found.select("node_id", "short_path", *sizes)


def node_context(spark, sf_dir):
    found = context.context(all_nodes(spark, sf_dir), calls(spark, sf_dir))
    return found.select("node_id", "docstring", "short_path", F.size("callers").alias("n_callers"), F.size("callees").alias("n_callees"))


QUERIES = {
    f.__name__: f
    for f in (
        symbol_table_last_wins, edge_resolution, link_cap_and_chunks, containment_links, sibling_index, forward_adjacency, reverse_adjacency, in_degree,
        entry_points, induced_subgraph, call_links, structural_links, scannable_bodies, map_filter, map_drilldown, present_languages, primary_language,
        method_nesting, top_callers, related_links, export_nodes, export_edges, export_subgraph, node_names, workspace_names, member_hash, components,
        cycle_edges, reverse_flow_nodes, reverse_flow_edges, reverse_flow_calls, reverse_flow_cut, forward_flow_nodes, depth_layout, sphere_layout, ring_layout, fingerprint,
        history_trim, recent_repos, doc_budget, status_join, caller_snippets, callee_signatures, node_context, link_cap_reached, sidebar_tree, tree_search, parent_navigation, chat_context, context_sizes,
        folder_components, view_depth_limit, view_hidden_cycles, map_selection,
    )
}
QUERIES |= {"cycle_hide": _view("hide"), "cycle_only": _view("only"), "cycle_show": _view("show"), "cycle_collapse": _view("collapse"), "cycle_collapse_remapped": _view("collapse", 5, True)}

_CALLS = CALLS
_NAME = "regexp_replace(replace(label, '()', ''), '^.*\\] ', '')"
_ALL = (
    "every AS (SELECT ordinal, repo, id, label, type, path, code FROM nodes UNION ALL"
    " SELECT 1099511627776 AS ordinal, NULL, id, label, type, path, code FROM core_symbols)"
)
_FILE = "split_part(id, ':', 2)"
_STRUCTURE = f"""structure AS (SELECT ordinal, CASE WHEN type = 'file' THEN 'repo-root' ELSE 'file:' || {_FILE} END AS source, id AS target FROM nodes WHERE type <> 'root')"""
_FOLD = (
    "folded AS (SELECT DISTINCT list_aggregate(list_slice(string_split(split_part(caller, ':', 2), '/'), 1, 2), 'string_agg', '/') AS caller,"
    " list_aggregate(list_slice(string_split(split_part(callee, ':', 2), '/'), 1, 2), 'string_agg', '/') AS callee FROM calls)"
)
_CLOSURE = "reach AS (SELECT caller AS a, callee AS b FROM folded UNION SELECT r.a, f.callee FROM reach r JOIN folded f ON r.b = f.caller)"
_SCC = "scc AS (SELECT x.a AS node_id, min(x.b) AS scc_id, count(DISTINCT x.b) AS scc_size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
_EXT = "lower(regexp_extract(regexp_extract(replace(label, chr(92), '/'), '([^/]*)$', 1), '(\\.[^.]*)$', 1))"
SQL = {
    "symbol_table_last_wins": f"""
        WITH named AS (SELECT {_NAME} AS name, id, ordinal FROM nodes WHERE type NOT IN ('file', 'root'))
        SELECT name, arg_max(id, (ordinal, id)) AS node_id FROM named WHERE name <> '' GROUP BY name""",
    "link_cap_and_chunks": f"""
        WITH {_CALLS}, n AS (SELECT caller AS source, callee AS target, row_number() OVER (ORDER BY caller, callee) AS number FROM calls)
        SELECT source, target, number, (number - 1) // 200 AS chunk FROM n WHERE number <= 50000""",
    "containment_links": f"WITH {_STRUCTURE} SELECT DISTINCT source, target FROM structure",
    "sibling_index": f"""
        WITH {_STRUCTURE}, p AS (SELECT target AS child, arg_min(source, ordinal) AS parent, min(ordinal) AS ordinal FROM structure GROUP BY target)
        SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY ordinal, child) - 1 AS index, count(*) OVER (PARTITION BY parent) AS siblings FROM p""",
    "forward_adjacency": f"WITH {_CALLS} SELECT caller AS node, count(*) AS n, string_agg(callee, '|' ORDER BY callee) AS neighbours FROM calls GROUP BY caller",
    "reverse_adjacency": f"""
        WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS k FROM calls)
        SELECT callee AS node, max(k) AS n, string_agg(caller, '|' ORDER BY caller) FILTER (WHERE k <= 20) AS neighbours FROM r GROUP BY callee""",
    "in_degree": "SELECT callee, count(DISTINCT caller) AS n_callers FROM edges WHERE caller IS NOT NULL AND callee IS NOT NULL GROUP BY callee",
    "entry_points": f"WITH {_CALLS} SELECT DISTINCT caller AS node FROM calls WHERE caller NOT IN (SELECT callee FROM calls)",
    "induced_subgraph": f"""
        WITH {_CALLS}, ids AS (SELECT id FROM nodes WHERE repo LIKE 'quarry%')
        SELECT caller, callee FROM calls WHERE caller IN (SELECT id FROM ids) AND callee IN (SELECT id FROM ids)""",
    "call_links": f"WITH {_CALLS} SELECT caller AS source, callee AS target FROM calls",
    "structural_links": f"WITH {_STRUCTURE} SELECT DISTINCT source, target FROM structure",
    "scannable_bodies": f"WITH {_ALL} SELECT DISTINCT id, {_NAME} AS own_name, length(code) AS size FROM every WHERE type IN ('function', 'class') AND length(code) > 0",
    "edge_resolution": f"""
        WITH {_ALL}, bodies AS (SELECT DISTINCT id, {_NAME} AS own, code FROM every WHERE type IN ('function', 'class') AND length(code) > 0),
        symbols AS (SELECT name, arg_max(id, (ordinal, id)) AS node_id FROM (SELECT {_NAME} AS name, id, ordinal FROM every WHERE type NOT IN ('file', 'root')) WHERE name <> '' GROUP BY name),
        tokens AS (SELECT id, own, unnest(list_distinct(regexp_split_to_array(code, '[^\\p{{L}}\\p{{N}}_]+'))) AS token FROM bodies)
        SELECT DISTINCT id AS source, node_id AS target FROM tokens JOIN symbols ON token = name AND name <> own""",
    "map_filter": f"""
        SELECT DISTINCT id, label, type FROM nodes WHERE contains(lower(label), 'ledger') AND type <> 'struct' AND NOT lower(coalesce(path, {_FILE})) LIKE '%.java'""",
    "map_drilldown": "SELECT DISTINCT id FROM nodes WHERE type IN ('root', 'file')",
    "present_languages": f"SELECT DISTINCT {_EXT} AS ext FROM nodes WHERE type = 'file'",
    "primary_language": f"""
        WITH e AS (SELECT repo, replace({_EXT}, '.', '') AS ext, count(*) AS n, min(ordinal) AS first FROM nodes WHERE type = 'file' AND repo IS NOT NULL GROUP BY ALL),
        best AS (SELECT repo, arg_max(ext, (n, -first)) AS ext FROM e GROUP BY repo)
        SELECT repo, coalesce(MAP {{'py': 'Python', 'js': 'JavaScript', 'ts': 'TypeScript', 'jsx': 'React', 'tsx': 'React TypeScript', 'java': 'Java', 'cs': 'C#', 'go': 'Go',
        'rs': 'Rust', 'c': 'C', 'cpp': 'C++'}}[ext], upper(ext)) AS language FROM best""",
    "method_nesting": f"""
        WITH named AS (SELECT DISTINCT id, type, code, {_FILE} AS path, regexp_replace(label, '\\(\\)$', '') AS name FROM nodes WHERE type IN ('function', 'class')),
        inside AS (SELECT DISTINCT f.path, c.id AS class_id, f.id AS function_id FROM named f JOIN named c ON f.path = c.path AND f.type = 'function' AND c.type = 'class' AND contains(c.code, f.name))
        SELECT path, class_id, function_id FROM inside UNION ALL
        SELECT DISTINCT path, NULL, id FROM named WHERE type = 'function' AND (path, id) NOT IN (SELECT path, function_id FROM inside)""",
    "top_callers": f"""
        WITH {_CALLS}, {_ALL}, d AS (SELECT caller, count(*) AS degree FROM calls GROUP BY caller),
        r AS (SELECT callee, caller, row_number() OVER (PARTITION BY callee ORDER BY CASE WHEN contains(caller, split_part(callee, ':', 2)) THEN 0 ELSE 1 END, degree DESC, caller) AS rank
              FROM calls JOIN d USING (caller))
        SELECT callee, caller, rank FROM r WHERE rank <= 3 AND callee IN (SELECT id FROM every)""",
    "related_links": f"""
        WITH {_CALLS} SELECT caller AS other, 'in' AS direction FROM calls WHERE callee = 'function:core/config.py:collapse_ledger_fragment'
        UNION SELECT callee, 'out' FROM calls WHERE caller = 'function:core/config.py:collapse_ledger_fragment'""",
    "export_nodes": f"SELECT DISTINCT id, replace(label, '()', '') AS name, {_FILE} AS file FROM nodes WHERE type IN ('function', 'class', 'interface', 'struct')",
    "export_edges": f"""WITH {_CALLS} SELECT caller AS "from", callee AS "to", 'call' AS type FROM calls""",
    "export_subgraph": f"""
        WITH {_CALLS}, ids AS (SELECT id FROM nodes WHERE repo LIKE 'quarry%')
        SELECT caller AS "from", callee AS "to", 'call' AS type FROM calls WHERE caller IN (SELECT id FROM ids) AND callee IN (SELECT id FROM ids)""",
    "node_names": f"""
        SELECT DISTINCT id, {_NAME} AS name, {_FILE} AS file, CASE WHEN len(string_split({_FILE}, '/')) <= 2 THEN {_FILE}
        ELSE '.../' || list_aggregate(list_slice(string_split({_FILE}, '/'), -2, -1), 'string_agg', '/') END AS short FROM nodes""",
    "workspace_names": "SELECT DISTINCT file_path, regexp_extract(replace(file_path, chr(92), '/'), '([^/]*)/*$', 1) AS name FROM detail_requests",
    "folder_components": f"WITH RECURSIVE {_CALLS}, {_FOLD}, {_CLOSURE}, {_SCC} SELECT node_id, scc_id, scc_size FROM scc WHERE scc_size > 1",
    "components": f"WITH RECURSIVE {CALLS}, {COMPONENTS} SELECT node_id, scc_id, scc_size FROM multi",
    "cycle_edges": f"""
        WITH RECURSIVE {CALLS}, {COMPONENTS}
        SELECT caller, callee, coalesce(a.scc_id = b.scc_id, false) AS is_cycle FROM calls LEFT JOIN multi a ON caller = a.node_id LEFT JOIN multi b ON callee = b.node_id""",
    "sphere_layout": """
        WITH f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM nodes WHERE type = 'file')),
        g AS (SELECT id, 90 * greatest(1.0, sqrt(n / 50.0)) AS r, 1 - i / greatest(n - 1, 1) * 2 AS u, pi() * (3 - sqrt(5)) * i AS t FROM f),
        h AS (SELECT id, round(cos(t) * sqrt(greatest(0, 1 - u * u)) * r, 4) AS x, round(u * r, 4) AS y, round(sin(t) * sqrt(greatest(0, 1 - u * u)) * r, 4) AS z FROM g)
        SELECT id, CASE WHEN x = 0 THEN 0.0 ELSE x END AS x, CASE WHEN y = 0 THEN 0.0 ELSE y END AS y, CASE WHEN z = 0 THEN 0.0 ELSE z END AS z FROM h""",
    "history_trim": """
        WITH t AS (SELECT DISTINCT repo, request_id, requested_at FROM detail_requests WHERE repo IS NOT NULL AND requested_at IS NOT NULL)
        SELECT repo, request_id FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY requested_at DESC, request_id DESC) AS k FROM t) WHERE k <= 12""",
    "recent_repos": """
        SELECT repo, max(requested_at) AS requested_at FROM detail_requests WHERE repo IS NOT NULL AND requested_at IS NOT NULL GROUP BY repo ORDER BY 2 DESC, 1 LIMIT 8""",
    "doc_budget": """
        WITH d AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY repo ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM documents WHERE text <> '' AND repo IS NOT NULL)
        SELECT doc_id, CAST(least(n, 4000 - before) AS BIGINT) AS taken FROM d WHERE before < 4000""",
    "status_join": f"""
        WITH s AS (SELECT replace(path, chr(92), '/') AS p, arg_max(CASE ordinal % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN 'A' ELSE 'M' END, ordinal) AS status
        FROM nodes WHERE type = 'file' AND path IS NOT NULL GROUP BY 1),
        f AS (SELECT DISTINCT id, replace(CASE WHEN type = 'file' THEN path ELSE {_FILE} END, chr(92), '/') AS file FROM nodes)
        SELECT id AS node_id, status FROM f JOIN s ON file = p""",
    "member_hash": """
        WITH h AS (SELECT DISTINCT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM nodes)
        SELECT id, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS hash FROM h""",
    "link_cap_reached": f"""
        WITH {_CALLS}, p AS (SELECT id, min(ordinal) AS ordinal FROM nodes GROUP BY id),
        n AS (SELECT caller AS source, callee AS target, row_number() OVER (ORDER BY p.ordinal, caller, callee) AS number FROM calls JOIN p ON id = caller)
        SELECT source, target, number, (number - 1) // 200 AS chunk FROM n WHERE number <= {SMALL_CAP}""",
    "ring_layout": f"""
        WITH {_STRUCTURE}, p AS (SELECT target AS child, arg_min(source, ordinal) AS parent, min(ordinal) AS ordinal FROM structure WHERE source <> 'repo-root' GROUP BY target),
        s AS (SELECT child, row_number() OVER (PARTITION BY parent ORDER BY ordinal, child) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM p),
        f AS (SELECT greatest(1.0, sqrt(count(DISTINCT id) / 50.0)) AS scale FROM nodes WHERE type = 'file'),
        r AS (SELECT child AS id, (25.0 + n * 0.2) * scale AS r, i / greatest(n, 1) * (2 * pi()) AS t FROM s, f),
        h AS (SELECT id, round(cos(t) * r, 4) AS x, round(sin(t) * r, 4) AS z FROM r)
        SELECT id, CASE WHEN x = 0 THEN 0.0 ELSE x END AS x, CASE WHEN z = 0 THEN 0.0 ELSE z END AS z FROM h""",
    "callee_signatures": f"""
        WITH {_CALLS}, {_ALL}, r AS (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY callee) AS rank FROM calls),
        b AS (SELECT id, arg_max(label, ordinal) AS label, arg_max(code, ordinal) AS code FROM (SELECT id, ordinal, label, coalesce(code, '') AS code FROM every) GROUP BY id)
        SELECT caller, callee, rank, label, split_part(code, chr(10), 1) AS first_line FROM r JOIN b ON id = callee WHERE rank <= 5 AND code <> ''""",
    "chat_context": f"""
        WITH {_CALLS}, {_ALL}, known AS (SELECT DISTINCT id FROM every), d AS (SELECT caller, count(*) AS degree FROM calls GROUP BY caller),
        up AS (SELECT callee AS node_id, 'caller' AS role, caller AS other, row_number() OVER (PARTITION BY callee ORDER BY CASE WHEN contains(caller, split_part(callee, ':', 2)) THEN 0 ELSE 1 END, degree DESC, caller) AS rank
               FROM calls JOIN d USING (caller)),
        down AS (SELECT caller AS node_id, 'callee' AS role, min(callee) AS other, 1 AS rank FROM calls GROUP BY caller),
        n AS (SELECT * FROM up WHERE rank <= 3 UNION ALL SELECT * FROM down),
        b AS (SELECT id, arg_max(code, ordinal) AS code FROM (SELECT id, ordinal, coalesce(code, '') AS code FROM every) GROUP BY id)
        SELECT node_id, role, other, rank, least(length(code), 1500) AS size FROM n JOIN known k ON k.id = node_id JOIN b ON b.id = other WHERE code <> ''""",
    "context_sizes": f"""
        WITH {_CALLS}, {_ALL}, b AS (SELECT id, arg_max(type, ordinal) AS type, arg_max(code, ordinal) AS code FROM (SELECT id, ordinal, type, coalesce(code, '') AS code FROM every) GROUP BY id),
        up AS (SELECT callee AS id, count(*) AS n FROM (SELECT callee, caller, row_number() OVER (PARTITION BY callee ORDER BY caller) AS k FROM calls) JOIN b ON b.id = caller WHERE k <= 5 AND code <> '' GROUP BY callee),
        down AS (SELECT caller AS id, count(*) AS n FROM (SELECT callee, caller, row_number() OVER (PARTITION BY caller ORDER BY callee) AS k FROM calls) JOIN b ON b.id = callee WHERE k <= 5 AND code <> '' GROUP BY caller),
        s AS (SELECT id, split_part(id, ':', 2) AS file FROM b WHERE type NOT IN ('root', 'file'))
        SELECT s.id AS node_id, CASE WHEN len(string_split(file, '/')) <= 2 THEN file ELSE '.../' || list_aggregate(list_slice(string_split(file, '/'), -2, -1), 'string_agg', '/') END AS short_path,
        coalesce(up.n, 0) AS n_callers, coalesce(down.n, 0) AS n_callees FROM s LEFT JOIN up ON up.id = s.id LEFT JOIN down ON down.id = s.id""",
    "parent_navigation": f"""
        WITH f AS (SELECT id AS file_id, min(ordinal) AS ordinal, substr(id, 6) AS path FROM nodes WHERE type = 'file' GROUP BY id),
        s AS (SELECT DISTINCT id, {_FILE} AS path FROM nodes WHERE type IN ('function', 'class', 'interface', 'struct'))
        SELECT s.id, arg_min(file_id, (ordinal, file_id)) AS file_id FROM s JOIN f ON f.path = s.path OR ends_with(f.path, '/' || s.path) GROUP BY s.id""",
    "fingerprint": "SELECT printf('%d:%.6f', count(*), max(epoch_us(ts)) / 1e6) AS fingerprint FROM events",
    "caller_snippets": f"""
        WITH {_CALLS}, {_ALL}, r AS (SELECT callee, caller, row_number() OVER (PARTITION BY callee ORDER BY caller) AS rank FROM calls),
        b AS (SELECT id, arg_max(code, ordinal) AS code FROM (SELECT id, ordinal, coalesce(code, '') AS code FROM every) GROUP BY id)
        SELECT callee, caller, rank, CASE WHEN len(string_split(code, chr(10))) > 50
        THEN length(list_aggregate(list_slice(string_split(code, chr(10)), 1, 50), 'string_agg', chr(10))) + 16 ELSE length(code) END AS size
        FROM r JOIN b ON id = caller WHERE rank <= 5 AND code <> ''""",
}
_VIEW = (
    f"WITH RECURSIVE {_CALLS}, {_FOLD}, {_CLOSURE}, {_SCC}, multi AS (SELECT * FROM scc WHERE scc_size > 1),"
    " ids AS (SELECT caller AS id FROM folded UNION SELECT callee FROM folded), start AS (SELECT min(id) AS id FROM ids),"
    " up AS (SELECT f.callee AS here, coalesce(b.node_id, f.caller) AS id, a.scc_id IS NOT NULL AS free FROM folded f LEFT JOIN multi a ON f.caller = a.node_id LEFT JOIN multi b ON a.scc_id = b.scc_id),"
    " walk AS (SELECT id, 0 AS depth FROM start UNION SELECT up.id, w.depth + 1 FROM walk w JOIN up ON up.here = w.id WHERE (free OR w.depth < 2) AND w.depth < 12),"
    " flow AS (SELECT w.id, min(depth) AS depth, any_value(m.scc_id) AS scc_id, any_value(m.scc_size) AS scc_size FROM walk w LEFT JOIN multi m ON m.node_id = w.id GROUP BY w.id) "
)
SQL |= {
    "reverse_flow_nodes": _VIEW + "SELECT id, depth FROM flow",
    "reverse_flow_edges": _VIEW + "SELECT caller, callee FROM folded JOIN flow ON callee = id",
    "cycle_hide": _VIEW + "SELECT id, id AS name, 'module' AS type, depth FROM flow WHERE scc_id IS NULL AND depth <= 10",
    "cycle_only": _VIEW + "SELECT id, id AS name, 'module' AS type, depth FROM flow WHERE scc_id IS NOT NULL AND depth <= 10",
    "cycle_show": _VIEW + "SELECT id, id AS name, 'module' AS type, depth FROM flow WHERE (scc_id IS NULL OR scc_id = id) AND depth <= 10",
    "depth_layout": _VIEW
    + "SELECT id, round((row_number() OVER (PARTITION BY depth ORDER BY id) - 1 - (count(*) OVER (PARTITION BY depth) - 1) / 2.0) * 25.0, 6) AS across, round(depth * 30.0, 6) AS along FROM flow",
}
_TREE = """
    WITH r AS (SELECT DISTINCT id, coalesce(label, '') AS name, type, code, string_split(id, ':') AS parts FROM nodes),
    f AS (SELECT id AS file_id, name, regexp_replace(id, '^file:', '') AS path FROM r WHERE type = 'file'),
    b AS (SELECT file_id, r.id, r.name, type, code FROM r JOIN f ON f.path = array_to_string(list_slice(parts, 2, len(parts) - 1), ':')
          WHERE type IN ('function', 'class', 'interface', 'struct', 'module') AND len(parts) >= 3),
    c AS (SELECT * FROM b WHERE type = 'class'), o AS (SELECT * FROM b WHERE type <> 'class'),
    n AS (SELECT o.file_id, c.id AS parent_id, o.id, 'symbol' AS kind, o.name FROM o JOIN c ON o.file_id = c.file_id AND contains(c.code, regexp_replace(o.name, '\\(\\)$', ''))),
    a AS (SELECT file_id, file_id AS parent_id, id, 'symbol' AS kind, name FROM o WHERE (file_id, id) NOT IN (SELECT file_id, id FROM n)),
    u AS (SELECT file_id, file_id AS parent_id, id, 'class' AS kind, name FROM c UNION ALL SELECT * FROM a UNION ALL SELECT * FROM n),
    tree AS (SELECT file_id, NULL AS parent_id, file_id AS id, 'file' AS kind, name, CAST(NULL AS BIGINT) AS place FROM f
             UNION ALL SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY kind, name, id) - 1 FROM u) """
_HIT = f"contains(lower(name), '{WORD}')"
_MOST_CALLED = "SELECT callee AS id FROM calls GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1"
_MOST_CALLING = "SELECT caller AS id FROM calls GROUP BY caller ORDER BY count(*) DESC, caller LIMIT 1"
SQL |= {
    "sidebar_tree": _TREE + "SELECT file_id, parent_id, id, kind, name, coalesce(place, -1) AS place FROM tree",
    "tree_search": _TREE
    + f"""SELECT file_id, parent_id, id, kind FROM tree t WHERE {_HIT} OR kind = 'class' AND id IN (SELECT parent_id FROM tree WHERE {_HIT})
        OR kind = 'file' AND id IN (SELECT file_id FROM tree WHERE {_HIT})""",
    "reverse_flow_calls": flow_levels(_MOST_CALLED, False, FLOW_DEPTH, FLOW_NODES) + "SELECT id, depth, rank, scc_id IS NOT NULL AS in_cycle, scc_id FROM flow",
    "forward_flow_nodes": flow_levels(_MOST_CALLING, True, FLOW_DEPTH, FLOW_NODES)
    + "SELECT id, depth, rank, total AS total_callees, stopped AS truncated_calls, scc_id IS NOT NULL AS in_cycle, scc_id FROM flow",
    "reverse_flow_cut": flow_levels(_MOST_CALLED, False, FLOW_DEPTH, 5)
    + """, e AS (SELECT caller, callee FROM calls WHERE callee IN (SELECT id FROM flow))
        SELECT (SELECT id FROM start) AS source_id, (SELECT count(*) FROM flow) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT max(depth) FROM flow) AS depth_used,
        (SELECT count(*) >= 5 FROM flow) AS truncated, (SELECT coalesce(bool_or(a.scc_id = b.scc_id), false) FROM e LEFT JOIN multi a ON a.node_id = caller LEFT JOIN multi b ON b.node_id = callee) AS has_cycles""",
}
_SUMMARY = (
    _VIEW
    + """, m AS (SELECT scc_id, count(*) AS n, min(depth) AS depth, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(string_agg(id, '|' ORDER BY id), ''), lambda c: unicode(c)::BIGINT)),
        lambda a, c: (a * 31 + c) % 4294967296) AS h FROM flow WHERE scc_id IS NOT NULL GROUP BY scc_id HAVING count(*) > 5),
        shown AS (SELECT id, id AS name, 'module' AS type, depth FROM flow WHERE scc_id IS NULL OR scc_id NOT IN (SELECT scc_id FROM m)
        UNION ALL SELECT 'scc-summary:' || lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)), '\u267b Cycle (' || n || ')', 'scc-summary', depth FROM m)
        SELECT * FROM shown WHERE depth <= 10"""
)
SQL |= {
    "cycle_collapse": _SUMMARY,
    "cycle_collapse_remapped": _SUMMARY,
    "view_depth_limit": flow_levels(_MOST_CALLED, False, FLOW_DEPTH, FLOW_NODES) + "SELECT id, depth FROM flow WHERE depth <= 1",
    "view_hidden_cycles": flow_levels(_MOST_CALLED, False, FLOW_DEPTH, FLOW_NODES)
    + "SELECT count(*) FILTER (WHERE scc_id IS NOT NULL OR depth > 10) AS nodes, count(DISTINCT scc_id) AS sccs FROM flow",
    "map_selection": f"""
        WITH s AS (SELECT DISTINCT 'file:' || {_FILE} AS source, id FROM nodes WHERE type NOT IN ('root', 'file')),
        c AS (SELECT source FROM s GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
        SELECT id FROM s WHERE source IN (SELECT source FROM c) AND id IN (SELECT id FROM nodes) UNION SELECT source FROM c WHERE source IN (SELECT id FROM nodes)""",
}
