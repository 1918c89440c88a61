"""SQL of bounded flows: levels one after another, each in the order of its parents, as common table expressions."""

from __future__ import annotations

CALLS = "calls AS (SELECT DISTINCT caller, callee FROM edges WHERE caller IS NOT NULL AND callee IS NOT NULL)"
#: Components of the calls by their closure; ``multi`` has those of several nodes.
COMPONENTS = (
    "reach AS (SELECT caller AS a, callee AS b FROM calls UNION SELECT r.a, c.callee FROM reach r JOIN calls c ON r.b = c.caller),"
    " multi AS (SELECT x.a AS node_id, min(x.b) AS scc_id, count(DISTINCT x.b) AS scc_size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1)"
)
_IDS = "ids AS (SELECT id FROM nodes UNION SELECT id FROM core_symbols)"


def flow_levels(start: str, forward: bool, max_depth: int, max_nodes: int, levels: int = 4) -> str:
    """``WITH`` clause whose last table ``flow`` has ``id, depth, rank, total, stopped, scc_id``; ``start`` selects one ``id``."""
    here, there = ("caller", "callee") if forward else ("callee", "caller")
    facts = (
        "(SELECT count(*) FROM calls WHERE caller = l.id) AS total, m.scc_id, CASE WHEN m.scc_size > 5 THEN m.scc_id END AS large"
        if forward
        else "0 AS total, m.scc_id, NULL AS large"
    )
    stopped = "total > 10 AND depth > 0" if forward else "false"
    parts = [CALLS, COMPONENTS, _IDS, f"start AS ({start})"]
    parts.append(f"level0 AS (SELECT l.id, 0 AS depth, 0 AS rank, {facts} FROM start l LEFT JOIN multi m ON m.node_id = l.id)")
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM level{j}" for j in range(k))
        single = f" UNION ALL SELECT o AS next, min((rank, o)) AS spot FROM near{k} WHERE sid IS NULL GROUP BY o" if k - 1 < max_depth else ""
        parts += [
            f"near{k} AS (SELECT p.rank, c.{there} AS o, m.scc_id AS sid FROM level{k - 1} p JOIN calls c ON c.{here} = p.id LEFT JOIN multi m ON m.node_id = c.{there}"
            f" WHERE NOT ({stopped}) AND (p.large IS NULL OR p.large = m.scc_id))",
            f"first{k} AS (SELECT m.node_id AS next, w.spot FROM (SELECT sid, min((rank, o)) AS spot FROM near{k} WHERE sid IS NOT NULL GROUP BY sid) w JOIN multi m ON m.scc_id = w.sid{single})",
            f"seen{k} AS ({seen})",
            f"fresh{k} AS (SELECT next AS id, row_number() OVER (ORDER BY spot, next) + (SELECT count(*) FROM seen{k}) - 1 AS rank FROM first{k} WHERE next IN (SELECT id FROM ids) AND next NOT IN (SELECT id FROM seen{k}))",
            f"level{k} AS (SELECT l.id, {k} AS depth, l.rank, {facts} FROM fresh{k} l LEFT JOIN multi m ON m.node_id = l.id WHERE l.rank < {max_nodes})",
        ]
    union = " UNION ALL ".join(f"SELECT id, depth, rank, total, {stopped} AS stopped, scc_id FROM level{k}" for k in range(levels + 1))
    return f"WITH RECURSIVE {', '.join(parts)}, flow AS ({union}) "
