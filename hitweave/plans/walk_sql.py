"""DuckDB SQL that finds tracks as the walks do: all paths listed, then one start after the other by recursion.

Each function gives common table expressions over a relation of oriented, scored
edges; they are made for the small graphs of the tests, whose paths can be listed.
"""

from __future__ import annotations


def reach(edges: str) -> str:
    return f"""reach(event_id, a, b) AS (
    SELECT event_id, src, src FROM {edges} UNION SELECT event_id, dst, dst FROM {edges} UNION
    SELECT r.event_id, r.a, CASE WHEN e.src = r.b THEN e.dst ELSE e.src END FROM reach r JOIN {edges} e ON e.event_id = r.event_id AND (e.src = r.b OR e.dst = r.b)),
comp AS (SELECT event_id, a AS node, min(b) AS component FROM reach GROUP BY 1, 2)"""


def kinds(edges: str) -> str:
    return f"""kinds AS (
    SELECT event_id, component, count(*) AS size, CASE WHEN count(*) < 3 THEN 'small' WHEN max(i) <= 1 AND max(o) <= 1 THEN 'simple' ELSE 'complex' END AS kind FROM (
        SELECT c.*, (SELECT count(*) FROM {edges} e WHERE e.event_id = c.event_id AND e.dst = c.node) AS i, (SELECT count(*) FROM {edges} e WHERE e.event_id = c.event_id AND e.src = c.node) AS o FROM comp c) GROUP BY 1, 2)"""


def simple(name: str = "simple") -> str:
    return f"{name} AS (SELECT event_id, component, list(node ORDER BY node) AS hits FROM comp JOIN kinds USING (event_id, component) WHERE kind = 'simple' GROUP BY 1, 2)"


def marked(edges: str) -> str:
    """Each edge with its places among those of its source (o) and of its target (i)."""
    return f"""marked AS (SELECT *, max(score) OVER (PARTITION BY event_id, src) AS top,
    row_number() OVER (PARTITION BY event_id, src ORDER BY score DESC, dst) AS o, row_number() OVER (PARTITION BY event_id, dst ORDER BY score DESC, src) AS i,
    EXISTS (SELECT 1 FROM {edges} x WHERE x.event_id = z.event_id AND x.dst = z.src) AS inner_ FROM {edges} z)"""


CUT = {
    "longest": "((o = 1 AND top >= 0.1) OR score > 0.6)",
    "level": "((o = 1 AND top >= 0.1) OR score > 0.6)",
    "lookback": "((o = 1 AND top >= 0.1) OR score > 0.6) AND (inner_ OR i = 1)",
    "dp": "((o = 1 AND score >= 0.1) OR score > 0.6) AND ((i = 1 AND score >= 0.1) OR score > 0.6)",
    "road": "true",
}


def _edges(walk: str) -> str:
    """The cut edges of the complex components, the out-neighbours of nodes, and the nodes by start order."""
    root = "[r.s]" if walk == "road" else "[r.first_dst, r.s]"
    return f"""we AS (SELECT m.event_id, c.component, m.src, m.dst, m.score FROM marked m JOIN comp c ON c.event_id = m.event_id AND c.node = m.src JOIN kinds k ON k.event_id = c.event_id AND k.component = c.component WHERE k.kind = 'complex' AND {CUT[walk]}),
out_ AS (SELECT event_id, src AS node, list(dst ORDER BY dst) AS ds, list({{'d': dst, 'w': score}} ORDER BY dst) AS ws FROM we GROUP BY 1, 2),
no AS (SELECT n.*, coalesce(o.ds, []) AS ds, coalesce(o.ws, []) AS ws FROM (SELECT event_id, component, src AS node FROM we UNION SELECT event_id, component, dst FROM we) n LEFT JOIN out_ o USING (event_id, node)),
root AS (SELECT w.event_id, w.src AS s, min(w.dst) AS first_dst FROM we w WHERE NOT EXISTS (SELECT 1 FROM we x WHERE x.event_id = w.event_id AND x.dst = w.src) GROUP BY 1, 2),
ap(event_id, component, s, at_, nodes, scores, nbs, ds) AS (
    SELECT event_id, component, node, node, [node], []::DOUBLE[], []::BIGINT[][], ds FROM no UNION ALL
    SELECT a.event_id, a.component, a.s, e.dst, list_append(a.nodes, e.dst), list_append(a.scores, e.score), list_append(a.nbs, a.ds), n.ds FROM ap a JOIN we e ON e.event_id = a.event_id AND e.src = a.at_ JOIN no n ON n.event_id = e.event_id AND n.node = e.dst),
place AS (SELECT event_id, component, node, row_number() OVER (PARTITION BY event_id, component ORDER BY depth, k) AS p FROM (
    SELECT a.event_id, a.component, a.at_ AS node, len(a.nodes) AS depth, list_concat({root}, a.nodes[2:]) AS k, row_number() OVER (PARTITION BY a.event_id, a.at_ ORDER BY len(a.nodes) DESC, list_concat({root}, a.nodes[2:]) DESC) AS best
    FROM ap a JOIN root r ON r.event_id = a.event_id AND r.s = a.s) WHERE best = 1)"""


def _greedy(walk: str, reuse: bool) -> str:
    free = "NOT list_contains(w.used, a.s)" if reuse else "NOT list_has_any(a.nodes, w.used)"
    done = "len(a.ds) = 0" if walk == "longest" else "list_has_all(w.used, a.ds)"
    branch = "[a.scores[i] FOR i IN range(1, len(a.scores) + 1) IF len(a.nbs[i]) - len(list_intersect(a.nbs[i], w.used)) > 1]" if walk == "lookback" else "[]::DOUBLE[]"
    depth = 1 if walk == "lookback" else 0
    return f"""walk(event_id, component, p, used, hits) AS (
    SELECT DISTINCT event_id, component, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM place UNION ALL
    SELECT event_id, component, p, CASE WHEN len(path) > 1 THEN list_concat(used, path) ELSE used END, CASE WHEN len(path) > 1 THEN path ELSE [] END FROM (
        SELECT event_id, component, p, used, first(nodes ORDER BY br DESC, len(nodes) DESC, nodes) FILTER (len(nodes) >= longest - {depth}) AS path FROM (
            SELECT w.event_id, w.component, w.p + 1 AS p, w.used, a.nodes, {branch} AS br, max(len(a.nodes)) OVER (PARTITION BY w.event_id, w.component) AS longest
            FROM walk w JOIN place o ON o.event_id = w.event_id AND o.component = w.component AND o.p = w.p + 1
            LEFT JOIN ap a ON a.event_id = w.event_id AND a.s = o.node AND {free} AND {done}) GROUP BY 1, 2, 3, 4))"""


ROAD = """walk(event_id, component, p, used, road, hits) AS (
    SELECT DISTINCT event_id, component, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM place UNION ALL
    SELECT event_id, component, CASE WHEN len(road) = 0 THEN p + 1 ELSE p END,
        CASE WHEN len(road) = 0 OR good THEN used WHEN len(road) < 3 THEN list_append(used, road[1]) ELSE list_concat(used, road) END,
        CASE WHEN len(road) = 0 THEN (CASE WHEN list_contains(used, node) THEN [] ELSE [node] END) WHEN NOT good THEN []
            WHEN len(adds) > 0 THEN list_concat(road, adds) ELSE list_append(road, best) END,
        CASE WHEN len(road) >= 3 AND NOT good THEN road ELSE [] END FROM (
        SELECT w.*, o.node, coalesce(list_max([x.w FOR x IN ways]) > 0.1, false) AS good, [x.d FOR x IN ways IF x.w > 0.6] AS adds, [x.d FOR x IN ways IF x.w = list_max([y.w FOR y IN ways])][1] AS best FROM (
            SELECT v.*, [x FOR x IN coalesce(n.ws, []) IF NOT list_contains(v.used, x.d) AND NOT list_contains(v.road, x.d)] AS ways
            FROM walk v LEFT JOIN no n ON n.event_id = v.event_id AND n.node = v.road[-1]) w
        LEFT JOIN place o ON o.event_id = w.event_id AND o.component = w.component AND o.p = w.p + 1 WHERE o.node IS NOT NULL OR len(w.road) > 0))"""

DP = """sums(event_id, component, s, nodes, total) AS (
    SELECT event_id, component, src, [src, dst], score + 0.0::DOUBLE FROM we UNION ALL
    SELECT e.event_id, e.component, e.src, list_prepend(e.src, q.nodes), e.score + q.total FROM sums q JOIN we e ON e.event_id = q.event_id AND e.dst = q.s),
inb AS (SELECT event_id, dst AS s, list(src) AS ps FROM we GROUP BY 1, 2),
walk(event_id, component, p, gone, hits, score) AS (
    SELECT DISTINCT event_id, component, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::DOUBLE FROM we UNION ALL
    SELECT event_id, component, p, list_concat(gone, top.nodes), top.nodes, top.total FROM (
        SELECT w.event_id, w.component, w.p + 1 AS p, w.gone, first({'nodes': q.nodes, 'total': q.total} ORDER BY q.total DESC, q.s, q.nodes) AS top
        FROM walk w JOIN sums q ON q.event_id = w.event_id AND q.component = w.component AND NOT list_has_any(q.nodes, w.gone)
        LEFT JOIN inb b ON b.event_id = q.event_id AND b.s = q.s WHERE list_has_all(w.gone, coalesce(b.ps, [])) GROUP BY 1, 2, 3, 4))"""


def walked(edges: str, walk: str, reuse: bool = False) -> str:
    """CTEs up to walked(event_id, component, ord, hits, score), the tracks of the complex components of `edges`."""
    body = DP if walk == "dp" else ROAD if walk == "road" else _greedy(walk, reuse)
    score = "score" if walk == "dp" else "NULL::DOUBLE AS score"
    last = f"walked AS (SELECT event_id, component, (row_number() OVER (PARTITION BY event_id, component ORDER BY p) - 1)::INTEGER AS ord, hits, {score} FROM walk WHERE len(hits) > 0)"
    return ",\n".join([reach(edges), kinds(edges), marked(edges), _edges(walk), body, last])


def streams(nodes: str, radius: str | None) -> str:
    """CTEs from `walked` to streams(event_id, labels); hits by `radius` of `nodes` and id, or as they are."""
    tracks = f"""{simple()},
both_ AS (SELECT event_id, 0 AS kind, component, 0 AS ord, hits FROM simple UNION ALL SELECT event_id, 1, component, ord, hits FROM walked)"""
    if radius:
        tracks += f""",
sorted_ AS (SELECT b.event_id, b.kind, b.component, b.ord, list(b.hit ORDER BY n.{radius}, b.hit) AS hits FROM (SELECT event_id, kind, component, ord, unnest(hits) AS hit FROM both_) b
    JOIN {nodes} n ON n.event_id = b.event_id AND n.hit_id = b.hit GROUP BY 1, 2, 3, 4)"""
    return f"""{tracks},
streams AS (SELECT e.event_id, coalesce(s.labels, [-1]::BIGINT[]) AS labels FROM (SELECT DISTINCT event_id FROM {nodes}) e LEFT JOIN (
    SELECT event_id, flatten(list(list_append(hits, -1) ORDER BY kind, component, ord)) AS labels FROM {"sorted_" if radius else "both_"} GROUP BY 1) s USING (event_id))"""
