"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import url_filter as u

#: All pairs by shared n-grams, their closure, and equal sets.
JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS gram FROM i),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c, sx.n AS nx, sy.n AS ny FROM p JOIN s AS sx ON sx.doc_id = x JOIN s AS sy ON sy.doc_id = y WHERE 9 * c >= 4 * (sx.n + sy.n)),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.x, r.root FROM r JOIN l ON l.y = r.doc),
m AS (SELECT doc, min(root) AS class_id FROM r GROUP BY doc),
t AS (SELECT x, count(*) AS n_links, count(*) FILTER (WHERE c = nx AND c = ny) AS same, min(y) FILTER (WHERE c = nx AND c = ny) AS first FROM l GROUP BY x)
SELECT d.doc_id, class_id, least(d.doc_id, coalesce(first, d.doc_id)) AS set_id, coalesce(same, 0) + 1 AS copies, coalesce(n_links, 0) AS n_links
FROM d JOIN m ON m.doc = d.doc_id LEFT JOIN t ON t.x = d.doc_id
"""


def link_graph() -> str:
    """Rules by a case of conditions, and the steps of both ranks one after the other."""
    rules = sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in rules]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    lower = lambda x: f"translate({x}, '{u.UPPER}', '{u.LOWER}')"
    link = u.LINK.replace("'", "''")
    parts = [
        "a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "b AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a)",
        f"c AS (SELECT page_id, html, {lower('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)",
        f"j AS MATERIALIZED (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM c)",
        f"x AS (SELECT host, {lower(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM j)",
        "e AS MATERIALIZED (SELECT DISTINCT host AS src, dst FROM x WHERE host <> '' AND host <> dst)",
        "f AS MATERIALIZED (SELECT kind, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS share FROM (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e))",
        "h AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (WHERE by_rule = 'allow') AS trust, count(*) FILTER (WHERE by_rule = 'block') AS distrust FROM j GROUP BY host)",
        "t AS MATERIALIZED (SELECT 'trust' AS kind, host, trust::DOUBLE / (SELECT sum(trust) FROM h) AS mass FROM h WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust::DOUBLE / (SELECT sum(distrust) FROM h) FROM h WHERE distrust > 0)",
        "r0 AS MATERIALIZED (SELECT kind, host, mass AS rank FROM t)",
    ]
    for k in range(1, u.STEPS + 1):
        q = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT f.kind, f.dst AS host, {q}.rank * f.share * {u.DAMPING} AS rank FROM {q} JOIN f ON f.kind = {q}.kind AND f.src = {q}.host"
            f" UNION ALL SELECT kind, host, rank * {u.DAMPING} FROM {q} WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.kind = {q}.kind AND f.src = {q}.host)"
            f" UNION ALL SELECT kind, host, mass * {1 - u.DAMPING} FROM t) GROUP BY kind, host)"
        )
    lift = "coalesce(sum(rank) FILTER (WHERE kind = '{k}'), 0) / (any_value(h.n)::DOUBLE / (SELECT sum(n) FROM h))"
    parts.append(f"z AS (SELECT h.host, {lift.format(k='trust')} AS trust, {lift.format(k='distrust')} AS distrust FROM h LEFT JOIN r{u.STEPS} AS r ON r.host = h.host GROUP BY h.host)")
    method = f"CASE WHEN distrust >= {u.LIFT} AND distrust > trust THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(parts)} SELECT page_id, j.host, path, rule, coalesce(by_rule, {method}) AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust FROM j JOIN z ON z.host = j.host"


SQL = {"op7_minhash_jaccard": JACCARD, "op9_link_graph_urls": link_graph()}
