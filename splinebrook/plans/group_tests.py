"""SQL of the permutation tests of groups, from the definition: every permutation's pairs, one by one."""

from __future__ import annotations

from ..operators import permutation as P


def mixed(z: str, by: int, shift: int) -> str:
    return f"(xor({z}, {z} >> {shift}) * {by} % {P.PRIME})"


def walked(name: str, source: str, seed: int) -> str:
    """Table {name} (t, k, p, v): where place p of 0..n-1 goes in permutation k of test t; source has (t, k, p, n). For WITH RECURSIVE."""
    mask = "((CAST(1 AS BIGINT) << w) - 1)"
    step = f"SELECT t, k, p, n, w, it, v >> w AS l, v & {mask} AS r FROM {name}_walk WHERE it = 0 OR v >= n"
    for r in range(P.ROUNDS):
        key = mixed(mixed(f"((k * 69069 + t * 362437 + {seed * 12289 + r * 5179 + 1}) * 48271 % {P.PRIME})", 69621, 16), 39373, 11)
        step = f"SELECT *, (r + 1) * {key} % {P.PRIME} AS y FROM ({step})"
        step = f"SELECT t, k, p, n, w, it, r AS l, xor(l, ({mixed('y', 48271, 13)} >> 9) & {mask}) AS r FROM ({step})"
    width = "CASE " + " ".join(f"WHEN n <= {4**w} THEN {w}" for w in range(1, 21)) + " END"
    return f"""{name}_walk AS (SELECT CAST(t AS BIGINT) AS t, CAST(k AS BIGINT) AS k, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n, CAST({width} AS INTEGER) AS w, 0 AS it, CAST(p AS BIGINT) AS v FROM ({source})
   UNION ALL SELECT t, k, p, n, w, it + 1, (l << w) | r FROM ({step})),
 {name} AS MATERIALIZED (SELECT t, k, p, v FROM {name}_walk WHERE it > 0 AND v < n)"""


def group_tests(distances: str, labels: str, n: int, seed: int) -> str:
    """Table tested (a, b, distance, p), for WITH RECURSIVE. distances (i, j, d) with i < j; labels (id, label as text)."""
    return f"""dist AS MATERIALIZED ({distances}), pl AS MATERIALIZED (SELECT id, label, row_number() OVER (ORDER BY label, id) - 1 AS place FROM ({labels})),
 grp AS MATERIALIZED (SELECT label, count(*) AS size, min(place) AS first FROM pl GROUP BY label),
 tests AS MATERIALIZED (SELECT a.label AS a, b.label AS b, a.size AS sa, b.size AS sb, a.first AS fa, b.first AS fb, row_number() OVER (ORDER BY a.label, b.label) - 1 AS t FROM grp a JOIN grp b ON a.label <= b.label),
 mem AS MATERIALIZED (SELECT t, id, label = a AS own, sa, a = b AS one, CASE WHEN a = b THEN place WHEN label = a THEN place - fa ELSE place - fb + sa END AS p, CASE WHEN a = b THEN (SELECT count(*) FROM pl) ELSE sa + sb END AS n FROM tests JOIN pl ON a = b OR label = a OR label = b),
 {walked("dealt", f"SELECT t, k, p, n FROM mem CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS k)", seed)},
 placed AS (SELECT m.t, k, id, v < sa AS inside, one FROM dealt d JOIN mem m ON m.t = d.t AND m.p = d.p UNION ALL SELECT t, 0, id, own, one FROM mem),
 sides AS MATERIALIZED (SELECT * FROM placed WHERE inside OR NOT one),
 means AS (SELECT x.t, x.k, avg(d) AS m FROM sides x JOIN sides y ON x.t = y.t AND x.k = y.k AND x.id < y.id AND (x.one OR x.inside <> y.inside) JOIN dist ON i = x.id AND j = y.id GROUP BY x.t, x.k),
 tested AS (SELECT a, b, coalesce(o.m, 0) AS distance, CASE WHEN o.m IS NULL THEN 1 ELSE (coalesce(h.hits, 0) + 1) / {n + 1}.0 END AS p FROM tests LEFT JOIN (SELECT t, m FROM means WHERE k = 0) o USING (t)
   LEFT JOIN (SELECT z.t, count(*) AS hits FROM means z JOIN means s ON s.t = z.t AND s.k = 0 JOIN tests u ON u.t = z.t WHERE z.k > 0 AND CASE WHEN a = b THEN z.m <= s.m + {P.CLOSE!r} ELSE z.m >= s.m - {P.CLOSE!r} END GROUP BY z.t) h USING (t))"""


def rank_test(distances: str, labels: str, n: int, seed: int) -> str:
    """SELECT of (rho, p), with WITH RECURSIVE; distances and labels as above."""
    return f"""WITH RECURSIVE dist AS MATERIALIZED (SELECT i, j, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS r FROM ({distances})),
 pl AS MATERIALIZED (SELECT id, label, row_number() OVER (ORDER BY label, id) - 1 AS place FROM ({labels})),
 {walked("dealt", f"SELECT {P.GLOBAL} AS t, k, place AS p, (SELECT count(*) FROM pl) AS n FROM pl CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS k)", seed)},
 named AS MATERIALIZED (SELECT k, x.id, y.label FROM dealt d JOIN pl x ON x.place = d.p JOIN pl y ON y.place = d.v UNION ALL SELECT 0, id, label FROM pl),
 rhos AS (SELECT x.k, corr(r, CASE WHEN x.label <> y.label THEN 1.0 ELSE 0.0 END) AS rho FROM dist JOIN named x ON x.id = i JOIN named y ON y.id = j AND y.k = x.k GROUP BY x.k)
 SELECT round(o.rho, 6) + 0.0 AS rho, (count(*) FILTER (z.k > 0 AND z.rho >= o.rho - 1e-12) + 1) / {n + 1}.0 AS p FROM rhos z, (SELECT rho FROM rhos WHERE k = 0) o GROUP BY o.rho"""
