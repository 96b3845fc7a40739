"""DuckDB SQL of the numerical queries, from the definitions and not from the engine's matrices.

Bases come from Cox-de Boor's recursion, penalties from Gauss-Legendre sums, inverses from Gauss-Jordan elimination, leading
eigenvectors from repeated squaring, filters from their difference equation, time warping from its recurrence.
"""

from __future__ import annotations

import numpy as np

#: Nodes and weights of the four-point Gauss-Legendre rule.
_NEAR, _FAR = (3 / 7 - 2 / 7 * 1.2**0.5) ** 0.5, (3 / 7 + 2 / 7 * 1.2**0.5) ** 0.5
GAUSS = ((-_FAR, (18 - 30**0.5) / 36), (-_NEAR, (18 + 30**0.5) / 36), (_NEAR, (18 + 30**0.5) / 36), (_FAR, (18 - 30**0.5) / 36))


def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def basis(source: str, lo: float, hi: float, k: int, degree: int, derivative: int = 0, keep: str = "id") -> str:
    """source has `keep` and x -> the same with b, the list of all functions (or derivatives) at x, level by level."""
    inner = k - degree
    knots = f"list_concat(list_concat([{number(lo)} FOR i IN range({degree})], [{number(lo)} + i * {number(hi - lo)} / {inner} FOR i IN range({inner + 1})]), [{number(hi)} FOR i IN range({degree})])"
    end = f"(x >= {number(hi)} AND kn[j + 2] >= {number(hi)} - 1e-9 AND kn[j + 1] < {number(hi)} - 1e-9)"
    level = f"SELECT {keep}, x, kn, [CASE WHEN kn[j + 1] <= x AND (x < kn[j + 2] OR {end}) THEN 1.0::DOUBLE ELSE 0.0 END FOR j IN range({k + degree})] AS b FROM (SELECT {keep}, CAST(x AS DOUBLE) AS x, {knots} AS kn FROM ({source}))"
    for p in range(1, degree + 1):
        left, right = f"(kn[j + {p + 1}] - kn[j + 1])", f"(kn[j + {p + 2}] - kn[j + 2])"
        if p > degree - derivative:
            a, b = f"{p} / {left} * b[j + 1]", f"-{p} / {right} * b[j + 2]"
        else:
            a, b = f"(x - kn[j + 1]) / {left} * b[j + 1]", f"(kn[j + {p + 2}] - x) / {right} * b[j + 2]"
        level = f"SELECT {keep}, x, kn, [(CASE WHEN {left} > 0 THEN {a} ELSE 0.0 END) + (CASE WHEN {right} > 0 THEN {b} ELSE 0.0 END) FOR j IN range({k + degree - p})] AS b FROM ({level})"
    return f"SELECT {keep}, x, b FROM ({level})"


def products(rows: str, k: int, weight: str = "1.0") -> str:
    """rows with b -> one row m: the matrix of sums of weight * b[i] * b[j]."""
    cells = f"SELECT i, j, sum(({weight}) * b[i] * b[j]) AS v FROM ({rows}) CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS j) GROUP BY i, j"
    return f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM ({cells}) GROUP BY i)"


def smoothing(volumes: int, tr: float, k: int, degree: int, derivative: int, lams, metric: bool = False) -> str:
    """Tables f (t, b), g (the Gram matrix m), p (the penalty m), inv (la, m: inverse of Gram + la (penalty + 1e-12)), for WITH RECURSIVE."""
    hi = (volumes - 1) * tr
    h = hi / (k - degree)

    def rule(d: int) -> str:
        nodes = ", ".join(f"({number(x)}, {number(w)})" for x, w in GAUSS)
        points = f"SELECT w * {number(h / 2)} AS w, (s + 0.5) * {number(h)} + {number(h / 2)} * x AS x FROM (SELECT unnest(range({k - degree})) AS s) CROSS JOIN (VALUES {nodes}) AS q(x, w)"
        return products(basis(points, 0.0, hi, k, degree, d, keep="w"), k, "w")

    grid = ", ".join(number(x) for x in lams)
    start = f"[list_concat([g.m[i][j] + la * (p.m[i][j] + CASE WHEN i = j THEN 1e-12::DOUBLE ELSE 0.0 END) FOR j IN range(1, {k + 1})], [CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0 END FOR j IN range(1, {k + 1})]) FOR i IN range(1, {k + 1})]"
    step = f"[CASE WHEN i = n + 1 THEN [v / m[n + 1][n + 1] FOR v IN m[n + 1]] ELSE [m[i][j] - m[i][n + 1] * m[n + 1][j] / m[n + 1][n + 1] FOR j IN range(1, {2 * k + 1})] END FOR i IN range(1, {k + 1})]"
    metric_table = f", u AS MATERIALIZED ({rule(0)})" if metric else ""
    return f"""f AS MATERIALIZED (SELECT t, b FROM ({basis(f"SELECT t, t * {number(tr)} AS x FROM (SELECT unnest(range({volumes})) AS t)", 0.0, hi, k, degree, keep="t")})),
 g AS MATERIALIZED ({products("SELECT b FROM f", k)}), p AS MATERIALIZED ({rule(derivative)}){metric_table},
 gj AS (SELECT 0 AS n, la, {start} AS m FROM g, p, (SELECT unnest([{grid}]) AS la) UNION ALL SELECT n + 1, la, {step} FROM gj WHERE n < {k}),
 inv AS MATERIALIZED (SELECT la, [r[{k + 1}:{2 * k}] FOR r IN m] AS m FROM gj WHERE n = {k})"""


def gcv(signals: str, volumes: int, k: int) -> str:
    """Table fit (voxel_id, la, c, gcv, n): every series with every lambda, n = 1 for the first of the best."""
    return f"""z AS MATERIALIZED (SELECT voxel_id, list_dot_product(y, y) AS yy, [list_sum([y[t + 1] * fs[t + 1][k] FOR t IN range({volumes})]) FOR k IN range(1, {k + 1})] AS z FROM ({signals}), (SELECT list(b ORDER BY t) AS fs FROM f)),
 tr AS (SELECT la, list_sum([list_dot_product(inv.m[i], g.m[i]) FOR i IN range(1, {k + 1})]) AS tr FROM inv, g),
 fc AS MATERIALIZED (SELECT voxel_id, la, yy, z, [list_dot_product(r, z) FOR r IN m] AS c FROM z, inv),
 fg AS (SELECT voxel_id, la, c, (yy - 2 * list_dot_product(z, c) + list_dot_product(c, [list_dot_product(r, c) FOR r IN g.m])) / {volumes} / pow(1 - tr / {volumes}, 2) AS gcv FROM fc JOIN tr USING (la), g),
 fit AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY voxel_id ORDER BY gcv, la) AS n FROM fg)"""


def leading(matrix: str, size: int, q: int, name: str = "e", squarings: int = 24) -> str:
    """matrix has k (of each matrix) and s (symmetric) -> tables e1..eq (k, s: what is left of the matrix, v: its leading
    eigenvector with the largest entry positive, value), by squaring the matrix again and again and taking out what was found."""
    out, source = [], matrix
    scaled = "SELECT k, n, [[x / t FOR x IN r] FOR r IN m] AS m FROM (SELECT k, n, m, list_sum([m[i][i] FOR i IN range(1, len(m) + 1)]) AS t FROM ({0}))"
    for c in range(1, q + 1):
        begin = scaled.format(f"SELECT k, 0 AS n, s AS m FROM ({source})")
        square = scaled.format(f"SELECT k, n + 1 AS n, [[list_dot_product(a, b) FOR b IN m] FOR a IN m] AS m FROM {name}p{c} WHERE n < {squarings}")
        longest = "list_extract(m, list_position([m[i][i] FOR i IN range(1, len(m) + 1)], list_max([m[i][i] FOR i IN range(1, len(m) + 1)])))"
        out.append(f"{name}p{c} AS ({begin} UNION ALL {square})")
        vector = f"SELECT k, [x / sqrt(list_dot_product(r, r)) FOR x IN r] AS v FROM (SELECT k, {longest} AS r FROM {name}p{c} WHERE n = {squarings})"
        turned = f"SELECT k, [x * CASE WHEN list_max(v) < -list_min(v) THEN -1 ELSE 1 END FOR x IN v] AS v FROM ({vector})"
        out.append(f"{name}{c} AS MATERIALIZED (SELECT k, s, v, list_dot_product(v, [list_dot_product(r, v) FOR r IN s]) AS value FROM ({source}) JOIN ({turned}) USING (k))")
        source = f"SELECT k, [[s[i][j] - value * v[i] * v[j] FOR j IN range(1, {size + 1})] FOR i IN range(1, {size + 1})] AS s FROM {name}{c}"
    return ",\n ".join(out)


def covariance(rows: str, size: int) -> str:
    """rows (k, x: list) -> rows (k, mean, s): mean and population covariance of each k."""
    at = f"SELECT unnest(range(1, {size + 1}))"
    cells = f"SELECT k, list(r ORDER BY i) AS s FROM (SELECT k, i, list(v ORDER BY j) AS r FROM (SELECT k, i, j, covar_pop(x[i], x[j]) AS v FROM ({rows}) CROSS JOIN ({at} AS i) CROSS JOIN ({at} AS j) GROUP BY k, i, j) GROUP BY k, i) GROUP BY k"
    means = f"SELECT k, list(v ORDER BY i) AS mean FROM (SELECT k, i, avg(x[i]) AS v FROM ({rows}) CROSS JOIN ({at} AS i) GROUP BY k, i) GROUP BY k"
    return f"SELECT k, mean, s FROM ({means}) JOIN ({cells}) USING (k)"


def band_pass(signals: str, volumes: int, tr: float, low: float, high: float) -> str:
    """voxel_id, t, y: a third-order Butterworth band-pass forward and backward, from its difference equation.

    The low-pass s^3 + 2 s^2 + 2 s + 1 with s -> (s^2 + w^2) / (B s) and s -> 2 (1 - z) / (1 + z), time in samples. Before
    the first sample the input is held and the output, as no constant passes, is zero.
    """
    edges = [2 * np.tan(np.pi * f * tr) for f in (low, high)]
    w2, band = edges[0] * edges[1], edges[1] - edges[0]
    up, down = np.array([2.0, -2.0]), np.array([1.0, 1.0])  # of s = up / down, by rising powers of z

    def power(p, n):
        out = np.array([1.0])
        for _ in range(n):
            out = np.convolve(out, p)
        return out

    q = np.convolve(up, up) + w2 * np.convolve(down, down)
    s = band * np.convolve(up, down)
    a = power(q, 3) + 2 * np.convolve(s, power(q, 2)) + 2 * np.convolve(power(s, 2), q) + power(s, 3)
    b, a = power(s, 3) / a[0], a / a[0]
    pad, k = 3 * len(a), len(a) - 1
    extended = f"list_concat(list_concat([2 * y[1] - y[{pad} + 1 - i] FOR i IN range({pad})], y), [2 * y[{volumes}] - y[{volumes} - 1 - i] FOR i IN range({pad})])"
    terms = " + ".join([f"{number(b[i])} * x[n + {k + 1 - i}]" for i in range(k + 1)] + [f"{number(-a[i])} * o[n + {k + 1 - i}]" for i in range(1, k + 1)])
    size = volumes + 2 * pad

    def run(name: str, source: str) -> str:
        start = f"SELECT voxel_id, 0 AS n, list_concat([x[1] FOR i IN range({k})], x) AS x, [0.0::DOUBLE FOR i IN range({k})] AS o FROM ({source})"
        return f"{name} AS ({start} UNION ALL SELECT voxel_id, n + 1, x, list_append(o, {terms}) FROM {name} WHERE n < {size})"

    done = "SELECT voxel_id, list_reverse(o[{0}:]) AS x FROM {1} WHERE n = {2}"
    return f"""WITH RECURSIVE {run("fw", f"SELECT voxel_id, {extended} AS x FROM ({signals})")}, {run("bw", done.format(k + 1, "fw", size))}
 SELECT voxel_id, CAST(t AS INTEGER) AS t, round(x[{pad + 1} + t], 6) + 0.0 AS y FROM ({done.format(k + 1, "bw", size)}) CROSS JOIN (SELECT unnest(range({volumes})) AS t)"""


def warping(pairs: str, n: int) -> str:
    """pairs (i, j, a, b of n values) -> table dtw (i, j, distance), for WITH RECURSIVE: the table of costs a row at a time."""
    cell = "lambda acc, c: list_append(acc, c[1] + least(c[2], c[3], acc[len(acc)]))"
    start = f"SELECT i, j, a, b, 0 AS k, list_concat([0.0::DOUBLE], ['infinity'::DOUBLE FOR m IN range({n})]) AS row FROM ({pairs})"
    step = f"SELECT i, j, a, b, k + 1, list_reduce(list_concat([['infinity'::DOUBLE]], [[(a[k + 1] - b[m + 1]) * (a[k + 1] - b[m + 1]), row[m + 2], row[m + 1]] FOR m IN range({n})]), {cell}) FROM dw WHERE k < {n}"
    return f"dw AS ({start} UNION ALL {step}), dtw AS (SELECT i, j, sqrt(row[{n + 1}]) AS distance FROM dw WHERE k = {n})"
