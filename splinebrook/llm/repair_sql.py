"""DuckDB SQL of op11: a forward search a row at a time, with the least (cost, audit, text) for each state."""

from __future__ import annotations


def st(c: str, a: str, t: str) -> str:
    return f"{{'c': {c}, 'a': {a}, 't': {t}}}"


def least(*x: str) -> str:
    return f"list_sort([{', '.join(x)}])[1]"


def ins(s: str, role: str) -> str:
    return st(f"{s}.c + 2", f"{s}.a || 'I'", f"{s}.t || chr(10) || '{role}:'")


def dele(s: str) -> str:
    return st(f"{s}.c + 3", f"{s}.a || 'D'", f"{s}.t")


#: A state that cannot be reached.
NO = st("CAST(1000000000 AS BIGINT)", "'~'", "''")


def keep(s: str, ini: str) -> str:
    return f"CASE WHEN fault IN (0, 3) AND ini = '{ini}' THEN {st(f'{s}.c + CAST(fault = 3 AS BIGINT)', f'{s}.a || {chr(39)}K{chr(39)}', f'{s}.t || chr(10) || role || {chr(39)}:{chr(39)} || text')} ELSE {NO} END"


def rero(s: str, role: str) -> str:
    return f"CASE WHEN fault IN (0, 3) THEN {st(f'{s}.c + 2 + CAST(fault = 3 AS BIGINT)', f'{s}.a || {chr(39)}R{chr(39)}', f'{s}.t || chr(10) || {chr(39)}{role}:{chr(39)} || text')} ELSE {NO} END"


#: States with turns inserted, then with one row taken: nothing yet, after system, after user, after assistant.
I2 = least("s2", ins("s0", "user"), ins("s1", "user"), ins("s3", "user"))
I3 = least("s3", ins("i2", "assistant"))
N1 = least(dele("s1"), keep("s0", "s"))
N2 = least(dele("i2"), *[keep(s, "u") for s in ("s0", "s1", "i3")], *[rero(s, "user") for s in ("s0", "s1", "i3")])
N3 = least(dele("i3"), keep("i2", "a"), rero("i2", "assistant"))
START = st("CAST(0 AS BIGINT)", "''", "''")
REPAIR = rf"""
        WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
        k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, x: list_reduce(list_concat([xor(c, x)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, z: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM b),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
        e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        f AS MATERIALIZED (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, role, text, i, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM e),
        w AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, {START} AS s0, {NO} AS s1, {NO} AS s2, {NO} AS s3 FROM f
            UNION ALL SELECT conv, i, {dele("s0")}, {N1}, {N2}, {N3} FROM (SELECT *, {I3} AS i3 FROM (SELECT f.conv, f.i, f.fault, f.ini, f.role, f.text, s0, s1, s2, s3, {I2} AS i2 FROM w JOIN f ON f.conv = w.conv AND f.i = w.i + 1))),
        z AS (SELECT conv, {least("s0", "i3")} AS best FROM (SELECT *, {I3} AS i3 FROM (SELECT *, {I2} AS i2 FROM w QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1))),
        g AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
            FROM (SELECT *, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS was FROM f) GROUP BY conv)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv = coalesce(CAST(o.conv_id AS VARCHAR), ' ') LEFT JOIN z ON z.conv = coalesce(CAST(o.conv_id AS VARCHAR), ' ')
    """
