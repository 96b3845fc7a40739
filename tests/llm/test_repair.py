"""op11 against a plain forward search over (cost, audit)."""

import hashlib
import random
import re
import zlib

import pytest

from splinebrook.llm import conversation_repair as C
from splinebrook.llm import queries

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain(rows):
    """Faults, cost, audit and hash of one conversation's rows (turn, role, text) in order."""
    seen, faults, kinds = set(), [0] * 4, []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
        seen.add((role, text))
        faults[kind] += 1
        kinds.append(kind)
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", (*lines, ("user:" if to == "u" else "assistant:")))
                out[to] = min(out.get(to, new), new)
        return out

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if kind not in (1, 2):
                extra = kind == 3
                to = MOVES.get((state, role[:1]))
                if to:
                    options.append((to, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                to = "a" if state == "u" else "u"
                options.append((to, (cost + 2 + extra, audit + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}"))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    """{conv_id: rows (turn, role, text)} by the contract."""
    out = {}
    for conv, turn, role, text in rows:
        found = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found += [(turn, role, text)] * (2 if kind == 3 else 1)
    for found in out.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    return out


def expected(rows):
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: plain(found) if found else none for conv, found in damage(rows).items()}


def hostile():
    """Conversations of every kind: odd roles, blanks, repeats, nulls, one of thousands of turns."""
    r = random.Random(3)
    texts = ["Yes.", "No", " \t\n", "", "Why?", "a.  ", "ß!", None, "end. ", "x\x0b.", "　"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "use"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(r.randrange(0, 9)):
            rows.append((conv, r.choice([None, *range(7)]), r.choice(roles), r.choice(texts)))
    rows += [(1000, t, ("user", "assistant", "system")[r.randrange(3)], f"turn {t % 700}" + r.choice([".", ""])) for t in range(0, 4000, 2)]
    rows += [(1001, 5, "user", "the same.")] * 300 + [(1002, None, None, None)]
    return rows


@pytest.mark.parametrize("segment", [1, 7, 4096])
def test_whole_query(spark, tmp_path, monkeypatch, segment):
    repair = C.repair
    monkeypatch.setattr(C, "repair", lambda rows: repair(rows, segment))
    rows = hostile()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, cost long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).select(*COLUMNS).collect()}
    assert got == expected(rows)


def test_segments_chain():
    """Segments of one to three rows, with audits chained, give what one segment gives."""
    import numpy as np

    r = random.Random(5)
    for _ in range(300):
        codes = np.array([r.randrange(4) | r.choice([0, 0, C.GONE, C.CUT]) for _ in range(r.randrange(1, 12))], dtype=np.uint8)
        whole = C.solve([(codes, C.ENDING, True)])[0][0][0]
        borders = [0, *sorted(r.sample(range(1, len(codes)), min(len(codes) - 1, 3))), len(codes)]
        parts, ending, solved = list(zip(borders[:-1], borders[1:], strict=True)), C.ENDING, []
        for a, b in reversed(parts):
            solved += C.solve([(codes[a:b], ending, b == len(codes))])
            ending = C.behind(C.segment_matrix(codes[a:b]), ending)
        state, audit = 0, ""
        for found in reversed(solved):
            piece, state = found[state]
            audit += piece
        assert audit == whole


def test_turns_and_empty(spark, sf):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "tool", "Ho."), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    found = C.turns(C.repair(rows)).orderBy("part", "seq", "number")
    assert [tuple(r) for r in found.select("conv", "role", "text").collect()] == [("1", "user", "Hi."), ("1", "assistant", "Ho.")]
    assert C.summary(C.repair(rows.filter("false"))).count() == 0


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, sf).select(*COLUMNS).collect()}
    assert got == expected([tuple(r) for r in table.collect()])
