"""Cheapest repair of conversation structure, the least audit among the cheapest.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn; only first letters
of roles count. Rows are kept (0), given the role user or assistant (2), deleted (3; blank rows and repeats must be) or
empty turns are inserted (2); a truncated row that stays costs 1. The audit has the edits' first letters in order, and of
all cheapest audits the least in ASCII is taken.

A node is a place between rows and one of four states (nothing yet, after the system turn, after a user turn, after an
assistant turn). With the cost of the way to the end at each node, the arcs on cheapest ways are known, and from a node
each letter leads to one other node. Nodes are ranked by the least audit of 1, 2, 4, ... letters that starts at them: the rank for
twice as many letters comes from a node's own rank and that of the node its pointer names, and pointers double too. The
ranks choose each node's arc, and the doubled pointers give the way.

Conversations of any length go through segments of SEGMENT rows or SEGMENT_BYTES of text, cut from one sort of all rows.
A segment's costs are a 4 x 4 matrix; matrices, then audits for each state on entry, are chained along a conversation, one
short row for each segment. No task holds a conversation's texts.

A row's first fault counts: blank (nothing but spaces and \\t to \\r), duplicate (role and text are those of an earlier row),
truncated (the last character that is no space is not one of . ! ?). Rows go by turn, nulls first, then role and text;
equal rows are counted before they are sorted. Null roles and texts are one space. A null conversation is one of its own.
Empty tables give no rows. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

SEGMENT, SEGMENT_BYTES = 4096, 1 << 22
#: Ways that don't exist.
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state that the next inserted or renamed turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost from a state to another by insertions alone, and from a state to an acceptable end.
INSERTED = np.array([[0, NEVER, 2, 4], [NEVER, 0, 2, 4], [NEVER, NEVER, 0, 2], [NEVER, NEVER, 2, 0]], dtype=np.int64)
ENDING = np.array([0, 4, 2, 0], dtype=np.int64)
LETTERS = "DIKR"
#: A row's code: its initial's place in INITIALS, and bits for must be deleted and for truncated.
INITIALS = "sua"
GONE, CUT = 4, 8
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = {(0, 1), (1, 2), (2, 1)}

KEYS = ["conv", "part", "seq"]
SEGMENTS = "conv string, part int, seq int, codes binary, roles array<string>, texts array<string>, matrix array<long>, faults array<long>, low long, high long, turns long"


def kept_state(state: int, code: int) -> int | None:
    """Where keeping a row leads, if it may be kept."""
    initial = code & 3
    if code & GONE or initial > 2:
        return None
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if state == USER else None


def arcs(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits of a row in a state."""
    found = [("D", 3, state)]
    if not code & GONE:
        extra = 1 if code & CUT else 0
        keep = kept_state(state, code)
        if keep is not None:
            found.append(("K", extra, keep))
        found.append(("R", 2 + extra, NEXT[state]))
    return found


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices where sums are minima and products are sums."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), NEVER)


def row_matrices() -> np.ndarray:
    moves = np.full((16, STATES, STATES), NEVER, dtype=np.int64)
    for code in range(16):
        for s in range(STATES):
            for _, cost, t in arcs(s, code):
                moves[code, s, t] = min(moves[code, s, t], cost)
    return times(np.broadcast_to(INSERTED, moves.shape), moves)


ROWS = row_matrices()


def segment_matrix(codes: np.ndarray) -> np.ndarray:
    """Costs from each state before the rows to each state behind them."""
    m = ROWS[codes]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([times(m[: len(m) - len(odd) : 2], m[1::2]), odd])
    return m[0]


def behind(matrix: np.ndarray, ending: np.ndarray) -> np.ndarray:
    return np.minimum((matrix + ending).min(axis=1), NEVER)


def arc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and state of each letter's arc for each code and state; code 16 stands behind the last row of a segment, 17 behind
    that of a conversation, where turns can still be inserted."""
    cost, state = np.full((len(LETTERS), 18, STATES), NEVER, dtype=np.int64), np.zeros((len(LETTERS), 18, STATES), dtype=np.int64)
    for s in range(STATES):
        for code in range(16):
            for letter, c, t in [*arcs(s, code), ("I", 2, NEXT[s])]:
                cost[LETTERS.index(letter), code, s], state[LETTERS.index(letter), code, s] = c, t
        cost[LETTERS.index("I"), 17, s], state[LETTERS.index("I"), 17, s] = 2, NEXT[s]
    return cost, state


ARC_COST, ARC_STATE = arc_tables()
BY_CODE = [[[(c, t) for _, c, t in arcs(s, code)] for s in range(STATES)] for code in range(16)]
#: Nodes times the longest audit that are solved together, so that memory is bounded.
TOGETHER = 1 << 18


def ways_to_end(codes: np.ndarray, ending: np.ndarray) -> list[list[int]]:
    """The cost of the cheapest way to the end from each state before each row, and behind the last."""
    out = [ending.tolist()]
    for code in reversed(codes.tolist()):
        after = out[-1]
        start, system, user, assistant = (min(c + after[t] for c, t in moves) for moves in BY_CODE[code])
        user, assistant = min(user, 2 + assistant), min(assistant, 2 + user)
        out.append([min(start, 2 + user), min(system, 2 + user), user, assistant])
    return out[::-1]


def solve_all(segments: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[list[tuple[str, int]]]:
    """For each segment (codes, the cost of what follows it from each state, whether it is a conversation's last) and each state on
    entry: the least of the cheapest audits of its rows, and the state that it leaves."""
    sizes = np.array([len(c) + 1 for c, _, _ in segments])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    togo = np.array([low for codes, ending, _ in segments for low in ways_to_end(codes, ending)], dtype=np.int64)
    code = np.concatenate([x for codes, _, last in segments for x in (codes, np.array([17 if last else 16], dtype=np.uint8))])
    rows = np.arange(len(code))
    letter, pointer = np.zeros(togo.shape, dtype=np.int64), rows[:, None] * STATES + np.arange(STATES)
    for k in reversed(range(len(LETTERS))):
        place = rows if LETTERS[k] == "I" else np.minimum(rows + 1, len(rows) - 1)
        target = place[:, None] * STATES + ARC_STATE[k][code]
        cheapest = ARC_COST[k][code] + togo.ravel()[target] == togo
        letter, pointer = np.where(cheapest, k + 1, letter), np.where(cheapest, target, pointer)  # the least letter stays
    letter, steps = letter.ravel(), [pointer.ravel()]
    rank = letter.copy()
    while (letter[steps[-1]] > 0).any():  # some audit is longer than those ranked so far
        jump = steps[-1]
        rank = np.unique(rank * (len(rank) + len(LETTERS) + 1) + rank[jump], return_inverse=True)[1].astype(np.int64) + 1
        steps.append(jump[jump])
    way = (starts[:, None] * STATES + np.arange(STATES)).ravel()[:, None]
    for jump in reversed(steps):  # nodes 2^k letters apart, then half as far
        way = np.stack([way, jump[way]], axis=2).reshape(len(way), -1)
    text = np.frombuffer(b"\0" + LETTERS.encode(), dtype=np.uint8)[letter[way]]
    found = [(t.tobytes().rstrip(b"\0").decode(), int(w) % STATES) for t, w in zip(text, way[:, -1], strict=True)]
    return [found[k : k + STATES] for k in range(0, len(found), STATES)]


def solve(segments: list[tuple[np.ndarray, np.ndarray, bool]]) -> list[list[tuple[str, int]]]:
    """solve_all, a bounded number of nodes and letters at a time."""
    out, at = [], 0
    while at < len(segments):
        stop, longest = at, 0
        while stop < len(segments):
            longest = max(longest, 2 * len(segments[stop][0]) + 8)
            if stop > at and (stop - at + 1) * STATES * longest > TOGETHER:
                break
            stop += 1
        out += solve_all(segments[at:stop])
        at = stop
    return out


def counted(rows: DataFrame) -> DataFrame:
    """Each different row (conv, turn, role, text) once, with its copies, and whether an earlier turn has its role and text."""
    named = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    once = named.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.md5("text"))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = once.groupBy("conv", "role", "key").agg(F.min(order).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return once.join(repeated, ["conv", "role", "key"], "left").select("conv", "turn", "role", "text", "copies", F.coalesce(order > F.col("earliest"), F.lit(False)).alias("later"))


def coded(rows: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(F.col("later"), DUPLICATE).when(~whole, TRUNCATED).otherwise(0)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)], F.lit(3))
    return rows.withColumn("fault", fault).withColumn("initial", initial)


def cutter(segment: int):
    """Segments of sorted rows (conv, turn, role, text, copies, fault, initial), of `segment` rows at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        conv, codes, roles, texts, turns, size = None, [], [], [], [], 0
        faults, waiting = [0] * 4, 0
        found: list[tuple] = []

        def close():
            nonlocal seq, codes, roles, texts, turns, size, faults, waiting
            if codes:
                known = [t for t in turns if t is not None]
                distinct = sum(1 for k, t in enumerate(known) if k == 0 or t != known[k - 1])
                array = np.array(codes, dtype=np.uint8)
                ends = (known[0], known[-1]) if known else (None, None)
                found.append((conv, part, seq, array.tobytes(), roles, texts, segment_matrix(array).ravel().tolist(), faults, *ends, distinct))
                seq += 1
                waiting += size + 1
            codes, roles, texts, turns, size, faults = [], [], [], [], 0, [0] * 4

        def flush(always=False):
            nonlocal found, waiting
            if found and (always or len(found) >= 1024 or waiting >= 2 * SEGMENT_BYTES):
                columns = list(zip(*found, strict=True))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 3]
                names = [c.strip().split(" ")[0] for c in SEGMENTS.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                found, waiting = [], 0

        for batch in batches:
            for name, turn, role, text, copies, fault, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != conv or len(codes) >= segment or size >= SEGMENT_BYTES:
                    close()
                    conv = name
                turns.append(turn)
                faults[fault] += 1
                if fault in (BLANK, DUPLICATE):
                    codes.append(initial | GONE)
                else:
                    codes.append(initial | (CUT if fault == TRUNCATED else 0))
                    roles.append(role)
                    texts.append(text)
                    size += len(text)
                rest, kind = copies - 1, BLANK if fault == BLANK else DUPLICATE
                while rest:
                    if len(codes) >= segment:
                        close()
                        turns.append(turn)
                    k = min(rest, segment - len(codes))
                    codes += [initial | GONE] * k
                    faults[kind] += k
                    rest -= k
                yield from flush()
        close()
        yield from flush(always=True)

    return cut


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and states on leaving, for each state on entry, of segments that come last first within conversations."""
    conv, ending, seen = None, None, False
    for batch in batches:
        segments = []
        for name, codes, matrix in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            last = not seen or name != conv
            conv, seen = name, True
            ending = ENDING if last else ending
            segments.append((np.frombuffer(codes, dtype=np.uint8), ending, last))
            ending = behind(np.array(matrix).reshape(STATES, STATES), ending)
        found = solve(segments)
        audits, exits = ([[x[k] for x in f] for f in found] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], [*KEYS, "audits", "exits"])


def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state on entry and the audit of segments in order."""
    conv, state, seen = None, START, False
    for batch in batches:
        entries, chosen = [], []
        for name, audits, exits in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if not seen or name != conv:
                conv, seen, state = name, True, START
            entries.append(state)
            chosen.append(audits[state])
            state = exits[state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entries, pa.int32()), pa.array(chosen, pa.string())], [*KEYS, "entry", "audit"])


def applied(state: int, audit: str, codes: bytes, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """Roles and texts of the repaired turns, and the cost."""
    out_roles, out_texts, cost, row, held = [], [], 0, 0, 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out_roles.append(ROLE[state])
            out_texts.append("")
            cost += 2
            continue
        code = codes[row]
        row += 1
        if not code & GONE:
            if edit != "D":
                state = kept_state(state, code) if edit == "K" else NEXT[state]
                out_roles.append(roles[held] if edit == "K" else ROLE[state])
                out_texts.append(texts[held])
                cost += 1 if code & CUT else 0
            held += 1
        cost += {"D": 3, "K": 0, "R": 2}[edit]
    return out_roles, out_texts, cost


def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        found = [applied(*r) for r in zip(*(batch.column(names.index(c)).to_pylist() for c in ("entry", "audit", "codes", "roles", "texts")), strict=True)]
        initials = [np.frombuffer(c, dtype=np.uint8) & 3 for c in batch.column(names.index("codes")).to_pylist()]
        illegal = [sum((a, b) not in LEGAL for a, b in zip(i[:-1].tolist(), i[1:].tolist(), strict=True)) for i in initials]
        rest = [batch.column(names.index(c)) for c in ("audit", "faults", "low", "high", "turns")]
        new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()))]
        borders = [pa.array([int(i[k]) for i in initials], pa.int32()) for k in (0, -1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new, *rest, pa.array(illegal, pa.int64()), *borders], [*KEYS, "roles", "texts", "cost", "audit", "faults", "low", "high", "turns", "illegal", "first_initial", "last_initial"])


MENDED = "conv string, part int, seq int, roles array<string>, texts array<string>, cost long, audit string, faults array<long>, low long, high long, turns long, illegal long, first_initial int, last_initial int"


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """rows: conv_id, turn, role, text -> repaired conversations in segments, ordered by part and seq within a conv: roles and
    texts of the repaired turns, audit and cost, and what `summary` adds up. conv is conv_id as text, one space for null."""
    spark = rows.sparkSession
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    found = coded(counted(rows))
    ordered = found.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    at = scratch_path(spark, "segments")
    ordered.select("conv", "turn", "role", "text", "copies", "fault", "initial").mapInArrow(cutter(segment), SEGMENTS).write.parquet(at)
    segments = spark.read.parquet(at)
    down = [F.col("conv"), F.desc("part"), F.desc("seq")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a code is a byte but takes a while: bytes don't tell how many
    ways = segments.select(*KEYS, "codes", "matrix").repartition(tasks, "conv").sortWithinPartitions(*down).mapInArrow(settled, "conv string, part int, seq int, audits array<string>, exits array<int>")
    chosen = ways.repartition("conv").sortWithinPartitions(*KEYS).mapInArrow(entered, "conv string, part int, seq int, entry int, audit string")
    return segments.join(chosen, KEYS).select(*KEYS, *[c for c in ("codes", "roles", "texts", "faults", "low", "high", "turns", "entry", "audit")]).mapInArrow(mended, MENDED)


def turns(repaired: DataFrame) -> DataFrame:
    """Rows (conv, part, seq, number, role, text): the repaired turns, in order by part, seq and number."""
    both = repaired.select(*KEYS, F.posexplode(F.arrays_zip("roles", "texts")).alias("number", "t"))
    return both.select(*KEYS, "number", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(repaired: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: faults, cost, audit and the SHA-256 of its `role:text` lines. Segments
    stream through in order: besides the audit, which is a cell of the result, only running values are held."""

    def run(batches):
        conv, state, out = None, None, []

        def start():
            return {"faults": np.zeros(4, dtype=np.int64), "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "lines": 0, "low": None, "high": None, "turns": 0, "initial": None}

        def done():
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            return (conv, gaps, *state["faults"][1:].tolist(), state["illegal"], state["cost"], "".join(state["audit"]), state["hash"].hexdigest())

        def table():
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv"] != conv:
                    if state is not None:
                        out.append(done())
                    conv, state = r["conv"], start()
                state["faults"] += r["faults"]
                state["illegal"] += r["illegal"] + (state["initial"] is not None and (state["initial"], r["first_initial"]) not in LEGAL)
                state["initial"] = r["last_initial"]
                state["cost"] += r["cost"]
                state["audit"].append(r["audit"])
                if r["low"] is not None:
                    state["turns"] += r["turns"] - (state["high"] == r["low"])
                    state["low"] = r["low"] if state["low"] is None else state["low"]
                    state["high"] = r["high"]
                for role, text in zip(r["roles"], r["texts"], strict=True):
                    state["hash"].update((("\n" if state["lines"] else "") + f"{role}:{text}").encode())
                    state["lines"] += 1
            if len(out) >= 1024:
                yield table()
                out = []
        if state is not None:
            out.append(done())
        if out:
            yield table()

    kinds = {"string": pa.string(), "long": pa.int64()}
    names = [c.strip().split(" ")[0] for c in SUMMARY.split(",")]
    schema = pa.schema([(n, kinds[c.strip().split(" ")[1]]) for n, c in zip(names, SUMMARY.split(","), strict=True)])
    return repaired.repartition("conv").sortWithinPartitions(*KEYS).mapInArrow(run, SUMMARY)
