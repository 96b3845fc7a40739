"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A record is one row of a conversation, and its text is all that is known of it: who speaks has to be recovered. Each line
is an observation: the speaker marker at its start, its length class, whether it asks, and whether it is the first or the
last line of the record. Hidden states say who speaks, whether the line opens a turn or goes on with it, and whether the
record is plain (one turn, and what looks like a marker is text) or a transcript (turns that carry markers). A record's
first line always opens a turn. Viterbi gives the most probable states; each opened turn is rendered as one canonical
turn. A marker is taken off a line only where the state opens a turn of the role that it names, and is kept in a column of
its own, so no text is lost.

The model is counted over labelled records (`train`), with smoothing. Labels are one role for a record, so what they can't
show has fixed prior values: how turns follow inside a transcript, and how markers lie in it.

Conversations may be of any length: one that is longer is cut into segments of a bounded number of records. A segment gives
the best score from each state before it to each state at its end, a small matrix; one ordered pass over the matrices of a
conversation and one back fix the states at the borders, and each segment is then decoded on its own. The result is that
of Viterbi over the whole conversation.

Records go by turn; where turns repeat, those with other texts by a hash of the text, and equal records one after another,
MOST of them at a time. Null turns come first. Null texts are empty and give one empty turn. Ties between states go to the
first of ROLES. Without labelled records the smoothing alone decides. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROLES = ("system", "user", "assistant")
N = len(ROLES)
#: State 6 * style + 2 * r opens a turn of role r, the next one goes on with it; style 1 is a transcript.
STATES = 4 * N
OPENS = np.arange(STATES) % 2 == 0
ROLE = np.arange(STATES) // 2 % N
MARKED = np.arange(STATES) >= 2 * N
#: Turn numbers of a segment, and records beyond which such a range is cut further; also copies of a record in one piece.
SEGMENT = 256
MOST = 4096
SMOOTH = 0.5
#: Prior values: share of records that are transcripts (as records seen beforehand), of a transcript's lines that open a
#: turn, of opening lines with their own role's marker, and of other lines with any (mostly one that suits the speaker).
TRANSCRIPTS = (1, 20)
TURNS = 0.3
OWN = 0.97
STRAY = 0.05

#: Fixed speaker markers.
SPEAKERS = {
    "system": "system sys instruction instructions context système sistema anweisung",
    "user": "user human you q question prompt customer client me utilisateur usuario benutzer frage pregunta nutzer mensch",
    "assistant": "assistant ai bot gpt model a answer response reply agent assistent antwort réponse respuesta asistente",
}
ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in SPEAKERS[role].split()}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?\s*([^\W\d_]+)\s*(?:\|>)?|\[\s*([^\W\d_]+)\s*\]\s*:?|#{1,6}\s*([^\W\d_]+)\s*:?\s*$|(?:#{1,6}\s*|\*{1,2}|>\s*)?([^\W\d_]+)\s*(?:\*{1,2})?\s*[:：>]\s*(?:\*{1,2})?)\s*")
END_MARK = re.compile(r"<\|(?:im_end|end|eot_id|endoftext)\|>\s*$")
LENGTHS = (0, 40, 120, 400)


Observation = tuple[int, int, int, int, int]


def read_marker(line: str) -> tuple[int, int]:
    """The role that a line's marker names (N: none), and where the rest of the line begins."""
    m = MARKER.match(line)
    role = ROLE_OF.get((m[1] or m[2] or m[3] or m[4] or "").lower()) if m else None
    return (N, 0) if role is None else (role, m.end())


def observe(text: str | None) -> tuple[list[Observation], list[tuple[str, int]]]:
    """(marker, length class, asks, first, last) of each line, and the lines with the length of their markers."""
    lines = (text or "").split("\n")
    observations, found = [], []
    for k, line in enumerate(lines):
        role, end = read_marker(line)
        body = line.strip()
        observations.append((role, sum(len(body) > n for n in LENGTHS), int(body.endswith(("?", "？"))), int(not k), int(k == len(lines) - 1)))
        found.append((line, end))
    return observations, found


@dataclass
class Hmm:
    start: np.ndarray  # log probability of the first role
    follow: np.ndarray  # of the next turn's role, by role
    length: np.ndarray  # of a line's length class, by role and whether it opens (0) or goes on (1)
    asks: np.ndarray
    last: np.ndarray  # of being a plain record's last line
    marker: np.ndarray  # of a plain record's marker, by whether the line opens or goes on
    style: np.ndarray  # of a record's being plain, or a transcript

    def emission(self, o: Observation) -> np.ndarray:
        marker, length, asks, first, last = o
        on = 1 - OPENS.astype(int)
        # a transcript's lines are known by their markers: how long lines are was counted over plain records
        plain = self.length[ROLE, on, length] + self.asks[ROLE, on, asks] + self.last[ROLE, on, last] + self.marker[on, marker]
        own = np.where(ROLE == marker, np.log(OWN), np.log((1 - OWN) / N))
        stray = np.log(1 - STRAY) if marker == N else np.log(np.where(ROLE == marker, STRAY * 0.6, STRAY * 0.4 / (N - 1)))
        out = np.where(MARKED, np.where(OPENS, own, stray) - np.log(self.length.shape[2] * 4), plain)
        return np.where(OPENS | (not first), out, -np.inf)

    def transition(self, first: int) -> np.ndarray:
        """From each state to each state at the next line."""
        turn = self.follow[ROLE[:, None], ROLE[None, :]]
        if first:
            return np.where(OPENS[None, :], turn + self.style[MARKED.astype(int)][None, :], -np.inf)
        same = (MARKED[:, None] == MARKED[None, :]) & (OPENS[None, :] | (ROLE[:, None] == ROLE[None, :]))
        opens = np.where(MARKED[None, :], turn + np.log(TURNS), -np.inf)
        goes_on = np.where(MARKED[None, :], np.log1p(-TURNS), 0.0)
        return np.where(same, np.where(OPENS[None, :], opens, goes_on), -np.inf)

    def first(self) -> np.ndarray:
        return np.where(OPENS, self.start[ROLE] + self.style[MARKED.astype(int)], -np.inf)

    @functools.cached_property
    def step(self) -> Callable[[Observation], np.ndarray]:
        """Transition and emission together, by observation; there are few different ones, worked out once a process."""
        return functools.lru_cache(maxsize=None)(lambda o: self.transition(o[3]) + self.emission(o)[None, :])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "step"}

    def transfer(self, observations: list[Observation]) -> tuple[np.ndarray, np.ndarray]:
        """Best scores of each state at the last line where nothing is before the lines, and from each state before them."""
        score = None
        for o in observations:
            if score is None:
                score = np.vstack([self.first() + self.emission(o), self.step(o)])
            else:
                score = (score[:, :, None] + self.step(o)[None, :, :]).max(axis=1)
        return score[0], score[1:]

    def decode(self, observations: list[Observation], before: int | None, last: int | None) -> list[int]:
        """The best states between the given ones; before None: nothing is before the lines; last None: any may be last."""
        step, score, back = self.step, None, []
        for o in observations:
            if score is None:
                score = self.first() + self.emission(o) if before is None else step(o)[before]
                continue
            ways = score[:, None] + step(o)
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        states = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + SMOOTH
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def train(df: DataFrame, is_training: F.Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Hmm:
    """Count over all labelled records with is_training (all if None); only the counts reach the driver."""
    rows = df if is_training is None else df.filter(is_training)
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))

    def counted(batches):
        counts: Counter = Counter()
        for batch in batches:
            for given, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                role = ROLE_OF.get((given or "").strip().lower())
                if role is None:
                    continue
                observations = observe(text)[0]
                transcript = observations[0][0] == role
                counts["style", 0, 0, int(transcript)] += 1
                for marker, length, asks, first, last in observations:
                    on = 1 - first
                    counts["length", role, on, length] += 1
                    counts["asks", role, on, asks] += 1
                    if not transcript:
                        counts["last", role, on, last] += 1
                        counts["marker", 0, on, marker] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[c] for k in keys], pa.int32()) for c in (1, 2, 3)), pa.array(list(counts.values()), pa.int64())], ["what", "a", "b", "c", "n"])

    emitted = rows.select("role", "text").mapInArrow(counted, "what string, a int, b int, c int, n long").groupBy("what", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    tables = {"length": np.zeros((N, 2, len(LENGTHS) + 1)), "asks": np.zeros((N, 2, 2)), "last": np.zeros((N, 2, 2)), "marker": np.zeros((1, 2, N + 1)), "style": np.zeros((1, 1, 2))}
    for r in emitted:
        tables[r["what"]][r["a"], r["b"], r["c"]] = r["n"]
    role = F.when(F.col("role").isNull(), None)
    for name, k in ROLE_OF.items():
        role = role.when(F.lower(F.trim("role")) == name, k)
    known = rows.select("conv", "turn", role.alias("r")).filter("r IS NOT NULL")
    ahead = known.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    follow, start = np.zeros((N, N)), np.zeros(N)
    for r in known.join(ahead, ["conv", "turn"]).groupBy("r", "next").count().collect():
        follow[r["r"], r["next"]] = r["count"]
    for r in known.filter("turn = 0").groupBy("r").count().collect():
        start[r["r"]] = r["count"]
    plain, transcripts = tables["style"][0, 0]
    share = (transcripts + TRANSCRIPTS[0]) / (plain + transcripts + TRANSCRIPTS[1])
    return Hmm(logs(start), logs(follow), logs(tables["length"]), logs(tables["asks"]), logs(tables["last"]), logs(tables["marker"][0]), np.log([1 - share, share]))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal leading columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(keys)]
        begin = 0
        for k, key in enumerate(zip(*columns, strict=True)):
            if key != current:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, current, begin = [], key, k
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def observed(table: pa.Table) -> tuple[list[Observation], list[list[tuple[str, int]]]]:
    """All observations of a segment, and the lines of each record; a record counts as often as it has copies."""
    found = [f for text, copies in zip(table["text"].to_pylist(), table["copies"].to_pylist(), strict=True) for f in [observe(text)] * copies]
    return [o for f in found for o in f[0]], [f[1] for f in found]


def pieces(df: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """Rows (conv, range, piece, cut, alone, turn, rank, text, copies): the distinct records with their segments.

    A segment has one (conv, range, piece, cut). Equal records are counted, MOST in a piece at most; a range of turn numbers
    with more than MOST records is cut at turns, pieces and ranks (hashes of the text), the order in which its records come
    anyway. alone: the conversation has no other segment.
    """
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    rows = rows.groupBy("conv", "turn", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / MOST))))
    rows = rows.withColumn("copies", F.least(F.lit(MOST).cast("long"), F.col("n") - F.col("number") * MOST))
    rows = rows.withColumn("range", F.floor(F.col("turn") / SEGMENT)).withColumn("rank", F.xxhash64("text") / F.lit(2.0**64) + 0.5)
    sizes = rows.groupBy("conv", "range").agg(F.ceil(F.sum("copies") / MOST).alias("cuts"))
    of_conv = sizes.groupBy("conv").agg(F.count(F.lit(1)).alias("ranges"), F.max("cuts").alias("most")).filter("ranges > 1 OR most > 1")
    several = sizes.alias("s").join(of_conv.alias("c"), F.expr("s.conv <=> c.conv")).select("s.conv", "s.range", "s.cuts")
    rows = rows.alias("r").join(several.alias("l"), F.expr("r.conv <=> l.conv AND r.range <=> l.range"), "left")
    crowded = F.col("l.cuts") > 1
    piece = F.when(crowded, F.struct(F.col("r.turn"), F.col("r.number")))
    return rows.select("r.conv", "r.range", piece["turn"].alias("sub_turn"), piece["number"].alias("piece"), F.when(crowded, F.floor(F.col("r.rank") * F.col("l.cuts"))).alias("cut"), F.col("l.cuts").isNull().alias("alone"), "r.turn", "r.number", "r.rank", "r.text", "r.copies")


SEGMENT_KEYS = ["conv", "range", "sub_turn", "piece", "cut"]
ORDER = [*SEGMENT_KEYS, "turn", "number", "rank", "text"]


def format_chats(df: DataFrame, model: Hmm, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, part, role, text, marker, rendered): the turns of each record, numbered by part from 0.

    marker is what was taken off the turn's lines (speaker and end marks), empty for most. Roles in df are not looked at.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = pieces(df, conv_col, turn_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()
    keys, n_keys = f"conv {kind}, range long, sub_turn long, piece long, cut long", len(SEGMENT_KEYS)

    def matrices(batches):
        hmm = held.value
        for table in runs(batches, n_keys):
            observations, _ = observed(table)
            found = [f.ravel() for f in hmm.transfer(observations)]
            key = [table.column(c).slice(0, 1).combine_chunks() for c in range(n_keys)]
            lists = [pa.array([f.tolist()], pa.list_(pa.float64())) for f in found]
            yield pa.RecordBatch.from_arrays([*key, *lists], [*SEGMENT_KEYS, "opening", "inside"])

    long = rows.filter("NOT alone").repartition(*SEGMENT_KEYS).sortWithinPartitions(*ORDER)
    transfers = checkpoint(long.mapInArrow(matrices, f"{keys}, opening array<double>, inside array<double>"))

    def ahead(batches):
        conv, score, seen = None, None, False
        for batch in batches:
            entries = []
            for k, name in enumerate(batch.column(0).to_pylist()):
                first = not seen or name != conv
                conv, seen = name, True
                entries.append(None if first else score.tolist())
                found = np.array(batch.column(n_keys if first else n_keys + 1)[k].as_py())
                score = found if first else (score[:, None] + found.reshape(STATES, STATES)).max(axis=0)
            lists = pa.array(entries, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_keys + 2)), lists], [*SEGMENT_KEYS, "opening", "inside", "entry"])

    def behind(batches):
        conv, wanted, seen = None, None, False
        for batch in batches:
            befores, lasts = [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                last_of_conv = not seen or name != conv
                conv, seen = name, True
                entry = batch.column(n_keys + 2)[k].as_py()
                found = np.array(batch.column(n_keys if entry is None else n_keys + 1)[k].as_py())
                total = found[None, :] if entry is None else np.array(entry)[:, None] + found.reshape(STATES, STATES)
                last = int(total.max(axis=0).argmax()) if last_of_conv else wanted
                before = None if entry is None else int(total[:, last].argmax())
                lasts.append(last)
                befores.append(before)
                wanted = before
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_keys)), pa.array(befores, pa.int32()), pa.array(lasts, pa.int32())], [*SEGMENT_KEYS, "before", "last"])

    entered = transfers.repartition("conv").sortWithinPartitions(*SEGMENT_KEYS).mapInArrow(ahead, f"{keys}, opening array<double>, inside array<double>, entry array<double>")
    down = [F.col("conv"), *[F.col(c).desc() for c in SEGMENT_KEYS[1:]]]
    borders = entered.repartition("conv").sortWithinPartitions(*down).mapInArrow(behind, f"{keys}, before int, last int")
    same = " AND ".join(f"r.{c} <=> b.{c}" for c in SEGMENT_KEYS)
    joined = rows.alias("r").join(borders.alias("b"), F.expr(same), "left").select("r.*", "b.before", "b.last")

    def turns(batches):
        hmm = held.value
        for table in runs(batches, n_keys):
            observations, records = observed(table)
            states = hmm.decode(observations, table["before"][0].as_py(), table["last"][0].as_py())
            numbers = np.repeat(np.arange(table.num_rows), table["copies"].to_numpy())
            out, at = [], 0
            for number, lines in zip(numbers.tolist(), records, strict=True):
                out += [(number, part, *turn) for part, turn in enumerate(spoken(lines, states[at : at + len(lines)], observations[at : at + len(lines)]))]
                at += len(lines)
            index, part, roles, texts, markers = zip(*out, strict=True)
            index = pa.array(index, pa.int64())
            rendered = [render(a, t) for a, t in zip(roles, texts, strict=True)]
            columns = [table["conv"].take(index).combine_chunks(), table["turn"].take(index).combine_chunks(), pa.array(part, pa.int64()), *(pa.array(x, pa.string()) for x in (roles, texts, markers, rendered))]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "turn", "part", "role", "text", "marker", "rendered"])

    decoded = joined.repartition(*SEGMENT_KEYS).sortWithinPartitions(*ORDER).mapInArrow(turns, f"conv {kind}, turn long, part long, role string, text string, marker string, rendered string")
    return decoded.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)


def spoken(lines: list[tuple[str, int]], states: list[int], observations: list[Observation]) -> list[tuple[str, str, str]]:
    """(role, text, marks taken off) of each turn of a record."""
    turns: list[tuple[str, list[str], list[str]]] = []
    for (line, end), state, o in zip(lines, states, observations, strict=True):
        if OPENS[state]:
            turns.append((ROLES[ROLE[state]], [], []))
        _, texts, marks = turns[-1]
        if MARKED[state]:
            if OPENS[state] and o[0] == ROLE[state]:
                marks.append(line[:end])
                line = line[end:]
            closing = END_MARK.search(line)
            if closing:
                marks.append(closing[0])
                line = line[: closing.start()]
        texts.append(line)
    return [(role, "\n".join(texts).strip(), "".join(marks)) for role, texts, marks in turns]


def render(role: str, text: str) -> str:
    """One canonical turn."""
    return f"<|{role}|>\n{text}\n<|end|>"
