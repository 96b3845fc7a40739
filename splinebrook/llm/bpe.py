"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie; what a word shares with no other is one leaf. A depth-first walk hands down, for each
prefix, its last token: the one vocabulary entry that is a suffix of the prefix and may follow the last token of what is
left before it. It follows from the last tokens further up the same path, so a prefix shared by many words is encoded
once. Which entries are suffixes of a prefix is told by a state that goes down with it: the longest suffix of the prefix
that some entry begins with. The last tokens along a path are enough to read off the whole encoding backwards.

A sequence of tokens is the encoding of its text just when each neighbouring pair is the encoding of its own text, so a
prefix only ever tests pairs; the tests are cached. Nothing recurses: the work on a word is in proportion to its length,
however long it is.

Null texts count as empty and give no tokens. White space separates words and is dropped. Texts are never cut. Repeated
rows are encoded like any other, one row each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed values of the vocabulary file's own rules.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"

#: Separators that str.split() knows and the vocabulary's white space does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile(f"[{SPACE}]+")

#: Entries, and characters of them, that a worker keeps before it starts a new cache; bounds memory, not results.
CACHE_ENTRIES = 400_000
CACHE_CHARS = 16_000_000
NEVER = 1 << 60


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> list[str]:
    """A printable stand-in for each byte: itself where it prints, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def ranges(among: Callable[[str], bool]) -> str:
    """The inside of a character class of all code points that are among."""
    at = [c for c in range(0x110000) if among(chr(c))]
    starts = [c for k, c in enumerate(at) if not k or at[k - 1] != c - 1]
    ends = [c for k, c in enumerate(at) if k == len(at) - 1 or at[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@functools.lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numerals, runs of the rest but white space."""
    letters = ranges(str.isalpha)
    numerals = ranges(lambda c: c.isnumeric() and not c.isalpha())
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numerals}]|[^{SPACE}{letters}{numerals}]+")


class Recent(dict):
    """A cache of two generations: when the young one is full it becomes the old one; what is used again moves up."""

    def __init__(self, entries: int = CACHE_ENTRIES // 2):
        super().__init__()
        self.entries, self.old, self.chars = entries, {}, 0

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that neither generation has; those of the old one move to the young one."""
        if len(self) > self.entries or self.chars > CACHE_CHARS // 2:
            self.old, self.chars = dict(self), 0
            self.clear()
        absent = keys - self.keys()
        self.chars += sum(map(len, absent))
        for k in absent & self.old.keys():
            self[k] = self.old[k]
        return absent - self.old.keys()


class TrieEncoder:
    """Encodes words of one vocabulary; one per worker process and vocabulary path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.library = path, None
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(max([*self.vocab.values(), *self.special.values()]) + 1, dtype=object)
        self.tokens[:] = ""
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        letters = {t: t[: -len(END)] if t.endswith(END) and len(t) > len(END) else t for t in self.vocab}
        self.inner = {t: (self.vocab[t], len(t), {}, t) for t, own in letters.items() if t is own}
        self.final = {own: (self.vocab[t], len(own), {}, t) for t, own in letters.items() if t is not own}
        self.begun = {own[:k] for own in letters.values() for k in range(len(own) + 1)}
        self.root, self.states, self.n_states, self.n_pairs = None, {}, 0, 0
        self.forget()
        self.bytes = byte_chars()
        self.pattern = word_pattern()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.made = {x + y: (x, y, r) for (x, y), r in self.rank.items()}
        self.proper: dict[str, bool] = {}
        self.right_edges: dict[str, list[tuple[str, int]]] = {}
        self.left_edges: dict[str, list[tuple[str, int]]] = {}
        self.words = Recent()
        self.chunks = Recent()

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge by rank until nothing merges; only used to see that a token is the encoding of its own text."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), NEVER))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def alone(self, token: str) -> bool:
        known = self.proper.get(token)
        if known is None:
            marked = token.endswith(END) and len(token) > len(END)
            symbols = list(token[: -len(END)] if marked else token)
            if marked:
                symbols[-1] += END
            known = self.proper[token] = self.merged(symbols) == [token]
        return known

    def edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """What stands at the right (or left) edge of token while it is merged together, each with the rank that ends it."""
        spines = self.right_edges if right else self.left_edges
        known = spines.get(token)
        if known is None:
            known, part = [(token, NEVER)], token
            while part in self.made:
                left_part, right_part, rank = self.made[part]
                part = right_part if right else left_part
                known.append((part, rank))
            known.reverse()
            spines[token] = known
        return known

    def follows(self, left: str | None, right: str) -> bool:
        """Whether left then right is the encoding of their joint text (left None: right alone).

        It is unless, at some time, the symbols at both sides of the border merge with each other: that is, at a lower
        rank than the merge that takes the left one away, and at no higher one than that which takes the right one.
        """
        if left is None:
            return self.alone(right)
        lefts, rights, i, j = self.edge(left, True), self.edge(right, False), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = lefts[i], rights[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        """Drop the states and the tested pairs; they are worked out again when they are met."""
        for token in (*self.inner.values(), *self.final.values()):
            token[2].clear()
        self.states, self.n_states, self.n_pairs = {}, 0, 0
        self.root = self.state("")

    def state(self, suffix: str) -> tuple[dict, tuple, tuple, str]:
        """Next states by character, the entries that are suffixes within a word and at its end (longest first), itself."""
        known = self.states.get(suffix)
        if known is None:
            ends = [suffix[k:] for k in range(len(suffix))]
            known = self.states[suffix] = ({}, tuple(self.inner[e] for e in ends if e in self.inner), tuple(self.final[e] for e in ends if e in self.final), suffix)
        return known

    def next_state(self, state: tuple, c: str) -> tuple:
        suffix = state[3] + c
        while suffix not in self.begun:
            suffix = suffix[1:]
        self.n_states += 1
        found = state[0][c] = self.state(suffix)
        return found

    def pick(self, entries: tuple, lasts: list[tuple], depth: int) -> tuple:
        """The entry that ends a prefix of depth characters, given the last tokens of all shorter ones."""
        for entry in entries:
            before = lasts[depth - entry[1]]
            known = entry[2].get(before[0])
            if known is None:
                known = entry[2][before[0]] = self.follows(before[3], entry[3])
                self.n_pairs += 1
            if known:
                return entry
        raise ValueError("no token ends a prefix")

    def encode_words(self, words: set[str]) -> None:
        """Put the words' encodings (ids as bytes) into self.words: insert them into a trie, then walk it depth first."""
        if self.n_pairs > CACHE_ENTRIES or self.n_states > CACHE_ENTRIES:
            self.forget()
        collecting = gc.isenabled()
        gc.disable()  # a trie is many small dicts and no cycles
        try:
            self.walk(self.trie(words))
        finally:
            if collecting:
                gc.enable()

    def trie(self, words: set[str]) -> dict:
        """Dicts by character; a leaf is (word, its spelling), and "" leads to a word that ends where others go on."""
        trie: dict = {}
        for word in words:
            spelled = word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode()])
            node = trie
            for depth, c in enumerate(spelled, 1):
                below = node.get(c)
                if below is None:
                    node[c] = (word, spelled)
                    break
                if type(below) is tuple:  # a leaf gives way to a branch
                    node[c] = {below[1][depth : depth + 1]: below}
                    below = node[c]
                node = below
            else:
                node[""] = (word, spelled)
        return trie

    def walk(self, trie: dict) -> None:
        """Depth first, with the last tokens and the states of all prefixes on the path from the root."""
        lasts: list[tuple] = [(-1, 0, None, None)]
        states = [self.root]
        stack = [(0, c, node) for c, node in trie.items()]
        pick = self.pick
        while stack:
            depth, c, node = stack.pop()
            del lasts[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            if type(node) is dict:
                state = state[0].get(c) or self.next_state(state, c)
                depth += 1
                states.append(state)
                lasts.append(pick(state[1], lasts, depth))
                stack += [(depth, k, below) for k, below in node.items()]
                continue
            word, spelled = node
            n = len(spelled)
            for at in range(depth, n):
                c = spelled[at]
                state = state[0].get(c) or self.next_state(state, c)
                if at + 1 < n:
                    lasts.append(pick(state[1], lasts, at + 1))
            token = pick(state[2], lasts, n)
            ids, at = [token[0]], n - token[1]
            while at:
                token = lasts[at]
                ids.append(token[0])
                at -= token[1]
            ids.reverse()
            self.words[word] = array("I", ids).tobytes()

    def split(self, chunk: str) -> list[str]:
        """The words of a run without white space, after the vocabulary's normalisation."""
        if not chunk.isascii():
            if not chunk.isprintable() and any(unicodedata.category(c) == "Cn" for c in chunk):
                return self.library_words(chunk)
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def library_words(self, chunk: str) -> list[str]:
        """The same by the library's own rules, for characters that are newer than Python's tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        chunk = self.library.normalizer.normalize_str(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def prepare(self, chunks: set[str]) -> None:
        """Make the encodings of all these chunks (runs without white space) known."""
        missing = self.chunks.missing(chunks)
        if not missing:
            return
        split = {c: self.split(c) for c in missing}
        new = self.words.missing({w for ws in split.values() for w in ws})
        if new:
            self.encode_words(new)
        words, known = self.words, self.chunks
        for c, ws in split.items():
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def chunked(self, text: str | None) -> list[str]:
        """The runs without white space of text; special tokens' strings stand alone."""
        if not text:
            return []
        if self.special_pattern is not None and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.special_pattern.split(text)):
                out += [part] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    @staticmethod
    def plain(text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x] if ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.chunked(t) for t in texts]
        distinct = set().union(*pieces)
        special = distinct & self.special.keys()
        self.prepare(distinct - special)
        for token in special:
            self.chunks[token] = array("I", [self.special[token]]).tobytes()
        get = self.chunks.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings, joined by one space (the vocabulary file names no decoder)."""
        return " ".join(self.tokens[ids].tolist())


#: Chunks that a RankEncoder remembers: the first ones it meets, so the frequent ones, unless they are long.
KNOWN_CHUNKS = 100_000
KNOWN_CHARS = 64


class RankEncoder(TrieEncoder):
    """The same ids with new words merged by tiktoken, for callers that need no trie.

    A word end is a zero byte that merges with the byte before it ahead of all other merges, as the vocabulary's end mark
    belongs to the last character from the start. Words that hold a zero byte go through the trie.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        value = {c: b for b, c in enumerate(self.bytes)}
        ranks = {}
        for token, i in self.vocab.items():
            marked = token.endswith(END) and len(token) > len(END)
            ranks[bytes(value[c] for c in (token[: -len(END)] if marked else token)) + b"\0" * marked] = i
        self.merger = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.array([t.endswith(END) for t in self.tokens])
        self.known = {t: array("I", [i]).tobytes() for t, i in self.special.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        get = self.known.get
        for text in texts:
            chunks = self.chunked(text)
            found = list(map(get, chunks))
            new = [c for c, f in zip(chunks, found, strict=True) if f is None]
            if new:
                ids = self.encode_chunks(new)
                if len(self.known) < KNOWN_CHUNKS:
                    self.known.update((c, i) for c, i in zip(new, ids, strict=True) if len(c) <= KNOWN_CHARS)
                rest = iter(ids)
                found = [next(rest) if f is None else f for f in found]
            out.append(b"".join(found))
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = self.split
        words, ends = [], []
        for c in chunks:
            words += split(c)
            ends.append(len(words))
        joined = "\0".join(words) + "\0"
        if joined.count("\0") != len(words):
            self.prepare(set(chunks))
            return [self.chunks[c] for c in chunks]
        ids = self.merger.encode_to_numpy(joined)
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1))[np.array(ends) - 1].tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, trie: bool = True) -> TrieEncoder:
    return (TrieEncoder if trie else RankEncoder)(path)


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """Rows (id, token_ids array<int>), one per row of df, in no particular order; other columns are left out."""
    path = vocab_path or default_vocab()

    def make():
        enc = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), id_lists(enc.encode(batch.column(1).to_pylist()))], ["id", "token_ids"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocab_path: str | None = None) -> DataFrame:
    """Rows (id, token_ids, decoded string), one per row of df; null ids decode to the empty text."""
    path = vocab_path or default_vocab()

    def make():
        enc = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(1)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            texts = [enc.decode(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["id", "token_ids", "decoded"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("token_ids"))
    return map_arrow(rows, make, f"id {kind}, token_ids array<int>, decoded string").withColumnRenamed("id", id_col)
