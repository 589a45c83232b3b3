"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that the merge list produces. It starts
as one state with an arc for every byte. Each merge (u, v), taken in order of priority,
adds a gadget: the state reached by the new token uv, which starts as a copy of the state
reached by v; an arc uv wherever there was an arc u (but not after u itself if u = v, as
merging goes from left to right); and the arc v after u is cut. Copies are kept as links
to their origin with the time of copying, so compiling is linear in the merges; a
transition that has been resolved once stays in the table.

A word is read by following labels byte by byte from each state, longest arc first, with
the table saying which arcs the state has. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postloom.shipping import ship

#: The pre-splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their tokens in a worker, and the longest of them in characters.
WORDS_KEPT, WORD_LENGTH = 250_000, 64
#: Transitions kept in a worker.
STEPS_KEPT = 500_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic automaton over tokens; states are named by the arc that leads to them."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = labels
        self.born: dict[int, int] = {}  # time at which a token's state and arcs came to be
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[int, int] = {}  # (state, arc) -> time at which a gadget cut the arc
        self.table: dict[int, bool] = {}
        for byte in range(256):
            if (t := labels.get(bytes([byte]))) is not None:
                self.born[t] = 0
        for time, (left, right) in enumerate(merges, 1):
            u, v, uv = labels[left], labels[right], labels[left + right]
            self.cut.setdefault(u << 32 | v, time)
            if uv not in self.born:
                self.born[uv], self.parts[uv] = time, (u, v)
        self.nexts: dict[int, int] = {}  # bytes of the labels: node << 8 | byte -> node
        self.tokens: dict[int, int] = {}
        for label, token in labels.items():
            if token in self.born:
                node = 0
                for byte in label:
                    node = self.nexts.setdefault(node << 8 | byte, len(self.nexts) + 1)
                self.tokens[node] = token

    def allows(self, state: int, arc: int, time: int) -> bool:
        """Whether the state had the arc after `time` merges."""
        while True:
            if self.cut.get(state << 32 | arc, time + 1) <= time:
                return False
            a, b = self.born[state], self.born[arc]
            if not a and not b:
                return True
            if a > b:  # the state is a copy of the one that its right part leads to
                state, time = self.parts[state][1], a - 1
            elif b > a:  # the arc came wherever its left part was
                u, v = self.parts[arc]
                if u == v == state:
                    return False
                arc, time = u, b - 1
            else:
                (arc, state), time = self.parts[state], a - 1

    def steps(self, state: int, arc: int) -> bool:
        key = state << 32 | arc
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self.allows(state, arc, 1 << 31)
            if len(self.table) > STEPS_KEPT:
                self.table.clear()
        return known

    def _matches(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Ends and tokens that begin at `at`, shortest first."""
        out, node, nexts, tokens = [], 0, self.nexts, self.tokens
        for end in range(at, len(word)):
            node = nexts.get(node << 8 | word[end])
            if node is None:
                break
            if (token := tokens.get(node)) is not None:
                out.append((end + 1, token))
        return out

    def encode(self, word: bytes) -> list[int]:
        """The accepted path. A prefix has one accepted path, so an end that led nowhere never needs a second try."""
        n, at, path, ends, tries = len(word), 0, [], [0], []
        dead: set[int] = set()
        open_arcs = self._matches(word, 0)
        while at < n:
            while open_arcs:
                end, token = open_arcs.pop()
                if end not in dead and (self.steps(path[-1], token) if path else self._reaches(token)):
                    tries.append(open_arcs)
                    path.append(token)
                    ends.append(end)
                    at, open_arcs = end, self._matches(word, end) if end < n else []
                    break
            else:
                dead.add(at)
                path.pop()
                ends.pop()
                at, open_arcs = ends[-1], tries.pop()
        return path

    def _reaches(self, token: int) -> bool:
        """A token begins a word if it is a byte or its parts were still joined by an arc when it was made."""
        if token not in self.parts:
            return token in self.born
        u, v = self.parts[token]
        key = -1 - token
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self.allows(u, v, self.born[token] - 1)
        return known


class Tokenizer:
    """Vocabulary file, automaton and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        labels = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(SPLIT).findall
        self._compile = lambda: MergeAutomaton(labels, merges)
        by_id = {i: t for t, i in labels.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(by_id) + 1
        self.arcs = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)
        self.lengths = np.array([len(by_id.get(i, b"")) for i in range(size)], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    @cached_property
    def words(self) -> _Words:
        return _Words(self._compile())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [*map(self.words.__getitem__, self.split(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, *map(self.words.__getitem__, self.split(text[at:]))])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.arcs[np.repeat(self.begins[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()

    def text(self, packed: bytes) -> str:
        return self.decode(np.frombuffer(packed, "<u4")).decode("utf-8", "replace")


class _Words(dict):
    """Tokens of the words met lately, in two generations: when the young one is full it becomes the old one, and words met again come back from there."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.automaton.encode(word.encode()), "<u4").tobytes()
        if len(word) <= WORD_LENGTH:
            if len(self) >= WORDS_KEPT // 2:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)


def _extended(docs: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, kind)])


def _with(batch: pa.RecordBatch, names: list[str], column: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names[:-1]] + [values], names=names)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds `ids`: the text's token ids, packed as little-endian unsigned 32-bit integers; and what they decode to (see bpe_decode) where `decoded` names a column for it.

    Null texts count as empty and have no ids. A column of docs that is named like a new one is
    replaced; all others stay. No shuffle: each row is encoded, and decoded again, where it is
    read, so repeated rows come out alike and an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    schema = _extended(docs, ids, T.BinaryType())
    if decoded is not None:
        schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier steps left in this worker
        one = tokenizer(path)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                packed = [one.encode(t) if t else b"" for t in part.column(text).to_pylist()]
                made = [pa.array(packed, pa.binary())]
                if decoded is not None:
                    made.append(pa.array([one.text(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names[: -len(made)]] + made, names=names)

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`: the labels of the ids' arcs, one after another, read as UTF-8 (bytes that are not are replaced). Null ids count as none."""
    ship(encoded.sparkSession)
    schema = _extended(encoded, decoded, T.StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizer(path)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                rows = pc.fill_null(part.column(ids), b"").to_pylist()
                yield _with(part, names, decoded, pa.array([one.text(r) for r in rows], pa.string()))

    return encoded.mapInArrow(run, schema)
