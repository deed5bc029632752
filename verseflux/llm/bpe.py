"""BPE encoding and decoding by an automaton compiled from the merges.

The automaton reads tokens and accepts exactly the right tokenizations. It begins as one state
with an arc to itself for every byte. Each merge (u, v), in order, puts in a gadget:

* The state q that u leads to gets a copy q' without the arc v, and u leads to q' from now on:
  after u, the token v cannot follow any more.
* Wherever u can be read, the arc uv can be read too; it leads where v led from q.

Copies are stored as differences (owner token, birth, removed arc), so the table has one row
per merge. Whether an arc exists follows from the rows: neither it nor, at the time of its
merge, its left part may have been removed on the way from the state to the first one. Arcs
that are asked for are kept in a transition table.

A pre-split word is read along the arcs, longest label first, turning back at dead ends; the
path that reaches the end is the only one there is. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from verseflux.llm.chunks import PieceCoder, flattened, groups
from verseflux.llm.common import add_arrow, without

#: Fixed pattern of byte-level pre-tokenization.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words kept by a worker with their ids: those of the last half and those met since then.
CACHE_WORDS = 150_000
_FIRST = 0


def byte_characters() -> dict[str, int]:
    """Character that stands for a byte in vocabulary files -> byte: printable bytes stand for
    themselves, the others for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """``labels``: token -> bytes; ``merges``: (left, right, merged) tokens in order."""
        self.labels = labels
        self.left: dict[int, int] = {}
        self.born = dict.fromkeys(labels, 0)  # when a token's arc came to be
        self.after = dict.fromkeys(labels, _FIRST)  # token -> state it leads to
        self.owner, self.birth = [-1], [0]  # of each state
        self.base: dict[int, int] = {}  # owner -> state that its first copy was made from
        self.copies: dict[int, list[int]] = {}  # owner -> its states, oldest first
        self.removed: dict[tuple[int, int], int] = {}  # (owner, arc) -> birth of the copy without it
        for time, (u, v, w) in enumerate(merges, 1):
            self._gadget(time, u, v, w)
        self.arcs: dict[int, int] = {}
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for token, label in labels.items():
            node = 0
            for b in label:
                key = node << 8 | b
                node = self.trie.get(key)
                if node is None:
                    node = self.trie[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = token

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        q, r = self.after[u], self.after[v]
        state = len(self.owner)
        self.owner.append(u)
        self.birth.append(time)
        self.base.setdefault(u, q)
        self.copies.setdefault(u, []).append(state)
        self.removed[u, v] = time
        self.after[u] = state
        self.after[w] = r
        self.born[w], self.left[w] = time, u

    def _earlier(self, state: int, time: int) -> int:
        """The state that this one was copied from, directly or not, as it was at a time."""
        while self.birth[state] > time:
            own = self.copies[self.owner[state]]
            k = bisect_right(own, time, key=self.birth.__getitem__)
            state = own[k - 1] if k else self.base[self.owner[state]]
        return state

    def _has(self, state: int, token: int) -> bool:
        while True:
            at = state
            while at != _FIRST:
                owner = self.owner[at]
                gone = self.removed.get((owner, token))
                if gone is not None and gone <= self.birth[at]:
                    return False
                at = self.base[owner]
            if token not in self.left:
                return True
            state = self._earlier(state, self.born[token])
            token = self.left[token]

    def step(self, state: int, token: int) -> int:
        """The state that the arc leads to, or -1."""
        key = state << 32 | token
        to = self.arcs.get(key)
        if to is None:
            to = self.arcs[key] = self.after[token] if self._has(state, token) else -1
        return to

    def encode(self, word: bytes) -> list[int]:
        trie, ends, step = self.trie, self.ends, self.step
        n, at, state = len(word), 0, _FIRST
        path: list[int] = []
        open_: list[tuple[int, int, list[tuple[int, int]]]] = []
        dead: set[tuple[int, int]] = set()
        while at < n:
            choices, node, i = [], 0, at
            while i < n:
                node = trie.get(node << 8 | word[i])
                if node is None:
                    break
                i += 1
                if ends[node] >= 0:
                    choices.append((i, ends[node]))
            while True:
                while choices:
                    end, token = choices.pop()
                    to = step(state, token)
                    if to >= 0 and (end, to) not in dead:
                        break
                else:
                    dead.add((at, state))
                    at, state, choices = open_.pop()
                    path.pop()
                    continue
                break
            open_.append((at, state, choices))
            path.append(token)
            at, state = end, to
        return path


class Codec:
    """A tokenizer file: automaton, added tokens, and the labels for decoding."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, chars = spec["model"], byte_characters()
        vocabulary = {t: i for t, i in model["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        labels = {i: bytes(chars[c] for c in t) for t, i in vocabulary.items() if all(c in chars for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.automaton = MergeAutomaton(labels, merges)
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.coder = PieceCoder(self._pieces, self.added)
        table = [labels.get(i, b"") for i in range(max([*labels, *self.added.values()]) + 1)]
        for content, i in self.added.items():
            table[i] = content.encode()
        self.label_sizes = np.array([len(x) for x in table], np.int64)
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.label_bytes = np.frombuffer(b"".join(table), np.uint8)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.older = {}, self.words
        if len(self.automaton.arcs) > 4 * CACHE_WORDS:
            self.automaton.arcs.clear()
        words, older, encode = self.words, self.older, self.automaton.encode
        found = []
        for piece in pieces:
            ids: list[int] = []
            for w in WORDS.findall(piece):
                own = words.get(w)
                if own is None:
                    own = older.get(w) or encode(w.encode())
                    if len(w) < 64:
                        words[w] = own
                ids += own
            found.append(ids)
        return flattened(found)

    def release(self) -> None:
        """Forget all texts; the compiled automaton stays."""
        self.words, self.older = {}, {}
        self.automaton.arcs = {}
        self.coder.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.label_sizes[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.label_starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.label_bytes[where].tobytes()


@lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Codec(f.read())


def ship_file(spark, path: str) -> str:
    """Send a tokenizer file to the executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_decode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids of the whole text) and
    ``decoded`` (the text that these ids stand for, made from the ids alone).

    Null and empty texts have no ids and decode to an empty text. Added tokens of the file that
    stand in a text become their ids. Rows are independent: repeated rows give repeated
    results, an empty table an empty one; columns of ``df`` named like a result are replaced.
    ``tokenizer`` is the path of a byte-level BPE file.
    """
    name = ship_file(df.sparkSession, tokenizer)

    def run(column: pa.Array) -> dict[str, pa.Array]:
        codec = _codec(name)
        ids, decoded = [], []
        for group in groups("" if t is None else t for t in column.to_pylist()):
            flat, edges = codec.coder.encode(group)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = flat[a:b]
                ids.append(own.astype("<u4").tobytes())
                decoded.append(codec.decode(own).decode("utf-8", "replace"))
        return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}

    rest = without(df, ["ids", "decoded"])
    return add_arrow(rest, [text_col], "ids binary, decoded string", run, lambda: _codec(name).release())
