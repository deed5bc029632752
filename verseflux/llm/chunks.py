"""Encoding of whole texts through a bounded cache of their pieces.

A byte-level tokenizer never joins what stands on the two sides of a space that is followed by
something else than white space, so a text may be cut before every such space and the pieces
encoded on their own, each distinct piece once per worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Distinct pieces kept by a worker; beyond them the more frequent half stays.
CACHE_PIECES = 250_000
#: Bytes of text encoded at once.
GROUP_CHARS = 2_000_000


def groups(texts: Iterable[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


class _Numbers(dict):
    """Piece -> number; new pieces get the next number and are remembered as fresh."""

    def __init__(self, coder: PieceCoder, prefix: str):
        super().__init__()
        self.coder, self.prefix = coder, prefix

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.coder.count
        self.coder.count += 1
        self.coder.fresh.append(self.prefix + piece)
        return number


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All members in a row, and the lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lengths.sum())), lengths


def put_together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in a row and lengths of n lists, from parts of (their places, members, lengths)."""
    lengths = np.zeros(n, np.int64)
    for places, _, own in parts:
        lengths[places] = own
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.int64)
    for places, members, own in parts:
        flat[np.repeat(starts[places] - (np.cumsum(own) - own), own) + np.arange(len(members))] = members
    return flat, lengths


class PieceCoder:
    """``encode_pieces`` gets new pieces and returns their ids in a row and the number of each;
    ``added`` maps the contents of added tokens, which are cut out of a text before anything
    else, to their ids."""

    def __init__(
        self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int]
    ):
        self.encode_pieces, self.added = encode_pieces, added
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        self.count, self.fresh = 0, []
        self.first, self.later = _Numbers(self, ""), _Numbers(self, " ")
        self.ids, self.lengths = array("I"), array("i")
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the pieces used most, half of the cache at most, and none that was used once."""
        keep = self.uses > 1
        if keep.sum() > CACHE_PIECES // 2:
            keep &= self.uses > np.partition(self.uses, -(CACHE_PIECES // 2))[-(CACHE_PIECES // 2)]
        numbers = np.cumsum(keep) - 1
        lengths = np.frombuffer(self.lengths, np.int32)
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(keep, lengths)]
        kept = [{p: int(numbers[n]) for p, n in known.items() if keep[n]} for known in (self.first, self.later)]
        uses, lengths = self.uses[keep] // 2, lengths[keep]
        self.clear()
        self.count, self.uses = len(lengths), uses
        self.first.update(kept[0])
        self.later.update(kept[1])
        self.ids.frombytes(ids.tobytes())
        self.lengths.frombytes(lengths.tobytes())

    def _numbers(self, text: str) -> list[np.ndarray]:
        parts = text.split(" ") if _ODD_SPACE.search(text) is None else _CUT.split(text)
        rest = parts[1:]
        return [
            np.array([self.first[parts[0]]] if parts[0] else [], np.int64),
            np.fromiter(map(self.later.__getitem__, rest), np.int64, len(rest)),
        ]

    def _pieces(self, text: str) -> list[np.ndarray]:
        if self.marks is None or not any(a in text for a in self.added):
            return self._numbers(text)
        out = []
        for part in self.marks.split(text):
            if part in self.added:
                out.append(np.array([-1 - self.added[part]], np.int64))
            elif part:
                out.extend(self._numbers(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (32 bits each), and where each text's ids begin and end."""
        if self.count > CACHE_PIECES:
            self._shrink()
        pieces = [self._pieces(t) for t in texts]
        if self.fresh:
            ids, lengths = self.encode_pieces(self.fresh)
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
            self.lengths.frombytes(lengths.astype(np.int32).tobytes())
            self.fresh = []
        lengths = np.frombuffer(self.lengths, np.int32).astype(np.int64) if self.count else np.zeros(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        row = np.concatenate([p for own in pieces for p in own]) if texts else np.zeros(0, np.int64)
        counts = np.array([sum(map(len, own)) for own in pieces], np.int64)
        added = row < 0
        uses = np.bincount(row[~added], minlength=self.count)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        size = np.where(added, 1, lengths[np.where(added, 0, row)] if self.count else 1)
        ends = np.cumsum(size)
        begin = np.where(added, 0, starts[np.where(added, 0, row)] if self.count else 0)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(begin - (ends - size), size) + np.arange(total)
        ids = flat[where] if len(flat) else np.zeros(total, np.uint32)
        if added.any():
            ids[(ends - 1)[added]] = (-1 - row[added]).astype(np.uint32)
        edges = np.r_[0, np.cumsum(counts)]
        return ids, np.r_[0, ends][edges]
