"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three characters, words padded with
a blank) of a language, most frequent first. A document's own list is compared with each
profile by the out-of-place distance: for every n-gram of the document, how far its rank is
from its rank in the profile, or the length of a profile where it has none. The nearest
language wins.

Profiles count all n-grams of all training texts: every task sums its batches, the sums are
added by a shuffle. n-grams are kept as 22-bit hashes. What is broadcast is ``size`` ranks per
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.llm.common import add_arrow

#: n-grams of a profile and of a document's list.
PROFILE = 400
GRAM_BITS = 22
UNKNOWN = "und"
#: Characters that are counted at once.
_GROUP = 1_500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram of the texts, and the text it comes from.

    Upper and lower case are one; what is no letter is a blank, and blanks in a row are one.
    """
    texts = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
    letter = _letters()[points]
    keep = letter | np.r_[True, letter[:-1]]  # a blank stays after a letter, or at the start
    points, owner, letter = np.where(letter, points, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    # A text begins with its first blank: add it where the text before it ended without a letter.
    first = np.r_[True, owner[1:] != owner[:-1]]
    missing = np.flatnonzero(first & letter)
    points, owner = np.insert(points, missing, 32), np.insert(owner, missing, owner[missing])
    letter = points != 32
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    same2 = owner[:-1] == owner[1:]
    same3 = same2[:-1] & same2[1:]
    # n-grams have a letter; a blank inside three characters joins two words and is left out.
    fine2 = same2 & (letter[:-1] | letter[1:])
    fine3 = same3 & letter[1:-1]
    codes = [one[letter], two[fine2] + np.uint32(1), three[fine3] + np.uint32(2)]
    mixed = [((c ^ (c >> np.uint32(16))) * np.uint32(2246822519)) >> np.uint32(32 - GRAM_BITS) for c in codes]
    owners = [owner[letter], owner[:-1][fine2], owner[:-2][fine3]]
    return np.concatenate(mixed), np.concatenate(owners)


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with their first place: so many that their number and the hash share 32 bits."""
    most = 1 << (32 - GRAM_BITS)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < most and (end == at or size + len(texts[end]) <= _GROUP):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows (text, lang), added up over all tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(names)):
                own = [t for t, n in zip(texts, names, strict=True) if n == lang]
                total = np.zeros(1 << GRAM_BITS, np.int64)
                for _, group in _groups(own):
                    codes = grams(group)[0]
                    if len(codes):
                        total += np.bincount(codes, minlength=1 << GRAM_BITS)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found])],
                    names=["lang", "gram", "n"],
                )

    sums = docs.mapInArrow(count, "lang string, gram int, n long")
    return sums.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> hashes of its ``size`` most frequent n-grams, most frequent first, ties to
    the smaller hash. Rows without text or language are left out."""
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = count_grams(known).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "rank").collect():  # languages x size rows
        lists.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(own)], np.int64) for lang, own in sorted(lists.items())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = list(profiles)
        self.size = size
        known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.place = np.full(1 << GRAM_BITS, len(known), np.int32)
        self.place[known] = np.arange(len(known))
        self.ranks = np.full((len(self.names), len(known) + 1), -1, np.int32)
        for i, own in enumerate(profiles.values()):
            self.ranks[i, self.place[own]] = np.arange(len(own))

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distance of every text to every language, and the length of the text's list."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        length = np.zeros(len(texts), np.int64)
        for at, group in _groups(texts):
            codes, owners = grams(group)
            if not len(codes):
                continue
            keys = np.sort(owners << np.uint32(GRAM_BITS) | codes)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[starts, len(keys)]).astype(np.uint64)
            keys = keys[starts].astype(np.uint64)
            # By text, then count from the largest, then hash.
            order = np.argsort(((keys >> np.uint64(GRAM_BITS)) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - counts), kind="stable")
            keys = keys[order].astype(np.int64)
            text = keys >> GRAM_BITS
            rank = np.arange(len(keys)) - np.searchsorted(text, np.arange(len(group)))[text]
            near = rank < self.size
            text, rank, place = text[near], rank[near], self.place[keys[near] & ((1 << GRAM_BITS) - 1)]
            length[at : at + len(group)] = np.bincount(text, minlength=len(group))
            for i in range(len(self.names)):
                own = self.ranks[i, place]
                off = np.where(own < 0, self.size, np.abs(own - rank))
                out[at : at + len(group), i] = np.bincount(text, weights=off, minlength=len(group)).astype(np.int64)
        return out, length


def identify(
    df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE
) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1: how near the text's list is to the
    profile, 1 for the same ranks).

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und``
    with score 0; equal distances go to the language whose name comes first. Rows are
    independent; an empty table gives an empty one; columns named like a result are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(Profiles(profiles, size))

    def run(column: pa.Array) -> dict[str, pa.Array]:
        known = sent.value
        distance, length = known.distances(["" if t is None else t for t in column.to_pylist()])
        if not known.names:
            return {"lang_pred": pa.array([UNKNOWN] * len(column)), "score": pa.array(np.zeros(len(column)))}
        best = distance.argmin(axis=1) if len(column) else np.zeros(0, np.int64)
        some = length > 0
        most = np.maximum(length, 1) * size
        score = np.where(some, 1 - distance[np.arange(len(best)), best] / most, 0.0)
        names = [known.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.clip(score, 0, 1))}

    return add_arrow(df, [text_col], "lang_pred string, score double", run)
