"""Best-fit packing of token pieces into sequences by bin completion, branch and bound.

Pieces are dealt by a hash into groups of about GROUP pieces; each group is packed on its own, so
a group wastes less than one sequence more than a packing of all pieces at once would. In a group
best-fit decreasing gives the first incumbent; if it has more sequences than a lower bound, bin
completion takes the largest piece left, tries the undominated fillings around it in order of waste,
each made only when the search comes to it, and drops a branch whose wasted room already rules out
fewer sequences. Sums of the sizes left, as bits, show which wastes can be had.

Cases: a null or empty text is one piece of the end id alone; rows that repeat, and rows with null or
repeated ids, are packed each for itself; pieces of one length are put in order of their ids and places;
a very long text is encoded whole by one task and gives as many pieces as it needs; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary, tokenizer_path
from .common import pieces, stored

#: Pieces that a group holds on average, and branch-and-bound steps spent on a group: so many, or so many
#: for each of its sequences, as one step makes one sequence.
GROUP, STEPS, DIVES = 4096, 2000, 4


class Ids(Vocabulary):
    """Ids of whole texts, equal to those of the tokenizers library; a compiled merge loop gives
    those of pre-tokens not met before."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        ranks = {token: i for token, i in self.id_of.items() if i not in self.special.values()}
        self.model = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        merge = self.model._core_bpe.encode_single_piece
        return {w: array("I", merge(w)).tobytes() for w in words}


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids and its end id: longer documents are cut into full pieces
    from their end on, so that only the first piece is shorter."""

    def rows(batches):
        own = ids_of(path)
        tail = np.array([end_id], np.uint32).tobytes()
        for batch in pieces(batches):
            keys, out = batch.column("doc_id").to_pylist(), []
            for k, ids in zip(keys, own.encode(batch.column("text")), strict=True):
                body = ids.tobytes() + tail
                n = len(body) // 4
                at, to, piece = 0, n % most or most, 0
                while at < n:
                    out.append((k, piece, at, to - at, zlib.crc32(body[4 * at : 4 * to])))
                    at, to, piece = to, to + most, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing over indices of sizes that are in descending order."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i, size in enumerate(sizes):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        if left > size:
            insort(free, (left - size, b))
    return bins


class Left:
    """Pieces not packed yet, by size, and the sums that the smallest sizes make."""

    def __init__(self, sizes: list[int], room: int):
        counted = Counter(sizes)
        self.sizes = sorted(counted)
        self.count = [counted[s] for s in self.sizes]
        self.pieces = len(sizes)
        self.there = sum(1 << s for s in self.sizes)  # a bit for each size that is left
        self.mask = (1 << room + 1) - 1
        self.made, self.good = [1] * (len(self.sizes) + 1), 0  # made[:good + 1] hold

    def change(self, i: int, by: int) -> None:
        self.count[i] += by
        self.pieces += by
        self.good = min(self.good, i)
        bit = 1 << self.sizes[i]
        self.there = self.there | bit if self.count[i] else self.there & ~bit

    def sums(self, n: int) -> int:
        """A bit for each sum that pieces of the n smallest sizes make."""
        while self.good < n:
            got, size, times, part = self.made[self.good], self.sizes[self.good], self.count[self.good], 1
            while times and got != self.mask:
                part = min(part, times)
                got |= got << part * size & self.mask
                times -= part
                part *= 2
            self.good += 1
            self.made[self.good] = got
        return self.made[n]

    def choices(self, total: int, n: int):
        """All ways to make total of the n smallest sizes as (size's place, times), those with larger pieces first."""
        if not total:
            yield []
            return
        for i in range(min(n, bisect_right(self.sizes, total)) - 1, -1, -1):
            if not self.sums(i + 1) >> total & 1:
                return
            for times in range(min(self.count[i], total // self.sizes[i]), 0, -1):
                rest = total - times * self.sizes[i]
                if self.sums(i) >> rest & 1:
                    for more in self.choices(rest, i):
                        yield [(i, times), *more]

    def fillings(self, room: int):
        """(waste, filling) of all fillings of the room, least waste first; None for a dominated one.
        What is left must be the same whenever the next one is asked for."""
        n = bisect_right(self.sizes, room)
        sums = self.sums(n) & (1 << room + 1) - 1
        while sums:
            total = sums.bit_length() - 1
            sums ^= 1 << total
            for chosen in self.choices(total, n):
                yield room - total, None if self.dominated(chosen, room - total) else chosen

    def dominated(self, chosen: list[tuple[int, int]], waste: int) -> bool:
        """Whether a piece left could be added, or take the place of a smaller one or of several that
        are no larger together. Any filling that dominates this one gives such a step: leave out the
        pieces that both hold, and swap in one of its others for those that it covers."""
        one = more = 0
        free = self.there
        for i, times in chosen:
            size = self.sizes[i]
            for _ in range(times):
                more |= (more | one) << size
                one |= 1 << size
            if times == self.count[i]:
                free &= ~(1 << size)
        return bool((spread(more, waste + 1) | spread((one | 1) << 1, waste)) & free)


def spread(bits: int, n: int) -> int:
    """Bits moved by 0 to n - 1 places, together."""
    done = 1
    while done < n:
        step = min(done, n - done)
        bits |= bits << step
        done += step
    return bits if n else 0


def least(sizes: list[int], room: int) -> int:
    """Sequences that any packing needs: by volume, and by volume beside pieces of over half the
    room (Martello and Toth): those that leave less than k hold nothing of k or more."""
    ordered = np.sort(np.array(sizes, np.int64))
    volume = np.concatenate([[0], ordered.cumsum()])
    place = lambda x: np.searchsorted(ordered, x, "right")
    k = np.unique(np.append(ordered[ordered <= room // 2], 0))
    half, alone, small = place(room // 2), place(room - k), np.searchsorted(ordered, k)
    over = volume[half] - volume[small] + volume[alone] - volume[half] - (alone - half) * room
    return int((len(ordered) - half + np.maximum(0, -(-over // room))).max(initial=0))


def pack(sizes: list[int], room: int = 2048, steps: int = STEPS) -> list[list[int]]:
    """Sequences as lists of indices of sizes. Best fit is the incumbent; bin completion looks for
    fewer sequences until the bound is met, no branch is left, or `steps` or DIVES times the
    sequences are spent, whichever is more."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ranked = [sizes[i] for i in order]
    incumbent = best_fit(ranked, room)
    total, bound = sum(ranked), least(ranked, room)
    if len(incumbent) > bound:
        left = Left(ranked, room)
        steps = max(steps, DIVES * len(incumbent))
        # a sequence of the branch: place of its largest size, its fillings, waste before it, its filling
        path: list[list] = []

        def begin(waste: int) -> None:
            largest = bisect_left(left.sizes, left.there.bit_length() - 1)
            left.change(largest, -1)
            path.append([largest, left.fillings(room - left.sizes[largest]), waste, []])

        begin(0)
        for _ in range(steps):
            if not path or len(incumbent) <= bound:
                break
            largest, options, waste, before = path[-1]
            for i, times in before:
                left.change(i, times)
            lost, chosen = next(options, (room, None))
            if total + waste + lost > (len(incumbent) - 1) * room:  # as do all later ones
                path.pop()
                left.change(largest, 1)
                continue
            path[-1][3] = chosen or []
            if chosen is None:
                continue
            for i, times in chosen:
                left.change(i, -times)
            if left.pieces:
                begin(waste + lost)
            else:
                incumbent = to_indices([[left.sizes[p[0]], *(left.sizes[i] for i, times in p[3] for _ in range(times))] for p in path], ranked)
    return [[order[i] for i in b] for b in incumbent]


def to_indices(bins: list[list[int]], ranked: list[int]) -> list[list[int]]:
    where: dict[int, list[int]] = {}
    for i in range(len(ranked) - 1, -1, -1):
        where.setdefault(ranked[i], []).append(i)
    return [[where[size].pop() for size in b] for b in bins]


def pack_documents(docs: DataFrame, path: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cuts = stored(cut(docs, path, most, end_id))
    groups = max(1, round(cuts.count() / GROUP))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        sizes = group["length"].tolist()
        full = sum(s >= most for s in sizes)
        for b, members in enumerate([[i] for i in range(full)] + [[i + full for i in m] for m in pack(sizes[full:], most)]):
            at = 0
            for i in members:
                sequence[i], offset[i] = b, at
                at += sizes[i]
        group["sequence_id"] = sequence + int(group["bin_group"].iloc[0]) * 2**32
        group["offset"] = offset
        return group.drop(columns="bin_group")

    grouped = cuts.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    return grouped.groupBy("bin_group").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
