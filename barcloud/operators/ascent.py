"""The density ascent over the arrays of a block of read pairs: the half-steps of ``density``, for all reads of the block at once.

Loads of bins come from outside, a list for each half-step; half-steps are done again from the scores in every pass.  Only reads with several candidates
in a cloud move, so the candidates that may be chosen are laid out by read and cloud once, of equal worth the first first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from barcloud.config import (
    DENSITY_BIN, DENSITY_MIN_RECORDS, DENSITY_SCORE_SCALE, INSERT_MAX, SPLIT_EXTRA_SEARCH_DEPTH, Platform,
)
from barcloud.operators.blocks import NONE, changes, flags, groups, numbers, reals


def log_density(n: np.ndarray, platform: Platform) -> np.ndarray:
    """``functions.alignment.log_density`` of whole numbers."""
    probs = platform.density_probs
    table = np.array([math.log(p) for p in probs])
    beyond = math.log(probs[-1]) - (n - (len(probs) - 1)) * math.log(2.0)
    return np.where(n < len(probs), table[np.clip(n, 0, len(probs) - 1)], beyond)


class Ascent:
    """One block."""

    def __init__(self, data: pa.RecordBatch):
        column = data.column
        self.data, self.n = data, len(data)
        self.pair = np.concatenate([[0], np.cumsum(changes(column("bc")) | changes(column("ident")))]).astype(np.int64)
        self.mate = (numbers(column("mate")) != 0).astype(np.int64)
        self.pos, self.rank, self.edits = numbers(column("pos")), numbers(column("bwa_rank")), numbers(column("clip_edit_dist"))
        self.rev, self.active = flags(column("rev")).astype(np.int64), flags(column("active"))
        self.parity, self.score = numbers(column("_parity")), reals(column("score"))
        bc, chrom, cloud = (numbers(column(c)) for c in ("bc", "chrom", "cloud"))
        self.known = (chrom != NONE) & (cloud != NONE)
        number, firsts = groups(~self.known, bc, chrom, cloud)
        self.clouds = firsts[self.known[firsts]]
        self.slot = np.minimum(number, len(self.clouds))
        self.of, firsts = groups(number, self.pair, self.mate)  # reads of clouds
        self.reads = len(firsts)

    def names(self, block: int) -> dict:
        rows = pa.array(self.clouds)
        return {"block": np.full(len(rows), block), "slot": np.arange(len(rows)), **{c: self.data.column(c).take(rows) for c in ("bc", "chrom", "cloud")}}

    def _of_clouds(self, ufunc, values: np.ndarray, none: int) -> np.ndarray:
        found = np.full(len(self.clouds) + 1, none, np.int64)
        ufunc.at(found, self.slot, values)
        return found[:-1]

    def collisions(self, block: int) -> dict:
        """Records of each cloud, and whether a read occurs in it twice."""
        copies = np.bincount(self.of, minlength=self.reads)[self.of]
        return {**self.names(block), "records": self._of_clouds(np.add, np.ones(self.n, np.int64), 0),
                "colliding": self._of_clouds(np.maximum, (copies > 1).astype(np.int64), 0) > 0}

    def cut(self, state: pa.StructScalar | None) -> None:
        """Leaves out hopeless repeats, from the facts of :meth:`collisions` of all blocks."""
        told = lambda name: np.append(np.array(state[name].as_py() if state else [], np.int64), 0)
        self.eligible = (told("colliding") > 0) & (told("records") >= DENSITY_MIN_RECORDS)
        least = np.full(self.reads, np.iinfo(np.int64).max)
        np.minimum.at(least, self.of, np.where(self.edits == NONE, np.iinfo(np.int64).max, self.edits))
        worse = self.edits - SPLIT_EXTRA_SEARCH_DEPTH > least[self.of]
        # whether a candidate without a cloud would be left out is not known
        self.unknown = self.active & ~self.known & worse
        self.active = self.active & ~(self.eligible[self.slot] & worse)

    def choices(self, block: int, state: pa.StructScalar | None) -> dict:
        """What the cut leaves of each cloud: its first position, its records, the most of one read."""
        kept = self.active & (self.pos != NONE)
        choices = np.bincount(self.of[kept], minlength=self.reads)[self.of]
        most = np.iinfo(np.int64).max
        low = self._of_clouds(np.minimum, np.where(kept, self.pos, most), most)
        return {**self.names(block), "lo": pa.array(low, mask=low == most), "left": self._of_clouds(np.add, kept.astype(np.int64), 0),
                "most": self._of_clouds(np.maximum, choices, 0), **{name: state[name].values if state else [] for name in ("records", "colliding")}}

    def lay(self, state: pa.StructScalar | None, platform: Platform) -> None:
        """The candidates to choose from by read, with the first choice, from the facts of :meth:`choices` of all blocks."""
        told = lambda name: np.append(np.array([NONE if v is None else v for v in state[name].as_py()] if state else [], np.int64), 0)
        anneal = self.eligible & (told("left") >= DENSITY_MIN_RECORDS) & (told("most") > 1)
        self.ours = np.flatnonzero(anneal[self.slot] & self.active & self.known)
        order = np.lexsort((self.rank[self.ours], self.pos[self.ours], self.of[self.ours]))
        self.ours = rows = self.ours[order]
        there = self.of[rows]
        self.starts = np.flatnonzero(np.diff(there, prepend=-1))
        self.read = np.cumsum(np.diff(there, prepend=-1) != 0) - 1
        self.platform = platform
        # the other mate of the read in the cloud, or a read beyond
        cloud, pair, mate = self.slot[rows], self.pair[rows], self.mate[rows]
        of_pair = (cloud * (int(self.pair.max(initial=0)) + 1) + pair)[self.starts]
        self.other = np.full(len(self.starts) + 1, len(self.starts))
        near = np.flatnonzero(of_pair[1:] == of_pair[:-1])
        self.other[near], self.other[near + 1] = near + 1, near
        place = np.diff(self.pos[rows], prepend=0) | np.diff(self.rank[rows], prepend=0) | np.diff(there, prepend=-1)
        self.place = np.cumsum(place != 0)  # equal for equal candidates
        self.bin = (self.pos[rows] - told("lo")[cloud]) // DENSITY_BIN
        self.cell, self.cells = groups(cloud, self.bin)
        self.chosen = self._greatest(np.floor(self.score[rows] * 1e9 + 0.5).astype(np.int64))

    def _greatest(self, worth: np.ndarray) -> np.ndarray:
        """The first row of greatest worth of each read, and those equal to it."""
        if not len(worth):
            return np.zeros(0, bool)
        best = worth == np.maximum.reduceat(worth, self.starts)[self.read]
        first = np.minimum.reduceat(np.where(best, self.place, np.iinfo(np.int64).max), self.starts)[self.read]
        return best & (self.place == first)

    def _chosen(self, values: np.ndarray) -> np.ndarray:
        """The greatest value of the chosen rows of each read."""
        found = np.full(len(self.starts) + 1, NONE)
        if len(self.starts):
            found[:-1] = np.maximum.reduceat(np.where(self.chosen, values, NONE), self.starts)
        return found

    def climb(self, loads: list[np.ndarray]) -> None:
        """As many half-steps as there are loads, the two halves of the reads in turn."""
        rows = self.ours
        pos, rev, mate, parity, score = self.pos[rows], self.rev[rows], self.mate[rows], self.parity[rows], self.score[rows]
        several = np.diff(np.append(self.starts, len(rows)))[self.read] > 1 if len(rows) else np.zeros(0, bool)
        for step, load in enumerate(loads):
            moving = several & (parity != NONE) & ((parity + mate) % 2 == step % 2)
            own = self._chosen(self.bin)[self.read]
            found = self._chosen(pos * 2 + rev)[self.other[self.read]]
            gap = np.where(rev == 1, pos - (found >> 1), (found >> 1) - pos)
            paired = (found != NONE) & (rev != found & 1) & (gap >= 0) & (gap <= INSERT_MAX)
            others = load[self.cell] - (self.bin == own)
            value = score / DENSITY_SCORE_SCALE + log_density(others + 1, self.platform) - log_density(others, self.platform)
            worth = np.floor(value * 1e9 + 0.5).astype(np.int64)
            best = self._greatest((paired.astype(np.int64) << 60) + worth * 2 + self.chosen)
            self.chosen = np.where(moving, best, self.chosen)

    def loads(self, block: int, past: pa.Array | None) -> dict:
        """Chosen candidates of each bin that a candidate of the block lies in."""
        rows = pa.array(self.ours[self.cells])
        n = len(self.cells)
        return {"block": np.full(n, block), "slot": np.arange(n), **{c: self.data.column(c).take(rows) for c in ("bc", "chrom", "cloud")},
                "bin": self.bin[self.cells], "load": np.bincount(self.cell[self.chosen], minlength=n),
                "loads": pa.nulls(n, pa.list_(pa.int64())) if past is None else past}

    def result(self) -> pa.Array:
        active = self.active.copy()
        active[self.ours] = self.chosen
        return pa.array(active, mask=self.unknown)
