"""Centroids of unit vectors: balanced fitting, and a neighbour graph that is searched in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a node to its nearest nodes, and to others anywhere.
NEAR_LINKS = 24
FAR_LINKS = 8
#: Nodes a search keeps.
BEAM = 64


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; rows are finite and not zero."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids whose lists are of similar length: a list pays for being longer than the mean."""
    random = np.random.default_rng(seed)
    centres = sample[random.permutation(len(sample))[:lists]].copy()
    price = np.zeros(len(centres))
    for _ in range(rounds):
        own = np.concatenate([
            (sample[at : at + 4096] @ centres.T - price).argmax(1) for at in range(0, len(sample), 4096)
        ])
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
        price += 0.02 * np.clip(sizes / max(1.0, sizes.mean()) - 1, -1, 2)
    return centres


@dataclass(frozen=True)
class Graph:
    """Centroids with links: each to its nearest and to some far ones, so any node is reached in few steps."""

    centres: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each query, and their cosines, nearest first.

        All queries walk together: each step expands every query's best node not expanded yet.
        """
        n, size = len(queries), len(self.centres)
        queries = queries.astype(np.float32)
        beam = min(beam, size)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, size), bool)
        start = self.entries[:beam]
        nodes = np.full((n, beam), -1)
        nodes[:, : len(start)] = start
        scores = np.full((n, beam), -np.inf, np.float32)
        scores[:, : len(start)] = queries @ self.centres[start].T
        seen[:, start] = True
        open_ = scores > -np.inf
        while True:
            best = np.where(open_, scores, -np.inf).argmax(1)
            active = open_[np.arange(n), best]
            if not active.any():
                order = np.argsort(-scores, axis=1, kind="stable")
                return nodes[rows, order], scores[rows, order]
            at = np.flatnonzero(active)
            open_[at, best[at]] = False
            near = self.links[nodes[at, best[at]]]
            fresh = ~seen[at[:, None], near]
            seen[at[:, None], near] = True
            found = np.where(fresh, np.einsum("qd,qld->ql", queries[at], self.centres[near]), -np.inf)
            every = np.concatenate([scores[at], found], 1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            pick = np.arange(len(at))[:, None]
            nodes[at] = np.concatenate([nodes[at], near], 1)[pick, top]
            open_[at] = np.concatenate([open_[at], fresh], 1)[pick, top]
            scores[at] = every[pick, top]


def graph(centres: np.ndarray, seed: int = 11) -> Graph:
    random = np.random.default_rng(seed)
    size = len(centres)
    near = min(NEAR_LINKS, size)
    links = np.concatenate([
        np.argpartition(-(centres[at : at + 1024] @ centres.T), near - 1, axis=1)[:, :near]
        for at in range(0, size, 1024)
    ])
    far = random.integers(0, size, (size, FAR_LINKS))
    return Graph(centres.astype(np.float32), np.concatenate([links, far], 1), random.permutation(size)[:16])
