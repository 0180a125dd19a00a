"""A navigable small-world graph over 1-bit min-hash signatures of word sets, in numpy.

Distances are Hamming distances of 256 bits, so ``1 - d / 128`` estimates the share of words in both texts; nodes of
different scopes are ``APART`` further from each other. Nodes are inserted in random order, in blocks that double until
they reach ``BLOCK``: each block searches the graph so far with a beam, links to its nearest nodes and to the nearest of
its own block, and these link back. Searches enter at nodes that share a band of min-hashes with the query and at a few
hubs. The beam is as wide as a search of the shard's own nodes needs to find what exhaustive search finds. A graph of
any size is searched this way.
"""

from __future__ import annotations

import numpy as np

BITS, BANDS, ROWS = 256, 16, 3
#: Signature distance up to which a pair is reranked: an estimate of 0.5, over four deviations from 0.7.
NEAR = 64
#: What nodes of different scopes are apart besides the distance of their signatures.
APART = 128
LINKS, LONG_LINKS, DEGREE = 10, 3, 22
BLOCK, INSERT_BEAM, WIDE = 256, 24, 6
BEAMS = (24, 48, 96, 192, 384)
#: The beam is tuned on pairs up to this distance (an estimate of 0.6 or more), among so many nodes of the shard.
TUNED, SAMPLE, RECALL = 51, 256, 0.99
FAR = 999

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BITS, dtype=np.uint64)


def signatures(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 bit signatures and (n, BANDS) uint32 band keys of word hashes; every row has a word."""
    sig = np.empty((len(starts), BITS // 64), np.uint64)
    mins = np.empty((len(starts), BITS), np.uint64)
    for k in range(BITS):
        h = words * _A[k] + _B[k]
        h ^= h >> np.uint64(29)
        mins[:, k] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), starts)
    bits = ((mins >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)
    sig[:] = np.packbits(bits, axis=1).view(np.uint64)
    m = mins[:, : BANDS * ROWS].reshape(len(starts), BANDS, ROWS)
    keys = m[:, :, 0] * np.uint64(3) + m[:, :, 1] * np.uint64(5) + m[:, :, 2] * np.uint64(7)
    keys ^= keys >> np.uint64(31)
    return sig, ((keys * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of ``a`` to all of ``b``."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a != b, np.int16(APART), np.int16(0))


class Graph:
    """``sig`` and ``bands`` of the nodes, and the number of the scope each belongs to. Nodes are numbered as given;
    inside, they stand in order of insertion."""

    def __init__(self, sig: np.ndarray, bands: np.ndarray, scope: np.ndarray | None = None, seed: int = 7):
        self.n = len(sig)
        scope = np.zeros(self.n, np.int32) if scope is None else scope.astype(np.int32)
        self.perm = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.sig, self.scope, self.bands = sig[self.perm], scope[self.perm], self._scoped(bands, scope)[self.perm]
        self.beam = BEAMS[0]
        self.links = np.full((self.n, DEGREE), -1, np.int32)
        self._index()
        self._build(seed)
        self._tune(seed)

    @staticmethod
    def _scoped(bands: np.ndarray, scope: np.ndarray) -> np.ndarray:
        """Band keys that only nodes of one scope share."""
        return bands ^ (scope.astype(np.uint32) * np.uint32(0x9E3779B1))[:, None]

    def _index(self) -> None:
        self.order = np.argsort(self.bands, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.bands, self.order, axis=0)

    # -- building --------------------------------------------------------------------------------------------------
    def _build(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        degree = np.zeros(self.n, np.int32)
        a = min(1, self.n)
        while a < self.n:
            rows = np.arange(a, min(self.n, a + min(a, BLOCK)))
            ids, d = self._search(self.sig[rows], self.scope[rows], self._entries(self.bands[rows], a), INSERT_BEAM, a)
            # what the block's own nodes are to each other, as they cannot find each other in the graph yet
            inside = distances(self.sig[rows], self.sig[rows]) + _apart(self.scope[rows][:, None], self.scope[rows][None, :])
            inside[np.arange(len(rows)), np.arange(len(rows))] = FAR
            k = min(LINKS, len(rows) - 1)
            if k > 0:
                mates = np.argpartition(inside, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, mates + a], axis=1)
                d = np.concatenate([d, np.take_along_axis(inside, mates, axis=1)], axis=1)
            best = np.argsort(d, axis=1, kind="stable")[:, :LINKS]
            near = np.where(np.take_along_axis(d, best, axis=1) < FAR, np.take_along_axis(ids, best, axis=1), -1)
            self.links[rows, : near.shape[1]] = near
            self.links[rows, LINKS : LINKS + LONG_LINKS] = rng.integers(0, a, (len(rows), LONG_LINKS))
            degree[rows] = LINKS + LONG_LINKS
            # links back, as far as a node has room
            u, v = np.repeat(rows, near.shape[1]), near.ravel()
            u, v = u[v >= 0], v[v >= 0]
            o = np.argsort(v, kind="stable")
            u, v = u[o], v[o]
            new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
            at = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
            slot = degree[v] + at
            ok = slot < DEGREE
            self.links[v[ok], slot[ok]] = u[ok]
            np.add.at(degree, v[ok], 1)
            a = int(rows[-1]) + 1

    def _tune(self, seed: int) -> None:
        """Widens the beam until the shard's own nodes find what exhaustive search finds."""
        rows = np.random.default_rng(seed + 1).permutation(self.n)[:SAMPLE]
        true = distances(self.sig[rows], self.sig) + _apart(self.scope[rows][:, None], self.scope[None, :]) <= TUNED
        for self.beam in BEAMS:
            ids, d = self._search(self.sig[rows], self.scope[rows], self._entries(self.bands[rows], self.n), self.beam, self.n)
            hit = sum(int(true[i, x[y <= TUNED]].sum()) for i, (x, y) in enumerate(zip(ids, d)))
            if hit >= RECALL * true.sum():
                break

    # -- searching -------------------------------------------------------------------------------------------------
    def _entries(self, bands: np.ndarray, below: int) -> np.ndarray:
        """Hubs (the first nodes) and two nodes for each band of the query, as far as they are below ``below``."""
        hubs = np.arange(min(8, below), dtype=np.int32)
        out = [np.broadcast_to(hubs, (len(bands), len(hubs)))]
        for k in range(bands.shape[1]):
            at = np.searchsorted(self.sorted[:, k], bands[:, k])
            for step in (0, 1):
                i = np.minimum(at + step, self.n - 1)
                node = self.order[i, k]
                out.append(np.where((self.sorted[i, k] == bands[:, k]) & (node < below), node, -1)[:, None])
        return np.concatenate(out, axis=1)

    def _search(self, q: np.ndarray, scope: np.ndarray, entries: np.ndarray, beam: int, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, distances) of all queries; nodes from ``below`` on are not there yet."""
        n, b = self.n, len(q)
        ids, d = np.full((b, beam), n, np.int32), np.full((b, beam), FAR, np.int16)
        done = np.ones((b, beam), bool)
        for lo in range(0, b, BLOCK):
            rows = np.arange(lo, min(b, lo + BLOCK))
            seen = np.zeros((len(rows), n + 1), bool)
            self._add(q, scope, rows, rows - lo, entries[rows], seen, ids, d, done, below)
            live = rows
            while len(live):
                open_d = np.where(done[live], FAR, d[live])
                pick = np.argpartition(open_d, min(WIDE, beam - 1), axis=1)[:, :WIDE]
                usable = np.take_along_axis(open_d, pick, axis=1) < FAR
                keep = usable.any(axis=1)
                live, pick, usable = live[keep], pick[keep], usable[keep]
                if not len(live):
                    break
                done[live[:, None], pick] = True
                from_ = np.where(usable, ids[live[:, None], pick], n)
                cands = np.where((from_ < n)[:, :, None], self.links[np.minimum(from_, n - 1)], -1).reshape(len(live), -1)
                self._add(q, scope, live, live - lo, cands, seen, ids, d, done, below)
        return ids, d

    def _add(self, q, scope, rows, local, cands, seen, ids, d, done, below) -> None:
        ok = (cands >= 0) & (cands < below)
        r, c = np.nonzero(ok & ~seen[local[:, None], np.where(ok, cands, self.n)])
        if not len(r):
            return
        # each (query, node) once: the last writer of a cell keeps it
        node = cands[r, c].astype(np.int64)
        key = local[r] * np.int64(self.n + 1) + node
        key, first = np.unique(key, return_index=True)
        r, node = r[first], node[first]
        seen[local[r], node] = True
        dist = np.bitwise_count(self.sig[node] ^ q[rows[r]]).sum(axis=1).astype(np.int16) + _apart(self.scope[node], scope[rows[r]])
        # what is further than the whole beam never enters it
        worst = d[rows].max(axis=1)
        fit = dist < worst[r]
        r, node, dist = r[fit], node[fit], dist[fit]
        if not len(r):
            return
        width = int(np.bincount(r).max())
        at = np.arange(len(r)) - np.searchsorted(r, r)
        new_ids, new_d = np.full((len(rows), width), self.n, np.int32), np.full((len(rows), width), FAR, np.int16)
        new_ids[r, at], new_d[r, at] = node, dist
        all_ids, all_d = np.concatenate([ids[rows], new_ids], axis=1), np.concatenate([d[rows], new_d], axis=1)
        all_done = np.concatenate([done[rows], new_d >= FAR], axis=1)
        best = np.argpartition(all_d, d.shape[1] - 1, axis=1)[:, : d.shape[1]]
        for whole, part in ((ids, all_ids), (d, all_d), (done, all_done)):
            whole[rows] = np.take_along_axis(part, best, axis=1)

    def near(self, sig: np.ndarray, bands: np.ndarray, scope: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs within ``NEAR``; a beam full of them is widened until it is not.

        ``scope`` numbers the queries' scopes as those of the nodes; -1 is none of them.
        """
        scope = np.zeros(len(sig), np.int32) if scope is None else scope.astype(np.int32)
        bands = self._scoped(bands, scope)
        todo, beam, out = np.arange(len(sig)) if self.n else np.zeros(0, int), self.beam, []
        while len(todo):
            beam = min(beam, self.n)
            ids, d = self._search(sig[todo], scope[todo], self._entries(bands[todo], self.n), beam, self.n)
            full = (d <= NEAR).all(axis=1) & (beam < self.n)
            i, j = np.nonzero((d <= NEAR) & ~full[:, None])
            out.append((todo[i], self.perm[ids[i, j]]))
            todo, beam = todo[full], beam * 4
        return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (np.zeros(0, int), np.zeros(0, int))

    def state(self) -> tuple:
        return self.sig, self.scope, self.bands, self.links, self.perm, self.beam

    @classmethod
    def of(cls, state: tuple) -> Graph:
        g = cls.__new__(cls)
        g.sig, g.scope, g.bands, g.links, g.perm, g.beam = state
        g.n = len(g.sig)
        g._index()
        return g
