"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text's lattice has an edge for every vocabulary piece at every position (byte
pieces for characters outside the vocabulary); a segmentation has the probability
proportional to exp(alpha * sum of its pieces' scores). ``samples`` distinct
segmentations of each whole text are drawn by Gumbel top-k: each segmentation's
log-probability is perturbed by Gumbel noise and the largest come out in order.

The search is A* over regions. A region holds all segmentations that leave a path
already taken, at any of its choices. Its key is the maximum of its perturbed leaves,
which its exact mass gives without visiting them (a Gumbel of that mass, cut off at
the last sample's key), so the region taken from the queue always holds the next
sample. Taking one means: choose where the new path leaves the old one by mass, choose
the piece there, draw the rest from the lattice, and queue what is left of the region
and the region of the new path. Choices are in reading order; only as many of them
are looked at as hold mass that a double can tell from none.

Texts are cut at characters which stand side by side in no vocabulary piece: no piece
crosses such a place, so the cuts' lattices are independent, and a worker keeps those
of parts met before (recognised by 64-bit hashes), in arrays of bounded size.

Random numbers are hashes of (seed, row key, sample, part, step): a row's samples
don't depend on partitions, batches or retries. ``log_inclusion`` is the log of the
probability that a segmentation enters the sample given the next key below it
(Horvitz-Thompson weights; 0 if all segmentations were drawn).

Null and empty texts have one empty segmentation. Rows with the same key and text
have the same samples. A null key counts as an empty key. A text that holds U+2581
decodes to a space there. Extra columns are ignored; an empty table gives no rows. A
text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
MOST_EDGES = 4_000_000  # of the lattices that a worker keeps: 32 bytes each
CHUNK = 400_000  # characters whose samples are drawn together
UNUSED = -1e8  # pieces of a lower score count as characters outside the vocabulary do
AHEAD = 512  # choices of a path that are looked at first
NEGLIGIBLE = 1e-18
BASE = np.uint64(0x100000001B3)
FIELDS = "best array<int>, samples array<struct<rank:int,ids:array<int>,log_prob:double,perturbed:double,log_inclusion:double>>"


def spread(z: np.ndarray) -> np.ndarray:
    """Whole numbers, mixed."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(seed: np.ndarray, n) -> np.ndarray:
    """Numbers in (0, 1) from mixed seeds and whole numbers."""
    with np.errstate(over="ignore"):
        z = seed + (np.asarray(n).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread(z) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        scores = np.array([self.model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.byte = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        lowest = min(scores[i] for i in plain if scores[i] > UNUSED) - 10
        scores = np.maximum(scores, lowest)
        self.outside = alpha * lowest
        known: dict[int, dict[int, int]] = {}  # by length: prefixes' hashes with the piece that ends there, or -1
        for i in plain:
            h = 0
            for k, c in enumerate(pieces[i], 1):
                h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
                known.setdefault(k, {}).setdefault(h, -1)
            known[len(pieces[i])][h] = i
        self.weight = alpha * scores
        self.known = {k: (np.array(hs := sorted(v), np.uint64), np.array([v[h] for h in hs], np.int64)) for k, v in known.items()}
        singles = np.full(0x110000, -1, np.int64)
        for i in plain:
            if len(pieces[i]) == 1:
                singles[ord(pieces[i])] = i
        self.singles = singles
        # characters that stand side by side in a piece
        inside = sorted({c for i in plain if len(pieces[i]) > 1 for c in pieces[i]})
        self.group = np.zeros(0x110000, np.int16)
        self.group[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for i in plain:
            own = self.group[[ord(c) for c in pieces[i]]]
            self.joined[own[:-1], own[1:]] = True
        self.mark = next(c for c in map(chr, range(1, 32)) if not self.group[ord(c)] and len(self.model.encode(c + "a")) > len(self.model.encode(c)))
        self.mark_n = len(self.model.encode(self.mark))
        self.raw = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.encode() for i, p in enumerate(pieces)]
        self.raw_n = np.array([len(r) for r in self.raw], np.int64)
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.store = Store(self)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def parts_of(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' characters one after the other (a space before each, as the model puts one), the
    starts of the parts that no piece crosses and their end, and each text's first part and their end."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    joined = "".join(SPACE + t.replace(" ", SPACE) for t in texts if t)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    group = vocabulary.group[chars]
    cut = np.ones(len(chars) + 1, bool)
    if len(chars):
        cut[1:-1] = ~vocabulary.joined[group[:-1], group[1:]]
    ends = np.cumsum(sizes)
    cut[ends] = True
    starts = np.flatnonzero(cut)
    return chars, starts, np.searchsorted(starts, np.concatenate([[0], ends]))


def hashes(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each part, of its characters and their places."""
    if len(starts) < 2:
        return np.empty(0, np.uint64)
    place = np.arange(len(chars)) - np.repeat(starts[:-1], np.diff(starts))
    return np.add.reduceat(spread((place.astype(np.uint64) << np.uint64(21)) + chars + np.uint64(1)), starts[:-1])


class Lattices:
    """The lattices of parts side by side. A part of n characters has n + 1 nodes; edges are sorted by node.

    piece >= 0 is a vocabulary id, -1 - c the bytes of character c.
    """

    def __init__(self, chars: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> None:
        self.first = np.cumsum(sizes + 1) - (sizes + 1)
        self.last = self.first + sizes
        total = int(sizes.sum() + len(sizes))
        inside = np.ones(total, bool)
        inside[self.last] = False
        at_node = np.zeros(total, np.uint64)
        at_node[inside] = chars
        left = np.repeat(self.last, sizes + 1) - np.arange(total)  # characters from a node to its part's end
        own, h = np.flatnonzero(inside), np.zeros(int(inside.sum()), np.uint64)
        starts, ends, pieces, weights = [], [], [], []
        for k in range(1, len(vocabulary.known) + 1):
            h = h * BASE + at_node[own + k - 1] + np.uint64(1)
            if k == 1:
                c = at_node[own].astype(np.int64)
                ids = vocabulary.singles[c]
                w = np.where(ids < 0, vocabulary.outside, vocabulary.weight[ids])
                alive = left[own] > 1
                ids = np.where(ids < 0, np.where(c < 128, vocabulary.byte[np.minimum(c, 127)], -1 - c), ids)
                good = slice(None)
            else:
                found, which = vocabulary.known[k]
                at = np.minimum(np.searchsorted(found, h), len(found) - 1)
                prefix = found[at] == h
                own, h, ids = own[prefix], h[prefix], which[at[prefix]]
                good, w, alive = ids >= 0, vocabulary.weight[ids], left[own] > k
            starts.append(own[good])
            ends.append(own[good] + k)
            pieces.append(ids[good])
            weights.append(w[good])
            own, h = own[alive], h[alive]
        # edges go to their nodes' places, a node's longest first: those are its likeliest
        many = np.zeros(total + 1, np.int64)
        for own in starts:
            many[own + 1] += 1
        self.row = np.cumsum(many)  # edges of node v: row[v] .. row[v + 1]
        free = self.row[:-1].copy()
        edges = int(self.row[-1])
        start, self.end, self.piece, weight = (np.empty(edges, kind) for kind in (np.int64, np.int64, np.int64, float))
        for own, end, piece, w in zip(reversed(starts), reversed(ends), reversed(pieces), reversed(weights), strict=True):
            at = free[own]
            start[at], self.end[at], self.piece[at], weight[at] = own, end, piece, w
            free[own] += 1
        self.beta = self._completions(weight, left, total)
        self.log_p = np.minimum(weight + self.beta[self.end] - self.beta[start], 0.0)
        p = np.exp(self.log_p)
        self.below = p.copy()  # p summed up to an edge within its node, so that neighbours don't matter
        place = np.arange(edges) - self.row[start]
        for k in range(1, int(place.max(initial=0)) + 1):
            at = np.flatnonzero(place == k)
            self.below[at] += self.below[at - 1]
        # log of the mass of a node's other edges; summed apart for its likeliest edge, where 1 - p would cancel
        n = many[1:][many[1:] > 0]
        begin = self.row[:-1][many[1:] > 0]
        if edges:
            top = p == np.repeat(np.maximum.reduceat(p, begin), n)
            top &= np.concatenate([[True], (start[1:] != start[:-1]) | ~top[:-1]])
            rest = np.repeat(np.add.reduceat(np.where(top, 0.0, p), begin), n)
        else:
            top, rest = p > 2, p
        with np.errstate(divide="ignore"):
            self.log_others = np.log(np.where(top, rest, np.maximum(1 - p, 0.0)))

    def _completions(self, weight: np.ndarray, left: np.ndarray, total: int) -> np.ndarray:
        """Log of the summed weight of all ways from a node to its part's end, for nodes ever farther from it."""
        beta = np.zeros(total)
        nodes = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[nodes], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            v = nodes[a:b]
            n = self.row[v + 1] - self.row[v]
            at = np.cumsum(n) - n
            e = np.repeat(self.row[v] - at, n) + np.arange(int(n.sum()))
            x = weight[e] + beta[self.end[e]]
            top = np.maximum.reduceat(x, at)
            beta[v] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), at))
        return beta


class Grown:
    """An array that grows by doubling."""

    def __init__(self, kind, *start) -> None:
        self.room, self.n = np.array(start, kind), len(start)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.n + len(more)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Store:
    """Lattices and best encodings of the parts met so far, side by side; emptied when there are MOST_EDGES."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.hashes, self.kinds = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by hash
        self.end, self.piece, self.log_p, self.below, self.log_others = map(Grown, (np.int32, np.int32, float, float, float))
        self.row, self.first, self.last, self.best, self.best_at = Grown(np.int64, 0), Grown(np.int64), Grown(np.int64), Grown(np.int32), Grown(np.int64, 0)

    def of(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The parts' numbers, new parts added."""
        if self.end.n > MOST_EDGES:
            self.clear()
        every, place, inverse = np.unique(hashes(chars, starts), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, every)
        new = np.ones(len(every), bool)
        in_range = at < len(self.hashes)
        new[in_range] = self.hashes[at[in_range]] != every[in_range]
        if new.any():
            n = len(self.hashes)
            own = place[new]
            self._add(chars, starts[own], starts[own + 1] - starts[own])
            self.hashes, self.kinds = np.insert(self.hashes, at[new], every[new]), np.insert(self.kinds, at[new], n + np.arange(int(new.sum())))
            at = np.searchsorted(self.hashes, every)
        return self.kinds[at][inverse]

    def _add(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        own = chars[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        lat = Lattices(own, sizes, self.vocabulary)
        nodes, edges = self.row.n - 1, self.end.n
        self.end.add(lat.end + nodes)
        self.first.add(lat.first + nodes)
        self.last.add(lat.last + nodes)
        self.row.add(lat.row[1:] + edges)
        for name in ("piece", "log_p", "below", "log_others"):
            getattr(self, name).add(getattr(lat, name))
        text = own.tobytes().decode("utf-32-le", "surrogatepass")
        v = self.vocabulary
        words = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        # the model puts a space before a text: one that begins with it is given without, others behind a mark that no piece holds
        found = v.model.encode([(w[1:] if w[0] == SPACE else v.mark + w).replace(SPACE, " ") for w in words], num_threads=1)
        lone = [v.model.piece_to_id(SPACE)]
        best = [(b or lone) if w[0] == SPACE else b[v.mark_n :] for w, b in zip(words, found, strict=True)]
        n = np.fromiter(map(len, best), np.int64, len(best))
        self.best_at.add(self.best_at.room[self.best_at.n - 1] + np.cumsum(n))
        self.best.add(np.fromiter(chain.from_iterable(best), np.int32, int(n.sum())))

    def best_of(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ids of the parts one after the other, and where each part's end."""
        begin = self.best_at.room[kind]
        n = self.best_at.room[kind + 1] - begin
        ends = np.cumsum(n)
        return self.best.room[np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))], ends

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        row, below = self.row.room, self.below.room
        e, last = row[node], row[node + 1] - 1
        ahead = np.flatnonzero((u > below[e]) & (e < last))
        while len(ahead):  # nodes have few edges
            e[ahead] += 1
            ahead = ahead[(u[ahead] > below[e[ahead]]) & (e[ahead] < last[ahead])]
        return e

    def others(self, edge: int, gone: list[int]) -> tuple[list[int], np.ndarray]:
        """The edges beside one that are not gone, and their probabilities."""
        v = int(self.row.room[: self.row.n].searchsorted(edge, "right")) - 1
        a, b = self.row.room[v : v + 2].tolist()
        own = [e for e in range(a, b) if e != edge and e not in gone]
        return own, np.exp(self.log_p.room[own])


def truncated(location: float, bound: float, u: float) -> float:
    """A Gumbel variable of a location, given that it is at most bound."""
    if location == -np.inf:
        return -np.inf
    return location - math.log(math.exp(min(max(location - bound, -700.0), 700.0)) - math.log(u))


@dataclass
class Path:
    """A sample of each text: edges in reading order, where each text's begin, and where each part's begin."""

    edge: np.ndarray
    at: np.ndarray
    part_at: np.ndarray


@dataclass
class Region:
    """Segmentations that leave a text's path at its choice ``begin`` or later, without those gone at a choice."""

    path: int
    begin: int
    start: float  # log-probability of the path's choices before begin
    gone: dict[int, list[int]] = field(default_factory=dict)
    key: float = -np.inf
    masses: np.ndarray = field(default_factory=lambda: np.empty(0))  # of its choices relative to start, as far as looked at
    beyond: float = 1.0  # what is left of the path's own mass there; 0 at its end

    def log_mass(self, lat: Store, own: np.ndarray) -> float:
        """Log of the region's mass; looks at more choices while those beyond may matter."""
        while self.beyond > NEGLIGIBLE * (total := float(self.masses.sum())):
            part = own[self.begin : self.begin + max(AHEAD, 8 * len(self.masses))]
            if not len(part):
                self.beyond = 0.0
                continue
            p = lat.log_p.room[part]
            reach = p.cumsum()
            self.masses = np.exp(lat.log_others.room[part] + (reach - p))
            self.beyond = float(np.exp(reach[-1])) if self.begin + len(part) < len(own) else 0.0
            for j, gone in self.gone.items():
                at = j - self.begin
                self.masses[at] = lat.others(int(own[j]), gone)[1].sum() * np.exp(reach[at] - p[at])
        return self.start + float(np.log(total)) if total > 0 else -np.inf

    def left_at(self, j: int, edge: int, share: float) -> None:
        """The part that leaves the path at j by the edge is gone; what else leaves there keeps the share."""
        self.gone.setdefault(j, []).append(edge)
        self.masses[j - self.begin] *= share


@dataclass
class Drawn:
    """A text's best encoding and its samples: (ids, log-probability, perturbed, log of the inclusion probability)."""

    best: np.ndarray
    samples: list[tuple[np.ndarray, float, float, float]]


def sample(texts: list[str], keys: list[int], vocabulary: Vocabulary, samples: int) -> list[Drawn]:
    """For each text its best encoding and its sampled segmentations, best key first."""
    docs = len(texts)
    chars, starts, first = parts_of(texts, vocabulary)
    none = np.empty(0, np.int32)
    sizes = np.diff(first)
    out = [Drawn(none, [] if n else [(none, 0.0, 0.0, 0.0)]) for n in sizes]
    if not sizes.any():
        return out
    lat = vocabulary.store
    kind = lat.of(chars, starts)
    doc = np.repeat(np.arange(docs), sizes)
    local = (np.arange(len(kind)) - first[doc]).astype(np.uint64) << np.uint64(32)
    begin, final = lat.first.room[kind], lat.last.room[kind]
    key = spread(np.array(keys, np.uint64))
    live = np.flatnonzero(sizes).tolist()
    paths: list[Path] = []
    regions: list[list[Region]] = [[] for _ in texts]
    below = np.full(docs, -np.inf)  # the key that comes after a text's samples
    for rank in range(samples):
        with np.errstate(over="ignore"):
            seed = spread(key + np.uint64(rank + 1) * np.uint64(0xD6E8FEB86659FD93))
        fresh = uniform(seed, np.uint64(1 << 63))
        bound = -np.log(-np.log(fresh))  # of the first sample: the largest of all, whose mass is 1
        node, step = final.copy(), np.zeros(len(kind), np.int64)
        count = np.zeros(len(kind), np.int64)
        heads: dict[int, tuple[Region, int, int, float]] = {}  # by text: region taken, choice, edge, log-probability up to it
        for d in list(live):
            if not rank:
                node[first[d] : first[d + 1]] = begin[first[d] : first[d + 1]]
                continue
            region = max(regions[d], key=lambda r: r.key)
            if region.key == -np.inf:  # every segmentation has been drawn
                live.remove(d)
                continue
            bound[d] = region.key
            parent = paths[region.path]
            a = int(parent.at[d])
            own = parent.edge[a : int(parent.at[d + 1])]
            u = uniform(seed[d], np.arange(1, 4, dtype=np.uint64) << np.uint64(60))
            mass = region.masses.cumsum()
            j = region.begin + min(int(mass.searchsorted(u[0] * mass[-1])), len(mass) - 1)
            options, p = lat.others(int(own[j]), region.gone.get(j, []))
            upto = p.cumsum()
            k = min(int(upto.searchsorted(u[1] * upto[-1])), len(options) - 1)
            before = region.start + float(lat.log_p.room[own[region.begin : j]].sum())
            heads[d] = (region, j, options[k], before + float(lat.log_p.room[options[k]]))
            region.left_at(j, options[k], float((upto[k - 1] if k else 0.0) + p[k + 1 :].sum()) / float(upto[-1]))
            region.key = truncated(region.log_mass(lat, own), bound[d], float(u[2]))
            part_at = parent.part_at[first[d] : first[d + 1] + 1]
            w = int(np.searchsorted(part_at, a + j, "right")) - 1
            w0 = int(first[d]) + w
            count[first[d] : w0] = np.diff(part_at[: w + 1])
            step[w0] = a + j - int(part_at[w]) + 1
            node[w0 : first[d + 1]] = begin[w0 : first[d + 1]]
            node[w0] = lat.end.room[options[k]]
        count += step
        # the rest of every part is drawn from its node
        moves = []
        open_parts = np.flatnonzero(node != final)
        while len(open_parts):
            at = doc[open_parts]
            e = lat.pick(node[open_parts], uniform(seed[at], local[open_parts] + step[open_parts].astype(np.uint64)))
            moves.append((open_parts, step[open_parts], e))
            node[open_parts] = lat.end.room[e]
            step[open_parts] += 1
            count[open_parts] += 1
            open_parts = open_parts[node[open_parts] != final[open_parts]]
        part_at = np.concatenate([[0], np.cumsum(count)])
        edge = np.empty(int(part_at[-1]), np.int32)
        for own, s, e in moves:
            edge[part_at[own] + s] = e
        path = Path(edge, part_at[first], part_at)
        for d, (region, j, e, _) in heads.items():
            parent, a, b = paths[region.path], int(path.at[d]), int(paths[region.path].at[d])
            edge[a : a + j] = parent.edge[b : b + j]
            edge[a + j] = e
        paths.append(path)
        piece = lat.piece.room[edge]
        outside = np.searchsorted(np.flatnonzero(piece < 0), path.at)
        filled = np.flatnonzero(np.diff(path.at))
        total = np.zeros(docs)
        total[filled] = np.add.reduceat(lat.log_p.room[edge], path.at[filled])
        u = uniform(seed, np.uint64(1 << 62) + np.uint64(1))
        for d in filled.tolist():
            a, b = path.at[d], path.at[d + 1]
            region = Region(rank, heads[d][1] + 1, heads[d][3]) if rank else Region(rank, 0, 0.0)
            region.key = truncated(region.log_mass(lat, edge[a:b]), bound[d], float(u[d]))
            regions[d].append(region)
            ids = piece[a:b] if outside[d] == outside[d + 1] else _ids(piece[a:b], vocabulary)
            out[d].samples.append((ids, float(total[d]), float(bound[d]), 0.0))
    for d in live:
        below[d] = max(r.key for r in regions[d])
    every, ends = lat.best_of(kind)
    cuts = np.concatenate([[0], ends])[first]
    for d in range(docs):
        out[d].best = every[cuts[d] : cuts[d + 1]]
        out[d].samples = [(i, p, g, inclusion(p, below[d])) for i, p, g, _ in out[d].samples]
    return out


def inclusion(log_prob: float, below: float) -> float:
    """log(1 - exp(-exp(log_prob - below))), the log of the chance to be above the key that came next."""
    if below == -np.inf:
        return 0.0
    x = log_prob - below
    return float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def _ids(piece: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    outside = np.flatnonzero(piece < 0)
    parts, at = [], 0
    for k in outside.tolist():
        parts += [piece[at:k], vocabulary.byte[list(chr(-1 - int(piece[k])).encode("utf-8", "surrogatepass"))]]
        at = k + 1
    return np.concatenate([*parts, piece[at:]]).astype(np.int32)


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One for each worker process."""
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[slice]:
    """Consecutive texts of about ``most`` characters, and at most 1,000 of them; a longer text is its own chunk."""
    a = held = 0
    for k, n in enumerate(sizes):
        if k > a and (held + n > most or k - a >= 1000):
            yield slice(a, k)
            a, held = k, 0
        held += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest("" if doc_id is None or doc_id is pd.NA else str(doc_id), seed)


def _rows(batches: Iterator[pa.RecordBatch], own: Vocabulary, samples: int, seed: int) -> Iterator[tuple[pa.Array, list[str], list[Drawn]]]:
    """Ids, texts and samples of a chunk of rows at a time."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
        for part in chunks(lengths):
            ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
            texts = [t or "" for t in batch.column("text").slice(part.start, part.stop - part.start).to_pylist()]
            yield ids, texts, sample(texts, [row_key(i, seed) for i in ids.to_pylist()], own, samples)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def _sampled(path: str, alpha: float, samples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, alpha)
        for ids, _, found in _rows(batches, own, samples, seed):
            flat = [(r, *s) for o in found for r, s in enumerate(o.samples, 1)]
            columns = [pa.array([x[0] for x in flat], pa.int32()), _lists([x[1] for x in flat]), *(pa.array([x[k] for x in flat], pa.float64()) for k in (2, 3, 4))]
            held = pa.StructArray.from_arrays(columns, ["rank", "ids", "log_prob", "perturbed", "log_inclusion"])
            at = pa.array(np.cumsum([0, *(len(o.samples) for o in found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, _lists([o.best for o in found]), pa.ListArray.from_arrays(at, held)], ["doc_id", "best", "samples"])

    return run


def sampled(docs: DataFrame, model: str, samples: int = 3, alpha: float = 5e-4, seed: int = 1) -> DataFrame:
    """(doc_id, best, samples) of docs(doc_id, text): ids of the model's own encoding and of the samples."""
    common.importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sampled(model, alpha, samples, seed), f"doc_id long, {FIELDS}")


def _decode_to(texts: list[str], encodings: list[list[np.ndarray]], vocabulary: Vocabulary) -> np.ndarray:
    """Whether each text's encodings all decode to it; bytes of pieces are compared for all texts at once."""
    raw = [(SPACE + t.replace(" ", SPACE)).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    good = np.ones(len(texts), bool)
    whole = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    for each in encodings:
        n = np.array([len(i) for i in each], np.int64)
        ids = np.concatenate([*each, np.empty(0, np.int32)])
        length = vocabulary.raw_n[ids]
        ends = np.cumsum(length)
        of = np.add.reduceat(np.append(length, 0), np.minimum(np.cumsum(n) - n, len(ids))) * (n > 0) if len(n) else n
        fits = of == sizes
        good &= fits
        if fits.all() and len(whole):
            made = vocabulary.raw_flat[np.repeat(vocabulary.raw_at[ids] - (ends - length), length) + np.arange(int(length.sum()))]
            wrong = np.flatnonzero(made != whole)
            good[np.searchsorted(np.cumsum(sizes), wrong, side="right")] = False
        else:
            for d in np.flatnonzero(fits):
                good[d] &= b"".join(map(vocabulary.raw.__getitem__, each[d].tolist())) == raw[d]
    return good


DIGEST = "doc_id long, n_best long, best_crc32 long, n_samples int, n_pieces array<long>, crc32s array<long>, log_probs array<double>, perturbed array<double>, log_inclusions array<double>, round_trip boolean"


def _digests(path: str, alpha: float, samples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, alpha)
        for ids, texts, found in _rows(batches, own, samples, seed):
            same = [[o.best for o in found], *[[o.samples[k][0] if k < len(o.samples) else o.best for o in found] for k in range(samples)]]
            whole = _decode_to(texts, same, own)
            number = lambda k: pa.array([[x[k] for x in o.samples] for o in found], pa.list_(pa.float64()))
            columns = [
                ids,
                pa.array([len(o.best) for o in found], pa.int64()),
                pa.array([zlib.crc32(np.ascontiguousarray(o.best)) for o in found], pa.int64()),
                pa.array([len(o.samples) for o in found], pa.int32()),
                pa.array([[len(s[0]) for s in o.samples] for o in found], pa.list_(pa.int64())),
                pa.array([[zlib.crc32(np.ascontiguousarray(s[0])) for s in o.samples] for o in found], pa.list_(pa.int64())),
                number(1), number(2), number(3), pa.array(whole.tolist()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DIGEST.split(", ")])

    return run


def digests(docs: DataFrame, model: str, samples: int = 3, alpha: float = 5e-4, seed: int = 1) -> DataFrame:
    """One row for each document: its encodings' sizes, checksums, scores, and whether all decode to the text."""
    common.importable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests(model, alpha, samples, seed), DIGEST)
