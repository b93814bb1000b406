"""A stored graph index: built once by part, reopened, and walked for many queries at once.

A part is a bounded run of rows (PART_ROWS at most) and one row of the index table: ids,
vectors, layers of links and, if asked for, product codes, as flat arrays. A search reads
each part once, walks it for all queries of a block together (every step is an array
operation over queries) and sends k rows for a query and part; no vector is shuffled.
A header row says what the index is and is checked when it is opened.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Metric, exact, unit_rows
from . import quantize
from .search import DIGITS, matrix, query_blocks, top

MAGIC, VERSION = "lodestone-graph", 1
#: Rows of a part at most, so that a part's arrays and its build fit a task.
PART_ROWS = 50_000
#: Rows whose distances to all others are held at once, and queries that walk together.
BLOCK, WALKERS = 512, 256
#: Numbers that one step of a part's work may hold at once.
CELLS = 1 << 22
#: A walk whose list has a sixteenth of a part's rows or more sees most of them, so their distances are taken at once.
MOST_SEEN = 16
#: Tasks that build or change parts.
MOST_TASKS = 4096
#: Rows that a codebook is trained on.
SAMPLE_ROWS = 20_000


def walk_space(vec: np.ndarray, metric: Metric, longest: float | None = None) -> np.ndarray:
    """Vectors in which squared L2 orders as the metric does: unit vectors for cosine; for inner products one
    more value brings all rows to the ``longest`` norm (queries have 0 there)."""
    if metric is Metric.COSINE:
        return np.nan_to_num(unit_rows(vec))
    if metric in (Metric.INNER_PRODUCT, Metric.COSINE_NORMALIZED):
        if longest is None:
            return np.concatenate((vec, np.zeros((len(vec), 1))), 1)
        return np.concatenate((vec, np.sqrt(np.maximum(longest**2 - (vec**2).sum(1), 0))[:, None]), 1)
    return vec


def level_of(ids: np.ndarray, seed: int) -> np.ndarray:
    """Geometric with half, at most 7, from the id alone."""
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    low = x & (~x + np.uint64(1))
    return np.minimum(7, np.where(x > 0, np.log2(np.maximum(low, 1).astype(float)), 7)).astype(np.int64)


def thinned(vec: np.ndarray, near: np.ndarray, d: np.ndarray, most: int, alpha: float) -> np.ndarray:
    """For each row of candidates (places, -1 for none, nearest first) the kept ones, -1 padded to ``most``.

    The rule of ``graph.prune_candidates`` for all rows together: one goes if a kept one is
    nearer to it, times alpha, than the centre.
    """
    out = np.full((len(near), most), -1, np.int32)
    step = max(1, min(256, CELLS // max(1, near.shape[1] * (near.shape[1] + vec.shape[1]))))
    for lo in range(0, len(near), step):
        c, own = near[lo : lo + step], d[lo : lo + step]
        x = vec[c]
        norm = (x**2).sum(2)
        gap = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        alive, number = c >= 0, np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            now = np.flatnonzero(alive[:, j] & (number < most))
            if not len(now):
                continue
            out[lo + now, number[now]] = c[now, j]
            number[now] += 1
            if math.isfinite(alpha):
                alive[now, j + 1 :] &= alpha * gap[now, j, j + 1 :] > own[now, j + 1 :]
    return out


@dataclass
class Part:
    """The graph of one part: rows in the order in which they came, dense links by layer."""

    metric: Metric
    m: int
    length: int = 100
    alpha: float = 1.2
    seed: int = 42
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    raw: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    layered: bool = True
    #: Of each layer the places of its members and their links (places, -1 padded).
    members: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    dead: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    codes: np.ndarray | None = None

    def opened(self) -> Part:
        """With what the walk needs beside the stored arrays."""
        longest = math.sqrt(max((self.raw**2).sum(1).max(initial=0), 1e-30))
        self.vec = walk_space(self.raw, self.metric, longest) if len(self.raw) else self.raw
        self.norm, self.mutual = (self.vec**2).sum(1), None
        self.at = []
        for own in self.members:
            at = np.full(len(self.ids), -1, np.int64)
            at[own] = np.arange(len(own))
            self.at.append(at)
        return self

    # -- building

    def insert(self, ids: np.ndarray, raw: np.ndarray, intra: int | None = None) -> Part:
        """Insert a batch: in runs that double, each row is linked with the nearest of all rows before its
        run and of its run (``intra`` of those at most; None: all), thinned, and back-links are added and thinned.

        The rows come in the order of a hash, so a run before is a sample of the next and gives it long links.
        """
        order = np.argsort((ids.astype(np.uint64) ^ np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        old = len(self.ids)
        self.ids = np.concatenate((self.ids, ids[order]))
        self.raw = np.concatenate((self.raw, raw[order])) if old else raw[order]
        self.dead = np.concatenate((self.dead, np.zeros(len(ids), bool)))
        level = level_of(self.ids, self.seed) if self.layered else np.zeros(len(self.ids), np.int64)
        for layer in range(int(level.max(initial=-1)) + 1):
            if layer == len(self.members):
                self.members.append(np.zeros(0, np.int64))
                self.links.append(np.zeros((0, self.most(layer)), np.int32))
        self.opened()
        for layer in range(len(self.members)):
            new = old + np.flatnonzero(level[old:] >= layer)
            done = 0
            while done < len(new):
                run = new[done : done + max(64, len(self.members[layer]))]
                self._link(layer, run, intra)
                done += len(run)
        return self.opened()

    def most(self, layer: int) -> int:
        return 2 * self.m if layer == 0 else self.m

    def _nearest(self, rows: np.ndarray, pool: np.ndarray, run: np.ndarray | None, intra: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ``length`` nearest of pool to each row, themselves left out: places and squared distances, nearest first."""
        norm = (self.vec[pool] ** 2).sum(1)
        k = min(self.length, len(pool))
        near, far = np.full((len(rows), k), -1, np.int64), np.full((len(rows), k), np.inf)
        inside = np.isin(pool, run) if run is not None and intra is not None else None
        step = max(1, min(BLOCK, 2 * CELLS // len(pool)))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            d = np.maximum((self.vec[own] ** 2).sum(1)[:, None] + norm - 2 * self.vec[own] @ self.vec[pool].T, 0)
            d[own[:, None] == pool] = np.inf
            if inside is not None and inside.any():
                some = np.flatnonzero(inside)
                if intra < len(some):
                    part = d[:, some]
                    limit = np.partition(part, intra, axis=1)[:, intra : intra + 1]
                    d[:, some] = np.where(part < limit, part, np.inf)
            pick = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(own), 1))
            gap = np.take_along_axis(d, pick, 1)
            sort = np.lexsort((self.ids[pool[pick]], np.round(gap, 9)), axis=1)
            pick, gap = np.take_along_axis(pick, sort, 1), np.take_along_axis(gap, sort, 1)
            near[lo : lo + step], far[lo : lo + step] = np.where(np.isinf(gap), -1, pool[pick]), gap
        return near, far

    def _link(self, layer: int, run: np.ndarray, intra: int | None) -> None:
        most = self.most(layer)
        pool = np.concatenate((self.members[layer], run))
        live = pool[~self.dead[pool]]
        kept = thinned(self.vec, *self._nearest(run, live, run, intra), most, self.alpha) if len(live) > 1 else np.full((len(run), most), -1, np.int32)
        self.members[layer] = pool
        self.links[layer] = np.concatenate((self.links[layer], kept))
        self.at[layer][run] = np.arange(len(pool) - len(run), len(pool))
        at, slot = np.nonzero(kept >= 0)
        self._add(layer, kept[at, slot].astype(np.int64), run[at])

    def _add(self, layer: int, src: np.ndarray, dst: np.ndarray) -> None:
        """Add links src -> dst; rows that grow beyond their limit are thinned."""
        if not len(src):
            return
        most, table = self.most(layer), self.links[layer]
        row, slot = np.nonzero(table[self.at[layer][np.unique(src)]] >= 0)
        touched = np.unique(src)
        old = table[self.at[layer][touched]]
        pairs = np.unique(np.concatenate((np.stack((touched[row], old[row, slot]), 1), np.stack((src, dst), 1))), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        own, first, number = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        few = number <= most
        for wide in (False, True):
            group = np.flatnonzero(~few if wide else few)
            step = max(1, min(4096, CELLS // int(number[group].max(initial=1))))
            for lo in range(0, len(group), step):
                g = group[lo : lo + step]
                width = int(number[g].max())
                near = np.full((len(g), max(width, 1)), -1, np.int64)
                i = np.repeat(np.arange(len(g)), number[g])
                j = np.arange(len(i)) - np.repeat(np.cumsum(number[g]) - number[g], number[g])
                near[i, j] = pairs[np.repeat(first[g], number[g]) + j, 1]
                if wide:
                    near = self._sorted(own[g], near)
                    new = thinned(self.vec, *near, most, self.alpha)
                else:
                    new = np.full((len(g), most), -1, np.int32)
                    new[:, : min(width, most)] = near[:, :most]
                table[self.at[layer][own[g]]] = new

    def _sorted(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's places in order of (squared distance, id), and the distances; -1 last."""
        out, far = np.empty(near.shape, np.int64), np.empty(near.shape)
        step = max(1, CELLS // max(1, near.shape[1] * self.vec.shape[1]))
        for lo in range(0, len(rows), step):
            own = near[lo : lo + step]
            gap = np.where(own >= 0, ((self.vec[own] - self.vec[rows[lo : lo + step]][:, None, :]) ** 2).sum(2), np.inf)
            sort = np.lexsort((self.ids[own], np.round(gap, 9)), axis=1)
            out[lo : lo + step], far[lo : lo + step] = np.take_along_axis(own, sort, 1), np.take_along_axis(gap, sort, 1)
        return out, far

    def delete(self, ids: np.ndarray, method: str = "one_hop", replace: int = 3) -> Part:
        """Delete rows in place: each in-neighbour gets the ``replace`` best of the deleted row's replacements
        and is thinned; then the row's own links go. Replacements: its out-neighbours (``one_hop``), also theirs
        (``two_hop``), or the nearest that a walk to it finds (``visited``). Deleted rows are in no result."""
        if method not in ("one_hop", "two_hop", "visited"):
            raise ValueError(f"unknown method: {method!r}")
        gone = np.flatnonzero(np.isin(self.ids, ids) & ~self.dead)
        if not len(gone):
            return self
        found = self.walk(self.vec[gone], self.length)[0] if method == "visited" else None
        self.dead[gone] = True
        for layer, (own, table) in enumerate(zip(self.members, self.links)):
            row, slot = np.nonzero(np.isin(table, gone))
            src, lost = own[row], table[row, slot].astype(np.int64)
            alive = ~self.dead[src]
            src, lost = src[alive], lost[alive]
            wide = {"one_hop": table.shape[1], "two_hop": table.shape[1] * (table.shape[1] + 1), "visited": self.length}[method]
            step = max(1, CELLS // (wide * self.vec.shape[1] + 1))
            offers = [self._replacements(layer, src[lo : lo + step], lost[lo : lo + step], method, gone, found, replace) for lo in range(0, len(src), step)]
            table[np.isin(table, gone)] = -1
            table[self.at[layer][gone[self.at[layer][gone] >= 0]]] = -1
            if offers:
                self._add(layer, *(np.concatenate(x) for x in zip(*offers)))
        return self

    def _replacements(self, layer: int, src: np.ndarray, lost: np.ndarray, method: str, gone: np.ndarray, found: np.ndarray | None, replace: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (from, to) that stand for lost ones: the ``replace`` best of what each lost row offers to its in-neighbour."""
        table = self.links[layer]
        if method == "visited":
            offer = found[np.searchsorted(gone, lost)]
            offer = np.where((offer >= 0) & (self.at[layer][offer] >= 0), offer, -1)
        else:
            offer = table[self.at[layer][lost]].astype(np.int64)
            if method == "two_hop":
                more = np.where(offer[:, :, None] >= 0, table[self.at[layer][offer]], -1).reshape(len(lost), -1)
                offer = np.concatenate((offer, more), 1)
        offer = np.where((offer >= 0) & ~self.dead[offer] & (offer != src[:, None]), offer, -1)
        near, gap = self._sorted(src, offer)
        near = np.where(np.isinf(gap), -1, near)
        same = np.concatenate((np.zeros((len(near), 1), bool), near[:, 1:] == near[:, :-1]), 1) & (near >= 0)
        near[same] = -1
        i, j = np.nonzero((near >= 0) & (np.cumsum(near >= 0, axis=1) <= replace))
        return src[i], near[i, j]

    # -- walking

    def entry(self) -> tuple[int, int]:
        """The highest layer that has a row alive, and its first one; -1 if there is none."""
        for layer in range(len(self.members) - 1, -1, -1):
            alive = self.members[layer][~self.dead[self.members[layer]]]
            if len(alive):
                return layer, int(alive[0])
        return 0, -1

    def _step(self, layer: int, nodes: np.ndarray) -> np.ndarray:
        at = np.where(nodes >= 0, self.at[layer][nodes], -1)
        return np.where((at >= 0)[..., None], self.links[layer][at], -1)

    def walk(self, q: np.ndarray, length: int, width: int = 1, opens: int | None = None, seeds: np.ndarray | None = None, tables: np.ndarray | None = None, trace: list | None = None):
        """(places, squared distances, hops, comparisons) of the ``length`` nearest that each query's walk finds.

        From the highest layer down greedily, then on the lowest one ``width`` nodes are opened at a
        time, ``opens`` at most, until none of the list is unopened. ``seeds``: places to start from
        as well. ``tables``: lookups of product codes that stand for distances.
        """
        count = np.zeros(len(q), np.int64)

        def gap(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            np.add.at(count, rows, 1)
            if tables is not None:
                return tables[rows[:, None], np.arange(tables.shape[1]), self.codes[nodes]].sum(1)
            x = self.vec[nodes] - q[rows]
            return np.einsum("ij,ij->i", x, x)

        highest, entry = self.entry()
        start = np.full((len(q), 1), entry, np.int64)
        for layer in range(highest, 0, -1):
            start = self._descend(layer, start, 1, 1, None, gap)[0]
        if seeds is not None and len(seeds):
            start = np.concatenate((start, np.tile(seeds, (len(q), 1))), 1)
            start = np.sort(start, 1)
            start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        if len(self.ids) <= MOST_SEEN * length:
            found, d, hops, seen = self._descend_ranked(start, self._gaps(q, tables), length, width, opens, trace)
            return found, d, hops, count + seen
        found, d, hops = self._descend(0, start, length, width, opens, gap, trace)
        return found, d, hops, count

    def _gaps(self, q: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
        """Squared distances, or lookups, of all rows: queries x rows."""
        if tables is not None:
            return sum(tables[:, c, self.codes[:, c]] for c in range(tables.shape[1]))
        d = -2 * (q @ self.vec.T)
        d += (q**2).sum(1)[:, None]
        d += self.norm
        return np.maximum(d, 0, out=d)

    def _mutual(self) -> np.ndarray:
        """Of the lowest layer's rows those that the first of them reaches (column 0), and those that reach it (column 1)."""
        if self.mutual is None:
            row, slot = np.nonzero(self.links[0] >= 0)
            src, dst = self.members[0][row], self.links[0][row, slot].astype(np.int64)
            self.mutual = np.zeros((len(self.ids), 2), bool)
            for side, (a, b) in enumerate(((src, dst), (dst, src))):
                new = self.members[0][:1]
                while len(new):
                    self.mutual[new, side] = True
                    front = np.zeros(len(self.ids), bool)
                    front[b[np.isin(a, new)]] = True
                    new = np.flatnonzero(front & ~self.mutual[:, side])
        return self.mutual

    def _descend_ranked(self, start: np.ndarray, gaps: np.ndarray, length: int, width: int, opens: int | None, trace: list | None):
        """``_descend`` on the lowest layer, given the distances of all rows: a list is then the first of the seen
        rows in a query's own order, which needs no merging. Also the number of seen rows.

        A list that holds every row opens all that its start reaches: where that is what the first row
        reaches, it is looked up once.
        """
        n, total = gaps.shape
        order = np.argsort(gaps, axis=1, kind="stable")
        rank = np.empty((n, total), np.int32)
        np.put_along_axis(rank, order, np.arange(total, dtype=np.int32)[None], 1)
        seen, hops = np.zeros((n, total), bool), np.zeros(n, np.int64)
        i, j = np.nonzero(start >= 0)
        seen[i, rank[i, start[i, j]]] = True
        waiting, rows = seen.copy(), np.arange(n)
        if length >= total and opens is None and trace is None and width == 1:
            reached, back = self._mutual().T
            plain = ((start < 0) | (reached & back)[start]).all(1) & (start >= 0).any(1)
            seen[plain] = reached[order[plain]]
            hops[plain] = int(reached.sum())
            rows = rows[~plain]
        while len(rows):
            picks = []
            for _ in range(width):
                open_ = waiting[rows]
                first = open_.argmax(1)
                some = open_[np.arange(len(rows)), first]
                if opens is not None:
                    some &= hops[rows] < opens
                if total > length:
                    some &= np.count_nonzero(seen[rows] & (np.arange(total) < first[:, None]), axis=1) < length
                own, first = rows[some], first[some]
                waiting[own, first] = False
                node = order[own, first]
                if trace is not None:
                    trace += zip(own.tolist(), hops[own].tolist(), node.tolist(), gaps[own, node].tolist())
                hops[own] += 1
                picks.append((own, node))
                if not picks[0][0].size:
                    break
            rows = picks[0][0]
            own, node = (np.concatenate(x) for x in zip(*picks))
            new = self.links[0][self.at[0][node]]
            i, j = np.nonzero(new >= 0)
            own, at = own[i], rank[own[i], new[i, j]]
            fresh = ~seen[own, at]
            own, at = own[fresh], at[fresh]
            seen[own, at] = waiting[own, at] = True
        place = np.cumsum(seen, 1)
        i, at = np.nonzero(seen & (place <= length))
        beam, d = np.full((n, length), -1, np.int64), np.full((n, length), np.inf)
        beam[i, place[i, at] - 1] = node = order[i, at]
        d[i, place[i, at] - 1] = gaps[i, node]
        return beam, d, hops, place[:, -1]

    def _descend(self, layer: int, start: np.ndarray, length: int, width: int, opens: int | None, gap: Callable, trace: list | None = None):
        n = len(start)
        length = max(length, 1)
        seen = np.zeros((n, len(self.ids)), bool)
        beam, d, done = np.full((n, length), -1, np.int64), np.full((n, length), np.inf), np.ones((n, length), bool)
        hops = np.zeros(n, np.int64)

        def merge(rows: np.ndarray, new: np.ndarray, far: np.ndarray) -> None:
            both = np.concatenate((beam[rows], new), 1)
            gaps = np.concatenate((d[rows], far), 1)
            opened = np.concatenate((done[rows], new < 0), 1)
            sort = np.argsort(gaps, axis=1, kind="stable")[:, :length]
            beam[rows], d[rows], done[rows] = (np.take_along_axis(x, sort, 1) for x in (both, gaps, opened))

        def scored(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            out = np.full(nodes.shape, np.inf)
            i, j = np.nonzero(nodes >= 0)
            if len(i):
                seen[rows[i], nodes[i, j]] = True
                out[i, j] = gap(rows[i], nodes[i, j])
            return out

        all_ = np.arange(n)
        merge(all_, start, scored(all_, start))
        while True:
            rows = np.flatnonzero((~done & (beam >= 0)).any(1) & (hops < (opens if opens is not None else 1 << 62)))
            if not len(rows):
                return beam, d, hops
            waiting = ~done[rows] & (beam[rows] >= 0)
            pick = waiting & (np.cumsum(waiting, 1) <= (width if opens is None else np.minimum(width, opens - hops[rows])[:, None]))
            hops[rows] += pick.sum(1)
            if trace is not None:
                i, j = np.nonzero(pick)
                nth = hops[rows[i]] - pick.sum(1)[i] + np.cumsum(pick, 1)[i, j] - 1
                trace += zip(rows[i].tolist(), nth.tolist(), beam[rows[i], j].tolist(), d[rows[i], j].tolist())
            wide = int(pick.sum(1).max())
            nodes = np.full((len(rows), wide), -1, np.int64)
            i, j = np.nonzero(pick)
            nodes[i, (np.cumsum(pick, 1) - 1)[i, j]] = beam[rows[i], j]
            done[rows] |= pick
            new = self._step(layer, nodes).reshape(len(rows), -1).astype(np.int64)
            new = np.where((new >= 0) & ~seen[rows[:, None], new], new, -1)
            if wide > 1:
                new = np.sort(new, 1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            merge(rows, new, scored(rows, new))

    # -- as a row

    def row(self, part: int) -> list:
        return [part, len(self.ids), self.raw.shape[1] if len(self.raw) else 0, self.ids.tobytes(), self.raw.astype("<f4").tobytes(), self.dead.tobytes(), [x.astype("<i4").tobytes() for x in self.members], [x.astype("<i4").tobytes() for x in self.links], None if self.codes is None else self.codes.astype("<u2").tobytes()]

    @classmethod
    def load(cls, row: dict, header: dict) -> Part:
        metric, m = Metric.parse(header["metric"]), header["m"]
        p = cls(metric, m, header["length"], header["alpha"], header["seed"], layered=header["layered"])
        p.ids = np.frombuffer(row["ids"], np.int64).copy()
        p.raw = np.frombuffer(row["vectors"], "<f4").reshape(len(p.ids), row["dim"]).astype(np.float64)
        p.dead = np.frombuffer(row["dead"], bool).copy()
        p.members = [np.frombuffer(x, "<i4").astype(np.int64) for x in row["members"]]
        p.links = [np.frombuffer(x, "<i4").reshape(-1, p.most(k)).copy() for k, x in enumerate(row["links"])]
        if row["codes"] is not None:
            p.codes = np.frombuffer(row["codes"], "<u2").reshape(len(p.ids), -1).astype(np.int64)
        return p.opened()


ROW = "part long, rows long, dim int, ids binary, vectors binary, dead binary, members array<binary>, links array<binary>, codes binary"
_ROW = pa.schema([("part", pa.int64()), ("rows", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("dead", pa.binary()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())), ("codes", pa.binary())])
_HEADER = "magic string, version int, metric string, dim int, m int, length int, alpha double, seed int, parts long, rows long, chunks int, layered boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, as a part is large."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Dealt by part to as many tasks as parts, MOST_TASKS at most: a part is little data and much work, so Spark must not put small ones together."""
    return rows.repartition(min(parts, MOST_TASKS), "part")


class GraphIndex:
    """An index folder: ``header``, ``parts.<n>`` and, with codes, ``codebook``."""

    def __init__(self, spark: SparkSession, path: str, header: dict):
        self.spark, self.path, self.header = spark, path, header
        self.nodes = spark.read.parquet(header["nodes"])
        self.codebook = quantize.load_codebook(spark, f"{path}/codebook") if header["chunks"] else None
        self.offsets = quantize.chunk_offsets(self._walk_dim(), header["chunks"]) if header["chunks"] else None

    def _walk_dim(self) -> int:
        return self.header["dim"] + (Metric.parse(self.header["metric"]) in (Metric.INNER_PRODUCT, Metric.COSINE_NORMALIZED))

    @classmethod
    def build(cls, base: DataFrame, path: str, metric: str = "l2", m: int = 16, length: int = 100, alpha: float = 1.2, seed: int = 42, chunks: int = 0, part_rows: int = PART_ROWS, layered: bool = True) -> GraphIndex:
        """Build and store the index of (id, vec): rows are dealt to parts by a hash of the id.

        Without layers and with an infinite alpha it is the plain small-world graph: each row is linked
        with the 2 m nearest both ways, and the nearest 2 m stay. Null vectors are left out; vectors of
        several dimensions are an error. ``chunks`` product codes
        of each row are stored beside, learned from a sample of SAMPLE_ROWS at most.
        """
        spark, metric = base.sparkSession, Metric.parse(metric).value
        rows = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("vec is not null")
        stats = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("dim")).first()
        if stats.least != stats.dim:
            raise ValueError(f"vectors of {stats.least} and {stats.dim} dimensions")
        parts = max(1, -(-stats.n // part_rows))
        header = {"magic": MAGIC, "version": VERSION, "metric": metric, "dim": stats.dim or 0, "m": m, "length": length, "alpha": alpha, "seed": seed, "parts": parts, "rows": stats.n, "chunks": chunks, "layered": layered}
        header["nodes"] = f"{path}/parts.0"
        book = offsets = None
        if chunks and stats.n:
            share = min(1.0, SAMPLE_ROWS / stats.n)
            got = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE_ROWS).collect()
            sample = np.array([r.vec for r in sorted(got, key=lambda r: r.id)], float)
            longest = math.sqrt(max((sample**2).sum(1).max(initial=0), 1e-30))
            sample = walk_space(sample, Metric.parse(metric), longest)
            offsets = quantize.chunk_offsets(sample.shape[1], chunks)
            book = quantize.train_codebook(sample, offsets)
            quantize.save_codebook(spark, book, f"{path}/codebook")

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            p = Part(Metric.parse(metric), m, length, alpha, seed, layered=layered).insert(table["id"].to_numpy(), matrix(table["vec"]))
            p.codes = coded(p.vec, book, offsets) if book else None
            return pa.Table.from_batches([_batch([p.row(key[0].as_py())])])

        dealt = by_part(rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts))), parts)
        dealt.groupBy("part").applyInArrow(run, ROW).write.parquet(header["nodes"])
        index = cls(spark, path, header)
        index._write_header()
        return index

    def _write_header(self) -> None:
        names = [x.split()[0] for x in _HEADER.split(", ")]
        row = tuple(self.header[n] for n in names) + (self.header["nodes"],)
        self.spark.createDataFrame([row], _HEADER + ", nodes string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/header")

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int | None = None) -> GraphIndex:
        """A stored index; its header must be this kind's and, with ``dim``, of that dimension."""
        header = spark.read.parquet(f"{path}/header").first().asDict()
        if header.get("magic") != MAGIC:
            raise ValueError("not a graph index")
        if header["version"] != VERSION:
            raise ValueError(f"index version {header['version']}, this is {VERSION}")
        if dim is not None and header["dim"] != dim:
            raise ValueError(f"the index has {header['dim']} dimensions, not {dim}")
        return cls(spark, path, header)

    def _changed(self, change: Callable[[Part, int], Part]) -> None:
        """Write all parts anew after a change and point the header at them; readers of the old ones aren't disturbed."""
        header, book, offsets = self.header, self.codebook, self.offsets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                p = change(Part.load(row, header), row["part"])
                if book:
                    p.codes = coded(p.vec, book, offsets)
                yield _batch([p.row(row["part"])])

        self.header = header | {"nodes": f"{self.path}/parts.{uuid.uuid4().hex}"}
        self.nodes.mapInArrow(run, ROW).write.parquet(self.header["nodes"])
        self._write_header()
        self.nodes = self.spark.read.parquet(self.header["nodes"])

    def insert(self, rows: DataFrame, intra: int | None = None) -> None:
        """Insert a batch of new ids (id, vec); see ``Part.insert``. The batch meets its parts by a join, one row for each part."""
        parts, seed, header, book, offsets = self.header["parts"], self.header["seed"], self.header, self.codebook, self.offsets
        new = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where("vec is not null").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)))

        def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0] if left.num_rows else {"part": key[0].as_py(), "ids": b"", "vectors": b"", "dim": header["dim"], "dead": b"", "members": [], "links": [], "codes": None}
            p = Part.load(row, header)
            if right.num_rows:
                p.insert(right["id"].to_numpy(), matrix(right["vec"]), intra)
            p.codes = coded(p.vec, book, offsets) if book else None
            return pa.Table.from_batches([_batch([p.row(row["part"])])])

        target = f"{self.path}/parts.{uuid.uuid4().hex}"
        by_part(self.nodes, parts).groupBy("part").cogroup(by_part(new, parts).groupBy("part")).applyInArrow(run, ROW).write.parquet(target)
        self.header = header | {"nodes": target, "rows": header["rows"] + new.count()}
        self._write_header()
        self.nodes = self.spark.read.parquet(target)

    def delete(self, ids: list[int], method: str = "one_hop", replace: int = 3) -> None:
        """Delete ids in place; see ``Part.delete``."""
        gone = np.array(sorted(set(ids)), np.int64)
        self._changed(lambda p, _: p.delete(gone, method, replace))

    def reachable_share(self) -> DataFrame:
        """(part, rows, reached, most_links): rows alive, those that links of the lowest layer reach from the entry, and the largest out-degree."""
        header = self.header

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                p = Part.load(row, header)
                seen = np.zeros(len(p.ids), bool)
                front = np.array([x for x in p.entry()[1:] if x >= 0], np.int64)
                while len(front):
                    seen[front] = True
                    out = p._step(0, front).ravel()
                    front = np.unique(out[(out >= 0)])
                    front = front[~seen[front]]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]]), pa.array([int((~p.dead).sum())]), pa.array([int((seen & ~p.dead).sum())]), pa.array([int((p.links[0] >= 0).sum(1).max(initial=0)) if p.links else 0])], ["part", "rows", "reached", "most_links"])

        return self.nodes.mapInArrow(run, "part long, rows long, reached long, most_links long")

    def edges(self) -> DataFrame:
        """(part, layer, src, dst, ord): all links by id."""
        header = self.header

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                p = Part.load(row, header)
                for layer, (own, table) in enumerate(zip(p.members, p.links)):
                    i, j = np.nonzero(table >= 0)
                    nth = (np.cumsum(table >= 0, 1))[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["part"])), pa.array(np.full(len(i), layer, np.int32)), pa.array(p.ids[own[i]]), pa.array(p.ids[table[i, j]]), pa.array(nth.astype(np.int32))], ["part", "layer", "src", "dst", "ord"])

        return self.nodes.mapInArrow(run, "part long, layer int, src long, dst long, ord int")

    def _found(self, queries: DataFrame, length: int, width: int, opens: int | None, seeds: list[int] | None, use_codes: bool, k: int, allowed: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
        header, book, offsets = self.header, self.codebook if use_codes else None, self.offsets
        metric, started = Metric.parse(header["metric"]), np.array(sorted(seeds or []), np.int64)
        out = self.spark.createDataFrame([], "part long, qid long, id long, distance double, hops long, comparisons long")
        for block in query_blocks(queries.where(F.size("query") == header["dim"])):
            sent = self.spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                qids, own = sent.value
                q = walk_space(own, metric)
                for row in _rows(batches):
                    p = Part.load(row, header)
                    if not len(p.ids):
                        continue
                    first = np.flatnonzero(np.isin(p.ids, started)) if len(started) else None
                    real = (p.raw**2).sum(1) > 0 if metric is Metric.COSINE else np.ones(len(p.ids), bool)
                    for lo in range(0, len(q), WALKERS):
                        part = q[lo : lo + WALKERS]
                        tables = lookups(part, book, offsets) if book else None
                        found, gap, hops, count = p.walk(part, length, width, opens, first, tables)
                        good = (found >= 0) & ~p.dead[found]
                        if allowed is not None:
                            good &= allowed(p.ids[found])
                        if tables is None:
                            good = foremost(good & real[found], gap, k)
                        i, j = np.nonzero(good)
                        d = exact(metric, own[lo + i], p.raw[found[i, j]])
                        keep = ~np.isnan(d)
                        i, j, d = i[keep], j[keep], np.round(d[keep], DIGITS) + 0.0
                        order = np.lexsort((p.ids[found[i, j]], d, i))
                        i, j, d = i[order], j[order], d[order]
                        nth = np.arange(len(i)) - np.searchsorted(i, i)
                        top_ = nth < k
                        i, j, d = i[top_], j[top_], d[top_]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["part"])), pa.array(qids[lo + i]), pa.array(p.ids[found[i, j]]), pa.array(d), pa.array(hops[i]), pa.array(count[i])], ["part", "qid", "id", "distance", "hops", "comparisons"])

            out = out.unionByName(self.nodes.mapInArrow(run, "part long, qid long, id long, distance double, hops long, comparisons long"))
        return out

    def search(self, queries: DataFrame, k: int = 10, length: int = 100, width: int = 1, page: int = 1, opens: int | None = None, seeds: list[int] | None = None, use_codes: bool | None = None, allowed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """(qid, id, rank, distance): the nearest that a walk over every part finds, by the index's metric.

        ``length`` nodes are listed (at least k * page), ``width`` opened at a time, ``opens`` at most.
        ``page`` p gives ranks (p-1)k+1 to pk. ``seeds`` are ids to start from as well. With stored codes
        the walk goes by them unless ``use_codes`` is False; results are always ranked by exact
        distances. ``allowed`` (ids -> booleans) drops listed rows at the end. Queries that are
        null or of another dimension have no results; neither has an empty table.
        """
        if length < k:
            raise ValueError(f"length {length} is below k {k}")
        codes = bool(self.codebook) if use_codes is None else use_codes
        pairs = self._found(queries, max(length, k * page), width, opens, seeds, codes, k * page, allowed)
        return top(pairs, k * page).where(F.col("rank") > k * (page - 1)).select("qid", "id", "rank", "distance")

    def costs(self, queries: DataFrame, k: int = 10, length: int = 100, width: int = 1, opens: int | None = None) -> DataFrame:
        """(qid, hops, comparisons): what each query's walks opened and compared, over all parts."""
        pairs = self._found(queries, length, width, opens, None, bool(self.codebook), k, None)
        own = pairs.groupBy("part", "qid").agg(F.max("hops").alias("hops"), F.max("comparisons").alias("comparisons"))
        return own.groupBy("qid").agg(F.sum("hops").alias("hops"), F.sum("comparisons").alias("comparisons"))

    def recorded(self, queries: DataFrame, length: int = 50, width: int = 1) -> DataFrame:
        """(part, qid, hop, id, distance): the nodes that each walk opens on the lowest layer, in order, with squared distances of the walk."""
        header = self.header
        metric = Metric.parse(header["metric"])
        out = self.spark.createDataFrame([], "part long, qid long, hop int, id long, distance double")
        for block in query_blocks(queries.where(F.size("query") == header["dim"])):
            sent = self.spark.sparkContext.broadcast(block)

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                qids, own = sent.value
                q = walk_space(own, metric)
                for row in _rows(batches):
                    p = Part.load(row, header)
                    for lo in range(0, len(q) if len(p.ids) else 0, WALKERS):
                        trace: list = []
                        p.walk(q[lo : lo + WALKERS], length, width, trace=trace)
                        cols = list(zip(*trace)) or [(), (), (), ()]
                        at = np.array(cols[0], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["part"])), pa.array(qids[lo + at]), pa.array(cols[1], pa.int32()), pa.array(p.ids[np.array(cols[2], np.int64)]), pa.array(cols[3], pa.float64())], ["part", "qid", "hop", "id", "distance"])

            out = out.unionByName(self.nodes.mapInArrow(run, "part long, qid long, hop int, id long, distance double"))
        return out


def foremost(good: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
    """What may be among the k nearest of each row's good ones, by squared distances of the walk (nearest first);
    all that may tie with the last after rounding are."""
    good = good & ~np.isnan(gap)
    last = np.where(good & (np.cumsum(good, 1) == k), gap, -np.inf).max(1, initial=-np.inf)
    last = np.where(np.isneginf(last), np.inf, last)
    return good & (gap <= (last + 4 * 10.0**-DIGITS * (1 + np.sqrt(last)) + 1e-6 * last)[:, None])


def coded(vec: np.ndarray, book: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Product codes of the walk's vectors."""
    if not len(vec):
        return np.zeros((0, len(book)), np.int64)
    return np.stack([quantize.nearest_rows(vec[:, a:z], c) for a, z, c in zip(offsets[:-1], offsets[1:], book)], 1)


def lookups(q: np.ndarray, book: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Squared distances of each query's chunks to all centroids: queries x chunks x centroids."""
    most = max(len(c) for c in book)
    out = np.full((len(q), len(book), most), np.inf)
    for x, (a, z, c) in enumerate(zip(offsets[:-1], offsets[1:], book)):
        out[:, x, : len(c)] = ((q[:, None, a:z] - c[None]) ** 2).sum(2)
    return out
