"""Exact n-gram Jaccard self-join with set-relation skipping.

The plan, with no pair of documents emitted that isn't needed:

1. One pass over the texts gives each document its set's size, digest and parity sketch.
   Equal sets are one class from here on. The same pass counts, for a fixed slice of
   the shingle space, in how many documents each shingle is.
2. A second pass writes each class's prefix (rarest shingles first) as index entries.
   The entries of one shingle are sorted by set size and position. Entries of one size are
   a block; blocks beyond the size bound are skipped whole, and in a block all positions
   too far from the own one are skipped by two binary searches. Entries that have a partner within their
   bounds get their set's sketch, whose width follows the set's size, and go through
   the lists again: position and sketch leave a graph of possible links, and of each
   list only a spanning forest of it leaves the task. All filters are safe, so linked
   sets always share a component of this graph: a relation group.
3. A third pass brings the whole sets of those classes, by relation group. In a group the
   overlaps of a set with all others are derived from the computed overlaps of a highly
   similar set by the lists of the shingles in which the two differ. Every link is
   counted exactly there; a spanning forest of the links leaves the task.

Long lists and large groups are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from .common import Tables, chunks, components, shingle_sets, small_batches, text_buffers

#: Shingles in more documents than this may be ordered by their count; at most so many of them.
HEAVY_FROM, HEAVY_MOST = 32, 1 << 20
#: Entries of a block of one list; shingles and sets of a block of one relation group.
LIST_BLOCK, GROUP_BLOCK, GROUP_SETS = 20_000, 4_000_000, 8192
#: Entries up to which a list's positions are compared one by one.
SHORT_LIST = 4096
#: Shingles gathered before a task writes a run of counts.
RUN = 4_000_000
#: Bits of the filter that says which classes' sets are needed; its size never grows.
FILTER_BITS = 1 << 26
#: Least bits of a set's parity sketch.
SKETCH = 256
#: Answer vectors kept to derive others from.
PIVOTS = 8


def need(n: int, percent: int) -> int:
    """Smallest overlap that a set of n can have with any set it links to."""
    return -(-n * percent // 100)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def counted_share(percent: int) -> int:
    """Of 65536 parts of the shingle space, those whose shingles are counted."""
    return min(65536, 5 * (100 - percent) * 65536 // 100)


def _pack(slots: np.ndarray) -> bytes:
    gaps = np.diff(slots, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def first_pass(docs: DataFrame, k: int, percent: int, ranges: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, cid, sketch) of each document, and (range, slots, counts) runs."""
    kind = docs.schema["doc_id"].dataType
    kind_arrow = to_arrow_type(kind)
    share, shift = np.uint64(counted_share(percent)), np.uint32(32 - ranges.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, gathered, held = ["doc_id", "n", "cid", "sketch", "range", "slots", "counts"], [], 0

        def counts() -> pa.RecordBatch:
            slots, number = np.unique(np.concatenate(gathered), return_counts=True)
            part = slots >> shift
            cut = np.searchsorted(part, np.arange(ranges + 1))
            rows = [(r, _pack(slots[a:b]), number[a:b].astype("<u4").tobytes() if number[a:b].max() > 1 else None) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            rows = [(r, s, None if c is None else zstandard.ZstdCompressor(level=1).compress(c)) for r, s, c in rows]
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([none.cast(kind_arrow), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names)

        for b in batches:
            data, off = text_buffers(b.column(1))
            sizes, digests, sketches = [], [], []
            for _, _, part, at in chunks(data, off):
                sets = shingle_sets(part, at, k)
                sizes += [len(s) for s in sets]
                digests += [digest(s) if len(s) else None for s in sets]
                sketches += [sketch(s, percent) if may_link(len(s), percent) else None for s in sets]
                all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                gathered.append((all_[(all_ & np.uint64(0xFFFF)) < share] >> np.uint64(32)).astype(np.uint32))
                held += len(gathered[-1])
                if held >= RUN:
                    yield counts()
                    gathered, held = [], 0
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names)
        if held:
            yield counts()

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, n int, cid binary, sketch binary, range int, slots binary, counts binary")


def heavy_slots(runs: DataFrame, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of frequent shingles and their document counts, HEAVY_MOST at most.

    Which shingles are listed changes only the order in which prefixes are taken, never the result.
    """

    def total(table: pa.Table) -> pa.Table:
        slots = [_unpack(s) for s in table["slots"].to_pylist()]
        counts = [np.ones(len(s), np.int64) if c is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<u4").astype(np.int64) for s, c in zip(slots, table["counts"].to_pylist())]
        all_ = np.concatenate(slots)
        order = np.argsort(all_, kind="stable")
        all_, number = all_[order], np.concatenate(counts)[order]
        new = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1])))
        sums = np.add.reduceat(number, new)
        keep = sums >= HEAVY_FROM
        return pa.table({"slot": pa.array(all_[new][keep].astype(np.int64)), "df": pa.array(sums[keep])})

    heavy = tables.write(runs.select("range", "slots", "counts").groupBy("range").applyInArrow(total, "slot long, df long"))
    level = F.floor(F.log2("df") * 8)
    sizes, least, n = heavy.groupBy(level.alias("l")).count().orderBy(F.desc("l")).collect(), None, 0
    for r in sizes:  # some hundred levels at most
        if n + r["count"] > HEAVY_MOST:
            break
        n, least = n + r["count"], r.l
    got = heavy.where(level >= (least if least is not None else 1 << 30)).select("slot", "df").toPandas() if least is not None else None
    tables.drop(heavy)
    if got is None or not len(got):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    got = got.sort_values("slot")
    return got.slot.to_numpy().astype(np.uint32), got.df.to_numpy().astype(np.int64)


def may_link(n: int, percent: int) -> bool:
    """Whether a set of n can link with any set but its equals."""
    return n > 0 and (n * 100 >= percent * (n + 1) or need(n, percent) < n)


def sketch(s: np.ndarray, percent: int) -> bytes:
    """Parities of the set's members by hash, in enough bits to tell unrelated sets of its size apart.

    The width is a power of two, so a wider sketch folds into a narrower one.
    """
    width = SKETCH
    while width * 30 < len(s) * (100 - percent):
        width *= 2
    bits = (s >> np.uint64(16)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(bits, minlength=width) & 1).astype(np.uint8)).tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to so many words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), 0)


def index_entries(docs: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(token, block, side, n, pos, id) for the prefix of every class's set; id: the digest's first half.

    Sets that link only with their equals have none. A class is written once by each
    task at least; the index drops what repeats.
    """
    share = np.uint64(counted_share(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, dfs = heavy.value
        seen: set[bytes] = set()
        for b in batches:
            data, off = text_buffers(b.column(0))
            for _, _, part, at in chunks(data, off):
                meta: list[tuple] = []
                sets = [s for s in shingle_sets(part, at, k) if may_link(len(s), percent)]
                for s in sets:
                    cid = digest(s)
                    if cid in seen:
                        continue
                    if len(seen) > 1 << 18:
                        seen.clear()
                    seen.add(cid)
                    meta.append((s, cid))
                if not meta:
                    continue
                all_ = np.concatenate([s for s, _ in meta])
                slot = (all_ >> np.uint64(32)).astype(np.uint32)
                key = all_ >> np.uint64(2)
                df = np.zeros(len(all_), np.int64)
                counted = (all_ & np.uint64(0xFFFF)) < share
                key[~counted] |= np.uint64(2 << 62)
                if len(slots):
                    at_ = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                    hot = counted & (slots[at_] == slot)
                    df[hot] = dfs[at_[hot]]
                    key[hot] = np.uint64(1 << 62) | np.minimum(df[hot], (1 << 29) - 1).astype(np.uint64) << np.uint64(32) | slot[hot].astype(np.uint64)
                lo = 0
                out: list[list] = [[] for _ in range(6)]
                for s, cid in meta:
                    n = len(s)
                    p = n - need(n, percent) + 1
                    mine = key[lo : lo + n]
                    pick = np.argsort(mine, kind="stable")[:p] if n > 1 else np.zeros(1, np.int64)
                    tokens, many = s[pick].view(np.int64), -(-df[lo : lo + n][pick] // LIST_BLOCK)
                    lo += n
                    wide = np.flatnonzero(many > 1)
                    block, side, pos = np.zeros(p, np.int32), np.zeros(p, np.int32), np.arange(p, dtype=np.int32)
                    if len(wide):  # a long list: this entry goes to all pairs of blocks that hold its own
                        plain = np.flatnonzero(many <= 1)
                        parts = [(tokens[plain], block[plain], side[plain], pos[plain])]
                        for w in wide.tolist():
                            m = int(many[w])
                            own, others = int.from_bytes(cid[8:12], "little") % m, np.arange(m)
                            parts.append((np.full(m, tokens[w]), (np.minimum(own, others) * m + np.maximum(own, others) + 1).astype(np.int32), np.full(m, own, np.int32), np.full(m, pos[w])))
                        tokens, block, side, pos = (np.concatenate(x) for x in zip(*parts))
                    for c, v in zip(out, (tokens, block, side, np.full(len(tokens), n, np.int32), pos, np.full(len(tokens), int.from_bytes(cid[:8], "big", signed=True)))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["token", "block", "side", "n", "pos", "id"])

    return docs.select("text").mapInArrow(run, "token long, block int, side int, n int, pos int, id long")


def by_position(n_i, n_j, pos_i, pos_j, percent: int) -> np.ndarray:
    """Whether sets that share the shingle at these positions can overlap enough."""
    least = -(-(n_i + n_j) * percent // (100 + percent))
    return np.minimum(pos_i, pos_j) + np.minimum(n_i - pos_i, n_j - pos_j) >= least


def by_sketch(n_i, n_j, x_i: np.ndarray, x_j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches of one width allow the symmetric difference that a link allows."""
    both = n_i + n_j
    return np.bitwise_count(x_i ^ x_j).sum(-1, dtype=np.int64) <= both - 2 * -(-both * percent // (100 + percent))


def position_runs(n: np.ndarray, pos: np.ndarray, percent: int):
    """For a list sorted by size then position: a function from an entry to its candidates before it.

    Entries of one size are one block, sorted by position. Of a block, the positions at which
    the rest of both sets can still overlap enough are one interval, so two binary searches
    skip all else, block by block; blocks of too small a size are skipped as a whole. In a list of
    SHORT_LIST entries at most positions are compared at once instead.
    """
    if len(n) <= SHORT_LIST:  # fewer steps than the searches would take

        def all_before(i: int) -> np.ndarray:
            first = np.searchsorted(n, need(int(n[i]), percent))
            return first + np.flatnonzero(by_position(n[i], n[first:i], pos[i], pos[first:i], percent))

        return all_before
    sizes = np.unique(n)
    span = int(pos.max()) + 2
    key = n * span + pos

    def candidates(i: int) -> np.ndarray:
        first, last = np.searchsorted(sizes, need(int(n[i]), percent)), np.searchsorted(sizes, n[i], "right")
        block = sizes[first:last]
        least = -(-(n[i] + block) * percent // (100 + percent))
        low = np.clip(pos[i] + least - n[i], 0, span - 1)
        high = np.clip(pos[i] + block - least, -1, span - 1)
        a = np.searchsorted(key, block * span + low)
        z = np.minimum(np.searchsorted(key, block * span + high, "right"), i)
        size = np.where(block >= least, np.maximum(0, z - a), 0)
        return np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    return candidates


def list_forest(n: np.ndarray, pos: np.ndarray, bits: list[np.ndarray], side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the possible links of one list, sorted by size then position."""
    size, out = len(n), []
    label = np.arange(size)
    candidates = position_runs(n, pos, percent)
    # Widths grow with n, so the sketches of one width are one run.
    width = np.array([len(x) for x in bits])
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(width)) + 1, [size]))
    runs = [(int(a), int(z), np.stack(bits[a:z])) for a, z in zip(cuts[:-1], cuts[1:])]
    for i in range(1, size):
        js = candidates(i)
        if cross:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        keep = [js[:0]]
        for a, z, matrix in runs:
            own = js[np.searchsorted(js, a) : np.searchsorted(js, z)]
            if len(own):
                keep.append(own[by_sketch(n[i], n[own], fold(bits[i], matrix.shape[1]), matrix[own - a], percent)])
        js = np.concatenate(keep)
        if len(js):
            roots, first = np.unique(label[js], return_index=True)
            out += [(int(js[f]), i) for f in first]
            if len(roots) > 1:
                label[: i + 1][np.isin(label[: i + 1], roots)] = roots[0]
            label[i] = roots[0]
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted batches, many at a time: a table and the starts of its groups (and its end)."""
    held: list[pa.RecordBatch] = []
    waiting = 0

    def cut(last: bool):
        nonlocal held, waiting
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for c in range(keys):
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        end = table.num_rows if last else int(starts[-1])
        done, rest = table.slice(0, end), table.slice(end)
        held, waiting = rest.to_batches(), rest.num_rows
        return done, np.append(starts[starts < end], end)

    limit = rows
    for b in batches:
        if b.num_rows:
            held.append(b)
            waiting += b.num_rows
        if waiting >= limit:
            done, starts = cut(False)
            limit = max(rows, 2 * waiting)  # one long group: don't look at it again for every batch
            if done.num_rows:
                yield done, starts
    if waiting:
        yield cut(True)


def dealt_blocks(table: pa.Table) -> pa.Table:
    """The entries of one whole list, each sent to every pair of blocks that holds its own.

    The list is cut by its measured length, as its shingle's documents weren't counted.
    """
    own = table.column(5).to_numpy()
    m = -(-len(own) // LIST_BLOCK)
    mine = (own.view(np.uint64) >> np.uint64(20)).astype(np.int64) % m
    at, others = np.repeat(np.arange(len(own)), m), np.tile(np.arange(m), len(own))
    low, high = np.minimum(mine[at], others), np.maximum(mine[at], others)
    out = table.take(pa.array(at))
    return out.set_column(1, "block", pa.array((low * m + high + 1).astype(np.int32))).set_column(2, "side", pa.array(mine[at].astype(np.int32)))


def partnered(entries: DataFrame, percent: int) -> DataFrame:
    """The entries that have another class within their bounds in their list, once for each class.

    What is left of a whole list is cut here if it is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, 2):
            sizes = np.diff(starts)
            n, pos, own = (table.column(c).to_numpy().astype(np.int64) for c in (3, 4, 5))
            keep = np.zeros(table.num_rows, bool)
            two = starts[:-1][sizes == 2]
            ok = (own[two] != own[two + 1]) & (n[two] * 100 >= n[two + 1] * percent) & by_position(n[two], n[two + 1], pos[two], pos[two + 1], percent)
            keep[two[ok]] = keep[two[ok] + 1] = True
            for s, e in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist()):
                _, once = np.unique(own[s:e], return_index=True)
                once = s + np.sort(once)
                m = n[once]
                others = np.searchsorted(m, m * 100 // percent, "right") - np.searchsorted(m, -(-m * percent // 100))
                if len(once) <= 64:
                    pairs = by_position(m[:, None], m[None, :], pos[once][:, None], pos[once][None, :], percent) & (np.minimum(m[:, None], m[None, :]) * 100 >= np.maximum(m[:, None], m[None, :]) * percent)
                    others = pairs.sum(1)
                keep[once[others > 1]] = True
            left = np.add.reduceat(keep, starts[:-1], dtype=np.int64) if len(table) else keep
            block = table.column(1).to_numpy()
            for g in np.flatnonzero(left > LIST_BLOCK).tolist():
                s, e = int(starts[g]), int(starts[g + 1])
                if block[s] == 0:
                    picked = table.slice(s, e - s).filter(pa.array(keep[s:e]))
                    keep[s:e] = False
                    yield from dealt_blocks(picked).to_batches(max_chunksize=1 << 16)
            if keep.any():
                yield from table.filter(pa.array(keep)).to_batches()

    dealt = entries.repartition("token", "block").sortWithinPartitions("token", "block", "n", "pos", "id")
    return dealt.mapInArrow(run, entries.schema)


def possible_links(entries: DataFrame, percent: int) -> DataFrame:
    """From (token, block, side, n, pos, cid, sketch): (a, b) classes, a spanning forest of the possible links of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, 2, 1 << 14):
            block, side, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in (1, 2, 3, 4))
            cid, blobs = table.column(5).to_pylist(), table.column(6).to_pylist()
            edges = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = list({cid[x]: x for x in range(e - 1, s - 1, -1)}.values())[::-1]
                if len(own) < 2:
                    continue
                cross = block[s] > 0 and len(np.unique(side[own])) > 1
                edges += [(cid[own[x]], cid[own[y]]) for x, y in list_forest(n[own], pos[own], [np.frombuffer(blobs[x], np.uint64) for x in own], side[own], cross, percent)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.binary()), pa.array([y for _, y in edges], pa.binary())], ["a", "b"])

    dealt = entries.repartition("token", "block").sortWithinPartitions("token", "block", "n", "pos", "cid")
    return dealt.mapInArrow(run, "a binary, b binary")


def needed_sets(docs: DataFrame, k: int, filter_) -> DataFrame:
    """(cid, tokens) of classes that may be in the filter; a class once by each task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(filter_.value, np.uint8), set()
        for b in batches:
            data, off = text_buffers(b.column(0))
            for _, _, part, at in chunks(data, off):
                names, blobs = [], []
                for s in shingle_sets(part, at, k):
                    if not len(s):
                        continue
                    cid = digest(s)
                    place = int.from_bytes(cid[:4], "big") & (FILTER_BITS - 1)
                    if bitmap[place >> 3] >> (place & 7) & 1 and cid not in seen:
                        if len(seen) > 1 << 18:
                            seen.clear()
                        seen.add(cid)
                        names.append(cid)
                        blobs.append(s.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(blobs, pa.binary())], ["cid", "tokens"])

    return docs.select("text").mapInArrow(run, "cid binary, tokens binary")


def class_filter(nodes: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS over the classes' digests."""
    place = F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = nodes.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("q")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[r.q * 4096 : r.q * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def group_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Exact links of every set, sorted by size, with the others (of the other side, if given), and a spanning forest."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    degree, forest, label = np.zeros(m, np.int64), [], np.arange(m)
    if m == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * c >= percent * (n.sum() - c):
            return np.ones(2, np.int64), [(0, 1)]
        return degree, forest
    flat = np.concatenate(sets)
    distinct, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(m), n)[order]
    cut = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(distinct)))))
    first = np.concatenate(([0], np.cumsum(n)))

    def entries(tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([owner[cut[t] : cut[t + 1]] for t in tokens.tolist()]) if len(tokens) else owner[:0]

    pivots: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i in range(m):
        mine = token[first[i] : first[i + 1]]
        lo, hi = np.searchsorted(n, [need(int(n[i]), percent), n[i] * 100 // percent + 1])
        best = min(((int(n[i] + n[q] - 2 * c[i]), x) for x, (q, c, _) in enumerate(pivots)), default=None)
        if best and 2 * best[0] < n[i]:  # answers of a highly similar set, corrected where the two differ
            q, c, other = pivots[best[1]]
            c = c.copy()
            np.add.at(c, entries(np.setdiff1d(mine, other, assume_unique=True)), 1)
            np.subtract.at(c, entries(np.setdiff1d(other, mine, assume_unique=True)), 1)
            if 4 * best[0] > n[i]:
                pivots = pivots[-PIVOTS + 1 :] + [(i, c, mine)]
        else:
            c = np.bincount(entries(mine), minlength=m)
            pivots = pivots[-PIVOTS + 1 :] + [(i, c, mine)]
        near = c[lo:hi]
        js = lo + np.flatnonzero(100 * near >= percent * (n[i] + n[lo:hi] - near))
        js = js[js != i]
        if side is not None:
            js = js[side[js] != side[i]]
        degree[i] = len(js)
        js = js[js < i]
        if len(js):
            roots, at = np.unique(label[js], return_index=True)
            forest += [(int(js[x]), i) for x in at]
            if len(roots) > 1:
                label[: i + 1][np.isin(label[: i + 1], roots)] = roots[0]
            label[i] = roots[0]
    return degree, forest


def exact_links(placed: DataFrame, percent: int) -> DataFrame:
    """From (part, block, side, n, cid, tokens): (cid, links, other): each set's links in its task, and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, 2, 4096):
            cids, blobs = table.column(4).to_pylist(), table.column(5)
            block, side = table.column(1).to_numpy(), table.column(2).to_numpy()
            names, links, others = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = list({cids[x]: x for x in range(e - 1, s - 1, -1)}.values())[::-1]
                if len(own) < 2:
                    continue
                sides = side[own]
                two = block[s] > 0 and len(np.unique(sides)) > 1
                degree, forest = group_links([np.frombuffer(blobs[x].as_py(), np.uint64) for x in own], sides if two else None, percent)
                if block[s] > 0 and not two and not _diagonal(int(block[s]), int(sides[0])):
                    continue
                names += [cids[x] for x in own] + [cids[own[y]] for _, y in forest]
                links += degree.tolist() + [0] * len(forest)
                others += [None] * len(own) + [cids[own[x]] for x, _ in forest]
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array(others, pa.binary())], ["cid", "links", "other"])

    dealt = placed.repartition("part", "block").sortWithinPartitions("part", "block", "n", "cid")
    return dealt.select("part", "block", "side", "n", "cid", "tokens").mapInArrow(run, "cid binary, links long, other binary")


def _diagonal(block: int, side: int) -> bool:
    """Whether the pair of blocks is side with itself; see ``place``."""
    return (block - 1) // (1 << 15) == (block - 1) % (1 << 15) == side


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row.

    A row's set is its distinct k-word shingles (words: runs without ASCII white space, A-Z
    lower-cased; with fewer words the whole sequence). Two rows link when
    100 * |intersection| >= percent * |union|. component_id is the smallest doc_id that
    links reach; n_links counts the other sets that a row's set links to (rows with equal
    sets are one). Null and empty texts and texts of white space have no set, no links, and
    are their own component. Null doc_ids take part as texts but name no component unless
    nothing else does. Ids may be of any type that can be ordered and isn't nested. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "jaccard")
    own_id = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.col(id_col)
    docs = docs.select(own_id.alias("doc_id"), F.col(text_col).alias("text"))
    ranges = 1 << max(2, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    first = tables.write(first_pass(docs, k, percent, ranges))
    heavy = spark.sparkContext.broadcast(heavy_slots(first.where("range is not null"), tables))
    rows = tables.write(first.where("range is null").select("doc_id", "n", "cid"))
    alike = first.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = tables.write(alike)
    tables.drop(first)

    alive = partnered(index_entries(docs, k, percent, heavy), percent)
    half = F.conv(F.hex(F.substring("cid", 1, 8)), 16, -10).cast("long")
    drawn = classes.where("sketch is not null").select(half.alias("id"), "cid", "sketch")
    forest = tables.write(possible_links(alive.join(drawn, "id").select("token", "block", "side", "n", "pos", "cid", "sketch"), percent))
    nodes = tables.write(components(forest, tables))
    tables.drop(forest)
    bits = spark.sparkContext.broadcast(class_filter(nodes))

    sized = nodes.join(classes, nodes["node"] == classes["cid"]).select("cid", F.col("component").alias("part"), "n")
    blocks = F.expr(f"cast(greatest((w + {GROUP_BLOCK - 1}) div {GROUP_BLOCK}, (c + {GROUP_SETS - 1}) div {GROUP_SETS}) as int)")
    weight = sized.groupBy("part").agg(F.sum("n").alias("w"), F.count("*").alias("c")).select("part", blocks.alias("m"))
    sized = sized.join(weight, "part")
    own = F.conv(F.hex(F.substring("cid", 5, 4)), 16, 10).cast("long") % F.col("m")
    sets = needed_sets(docs, k, bits).join(sized, "cid").withColumn("side", own.cast("int"))
    pairs = F.when(F.col("m") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.least(F.col("side"), j) * (1 << 15) + F.greatest(F.col("side"), j) + 1))
    placed = sets.select(F.xxhash64("part").alias("part"), F.explode(pairs).alias("block"), "side", "n", "cid", "tokens")
    links = tables.write(exact_links(placed, percent))

    named = links.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    rep = classes.select(F.col("cid").alias("a"), F.col("rep").alias("ra"))
    linked = named.join(rep, "a").join(rep.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    parts = components(linked, tables)
    degree = links.groupBy("cid").agg(F.sum("links").alias("n_links"))
    named = classes.select("cid", "rep").join(degree, "cid", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = tables.write(named.select("cid", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    tables.drop(links)
    # Rows without a set need no look-up, so their null keys meet in no task.
    none = rows.where("cid is null").select("doc_id", "n", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = rows.where("cid is not null").join(named, "cid").select("doc_id", "n", "component", "n_links").union(none)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all rows of ``documents`` by 3-word shingles at 90 percent; see ``jaccard_components``."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) end) as g from w),
classes as (select min(doc_id) as rep, any_value(g) as g from (select doc_id, g, list_sort(g) as k from grams where len(g) > 0) group by k),
parts as (select rep, len(g) as n, unnest(g) as s from classes),
links as (select a.rep as a, b.rep as b from parts a join parts b on a.s = b.s and a.rep <> b.rep group by 1, 2 having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a as rep, least(a, min(b)) as component_id from reach group by 1),
degree as (select a as rep, count(*) as n_links from links group by 1),
own as (select g.doc_id, len(g.g) as n, min(g.doc_id) over (partition by list_sort(g.g)) as rep from grams g)
select o.doc_id, o.n::bigint as n_shingles, case when o.n = 0 then o.doc_id else coalesce(c.component_id, o.rep) end as component_id, case when o.n = 0 then 0 else coalesce(d.n_links, 0) end::bigint as n_links
from own o left join component c on c.rep = o.rep left join degree d on d.rep = o.rep
"""
