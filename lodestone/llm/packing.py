"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED, Tables, chunks, lower_ascii, small_batches, text_buffers, word_bounds, word_hashes

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 4096, 1
#: The program's size classes and its step, the gap to the bound at which it ends, and its rounds at
#: most: all independent of the input, as is the histogram. Pieces that the rounds leave go by best fit.
CLASSES, STEP, GAP, ROUNDS = 128, 0.05, 0.01, 1000
#: Words whose ids a worker keeps; the store is emptied when it is full.
KEPT_WORDS = 1 << 20


#: The split of word_bpe tokenizers: contractions, runs of letters, single digits, runs of other signs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: unknown, ASCII sign, ASCII digit, letter.
_OTHER, _SIGN, _DIGIT, _LETTER = 0, 1, 2, 3
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte. Both bytes of U+00C0 to U+023F are letters but for the two signs and U+0130,
    whose lower case has a mark; all other code points beyond ASCII are unknown."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    after = data[lead + 1]
    lead = lead[~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((data[lead] == 0xC4) & (after == 0xB0))]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class WordIds:
    """Ids of texts by a tokenizer that drops white space; what it has met is looked up.

    Such a tokenizer's ids of a text are the ids of its words (runs without ASCII white
    space) one after the other, so only new words go through the tokenizer. Where the
    tokenizer splits by SPLIT and lower-cases, words are cut where it cuts anyway, between
    letters, digits and signs, and ASCII letters are lower-cased first; neither is done next
    to a byte of unknown kind (a mark there may join the letter), after an apostrophe, or in
    a word that may hold one of the tokenizer's added tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        lowers = "Lowercase" in [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fine = SPLIT in splits and lowers and spec["model"].get("end_of_word_suffix") == "</w>"
        #: Ids that end a run of letters.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.opens = np.zeros(256, bool)
        self.opens[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = True
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes with first id and number of ids: a large run and the one of late words.
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(r[0]) for r in self.runs)

    def split(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to look up, starts and ends of the parts of words there, and which are letters only."""
        starts, ends, _ = word_bounds(data, off, SPACED)
        if not self.fine or not len(starts):
            return data, starts, ends, np.zeros(len(starts), bool)
        kind = byte_kinds(data)
        whole = np.flatnonzero(self.opens[data])
        if len(whole):
            word = np.unique(np.searchsorted(starts, whole, "right") - 1)
            size = ends[word] - starts[word]
            kind[np.repeat(starts[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = _OTHER
        known, inside = kind > _OTHER, np.zeros(len(data) + 1, bool)
        nxt = np.append(kind[1:], _OTHER)
        nxt[ends - 1] = _SIGN
        cut = np.flatnonzero(known[1:] & known[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & (data[:-1] != 39)) + 1
        inside[starts] = True
        inside[cut] = True
        firsts = np.flatnonzero(inside)
        lasts = np.append(firsts[1:], 0)
        word = np.searchsorted(starts, firsts, "right") - 1
        lasts[:-1] = np.minimum(lasts[:-1], ends[word[:-1]])
        lasts[-1] = ends[-1]
        letters = np.concatenate(([0], np.cumsum(kind == _LETTER)))
        return np.where(known & (nxt > _OTHER), lower_ascii(data), data), firsts, lasts, letters[lasts] - letters[firsts] == lasts - firsts

    def learn(self, hashes: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        """Add new words; hashes are sorted. A plain word is one run of letters, whose last id alone ends it."""
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for pick in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if not len(pick):
                continue
            own = [words[i] for i in pick.tolist()]
            if plain[pick[0]]:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                size[pick] = np.diff(last, prepend=-1)
            else:
                whole = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
                ids = np.array(whole.ids, np.uint32)
                ends = np.cumsum([len(w) + 1 for w in own])
                at = np.array([o[0] for o in whole.offsets], np.int64)
                size[pick] = np.bincount(np.searchsorted(ends, at, "right"), minlength=len(own))
            start[pick] = self.used + np.cumsum(size[pick]) - size[pick]
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        old, late = self.runs
        late = self.merged(late, (hashes, start, size))
        if 4 * len(late[0]) > len(old[0]):
            old, late = self.merged(old, late), tuple(x[:0] for x in late)
        self.runs = [old, late]

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        place = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, place, y) for x, y in zip(a, b))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids, and whether known, of each hash."""
        start, size, found = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for known, s, n in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                start[hit], size[hit] = s[at[hit]], n[at[hit]]
                found |= hit
        return start, size, found

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the first id of each row (and the end)."""
        low, starts, ends, plain = self.split(data, off)
        distinct, pick, back = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self) > KEPT_WORDS:
            self.clear()
        start, size, found = self.look(distinct)
        if not found.all():
            raw, new = low.tobytes(), pick[~found]
            self.learn(distinct[~found], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())], plain[new])
            start, size, found = self.look(distinct)
        word, size = start[back], size[back]
        before = np.concatenate(([0], np.cumsum(size)))
        flat = self.flat[np.repeat(word - before[:-1], size) + np.arange(int(before[-1]))]
        return flat, before[np.searchsorted(starts, off)]


_tools: dict[str, WordIds] = {}


def tool_of(path: str) -> WordIds:
    """A worker's tokenizer and its words, which its next tasks use too.

    Tasks find this function by its name in the module, so they share the worker's one store.
    """
    if path not in _tools:
        _tools[path] = WordIds(path)
    return _tools[path]


def cut_pieces(flat: np.ndarray, first: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(row, piece, start, length, checksum) of the pieces of every row, each row's ids followed by the end id."""
    n = np.diff(first) + 1
    ids = np.full(len(flat) + len(n), END_ID, "<u4")
    ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n - 1)] = flat
    many = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(capacity, n[row] - start)
    begin = np.concatenate(([0], np.cumsum(length)))
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[a:z]) for a, z in zip((4 * begin[:-1]).tolist(), (4 * begin[1:]).tolist())]
    return row, piece, start, length, np.array(crc, np.int64)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): every document's pieces.

    nth counts the pieces of the same length that the task ``part`` has made before.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tool_of(tokenizer_path)
        part, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            data, off = text_buffers(b.column(1))
            for lo, _, text, at in chunks(data, off):
                row, piece, start, size, crc = cut_pieces(*tool.ids(text, at), capacity)
                order = np.argsort(size, kind="stable")
                new = np.flatnonzero(np.diff(size[order], prepend=-1))
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.repeat(new, np.diff(np.append(new, len(size)))) + made[size[order]]
                made += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc), pa.array(np.full(len(size), part, np.int32)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_configuration(value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each class (1, 2, ...) fill the capacity with the greatest value, ``most`` at most of each.

    Bounded knapsack by dynamic programming; copies of a class are tried in binary lots.
    """
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for c in np.flatnonzero((value > 0) & (most > 0)).tolist():
        size, left, lot = c + 1, min(int(most[c]), capacity // (c + 1)), 1
        while left > 0:
            lot = min(lot, left)
            w = lot * size
            better = best[:-w] + lot * value[c] > best[w:] if w <= capacity else None
            if better is None:
                break
            mark = np.zeros(capacity + 1, bool)
            mark[w:] = better
            best[w:] = np.where(better, best[:-w] + lot * value[c], best[w:])
            taken.append((c, lot, mark))
            left, lot = left - lot, lot * 2
    out, room = np.zeros(len(value), np.int64), int(np.argmax(best))
    for c, lot, mark in reversed(taken):
        if mark[room]:
            out[c] += lot
            room -= lot * (c + 1)
    return out


def configuration_program(number: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Fractional solution of min sum x, sum of a x >= number, by multiplicative weights, and its bound.

    A class's weight falls with the covered share of its pieces. Each round prices the
    classes by weight per piece, takes the best configuration, and adds a step of it. Any prices
    bound the program from below by all pieces' worth over the best configuration's; rounds end
    when the solution, scaled to cover all, is within ``gap`` of the best bound, or covers all as it is, or after ROUNDS.
    """
    live = number > 0
    covered, chosen, bound, used = np.zeros(len(number)), defaultdict(float), 0.0, 0.0
    for _ in range(ROUNDS if live.any() else 0):
        share = np.divide(covered, number, out=np.zeros(len(number)), where=live)
        weight = np.where(live, np.exp(-(share - share[live].min()) / STEP), 0)
        value = np.divide(weight, number, out=np.zeros(len(number)), where=live)
        a = best_configuration(value, number, capacity)
        bound = max(bound, weight.sum() / (a * value).sum())
        x = STEP / 4 * (number[a > 0] / a[a > 0]).min()
        covered += x * a
        used += x
        chosen[tuple(a.tolist())] += x
        least = (covered[live] / number[live]).min()
        if least >= 1 or least > 0 and used / least <= (1 + gap) * bound:
            break
    sizes = np.arange(1, len(number) + 1)
    scale = (number * sizes).sum() / max((covered * sizes).sum(), 1e-9)
    return [(np.array(a), x * scale) for a, x in chosen.items()], bound


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) for all pieces of a length histogram: each entry is so many equal sequences.

    The rounded-down program comes first, its slots filled with the longest pieces of their
    classes and the last of them with the longest that fit; what is left goes where it fits best, in the room left there or in new sequences.
    """
    width = -(-capacity // CLASSES)
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[int]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    of = (np.arange(capacity + 1) + width - 1) // width
    number = np.bincount(of, left, minlength=CLASSES + 1)[1:].astype(np.int64)
    #: Open sequences by free room.
    rooms: dict[int, list[list]] = defaultdict(list)
    by_class = [[x for x in range(min(c * width, capacity), (c - 1) * width, -1) if left[x]] for c in range(1, CLASSES + 1)]
    for a, x in sorted(configuration_program(number, capacity // width)[0], key=lambda p: -p[1]):
        times = math.floor(x)
        slots = [c for c in range(CLASSES - 1, -1, -1) for _ in range(int(a[c]))]
        while times > 0:
            use: dict[int, int] = defaultdict(int)
            lengths = []
            for c in slots:
                own = by_class[c]
                while own and not left[own[0]]:
                    own.pop(0)
                pick = next((y for y in own if left[y] > use[y]), None)
                if pick is None:
                    break
                use[pick] += 1
                lengths.append(pick)
            if len(lengths) < len(slots):
                break
            # The smallest slot takes the longest piece that fits, and so on while one fits.
            use[lengths.pop()] -= 1
            room = capacity - sum(lengths)
            for y in np.flatnonzero(left[: room + 1])[::-1].tolist():
                while y <= room and left[y] > use[y]:
                    use[y] += 1
                    lengths.append(y)
                    room -= y
                if room < y and not left[: room + 1].any():
                    break
            use = {y: k for y, k in use.items() if k}
            n = min(times, min(int(left[y]) // k for y, k in use.items()))
            for y, k in use.items():
                left[y] -= n * k
            rooms[capacity - sum(lengths)].append([n, lengths])
            times -= n
    open_rooms = np.array([len(rooms.get(r, ())) for r in range(capacity + 1)])
    for y in range(capacity - 1, 0, -1):
        while left[y]:
            fit = y + int(np.argmax(open_rooms[y:] > 0)) if open_rooms[y:].any() else -1
            if fit < 0:
                per = capacity // y
                n = max(1, int(left[y]) // per)
                per = min(per, int(left[y]))
                lengths, room = [y] * per, capacity - y * per
                left[y] -= n * per
                rooms[room].append([n, lengths])
                open_rooms[room] += 1
                continue
            n, lengths = rooms[fit].pop()
            open_rooms[fit] -= 1
            use = min(n, int(left[y]))
            if n > use:
                rooms[fit].append([n - use, lengths])
                open_rooms[fit] += 1
            rooms[fit - y].append([use, [*lengths, y]])
            open_rooms[fit - y] += 1
            left[y] -= use
    for r in sorted(rooms):
        out += [(n, lengths) for n, lengths in rooms[r]]
    return out


def plan_report(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, float]:
    """How good the plan of a histogram is: sequences, the least that could hold all tokens, the program's
    fractional number and bound for its size classes, and the share of sequences with room left."""
    width = -(-capacity // CLASSES)
    of = (np.arange(capacity + 1) + width - 1) // width
    number = np.bincount(of[:capacity], counts[:capacity], minlength=CLASSES + 1)[1:].astype(np.int64)
    found, bound = configuration_program(number, capacity // width)
    chosen = plan(counts, capacity)
    sequences = sum(n for n, _ in chosen)
    return {
        "sequences": sequences,
        "least": int(-(-(counts * np.arange(capacity + 1)).sum() // capacity)),
        "fractional": float(sum(x for _, x in found) + counts[capacity]),
        "bound": float(bound + counts[capacity]),
        "open_share": sum(n for n, lengths in chosen if sum(lengths) < capacity) / max(1, sequences),
    }


def places(chosen: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For runs of pieces of a length, in order of rank: first rank, first sequence, pieces in each sequence, offset."""
    rows: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, lengths in chosen:
        at = 0
        for y in sorted(set(lengths), reverse=True):
            k = lengths.count(y)
            rows.append((y, rank[y], sequence, k, at))
            rank[y] += k * times
            at += k * y
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": cols[0] << 44 | cols[1], "rank": cols[1], "sequence": cols[2], "each": cols[3], "offset": cols[4]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its ids and the end id; only longer ones than a sequence are cut. Null and
    empty texts are the end id alone. Pieces of one length are alike to the plan, so it is
    made from the histogram of lengths (as many numbers as a sequence has tokens) on the
    driver; each piece finds its place by its rank among pieces of its length. Ranks come from
    counts by task, so no length is gathered in one task. Repeated rows are packed each;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    made = tables.write(pieces(docs, tokenizer_path, capacity))
    by_task = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = tables.write(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    counts = np.zeros(capacity + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    place = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    # Offsets grow with the number of tasks, so they are joined by shuffle.
    ranked = made.join(before.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(p["key"], length << 44 | rank, "right") - 1
            nth = rank - p["rank"][i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["sequence"][i] + nth // p["each"][i]), pa.array(p["offset"][i] + nth % p["each"][i] * length)], [*names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_config_lp_packing(spark, sf_dir: str) -> DataFrame:
    """The place of every piece of every row of ``documents``; see ``pack`` for nulls, repeats and long texts."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
