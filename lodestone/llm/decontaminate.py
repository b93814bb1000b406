"""Benchmark decontamination by a positional inverted index.

The index is document-partitioned: each row holds the postings of all words of a run of
documents, sorted by term and position, so it serves any benchmark. Positions go on from
document to document with one empty place between, so no phrase crosses a border. It is
written once, needs no shuffle, and a query reads nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Tables, chunks, lower_ascii, small_batches, text_buffers, word_bounds, word_hashes

#: Words of a window; an item of fewer words is one window.
WINDOW = 8
#: Bytes of text that one index row covers.
ROW_BYTES = 4 << 20
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in as many blocks.
BLOCK_BYTES = 8 << 20
#: Windows looked up at once.
WINDOW_RUN = 20_000


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each row (and the end)."""
    data = lower_ascii(data)
    starts, ends, _ = word_bounds(data, off, ALNUM)
    return word_hashes(data, starts, ends), np.searchsorted(starts, off)


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    data, off = text_buffers(pa.array(texts, pa.string()))
    h, first = words_of(data, off)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def _shrink(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _grow(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def build_index(docs: DataFrame) -> DataFrame:
    """Index rows (doc_ids, n_words, terms, sizes, gaps, index_id) over all words of whole texts.

    ``gaps`` are the steps between ascending positions of each term, its first position first.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = text_buffers(b.column(1))
            for lo, hi, part, at in chunks(data, off, ROW_BYTES):
                hashes, sizes = [], []
                for _, _, small, cut in chunks(part, at):
                    h, first = words_of(small, cut)
                    hashes.append(h)
                    sizes.append(np.diff(first))
                h, n = np.concatenate(hashes), np.concatenate(sizes)
                place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
                order = np.argsort(h, kind="stable")
                t, p = h[order], place[order]
                new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
                gaps = np.diff(p, prepend=0)
                gaps[new] = p[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(b.schema.field(0).type)), pa.array([_shrink(n)], pa.binary()), pa.array([t[new].tobytes()], pa.binary()), pa.array([_shrink(np.diff(np.append(new, len(t))))], pa.binary()), pa.array([_shrink(gaps)], pa.binary()), pa.array([made])],
                    ["doc_ids", "n_words", "terms", "sizes", "gaps", "index_id"],
                )
                made += 1

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_ids array<{kind}>, n_words binary, terms binary, sizes binary, gaps binary, index_id long")


class Postings:
    """One index row, opened for the terms of a query."""

    def __init__(self, n_words: bytes, terms: bytes, sizes: bytes, gaps: bytes, known: np.ndarray):
        self.n = _grow(n_words).astype(np.int64)
        #: First place of each document, and the end of the last.
        self.base = np.concatenate(([0], np.cumsum(self.n + 1)))
        size = _grow(sizes).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(size)))
        own = np.frombuffer(terms, np.uint64)
        # The few query terms are looked for in the row's many.
        at = np.minimum(np.searchsorted(own, known), max(0, len(own) - 1))
        have = np.flatnonzero(own[at] == known) if len(own) else np.zeros(0, np.int64)
        #: Of each query term: first posting (among those of query terms) and number.
        self.first, self.size = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        self.size[have] = size[at[have]]
        self.first[have] = np.cumsum(self.size[have]) - self.size[have]
        steps = np.cumsum(_grow(gaps).astype(np.int64))
        before = np.concatenate(([0], steps))[starts[at[have]]]
        number = self.size[have]
        of = np.repeat(np.arange(len(have)), number)
        self.places = steps[starts[at[have]][of] + np.arange(len(of)) - self.first[have][of]] - before[of]
        # One sorted list of (term, place), terms numbered among those found: an offset-adjusted lookup is a binary search.
        self.rank = np.full(len(known), -1, np.int64)
        self.rank[have] = np.arange(len(have))
        self.keys = of << 40 | self.places

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each of the terms, one list after the other, and which term of the argument each is of."""
        size = self.size[term]
        of = np.repeat(np.arange(len(term)), size)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        return self.places[self.first[term][of] + inside], of

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place holds its term."""
        rank = self.rank[term]
        key = rank << 40 | np.maximum(place, 0)
        at = np.searchsorted(self.keys, key)
        return (rank >= 0) & (place >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)

    def phrases(self, terms: np.ndarray, order: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) of all exact matches.

        terms: rows of term numbers, padded; order: their offsets from the rarest term on.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(terms), WINDOW_RUN):
            row = np.arange(lo, min(len(terms), lo + WINDOW_RUN))
            row = row[self.size[terms[row, order[row, 0]]] > 0]
            place, of = self.lists(terms[row, order[row, 0]])
            row = row[of]
            place = place - order[row, 0]
            for step in range(1, terms.shape[1]):
                live = step < length[row]
                offset = order[row, step]
                ok = ~live
                ok[live] = self.holds(terms[row[live], offset[live]], (place + offset)[live])
                row, place = row[ok], place[ok]
            found.append((row, place))
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self, terms: np.ndarray, order: np.ndarray, length: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its rarest term) where every term is at most ``within`` words away in the same document."""
        row = np.arange(len(terms))
        place, of = self.lists(terms[row, order[row, 0]])
        row = row[of]
        for step in range(1, terms.shape[1]):
            live = np.flatnonzero(step < length[row])
            term, ok = terms[row[live], order[row[live], step]], np.ones(len(row), bool)
            rank = self.rank[term]
            doc = np.searchsorted(self.base, place[live], "right") - 1
            low = np.maximum(place[live] - within, self.base[doc])
            high = np.minimum(place[live] + within, self.base[doc + 1] - 2)
            ok[live] = (rank >= 0) & (np.searchsorted(self.keys, rank << 40 | low) < np.searchsorted(self.keys, rank << 40 | high, "right"))
            row, place = row[ok], place[ok]
        return row, place


class Phrases:
    """Distinct phrases of the items, with their terms from the rarest on."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        rows: dict[tuple, list[int]] = {}
        for i, (_, h) in enumerate(items):
            w = h.tolist()
            for x in range(max(1, len(w) - window + 1)) if w else ():
                rows.setdefault(tuple(w[x : x + window]), []).append(i)
        self.names = [name for name, _ in items]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.known = np.unique(np.array([t for r in rows for t in r], np.uint64))
        self.terms = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.terms[i, : len(r)] = np.searchsorted(self.known, np.array(r, np.uint64))
        own = [sorted(set(x)) for x in rows.values()]
        self.cut = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.items = np.array([y for x in own for y in x], np.int64)
        self.order = np.tile(np.arange(window), (len(rows), 1))

    def rank(self, counts: dict[int, int]) -> None:
        """Order each phrase's terms by their counts in all documents."""
        number = np.array([counts.get(int(t), 0) for t in self.known.view(np.int64)], np.int64)
        if len(self.terms):
            cost = np.where(np.arange(self.terms.shape[1]) < self.length[:, None], number[self.terms], 1 << 62)
            self.order = np.argsort(cost, axis=1, kind="stable")


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each of the sorted terms (of one benchmark block) in all documents."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wanted = np.zeros(len(sent.value), np.int64), sent.value
        for b in batches:
            for own, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, number = np.frombuffer(own, np.uint64), _grow(sizes).astype(np.int64)
                if len(own) and len(wanted):
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    total += np.where(own[at] == wanted, number[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    return {r.term: r.n for r in index.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def search(index: DataFrame, phrases: Phrases, within: int | None = None) -> DataFrame:
    """Each indexed document's (index_id, place, doc_id, n_words, n_hit, items, spans).

    index_id and place: its index row and its place there, which tell repeated ids apart.
    items: sorted names of items with a phrase in the document. spans: word ranges (start,
    end exclusive) that phrases cover, merged; with ``within``, phrases match in proximity and
    a span is the rarest term's word. n_hit: words in spans.
    """
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        names = np.array([str(x) for x in q.names], object)
        for b in batches:
            for i in range(b.num_rows):
                p = Postings(*[b.column(c)[i].as_py() for c in range(1, 5)], q.known)
                if within is None:
                    row, place = p.phrases(q.terms, q.order, q.length)
                    size = q.length[row]
                else:
                    row, place = p.near(q.terms, q.order, q.length, within)
                    size = np.ones(len(row), np.int64)
                covered = np.zeros(int(p.base[-1]) + 1, np.int64)
                np.add.at(covered, place, 1)
                np.add.at(covered, place + size, -1)
                inside = np.cumsum(covered) > 0
                n_hit = np.add.reduceat(inside[:-1], p.base[:-1], dtype=np.int64) if len(p.n) else p.n
                step = np.diff(inside.astype(np.int8), prepend=0)
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                doc_of_span = np.searchsorted(p.base, begin, "right") - 1
                many = q.cut[row + 1] - q.cut[row]
                doc = np.repeat(np.searchsorted(p.base, place, "right") - 1, many)
                item = q.items[np.repeat(q.cut[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                pair = np.unique(doc * max(1, len(names)) + item)
                items: list[list[str]] = [[] for _ in p.n]
                for x in pair.tolist():
                    items[x // len(names)].append(names[x % len(names)])
                spans: list[list[dict]] = [[] for _ in p.n]
                for d, s, e in zip(doc_of_span.tolist(), begin.tolist(), end.tolist()):
                    spans[d].append({"start": s - int(p.base[d]), "end": e - int(p.base[d])})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p.n), b.column(5)[i].as_py())), pa.array(np.arange(len(p.n))), b.column(0)[i].values, pa.array(p.n), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["index_id", "place", "doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return index.mapInArrow(run, f"index_id long, place long, doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def item_blocks(benchmark: DataFrame, window: int, whole_only: bool = False) -> Iterator[Phrases]:
    """The benchmark's items in blocks whose text is about BLOCK_BYTES."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = 1 + size // BLOCK_BYTES
    for x in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == x).collect()
        items = list(zip([r.item_id if r.item_id is not None else "" for r in got], text_words([r.text for r in got])))
        yield Phrases([i for i in items if len(i[1]) >= window or not whole_only], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, whole_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans of every document row.

    Words are runs of 0-9, a-z and code points beyond ASCII after A-Z is lower-cased. Every
    run of ``window`` words of an item is a phrase; an item of fewer words is one phrase (left
    out with ``whole_only``), an item without words none. n_hit counts the document's words
    inside any occurrence. Null and empty texts have no words; repeated rows are each
    reported; a null item_id is named by the empty string. Benchmark rows of one item_id are one item. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession, "decontaminate")
    index = tables.write(build_index(docs))
    parts = []
    for phrases in item_blocks(benchmark, window, whole_only):
        phrases.rank(term_counts(index, phrases.known))
        parts.append(search(index, phrases))
    out = parts[0]
    if len(parts) > 1:
        both = tables.write(parts[0])
        for p in parts[1:]:
            both = both.unionByName(tables.write(p))
        merged = both.groupBy("index_id", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        covered = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
        out = merged.withColumn("n_hit", covered)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in every row of ``documents``; see ``contamination`` for nulls, repeats and empty tables."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", names.alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), " + _LETTERS + "), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
with b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
windows as (select distinct item, list_slice(w, i, i + 7) as v from (select item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct len(v) as n from windows),
d as (select doc_id, {_WORDS} as w from documents),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hits as (select p.doc_id, p.i, p.n, x.item from places p join windows x on x.v = list_slice(p.w, p.i, p.i + p.n - 1)),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by 1),
items as (select doc_id, list_sort(list(distinct item)) as items from hits group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(len(i.items), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(i.items, ','), '')) as items_sha256, coalesce(len(i.items), 0) >= 2 as contaminated
from d left join covered c using (doc_id) left join items i using (doc_id)
"""
