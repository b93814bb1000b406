"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is a sum of learned weights of its byte n-grams (with its
borders), its prefix and suffix, and of the word itself if the lexicon has it. Learned
transitions tie neighbouring words, so words of code-switched text are labelled by
forward-backward. A document is one chain of all its words; it is worked off in blocks of
BLOCK words whose messages are carried over the borders exactly.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Tables, chunks, small_batches, text_buffers, word_bounds, word_hashes

#: Words of a block of a chain (all blocks advance together), and of a training chain.
BLOCK = 64
#: The sample that training starts from: rows in all (shared among the languages) and bytes of a text that are used at most.
TRAIN_ROWS, TRAIN_BYTES = 800, 1 << 14
#: Rows of each language, whatever TRAIN_ROWS says.
LEAST_ROWS = 20
#: Passes over the sample, chains of a step, and the learning rate.
EPOCHS, STEP_CHAINS, RATE = 3, 256, 0.5
#: Slots of the hashed n-gram and affix tables.
SLOTS = 1 << 16
#: Share of words whose lexicon weight a training step leaves out, so that n-grams learn too.
LEXICON_DROP = 0.4
#: Words of the lexicon at most, the most frequent ones; words that a task counts before it writes them.
LEXICON_MOST, COUNTED = 1 << 18, 1 << 20
#: Bytes of text of a step over all rows, and slots of a table that are averaged in one task.
STEP_BYTES, SLOT_RANGE = CHUNK_BYTES // 2, 1 << 13
#: How far from chance to the labelled texts' median sureness a text's own must be to count as text of the learned languages.
LEAST_SURE = 0.62

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CASE = np.full(256, 32, np.uint8)
_CASE[97:123] = np.arange(97, 123)
_CASE[65:91] = np.arange(97, 123)
_CASE[128:] = np.arange(128, 256)


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1), anything else as a space."""
    out = _CASE[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 0x20
    return out


def _slot(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), np.uint32)
    for p in parts:
        x = (x ^ p) * np.uint32(0x01000193) + np.uint32(0x9E3779B1)
    return (x ^ (x >> np.uint32(15))) & np.uint32(SLOTS - 1)


@dataclass
class Words:
    """Words of a run of documents with their features."""

    row: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    pairs: np.ndarray  # byte bigram at every place of the padded bytes
    triples: np.ndarray  # slot of the trigram around every place
    prefix: np.ndarray
    suffix: np.ndarray
    key: np.ndarray


def featured(data: np.ndarray, off: np.ndarray) -> Words:
    text = plain_letters(data)
    starts, ends, row = word_bounds(data, off, _LETTER)
    # Four spaces on each side; a document's last word and the next one's first don't see each other.
    pad = np.concatenate((np.full(4, 32, np.uint8), text, np.full(4, 32, np.uint8))).astype(np.uint32)
    pairs = (pad[:-1] << np.uint32(8) | pad[1:]).astype(np.uint16)
    triples = np.zeros(len(pad), np.uint16)
    triples[1:-1] = _slot(pad[:-2], pad[1:-1], pad[2:])
    a, z, size = starts + 4, ends + 4, ends - starts
    at = [np.where(size > k, pad[a + k], np.uint32(32)) for k in range(4)]
    tail = [np.where(size > k, pad[z - 1 - k], np.uint32(32)) for k in range(4)]
    return Words(row, starts + 4, ends + 4, pairs, triples, _slot(*at).astype(np.int64), _slot(*tail).astype(np.int64), word_hashes(text, starts, ends))


def joined(parts: list[Words], rows: list[int]) -> Words:
    """Words of several runs of documents as one; rows: the first document of each run."""
    at, cols = 0, {name: [] for name in Words.__dataclass_fields__}
    for w, first in zip(parts, rows):
        moved = {"row": w.row + first, "starts": w.starts + at, "ends": w.ends + at, "pairs": np.append(w.pairs, np.uint16(0))}
        for name, col in cols.items():
            col.append(moved.get(name, getattr(w, name)))
        at += len(w.triples)
    return Words(**{name: np.concatenate(col) if col else np.zeros(0, np.int64) for name, col in cols.items()})


class Model:
    """Weights of the field; tables are sized by parameters, never by the corpus."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.tables = [np.zeros((size, n), np.float32) for size in (1 << 16, SLOTS, SLOTS, SLOTS, len(lexicon) + 1)]
        self.turn, self.begin = np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        self.usual = 0.0  # median sureness of labelled texts; see ``median_sure``

    def least_sure(self) -> float:
        """The sureness below which a text is in no learned language. It needs two languages: one alone is always sure."""
        chance = 1 / max(1, len(self.langs))
        return chance + LEAST_SURE * (self.usual - chance) if self.usual else 0.0

    def entry(self, key: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon; its length for words it doesn't have (their weight stays 0)."""
        if not len(self.lexicon):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, key), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == key, at, len(self.lexicon))

    def emissions(self, w: Words, entry: np.ndarray) -> np.ndarray:
        out = self.tables[2][w.prefix] + self.tables[3][w.suffix] + self.tables[4][entry]
        for index, table, lo in ((w.pairs, self.tables[0], 1), (w.triples, self.tables[1], 0)):
            for k in range(len(self.langs)):
                run = np.cumsum(table[:, k][index], dtype=np.float64)
                out[:, k] += run[w.ends - 1] - run[w.starts - 1 - lo]
        return out


def blocks(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and place in it of each word, given the words' documents in order, and each block's number in its document."""
    if not len(row):
        return row, row, row
    new = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    number, place = place // BLOCK, place % BLOCK
    return np.cumsum(place == 0) - 1, place, number[place == 0]


def unit(x: np.ndarray, axes: int | tuple[int, int]) -> np.ndarray:
    """x scaled to sum 1 over the axes; a tiny floor keeps it above 0."""
    x = x + 1e-30
    return x / x.sum(axes, keepdims=True)


def forward_backward(emission: np.ndarray, chain: np.ndarray, place: np.ndarray, turn: np.ndarray, begin: np.ndarray, pairs: bool = False, number: np.ndarray | None = None):
    """Posterior of each word's labels; with ``pairs`` also the expected transitions and the first words' posteriors.

    All chains advance together, scaled at each step. With ``number`` chains are blocks: one
    whose number isn't 0 goes on where the one before ends. The products of their emissions and
    transitions say how blocks pass messages on; these are chained over each document's
    blocks first, so every block starts and ends with the messages of the whole document.
    """
    n, labels = int(chain[-1]) + 1, emission.shape[1]
    steps = int(place.max()) + 1
    size = np.bincount(chain, minlength=n)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    alive = [int(np.searchsorted(-size[order], -t, "left")) for t in range(steps)]
    e = np.zeros((steps, n, labels), np.float32)
    e[place, rank[chain]] = np.exp(emission - emission.max(1, keepdims=True))
    t_ = np.exp(turn - turn.max())
    first = np.tile(np.exp(begin - begin.max()), (n, 1))
    a, b = np.zeros_like(e), np.ones_like(e)
    if number is not None and number.any():
        many = np.zeros(n, bool)
        many[:-1] |= number[1:] > 0
        many |= number > 0
        own = np.flatnonzero(many[order])  # places in the order of size of the blocks of longer documents
        at = np.full(n, -1)
        at[order[own]] = np.arange(len(own))
        moves = np.zeros((len(own), labels, labels), np.float32)
        moves[:, np.arange(labels), np.arange(labels)] = e[0, own]
        for t in range(1, steps):
            m = int(np.searchsorted(own, alive[t]))
            moves[:m] = unit((moves[:m] @ t_) * e[t, own[:m], None, :], (1, 2))
        last = int(number.max())
        by_number = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[by_number], np.arange(last + 2))
        for k in range(1, last + 1):
            now = by_number[cut[k] : cut[k + 1]]
            sent = np.einsum("ij,ijk->ik", first[rank[now - 1]], moves[at[now - 1]])
            first[rank[now]] = unit(unit(sent, 1) @ t_, 1)
        back = np.ones((n, labels), np.float32)
        for k in range(last, 0, -1):
            now = by_number[cut[k] : cut[k + 1]]
            back[now - 1] = unit(unit(np.einsum("ijk,ik->ij", moves[at[now]], back[now]), 1) @ t_.T, 1)
        b[size - 1, rank] = back
    now = e[0] * first
    a[0] = now / np.maximum(now.sum(1, keepdims=True), 1e-30)
    for t in range(1, steps):
        m = alive[t]
        now = (a[t - 1, :m] @ t_) * e[t, :m] + 1e-30
        a[t, :m] = now / now.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        m = alive[t + 1]
        now = (e[t + 1, :m] * b[t + 1, :m]) @ t_.T + 1e-30
        b[t, :m] = now / now.sum(1, keepdims=True)
    post = a * b
    post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
    out = post[place, rank[chain]]
    if not pairs:
        return out
    expected = np.zeros((labels, labels))
    for t in range(1, steps):
        m = alive[t]
        joint = a[t - 1, :m, :, None] * t_ * (e[t, :m] * b[t, :m])[:, None, :]
        expected += (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)).sum(0)
    return out, expected, post[0].sum(0)


class Learner:
    """A model in training, with the sums of AdaGrad and how often each slot was met."""

    def __init__(self, model: Model):
        self.model = model
        self.sums = [np.full_like(t, 1e-2) for t in model.tables]
        self.turn_sum, self.begin_sum = np.full_like(model.turn, 1e-2), np.full_like(model.begin, 1e-2)
        self.met = [np.zeros(len(t), np.int64) for t in model.tables]
        self.chains = 0

    def step(self, w: Words, word: np.ndarray, c: np.ndarray, p: np.ndarray, gold: np.ndarray, entry: np.ndarray, rng: np.random.Generator) -> None:
        """One step by the chains of words ``word`` of w; c, p: chain and place in it of each; gold, entry: of each word of w."""
        model, n, labels = self.model, int(c[-1]) + 1, len(self.model.langs)
        sub = Words(w.row[word], w.starts[word], w.ends[word], w.pairs, w.triples, w.prefix[word], w.suffix[word], w.key[word])
        use = np.where(rng.random(len(word)) < LEXICON_DROP, len(model.lexicon), entry[word])
        post, expected, starts = forward_backward(model.emissions(sub, use), c, p, model.turn, model.begin, True)
        slope = post.astype(np.float64)
        slope[np.arange(len(word)), gold[word]] -= 1
        y = gold[word]
        same = p[1:] > 0
        seen = np.zeros_like(model.turn, np.float64)
        np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
        for value, total, grad in ((model.turn, self.turn_sum, (expected - seen) / n), (model.begin, self.begin_sum, (starts - np.bincount(y[p == 0], minlength=labels)) / n)):
            total += grad**2
            value -= RATE * grad / np.sqrt(total)
        size = sub.ends - sub.starts
        at = np.repeat(sub.starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        of = np.repeat(np.arange(len(word)), size)
        border = np.concatenate((at, sub.starts - 1))
        indices = [(w.pairs[border], np.concatenate((of, np.arange(len(word))))), (w.triples[at], of), (sub.prefix, None), (sub.suffix, None), (use, None)]
        for x, (index, source) in enumerate(indices):
            g = slope if source is None else slope[source]
            grad = np.stack([np.bincount(index, g[:, k], minlength=len(model.tables[x])) for k in range(labels)], 1) / n
            if x == 4:
                grad[-1] = 0
            self.sums[x] += (grad**2).astype(np.float32)
            model.tables[x] -= (RATE * grad / np.sqrt(self.sums[x])).astype(np.float32)
            self.met[x] += np.bincount(index, minlength=len(model.tables[x]))
        self.chains += n

    def changes(self, start: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, range, slots, times met, change since start) of the slots met; tables 5 and 6 are turn and begin."""
        for x, (now, was, met) in enumerate(zip(self.model.tables, start.tables, self.met)):
            slots = np.flatnonzero(met)
            cut = np.searchsorted(slots, np.arange(0, len(now) + SLOT_RANGE, SLOT_RANGE))
            for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])):
                if z > a:
                    yield x, r, slots[a:z], met[slots[a:z]], now[slots[a:z]] - was[slots[a:z]]
        if self.chains:
            for x, now, was in ((5, self.model.turn, start.turn), (6, self.model.begin, start.begin)):
                yield x, 0, np.zeros(1, np.int64), np.array([self.chains]), (now - was).reshape(1, -1)


def started(texts: list[str], langs: list[str], seed: int = 7, lexicon: np.ndarray | None = None) -> Learner:
    """The field fitted by AdaGrad on the likelihood of chains of a few texts.

    Half of the chains are made of runs of words from texts of several languages, so that
    transitions between languages are learned; the other half are as they were. Without a
    lexicon the texts' own repeated words are it.
    """
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    runs = list(chunks(*text_buffers(pa.array(texts, pa.string()))))
    w = joined([featured(part, at) for _, _, part, at in runs], [lo for lo, *_ in runs])
    keys, number = np.unique(w.key, return_counts=True)
    model = Model(names, keys[number >= 2] if lexicon is None else lexicon)
    learner = Learner(model)
    if len(names) < 2 or not len(w.row):
        return learner
    rng = np.random.Generator(np.random.PCG64(seed))
    entry, gold = model.entry(w.key), label[w.row]
    _, place, _ = blocks(w.row)
    first = np.append(np.flatnonzero(place == 0), len(place))
    runs = list(zip(first[:-1].tolist(), first[1:].tolist()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for lo in range(0, len(order), STEP_CHAINS):
            picked, sequences = [runs[i] for i in order[lo : lo + STEP_CHAINS]], []
            for x, (s, z) in enumerate(picked):
                if x % 2:
                    sequences.append(np.arange(s, z))
                else:
                    parts, room = [], BLOCK
                    while room > 0:
                        s, z = picked[int(rng.integers(len(picked)))]
                        a = int(rng.integers(s, z))
                        part = np.arange(a, min(z, a + int(rng.integers(3, 24)), a + room))
                        parts.append(part)
                        room -= len(part)
                    sequences.append(np.concatenate(parts))
            word = np.concatenate(sequences)
            c = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
            p = np.concatenate([np.arange(len(s)) for s in sequences])
            learner.step(w, word, c, p, gold, entry, rng)
    return learner


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """A model learned from a few texts alone."""
    return started(texts, langs, seed).model


def all_chains(place: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, chain, place) of all runs of words as they are, then of half as many made of parts of them."""
    first = np.flatnonzero(place == 0)
    end = np.append(first[1:], len(place))
    m = -(-len(first) // 2)
    run = rng.integers(len(first), size=(m, BLOCK // 3 + 1))
    begin = rng.integers(first[run], end[run])
    size = np.minimum(end[run] - begin, rng.integers(3, 24, size=run.shape))
    after = np.minimum(np.cumsum(size, 1), BLOCK)
    size = np.diff(after, axis=1, prepend=0)
    begin, flat, total = begin.ravel(), size.ravel(), after[:, -1]
    inside = np.arange(int(flat.sum())) - np.repeat(np.cumsum(flat) - flat, flat)
    made = np.repeat(begin, flat) + inside
    chain = np.cumsum(place == 0) - 1
    own = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return np.concatenate((np.arange(len(place)), made)), np.concatenate((chain, len(first) + np.repeat(np.arange(m), total))), np.concatenate((place, own))


def lexicon_of(texts: DataFrame, tables: Tables) -> np.ndarray:
    """Sorted hashes of the words that all texts hold twice or more, LEXICON_MOST at most: whole levels of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, number = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(number)], ["key", "n"])

        for b in batches:
            for _, _, part, at in chunks(*text_buffers(b.column(0))):
                text = plain_letters(part)
                starts, ends, _ = word_bounds(part, at, _LETTER)
                new, n = np.unique(word_hashes(text, starts, ends), return_counts=True)
                keys, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
                number = np.bincount(back, np.concatenate((number, n)), minlength=len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    yield counts()
                    keys, number = keys[:0], number[:0]
        if len(keys):
            yield counts()

    counted = texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2")
    counted = tables.write(counted.withColumn("level", F.floor(F.log2("n") * 8)))
    least, held = None, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # some hundred levels at most
        if held + r["count"] > LEXICON_MOST:
            break
        held, least = held + r["count"], r.level
    got = counted.where(F.col("level") >= least).select("key").toPandas().key.to_numpy() if least is not None else np.zeros(0, np.int64)
    tables.drop(counted)
    return np.sort(got.astype(np.int64).view(np.uint64))


def learned(texts: DataFrame, start: Learner) -> Model:
    """The model after one pass over all rows of (text, lang).

    Every task goes on from the start over all its rows; a weight is then the mean of the tasks'
    own, each by how often it met the slot (iterative parameter mixing). The tasks are the
    input's partitions, so the last digits of weights depend on how the rows are dealt.
    """
    sent = texts.sparkSession.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, task = copy.deepcopy(sent.value), TaskContext.get().partitionId()
        learner.met, learner.chains = [np.zeros_like(x) for x in learner.met], 0
        rng = np.random.Generator(np.random.PCG64([7, task]))
        names = {x: i for i, x in enumerate(learner.model.langs)}
        for b in batches:
            label = np.array([names[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, hi, part, at in chunks(*text_buffers(b.column(0)), STEP_BYTES):
                w = featured(part, at)
                if len(w.row):
                    learner.step(w, *all_chains(blocks(w.row)[1], rng), label[lo:hi][w.row], learner.model.entry(w.key), rng)
        found = list(learner.changes(sent.value.model))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([task] * len(found), pa.int32()), *(pa.array([f[i].astype(kind).tobytes() for f in found], pa.binary()) for i, kind in ((2, "<i8"), (3, "<i8"), (4, "<f4")))], ["t", "r", "task", "slots", "met", "change"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        slots, met, change = ([np.frombuffer(x, kind) for x in table[c].to_pylist()] for c, kind in (("slots", "<i8"), ("met", "<i8"), ("change", "<f4")))
        all_, back = np.unique(np.concatenate(slots), return_inverse=True)
        share = np.concatenate(met)
        moved = np.concatenate([c.reshape(len(s), -1) for s, c in zip(slots, change)]) * share[:, None].astype(np.float64)
        total = np.bincount(back, share)
        out = np.stack([np.bincount(back, moved[:, k]) / total for k in range(moved.shape[1])], 1)
        return pa.table({"t": table["t"][:1], "r": table["r"][:1], "slots": pa.array([all_.astype("<i8").tobytes()], pa.binary()), "change": pa.array([out.astype("<f4").tobytes()], pa.binary())})

    made = texts.select("text", "lang").mapInArrow(run, "t int, r int, task int, slots binary, met binary, change binary")
    model = copy.deepcopy(start.model)
    for g in made.groupBy("t", "r").applyInArrow(mean, "t int, r int, slots binary, change binary").collect():
        slots = np.frombuffer(g.slots, "<i8")
        change = np.frombuffer(g.change, "<f4").reshape(len(slots), -1)
        if g.t < 5:
            model.tables[g.t][slots] += change
        else:
            value = model.turn if g.t == 5 else model.begin
            value += change.reshape(value.shape)
    return model


def is_held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null doc_id isn't learned from either, but isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on all labelled documents that have text and aren't held out; of whole texts, and of every row.

    The lexicon counts the words of all of them. Training starts from a documented sample: the
    same number of documents of each language, chosen by a hash of doc_id, ``rows`` in all, but
    LEAST_ROWS of a language if it has them; of a text of more than TRAIN_BYTES only the beginning,
    TRAIN_BYTES at most; of rows that share doc_id and language one. It says where the pass over all rows begins, see ``learned``."""
    small_batches(docs.sparkSession)
    has = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0) & ~is_held_out(F.col("doc_id"))
    may = docs.where(has).select("doc_id", "lang")
    kinds = may.select("lang").distinct().count()
    if not kinds:
        return Model([], np.zeros(0, np.uint64))
    each = max(LEAST_ROWS, rows // kinds)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = may.withColumn("h", F.xxhash64("doc_id")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("doc_id").collect()
    wanted = sorted({r.doc_id for r in ids})
    start = F.when(F.octet_length("text") <= TRAIN_BYTES, F.col("text")).otherwise(F.substring("text", 1, TRAIN_BYTES // 4))
    picked = docs.where(F.col("doc_id").isin(wanted) & (F.octet_length("text") > 0) & F.col("lang").isNotNull())
    got = picked.select("doc_id", "lang", start.alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.lang, r.text))
    texts = docs.where(has).select("text", "lang")
    first = started([r.text for r in got], [r.lang for r in got], lexicon=lexicon_of(texts, Tables(docs.sparkSession, "langid")))
    return learned(texts, first) if kinds > 1 else first.model


def median_sure(sure: DataFrame) -> float:
    """The median of a table's one column, of all rows above 0, to four digits."""
    found = sure.toDF("s").where("s > 0").groupBy(F.round(F.col("s") * 10000).cast("int").alias("s")).count().orderBy("s").collect()
    number = np.cumsum([r["count"] for r in found])
    return found[int(np.searchsorted(number, (number[-1] + 1) // 2))].s / 10000 if found else 0.0


def read_labels(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a run of documents and the posterior of each word's language."""
    w = featured(data, off)
    if not len(w.row) or not model.langs:
        return w, np.zeros((len(w.row), len(model.langs)), np.float32)
    block, place, number = blocks(w.row)
    return w, forward_backward(model.emissions(w, model.entry(w.key)), block, place, model.turn, model.begin, number=number)


def predictions(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: language, score, number of words and of changes of language between words, sureness."""
    data, off = text_buffers(column)
    n = len(off) - 1
    names = np.array([*model.langs, "und"], object)
    pred, score, words, turns, sure = np.full(n, len(model.langs)), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for lo, hi, part, at in chunks(data, off):
        w, post = read_labels(model, part, at)
        words[lo:hi] = np.bincount(w.row, minlength=hi - lo)
        if not len(w.row) or not model.langs:
            continue
        weight = (w.ends - w.starts).astype(np.float64)
        mass = np.stack([np.bincount(w.row, weight * post[:, k], minlength=hi - lo) for k in range(len(model.langs))], 1)
        total = mass.sum(1)
        best = mass.argmax(1)
        raw = part.tobytes()
        ascii_ = np.concatenate(([0], np.cumsum(_LETTER[part] & (part < 128))))
        has = (ascii_[at[1:]] > ascii_[at[:-1]]) & (total > 0)
        for i in np.flatnonzero(~has & (total > 0)).tolist():
            has[i] = any(c.isalpha() for c in raw[at[i] : at[i + 1]].decode())
        pred[lo:hi] = np.where(has, best, len(model.langs))
        score[lo:hi] = np.where(has, mass.max(1) / np.maximum(total, 1e-9), 0)
        sure[lo:hi] = np.where(has, np.bincount(w.row, weight * post.max(1), minlength=hi - lo) / np.maximum(total, 1e-9), 0)
        label = post.argmax(1)
        turns[lo:hi] = np.bincount(w.row[1:][(label[1:] != label[:-1]) & (w.row[1:] == w.row[:-1])], minlength=hi - lo)
    return names[pred].tolist(), np.clip(score, 0, 1), words, turns, np.clip(sure, 0, 1)


def identify(docs: DataFrame, model: Model | None = None, prefix: str = "lang_") -> DataFrame:
    """docs with lang_pred, lang_score, lang_words, lang_switches and lang_sure; all other columns stay.

    The new columns take the place of others of their names; ``prefix`` gives them other ones.

    lang_pred is the language with most letters by the words' posteriors, lang_score its
    share. lang_sure is the mean over letters of the posterior of their word's likeliest language,
    whichever it is: near 1 for text of learned languages, switched or not, and lower for others
    and for junk. ``und`` and 0 where text is null, empty or without a letter, or nothing could be
    learned. Rows that repeat get equal answers; equal shares go to the first language by name.
    Very long texts are read whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or fit(docs))
    names = [prefix + x for x in ("pred", "score", "words", "switches", "sure")]
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, words, turns, sure = predictions(sent.value, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(words), pa.array(turns), pa.array(sure)], [*b.schema.names, *names])

    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    kinds = (StringType(), DoubleType(), LongType(), LongType(), DoubleType())
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(names, kinds):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans): runs of words of one language in each text, as byte ranges of its UTF-8."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffers(b.column(1))
            for lo, hi, part, at in chunks(data, off):
                w, post = read_labels(sent.value, part, at)
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                label = post.argmax(1) if post.size else np.zeros(len(w.row), np.int64)
                for r, s, e, k in zip(w.row.tolist(), (w.starts - 4).tolist(), (w.ends - 4).tolist(), label.tolist()):
                    lang = sent.value.langs[k] if sent.value.langs else "und"
                    s, e = s - int(at[r]), e - int(at[r])
                    if spans[r] and spans[r][-1]["lang"] == lang:
                        spans[r][-1]["end"] = e
                    else:
                        spans[r].append({"start": s, "end": e, "lang": lang})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,end:long,lang:string>>")


def op1_crf_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, learned from rows that aren't held out; see ``identify`` for nulls and ties."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_words").alias("n_words"), F.col("lang_switches").alias("n_switches"))
