"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, chunks, small_batches, text_buffers, word_bounds, word_hashes

#: Words whose counts a worker keeps; the store is emptied when it is full.
KEPT_WORDS = 1 << 19


class Automaton:
    """Counts of greedy longest-match pieces, in time linear in the word.

    Vertices are the prefixes of the vocabulary, of pieces that begin a word and of
    pieces that go on. Where a match can't grow, the pieces that greedy matching would
    take from the vertex are popped at once: ``pops[v]`` is their number and
    ``fail[v]`` the vertex of the text that is left. A character that begins no piece
    counts as its UTF-8 bytes, one piece each.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        #: Vertex 0 begins a word, vertex 1 goes on; child vertices by character.
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                v = root
                for c in piece:
                    w = self.next[v].get(c)
                    if w is None:
                        w = self.next[v][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    v = w
                whole[v] = v > 1
        self.fail, self.pops = [1] * len(whole), [0] * len(whole)
        queue = [0, 1]
        for v in queue:
            for c, w in self.next[v].items():
                queue.append(w)
                if whole[w]:
                    self.pops[w] = 1
                elif v <= 1:
                    self.pops[w] = byte_pieces(c)
                else:
                    z, popped = self.fail[v], self.pops[v]
                    while z > 1 and c not in self.next[z]:
                        z, popped = self.fail[z], popped + self.pops[z]
                    if c in self.next[z]:
                        self.fail[w], self.pops[w] = self.next[z][c], popped
                    else:
                        self.pops[w] = popped + byte_pieces(c)

    def count(self, word: str) -> int:
        """Number of pieces of a word without white space."""
        step, fail, pops = self.next, self.fail, self.pops
        total, v = 0, 0
        for c in word:
            while (w := step[v].get(c)) is None and v > 1:
                total += pops[v]
                v = fail[v]
            if w is None:
                total += byte_pieces(c)
                v = 1
            else:
                v = w
        while v > 1:
            total += pops[v]
            v = fail[v]
        return total


def byte_pieces(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def greedy_count(word: str, first: set[str], later: set[str]) -> int:
    """The same number by plain longest match; for tests."""
    total, at, own, longest = 0, 0, first, max(map(len, first | later), default=0)
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in own:
                total, at = total + 1, end
                break
        else:
            total, at = total + byte_pieces(word[at]), at + 1
        own = later
    return total


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentence-piece model that begin words (their marker removed) and all others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or piece == "\u2581":
            continue
        if piece.startswith("\u2581"):
            first.append(piece[1:])
        elif "\u2581" not in piece:
            later.append(piece)
    return first, later


class Counter:
    """An automaton and the counts of the words it has met."""

    def __init__(self, first: list[str], later: list[str]):
        self.automaton, self.known = Automaton(first, later), {}

    def sizes(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
        """Pieces of each of the distinct words raw[start:end]."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        out, known, count = np.zeros(len(hashes), np.int64), self.known, self.automaton.count
        for i, (key, s, e) in enumerate(zip(hashes.tolist(), starts.tolist(), ends.tolist())):
            size = known.get(key)
            if size is None:
                size = known[key] = count(raw[s:e].decode())
            out[i] = size
        return out


_counters: dict[str, Counter] = {}


def counter_of(key: str, first: list[str], later: list[str]) -> Counter:
    """A worker's counter for the vocabulary of that digest, which its next tasks use too.

    Tasks find this function by its name in the module, so they share the worker's one.
    """
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(first, later)
    return _counters[key]


def digest(first: list[str], later: list[str]) -> str:
    """What tells vocabularies apart: a digest of all pieces."""
    return hashlib.sha256("\n".join([*first, "", *later]).encode("utf-8", "surrogatepass")).hexdigest()


def token_counts(docs: DataFrame, first: list[str], later: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_tokens of every row.

    Words are runs without ASCII white space; each word's pieces are counted by
    greedy longest match, pieces of ``first`` at its start and of ``later`` after it.
    Null and empty texts have no tokens; an empty table gives no rows. Rows that repeat are
    each counted. Very long texts take linear time. Other columns are ignored. The vocabulary is a fixed file, so its broadcast
    doesn't grow with the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast((first, later))
    key = digest(first, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(key, *vocabulary.value)
        for b in batches:
            data, off = text_buffers(b.column(1))
            words, tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, part, ends_at in chunks(data, off):
                starts, ends, row = word_bounds(part, ends_at, SPACED)
                h, pick, back = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
                sizes = counter.sizes(h, starts[pick], ends[pick], part.tobytes())
                words[lo:hi] = np.bincount(row, minlength=hi - lo)
                tokens[lo:hi] = np.bincount(row, sizes[back], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], ["id", "n_words", "n_tokens"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``documents``; see ``token_counts`` for nulls and repeats."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
