"""Document fingerprints by winnowing."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, small_batches

#: Code points of a hashed gram, and grams of a window: a passage of GRAM + WINDOW - 1
#: code points that two texts share gives them a common fingerprint.
GRAM, WINDOW = 16, 48
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(code: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Polynomial hash of every run of k code points, by doubling run lengths."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, power, out, size, done = code.astype(np.uint64) + np.uint64(1), _BASE, None, 1, 0
    while True:
        if k & size:
            piece = run[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            done += size
        if done == k:
            return mix(out)
        run = run[:-size] * np.uint64(power) + run[size:] if len(run) > size else run[:0]
        power, size = power * power % (1 << 64), size * 2


def select(h: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every w hashes, the rightmost of equal ones.

    Fewer than w hashes are one window.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(w, len(h))
    at, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] <= h[a], b, a)
        size += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprint(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes (48 bits) and their positions in text order.

    A text shorter than k is hashed whole, at position 0; an empty text has none.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if 0 < len(code) < k:
        h = gram_hashes(code, len(code)) ^ np.uint64(len(code))
        return h >> np.uint64(16), np.zeros(1, np.int64)
    h = gram_hashes(code, k)
    at = select(h, w)
    return h[at] >> np.uint64(16), at


def spell(f: tuple[np.ndarray, np.ndarray]) -> str:
    """hash@position, comma-joined, in text order."""
    return ",".join([f"{h:x}@{p}" for h, p in zip(f[0].tolist(), f[1].tolist())])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the hashes; two empty fingerprints are alike."""
    x, y = np.unique(a[0]), np.unique(b[0])
    if not len(x) and not len(y):
        return 1.0
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / (len(x) + len(y) - same)


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as much of the start of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """id, n_chars, fingerprint of every row; null text counts as empty, rows stay as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([spell(fingerprint(t, k, w)) for t in texts], pa.string())], ["id", "n_chars", "fingerprint"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


#: Code points of a text by which the rows of one frequent id are cut into buckets, and beginnings drawn for a cut.
BEGIN, DRAWN = 1024, 8


def text_cuts(rows: DataFrame, parts: dict[int | None, int]) -> dict[int | None, list[str]]:
    """For each id, which many rows share, up to ``parts`` beginnings of its texts that cut them about evenly.

    Drawn are the different beginnings with the smallest hashes, DRAWN for each cut; they
    settle where buckets end, never what is in a result.
    """
    if not parts:
        return {}
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, DRAWN * n) for i, n in parts.items()], "_id long, _most int")
    begins = rows.select("doc_id", F.substring("text", 1, BEGIN).alias("p")).join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("p"), "p"))
    drawn = begins.groupBy("doc_id", "p").agg(F.first("_most").alias("_most")).withColumn("_r", place)
    found: dict[int | None, list[str]] = {i: [] for i in parts}
    for r in drawn.where((F.col("_r") <= DRAWN * max(parts.values())) & (F.col("_r") <= F.col("_most"))).collect():
        found[r.doc_id].append(r.p)
    return {i: sorted({p[x * len(p) // parts[i]] for x in range(parts[i])}) for i, p in ((i, sorted(p)) for i, p in found.items())}


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, doc_id, text, guest) dealt so that each bucket is a run of ascending (doc_id, text).

    The split points are quantiles of doc_id, which are ids that exist; the row at a
    split also goes, as a guest, to the bucket before it, and the first row of all to
    the last bucket. So every row's successor is in its own bucket without a second
    shuffle of the texts, and no global window is needed.

    An id (or null) that fills several buckets is cut by the beginnings of its texts too. A
    task sends one of its rows with the same such id and the same text; the others follow
    each other, so they are dealt evenly over all buckets, marked 3: each is its own successor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)]
    stat = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 100 * buckets).alias("cut"), F.count("*").alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    times = Counter(stat.cut or [])
    parts: dict[int | None, int] = {c: n for c, n in times.items() if n > 1}
    if stat.nulls * buckets > stat.n:
        parts[None] = stat.nulls * buckets // stat.n
    within = text_cuts(rows, parts)
    whole = {c for c in times if c not in within and c != stat.low}
    if stat.nulls and stat.low is not None and stat.low not in within:
        whole.add(stat.low)
    keys = sorted([*whole, *(i for i, p in within.items() if i is not None for _ in p)])
    of_null = len(within.get(None, ()))
    last = of_null + len(keys)
    first = None if stat.nulls else stat.low
    start = None  # how the first row of all begins, where many rows share its id
    if first in within:
        start = rows.where(F.col("doc_id").eqNullSafe(F.lit(first).cast("long"))).agg(F.min(F.substring("text", 1, BEGIN)).alias("p")).first().p

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, alone = np.array(keys, np.int64), np.array(sorted(whole), np.int64)
        crowded = np.array([i for i in within if i is not None], np.int64)
        seen: set[tuple[int | None, bytes]] = set()
        turn = 0
        for b in batches:
            ids = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            home = of_null + np.searchsorted(splits, ids, "left")
            home[null] = 0
            at_cut = ~null & np.isin(ids, alone)
            home[at_cut] += 1
            mark = np.zeros(len(ids), np.int8)
            wrap = null if first is None and stat.nulls else ~null & (ids == first) if first is not None else np.zeros(len(ids), bool)
            wrap = wrap.copy()
            many = np.flatnonzero((~null & np.isin(ids, crowded)) | (null if None in within else False))
            for i, text in zip(many.tolist(), b.column(1).take(pa.array(many)).to_pylist()):
                id_ = None if null[i] else int(ids[i])
                copy = (id_, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if copy in seen:
                    home[i], mark[i], wrap[i] = turn % (last + 1), 3, False
                    turn += 1
                    continue
                seen.add(copy)
                begins = within[id_]
                r = bisect.bisect_right(begins, text)
                home[i] += r
                at_cut[i] = r > 0 and text.startswith(begins[r - 1])
                if wrap[i]:
                    wrap[i] = text[:BEGIN] == start
            at_cut, wrap = np.flatnonzero(at_cut), np.flatnonzero(wrap)
            take = np.concatenate((np.arange(len(ids)), at_cut, wrap))
            to = np.concatenate((home, home[at_cut] - 1, np.full(len(wrap), last)))
            # A guest in the last bucket stands after all ids; elsewhere its id already sorts it last.
            guest = np.concatenate((mark, np.ones(len(at_cut), np.int8), np.full(len(wrap), 2, np.int8)))
            got = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), got.column(0), got.column(1), pa.array(guest, pa.int8())], ["bucket", "doc_id", "text", "guest"])

    dealt = rows.mapInArrow(deal, "bucket int, doc_id long, text string, guest byte")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")


def edit_report(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every document and of its edited text (see ``edited``), and likenesses.

    The next document is the next by (doc_id, text), null ids first; the last one's is
    the first. Repeated rows follow each other. A table of one row is its own successor.
    Null text counts as empty. Any other columns are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) of the row that waits for its successor
        for b in batches:
            out: list[tuple] = []
            for bucket, doc, text, guest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if guest == 3:
                    held = (bucket, doc, text, fingerprint(text, k, w))
                print_ = held[3] if guest == 3 else fingerprint(text, k, w) if not guest or held and held[0] == bucket else None
                if held and held[0] == bucket:
                    new = edited(held[2], text)
                    other = held[3] if new == held[2] else fingerprint(new, k, w)
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), spell(held[3]), spell(other), likeness(held[3], other), likeness(held[3], print_)))
                held = None if guest else (bucket, doc, text, print_)
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and of its edited text; see ``edit_report`` for nulls, repeats and empty tables."""
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
