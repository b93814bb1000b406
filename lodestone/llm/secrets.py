"""Secret scans: patterns, and zstandard novelty of strings in sensitive context."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_buffers, word_bounds

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: What makes the text before a string sensitive, and how far back it may stand on the line or on the end of the line above.
SENSITIVE = re.compile(r"(auth|bearer|credential|private|secret|token|passw|passphrase|pwd|api|access|signing|signature|encrypt|session|cookie|license|client|webhook|jwt|ssh|key|salt|seed)", re.IGNORECASE | re.ASCII)
REACH = 48
#: What opens a block whose strings are all in sensitive context; it reaches to the next END line, or to the end of the text.
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END |\Z)", re.DOTALL | re.ASCII)
#: Code points of surrounding text on each side that prime the compressor after the dictionary.
SURROUND = 256
#: A candidate's least length, and the marginal compressed bytes per byte that make it novel.
SHORTEST, NOVELTY = 16, 0.55

#: Identifiers and words of code; strings made of them compress well.
IDENTIFIERS = """
abstract access account action active address admin agent algorithm alias allow amount analysis angle answer api append application apply
archive argument array assert asset assign async attach attempt attribute auth author authorization available await background backup balance
base64 basic batch bearer before begin binary block body boolean border bottom bound branch break broadcast browser bucket buffer build bundle
button byte cache calculate callback cancel capture category certificate channel char check child chunk class clean clear client clone close
cluster code collection color column command comment commit common compare compile complete component compress config configuration connect
connection const constant constructor consumer container content context continue controller convert cookie copy count counter create credential
current cursor custom data database date debug decode default define delete deploy description destroy detail device dictionary digest directory
disable dispatch display document domain double download driver duplicate duration dynamic element email enable encode encrypt endpoint engine
entity entry environment error event example exception exchange execute exists expire export expression extend external extract factory failed
false feature fetch field file filter final find finish first fixture flag float flush folder font footer force format forward frame from function
gateway generate generic github global google graph group handle handler hash header health height hidden history home host html http https image
implement import include index info init initial input insert instance integer interface internal interval invalid invoke issue item iterator java
javascript join json keyboard label language large last latest layout length level library license limit line link list listener load local locale
location lock logger login logout long lookup loop main manager manifest map master match matrix maximum member memory menu merge message meta
method metric middle minimum missing mobile mock model modify module monitor mount move multiple mutex name namespace native network next node
notification null number object offset open operation operator option order origin output overflow override owner package page parameter parent
parse partition passphrase password path pattern pause payload peer pending permission persist phone pipeline pixel platform plugin point policy pool
port position post prefix prepare present previous primary print priority private process processor producer product production profile program
progress project promise prompt property protected protocol provider proxy public publish push python query queue random range raw read ready record
recursive redirect reference refresh region register registry reject relation release reload remote remove render repeat replace reply report
repository request require reset resolve resource response restart restore result retry return revision role root rotate route router rule runtime
sample save scale scan schedule schema scope screen script search second secret section secure security select send sequence serial series server
service session setting setup shadow shape share shell shift short signal signature simple single size skip slice snapshot socket sort source space
split stack stage standard start state static status step storage store stream string struct style submit success suffix summary support switch
symbol sync system table target task template temporary terminal test text theme thread threshold time timeout timestamp title token tool total
trace track transaction transfer transform transport trigger true type undefined union unique unit unknown unlock update upgrade upload user utility
valid validate value variable vector verify version video view virtual visible void wait warning watch web webhook width window worker wrapper write
www com org net example index html php json xml yaml sql abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
""".split()

_TOKEN, _HEX, _DIGIT, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_HEX[48:58] = _HEX[97:103] = True
_TOKEN[[43, 45, 46, 47, 61, 95]] = _TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True


def core(string: str) -> str:
    """The value in a string that may also hold its name (name=value): its longest part between equals signs, if that could be a candidate."""
    best = max(string.split("="), key=len)
    return best if len(best) >= SHORTEST else string


#: Words of the corpus that go to the dictionary: those around candidates in most documents.
MOST_WORDS = 4096
#: Different words a task gathers before it writes their counts.
RUN = 200_000
_NAME = re.compile(rb"[A-Z]?[a-z]{3,20}|[A-Z]{3,20}")
_MIXED = re.compile(rb"[A-Za-z0-9+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*")


def candidates(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and rows of the strings that may be secrets: long, of letters and digits."""
    s, e, row = word_bounds(part, at, _TOKEN)
    digits, letters = (np.concatenate(([0], np.cumsum(k[part]))) for k in (_DIGIT, _ALPHA))
    pick = np.flatnonzero((e - s >= SHORTEST) & (digits[e] > digits[s]) & (letters[e] > letters[s]))
    return s[pick], e[pick], row[pick]


def identifiers(docs: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The ``most`` words that stand around candidates in most rows, rarest first, so that frequent ones are near the text.

    Identifiers are cut at case, digits and underscores; strings that mix letters and digits
    give none, so copies of a secret don't make it known. All rows are counted; a task writes
    counts of words, not words. Ties go by the word.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            data, off = text_buffers(b.column(0))
            for _, _, part, at in chunks(data, off):
                raw, bounds = part.tobytes(), at.tolist()
                s, e, row = (x.tolist() for x in candidates(part, at))
                seen: set[bytes] = set()
                last = -1
                for i, r in enumerate(row):
                    if r != last:
                        counts.update(seen)
                        seen, last, done = set(), r, bounds[r]
                    low, high = max(done, s[i] - SURROUND), min(bounds[r + 1], e[i] + SURROUND)
                    if low < high:
                        seen.update(w.lower() for w in _NAME.findall(_MIXED.sub(b" ", raw[low:high])))
                    done = max(done, high)
                counts.update(seen)
                if len(counts) > RUN:
                    yield written()
                    counts.clear()
        if counts:
            yield written()

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()][::-1]


class Novelty:
    """Marginal compressed size of a string after a dictionary and the text around it."""

    def __init__(self, words: list[str]):
        prime = zstandard.ZstdCompressionDict("\n".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prime.precompute_compress(level=19)
        self.tool = zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_checksum=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds to its surroundings, per byte. Other copies of it don't count as surroundings."""
        copy = core(text[start:end])
        reach = SURROUND + len(copy)
        around = text[max(0, start - reach) : start].replace(copy, "")[-SURROUND:] + text[end : end + reach].replace(copy, "")[:SURROUND]
        own = text[start:end].encode()
        base = around.encode("utf-8", "surrogatepass")
        return (len(self.tool.compress(base + b"\n" + own)) - len(self.tool.compress(base + b"\n"))) / len(own)


def sensitive(text: str, start: int, blocks: list[tuple[int, int]], novel: set[int]) -> bool:
    """Whether a string that starts there is in sensitive context: a sensitive word before it on its line or on the
    line above (empty ones skipped), a block of a private key, or a line above that ends in a string found novel
    (one of the ends ``novel``) which the string, alone so far on its line, goes on."""
    before = text[max(0, start - REACH) : start]
    line = before.rfind("\n")
    block = bisect.bisect_right(blocks, (start, len(text)))
    if SENSITIVE.search(before, line + 1) or block and start < blocks[block - 1][1]:
        return True
    if line < 0:
        return False
    end = start - len(before) + line
    while end > 0 and text[end - 1].isspace():
        end -= 1
    if SENSITIVE.search(text[max(0, end - REACH) : end].rpartition("\n")[2]):
        return True
    while end > 0 and text[end - 1] in "\"',\\":
        end -= 1
    return end in novel and not before[line + 1 :].strip(" \t\"'-")


def copies(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Every further copy of the strings found novel, wherever it stands, that no span overlaps."""
    values = sorted({core(text[start:end]) for start, end, kind in spans if kind == "novel"}, key=lambda x: (-len(x), x))
    taken = np.zeros(len(text), bool)
    for start, end, _ in spans:
        taken[start:end] = True
    out = []
    for m in re.finditer("|".join(map(re.escape, values)), text):
        if not taken[m.start() : m.end()].any():
            out.append((*m.span(), "novel"))
    return out


def scan(column: pa.Array, novelty: Novelty) -> Iterator[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, in code points, by start and then kind.

    Only texts that hold a pattern's fixed part see its expression; runs of hexadecimal
    digits and candidate strings are found in the bytes of many texts at once.
    """
    data, off = text_buffers(column)
    for _, _, part, at in chunks(data, off):
        n = len(at) - 1
        raw, low = part.tobytes(), part.tobytes().lower()
        chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        found: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        s, e, row = word_bounds(part, at, _HEX)
        for i in np.flatnonzero(e - s >= LEAST["hex"]).tolist():
            zero = chars[at[row[i]]]
            found[row[i]].append((int(chars[s[i]] - zero), int(chars[e[i]] - zero), "hex"))
        texts: dict[int, str] = {}
        blocks: dict[int, list[tuple[int, int]]] = {}
        novel: dict[int, set[int]] = {}
        bounds = at.tolist()
        for r in range(n):
            a, z = bounds[r], bounds[r + 1]
            if low.find(b"token", a, z) >= 0 or low.find(b"secret", a, z) >= 0 or low.find(b"passw", a, z) >= 0 or low.find(b"api", a, z) >= 0:
                texts[r] = raw[a:z].decode()
                found[r] += [(*m.span(), "assign") for m in ASSIGN.finditer(texts[r]) if len(m[2]) >= LEAST["assign"]]
            if raw.find(b"AKIA", a, z) >= 0:
                texts.setdefault(r, raw[a:z].decode())
                found[r] += [(*m.span(), "access") for m in ACCESS.finditer(texts[r]) if m.end() - m.start() >= LEAST["access"]]
        s, e, row = candidates(part, at)
        last, base = -1, []
        for i, r in enumerate(row.tolist()):
            zero = chars[at[r]]
            start, end = int(chars[s[i]] - zero), int(chars[e[i]] - zero)
            if r != last:
                last, base, passed = r, sorted((x, y) for x, y, _ in found[r]), 0
                reach = 0  # the furthest end of the base spans that begin before this candidate's end
            while passed < len(base) and base[passed][0] < end:
                reach = max(reach, base[passed][1])
                passed += 1
            if reach > start:
                continue
            text = texts.get(r)
            if text is None:
                text = texts[r] = raw[bounds[r] : bounds[r + 1]].decode()
            if r not in blocks:
                blocks[r] = [m.span(1) for m in KEY_BLOCK.finditer(text)]
            if sensitive(text, start, blocks[r], novel.setdefault(r, set())) and novelty(text, start, end) >= NOVELTY:
                found[r].append((start, end, "novel"))
                novel[r].add(end)
        for r, spans in enumerate(found):
            if any(kind == "novel" for *_, kind in spans):
                spans += copies(texts[r], spans)
            yield sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every row.

    Base spans are whole matches of the patterns; the compressor adds strings that no
    pattern covers, stand after a sensitive word on their line or the line above, go on a string found
    there or stand in a private key's block, mix letters and digits, and
    don't compress against the identifiers and the text around them without their copies. Every
    copy of such a string is a span, whatever stands before it. The dictionary is ``words``, or
    IDENTIFIERS and the corpus's own (see ``identifiers``). Strings without a digit or without a
    letter, and those that a base span touches, are not measured. Null and empty texts have no
    spans; an empty table gives no rows; very long texts are scanned whole. Repeated rows are
    each reported; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    words = [*IDENTIFIERS, *identifiers(docs)] if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spelled = [], []
            for spans in scan(b.column(1), novelty):
                for c, kind in zip(counts, KINDS):
                    c.append(sum(x[2] == kind for x in spans))
                digests.append(hashlib.sha256(spell([x for x in spans if x[2] != "novel"]).encode()).hexdigest())
                spelled.append(spell(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(spelled, pa.string()), pa.array(counts[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, mark: str = "[REDACTED]", words: list[str] | None = None) -> DataFrame:
    """docs with every span of its texts replaced by mark (overlapping spans by one), and n_chars,
    where there is such a column, counted anew for changed texts. Null texts stay null; other
    columns stay; an empty table gives no rows. ``words`` as in ``scan_secrets``."""
    small_batches(docs.sparkSession)
    words = [*IDENTIFIERS, *identifiers(docs)] if words is None else words
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in batches:
            texts = lengths = None
            for i, spans in enumerate(scan(b.column(at), novelty)):
                if not spans:
                    continue
                texts = texts or b.column(at).to_pylist()
                lengths = lengths or (b.column(size).to_pylist() if size is not None else [None] * b.num_rows)
                text, out, last = texts[i], [], 0
                for start, end, _ in spans:
                    if start >= last:
                        out += [text[last:start], mark]
                    last = max(last, end)
                texts[i] = "".join([*out, text[last:]])
                lengths[i] = len(texts[i])
            cols = list(b.columns)
            if texts:
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if size is not None:
                    cols[size] = pa.array(lengths, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every row of ``documents``; see ``scan_secrets`` for nulls and repeats."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
