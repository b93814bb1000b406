"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, each by
its class, with weights learned from labelled pages. A word's class is what its elements'
names and attributes hint at, whether it is in a link, whether an article or main element is
open, and how long its block is; what a hint is worth is learned, so a long paragraph in an
element that is named for its place on the page still wins. One linear scan finds the
contiguous region with the greatest sum. The region's text is its blocks whose own words
score positive: an advert inside the article is passed over by the scan but isn't text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Weight limits; a tag's weight is at most the last.
MOST, TAG_MOST = 3.0, -0.02
#: Words from which a block counts as longer, and as long.
LONGER, LONG = 8, 30

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|(?=<)|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.I)

#: Elements whose content is never text of the page.
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select datalist map applet embed".split())
#: Those of them that a page may leave open without hiding the rest of it.
_MAY_OPEN = _RAW - {"script", "style", "textarea", "title"}
_VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
_SPACE = frozenset("br td th option".split())
_SELF_CLOSING = frozenset("p li dd dt tr".split())
#: Elements that are boilerplate wherever they stand.
_PLAIN = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "side", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "label": "form"}
_ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "status": "notice"}
_HINTS = [
    ("comment", r"comments?|comment(?:list|s?area|thread|section|body|box)|disqus\w*|respond|replies|reply|discussion|responses?|guestbook|feedback"),
    ("advert", r"ad|ads|adv|advert\w*|adsense|adslot|adbox|adunit|adwrap\w*|dfp|sponsor\w*|promo\w*|banner|outbrain|taboola|affiliate|commercial"),
    ("notice", r"cookies?\w*|consent|gdpr|notice|notices|alert|alerts|notification|newsletter\w*|subscri\w+|signup|popup|modal|overlay|paywall|disclaimer|toast|warning|announcement|interstitial"),
    ("side", r"sidebar\w*|side|aside|widgets?|related\w*|recommend\w*|trending|popular|teasers?|morefrom|readmore|rail|infobox|toc"),
    ("menu", r"menu\w*|nav|navbar|navigation|navi|topnav|subnav|mainnav|breadcrumbs?|pager|pagination|tabs|skip|skiplinks?|tags|tagcloud|toolbar|dropdown"),
    ("share", r"share\w*|sharing|social\w*|follow|likes?|tweet|author-?box|bio"),
    ("footer", r"footer|foot|bottom|copyright|colophon|legal|credits"),
    ("header", r"header|masthead|topbar|site-?title|branding|logo|top"),
    ("form", r"form|search\w*|login\w*|signin|register"),
]
_HINT = [(kind, re.compile(rf"(?:^|[-_:])(?:{words})(?:$|[-_:]|\d)", re.I)) for kind, words in _HINTS]
_NOT_HINT = re.compile(r"^(?:has|no|with|without|is|not|js|show|hide)[-_]|(?:^|[-_])(?:article|post|entry|story|content|page)[-_](?:header|head|top|title|body|content|text)$", re.I)
_CONTENT = re.compile(r"^(?:main|page|post|entry|article|story|site|blog)?[-_]?(?:content|article|body|main|story|post|entry|text)$", re.I)
_KEEP = frozenset(("html", "body", "main"))


@dataclass
class Block:
    """Text between two block borders."""

    parts: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)
    words: Counter = field(default_factory=Counter)
    tags: Counter = field(default_factory=Counter)
    kind: str = "text"
    home: int = -1

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def container_kind(tag: str, attributes: str, inside: bool, hints: bool) -> str | None:
    """The boilerplate that an element holds, if any; ``inside``: whether an article or main element is open."""
    if tag in _PLAIN:
        return _PLAIN[tag]
    if tag == "header" and not inside:
        return "header"
    if not hints or not attributes or tag in _KEEP:
        return None
    found = {}
    for name, value, flag in _ATTR.findall(attributes):
        found[(name or flag).lower()] = value.strip("\"'")
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "notice"
    role = found.get("role", "").lower()
    if role in _ROLES and not (role == "banner" and inside):
        return _ROLES[role]
    names = f"{found.get('class', '')} {found.get('id', '')}".split() + found.get("aria-label", "").lower().split()
    # One class that says content outweighs another one that tells of its place or looks.
    content = any(_CONTENT.search(n) for n in names)
    for name in names:
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)
        if _NOT_HINT.search(name):
            continue
        for kind, words in _HINT:
            if words.search(name) and not (tag == "article" and kind != "comment") and not (kind == "header" and inside) and not (content and kind in ("side", "menu", "share", "footer", "header")):
                return kind + "-like"  # a name is weaker evidence than an element or a role
    return None


def blocks(page: str, hints: bool = True) -> list[Block]:
    """The page's blocks in order, in one pass; unclosed and stray tags are put up with."""
    out, now, pos = [], Block(), 0
    stack: list[tuple[str, str | None, int]] = []  # open elements: tag, boilerplate in force, article or main in force
    homes = links = 0

    def place() -> None:
        now.kind, now.home = (stack[-1][1] or "text", stack[-1][2]) if stack else ("text", -1)

    def close() -> None:
        nonlocal now
        out.append(now)
        now = Block()
        place()

    def add(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            now.words[(now.kind, links > 0)] += len(raw.split())

    while True:
        m = _TOKEN.search(page, pos)
        add(page[pos : m.start() if m else len(page)])
        if not m:
            break
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = 0
            if tag in _RAW or tag in _VOID:
                continue
            if tag in _BLOCK:
                close()
                links = 0
            elif tag in _SPACE:
                now.parts.append(" ")
            deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # An inline end tag doesn't end the blocks around it.
            if deep is not None and (tag in _BLOCK or not any(x[0] in _BLOCK for x in stack[deep:])):
                del stack[deep:]
                place()
            now.tags["/" + tag if tag in _BLOCK else "/inline"] += 1
            continue
        if tag in _RAW:
            if not m[3].endswith("/") and tag not in _VOID:
                stop = re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, pos)
                pos = stop.end() if stop else pos if tag in _MAY_OPEN else len(page)
            continue
        if tag == "a":
            links = 1
        if tag in _SPACE:
            now.parts.append(" ")
        if tag in _BLOCK:
            close()
        if tag not in _VOID and (tag in _BLOCK or tag in _PLAIN or m[3].strip()):
            if stack and (stack[-1][0] == tag and tag in _SELF_CLOSING or tag in _BLOCK and stack[-1][0] == "p"):
                stack.pop()
            above, home = (stack[-1][1], stack[-1][2]) if stack else (None, -1)
            kind = above or container_kind(tag, m[3], home >= 0, hints)
            if tag in ("article", "main") and home < 0 and kind is None:
                home, homes = homes, homes + 1
            stack.append((tag, kind, home))
            place()
        now.tags[tag if tag in _BLOCK else "inline"] += 1
    out.append(now)
    return out


def block_classes(b: Block) -> Iterator[tuple[tuple, int]]:
    """(class, number) of the block's words and tags."""
    size = sum(b.words.values())
    for (kind, link), n in b.words.items():
        yield ("word", kind, link, b.home >= 0, (size >= LONGER) + (size >= LONG)), n
    for tag, n in b.tags.items():
        yield ("tag", tag), n


def log_odds(pages: list[tuple[str, list[bool]]]) -> dict[tuple, float]:
    """Weight of every class from blocks that are marked as inside or not."""
    inside, outside = Counter(), Counter()
    for page, marks in pages:
        for b, good in zip(_worded(blocks(page)), marks, strict=True):
            for c, n in block_classes(b):
                (inside if good else outside)[c] += n
    total = {k: math.log((1 + sum(outside.values())) / (1 + sum(inside.values()))) for k in ("word", "tag")}
    out = {}
    for c in {*inside, *outside}:
        w = math.log((inside[c] + 0.5) / (outside[c] + 0.5)) + 0.5 * total[c[0]]
        out[c] = min(max(w, -MOST), MOST) if c[0] == "word" else min(max(w, -MOST) / 4 - 0.25, TAG_MOST)
    return out


def region_marks(marks: list[bool]) -> list[bool]:
    """Marks of all blocks from the first that is text to the last: an advert between paragraphs lies in the article's region."""
    good = [i for i, x in enumerate(marks) if x]
    return [bool(good) and good[0] <= i <= good[-1] for i in range(len(marks))]


class Weights:
    """Log-odds of classes of words and tags, from blocks marked as text of the article or not: ``region``
    of lying between the article's first and last block, ``text`` of being its text."""

    def __init__(self, pages: list[tuple[str, list[bool]]]):
        self.text = log_odds(pages)
        self.region = log_odds([(page, region_marks(marks)) for page, marks in pages])

    def block(self, b: Block) -> tuple[float, float]:
        """The block's score for the region, and its words' score as text."""
        region = text = 0.0
        for c, n in block_classes(b):
            if c[0] == "word":
                region += n * self.word(self.region, c)
                text += n * self.word(self.text, c)
            else:
                region += n * self.region.get(c, -0.25)
        return region, text

    @staticmethod
    def word(of: dict[tuple, float], c: tuple) -> float:
        """The class's weight; an unseen one's is that of the nearest class of the same hint and link."""
        if c not in of:
            like = [(abs(x[4] - c[4]) + 3 * (x[3] != c[3]), w) for x, w in of.items() if x[0] == "word" and x[1].removesuffix("-like") == c[1].removesuffix("-like") and x[2] == c[2]]
            of[c] = min(like)[1] if like else 0.5 if c[1] == "text" and not c[2] else -1.0
        return of[c]


def _worded(all_: list[Block]) -> list[Block]:
    return [b for b in all_ if any(b.words.values())]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum, in one scan; the first and longest of equal ones."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > 0 and (total > best or total == best and start == span[0]):
            best, span = total, (start, i + 1)
    return span


def _region_blocks(all_: list[Block], weights: Weights) -> list[Block]:
    scores = [weights.block(b) for b in all_]
    lo, hi = best_region([s for s, _ in scores])
    return [b for b, (_, text) in zip(all_[lo:hi], scores[lo:hi]) if text > 0]


def main_text(page: str | None, weights: Weights) -> str:
    """The article's blocks, one line each; empty if there is none."""
    if not page:
        return ""
    text = "\n".join(t for t in (b.text() for b in _region_blocks(blocks(page), weights)) if t)
    if text or "<" not in page:
        return text
    return "\n".join(t for t in (b.text() for b in _region_blocks(blocks(page, False), weights)) if t)


def labelled_pages(n: int = 200, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of several layouts, each with a mark for every block that has words: article or not."""
    r = random.Random(seed)
    stock = "the of and to in is that for it as was with be by on not he this are or his from at which but have an they you were her she there would their".split()

    def words(a: int, b: int) -> str:
        return " ".join(r.choice(stock) for _ in range(r.randint(a, b)))

    places = "side-by-side top-text bottom-part right-rail-text social-study related-facts follow-up login-story footer-note-text header-text copyright-law legal-case recommend-list nav-guide".split()

    def item(tag: str, attributes: str, inner: str) -> str:
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}</{tag}>"

    def link_list(n: int) -> tuple[str, int]:
        return item("ul", "", "".join(item("li", "", item("a", 'href="/x"', words(1, 2))) for _ in range(n))), n

    out = []
    for _ in range(n):
        parts: list[tuple[str, list[bool]]] = []
        links, k = link_list(r.randint(3, 8))
        parts.append((item(*r.choice([("nav", ""), ("div", 'class="menu"'), ("div", 'id="topnav"')]), links), [False] * k))
        if r.random() < 0.7:
            parts.append((item("header", "", item("p", "", words(2, 6))), [False]))
        if r.random() < 0.6:
            parts.append((item("div", r.choice(['class="ad"', 'class="cookie-notice"', 'id="banner"']), words(4, r.choice([20, 80]))), [False]))
        body, marks = [item("h1", "", words(3, 10))], [True]
        wrapper = r.choice([("article", ""), ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="story"')])
        for _ in range(r.randint(2, 12)):
            kind = r.random()
            if kind < 0.75:
                body.append(item("p", "", words(8, 120)))
            elif kind < 0.85:
                body.append(item("p", "", words(5, 30) + item("b", "", words(1, 5)) + item("a", 'href="/y"', words(1, 4)) + words(3, 30)))
            elif kind < 0.93:
                body.append(item("h2", "", words(2, 6)))
            else:
                body.append(item("div", r.choice(['class="ad"', 'class="ad"', 'class="share"']), words(3, r.choice([12, 60]))))
                marks.append(False)
                continue
            if wrapper[0] != "div" and r.random() < 0.15:  # an element named for its place or looks that holds text of the article
                body[-1] = item("div", f'class="{r.choice(places)}"', item("p", "", words(30, 120)))
            elif r.random() < 0.05:
                body.append(item("form", "", item("label", "", words(1, 4)) + item("button", "", words(1, 2))))
                marks += [True, False]
                continue
            marks.append(True)
        parts.append((item(*wrapper, "".join(body)), marks))
        if r.random() < 0.5:
            k = r.randint(1, 4)
            parts.append((item("section", 'class="comments"', "".join(item("p", "", words(5, 40)) for _ in range(k))), [False] * k))
        if r.random() < 0.3:
            parts.append((item(*r.choice([("aside", ""), ("div", 'class="sidebar"')]), item("p", "", words(3, r.choice([24, 90])))), [False]))
        if r.random() < 0.5:
            links, k = link_list(r.randint(2, 6))
            parts.append((item(*r.choice([("aside", ""), ("div", 'class="sidebar"')]), links), [False] * k))
        if r.random() < 0.4:
            parts.append((item("form", "", item("p", "", words(2, 8))), [False]))
        parts.append((item(*r.choice([("footer", ""), ("footer", ""), ("div", 'class="footer"'), ("div", 'id="bottom"')]), item("p", "", words(3, r.choice([15, 15, 90])))), [False]))
        out.append(("<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [x for _, m in parts for x in m]))
    return out


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Text is the region's blocks in page order, character references decoded, white space in a
    block one space, blocks joined by one newline. Null, empty and wordless pages have empty
    text; an empty table gives no rows; very long pages are read whole. Unclosed elements end
    with their parents. Repeated rows are each extracted; other
    columns are ignored.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(weights or Weights(labelled_pages()))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = [main_text(p, own) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; see ``extract`` for nulls and broken pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
