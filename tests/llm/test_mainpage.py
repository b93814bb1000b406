import html
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mainpage

WEIGHTS = mainpage.Weights(mainpage.labelled_pages())


def article(page):
    """The test pages' article by their one layout."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_pages_of_the_tables(spark):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pandas().set_index("page_id")
    got = mainpage.op3_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages.html[r.page_id]) and r.n_chars == len(r.text)


LONG = "Many words of a long paragraph go on and on in here until there is no doubt that it is text of the page and not some small part of what stands around it on every side."
CASES = {
    "article": ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One two three.</p></article><footer>c</footer>", "T\nOne two three."),
    "entities": ("<article><p>a &amp;amp; b&nbsp;&#233;&eacute;&lt;i&gt;</p></article>", "a &amp; b éé<i>"),
    "comments": ("<main><h1>Title</h1><p>Body of the text that is long enough.</p><section id=comments><p>I liked this very much indeed thanks</p></section></main>", "Title\nBody of the text that is long enough."),
    "advert": ("<article><p>First block of words.</p><div class='ad-slot'>Buy this now</div><p>Second block of words.</p></article>", "First block of words.\nSecond block of words."),
    "notice": ("<div class='cookie-banner'><p>We use cookies to make it better for all of you</p></div><article><p>Text.</p></article>", "Text."),
    "form": ("<article><p>Before the form.</p><form><label>Mail</label><input><button>Go</button></form><p>After it.</p></article>", "Before the form.\nAfter it."),
    "divs": ("<div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=content><h2>Head line</h2><p>Long text in here, of many words, goes on and on.</p></div><div class=sidebar><a href=3>More</a></div>", "Head line\nLong text in here, of many words, goes on and on."),
    "layout class": ("<div class='main-content sidebar-right'><h1>Head</h1><p>The text of this page is here.</p></div><div class='sidebar'><p>Other things</p></div>", "Head\nThe text of this page is here."),
    "script": ("<article><p>x <script>var a = '<p>no</p>';</script>y</p><style>p{}</style><!-- <p>no</p> --></article>", "x y"),
    "unclosed": ("<article><p>One<p>Two <b>three", "One\nTwo three"),
    "inline": ("<article><p>fo<b>ob</b>ar<br>baz</p></article>", "foobar baz"),
    "side by side": (f"<main><h1>Head</h1><p>{LONG}</p><div class='side-by-side'><p>{LONG}</p></div></main><footer>c</footer>", f"Head\n{LONG}\n{LONG}"),
    "open object": (f"<article><p>{LONG}</p><object data=x><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    "open select": (f"<article><p>{LONG}</p><select><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    "two articles": (f"<nav><a href=1>x</a></nav><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p><p>{LONG}</p></article><footer>c</footer>", f"A\n{LONG}\nB\n{LONG}\n{LONG}"),
    "long advert inside": (f"<article><p>{LONG}</p><div class='ad'>{LONG} {LONG}</div><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    "plain": ("no tags at all", "no tags at all"),
    "empty": ("", ""),
    "null": (None, ""),
    "tags only": ("<div><p></p></div>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert mainpage.main_text(page, WEIGHTS) == want


def test_best_region_is_brute_force():
    r = random.Random(5)
    for _ in range(300):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, z = mainpage.best_region(s)
        best = max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert sum(s[a:z]) == best


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, None, "<p>" + "w " * 50000), (3, None, "<p>" + "w " * 50000)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = mainpage.extract(rows).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [0, 0, 99999, 99999]
    assert mainpage.extract(rows.limit(0)).count() == 0


def test_held_apart_layouts():
    """Words kept and lost over pages of another seed with other class names, against their marks."""
    swap = {"menu": "main-menu", "topnav": "site-nav", "sidebar": "sidebar-left", "comments": "comment-list", "ad": "advert-box", "cookie-notice": "gdpr-notice", "side-by-side": "bottom-up", "content": "post-content", "story": "entry"}
    kept = wanted = right = 0
    for page, marks in mainpage.labelled_pages(60, 99):
        page = re.sub(r'(class|id)="([^"]+)"', lambda m: f'{m[1]}="{swap.get(m[2], m[2])}"', page)
        own = mainpage._worded(mainpage.blocks(page))
        want = {id(b) for b, good in zip(own, marks, strict=True) if good}
        got = mainpage._region_blocks(own, WEIGHTS)
        kept += sum(sum(b.words.values()) for b in got)
        right += sum(sum(b.words.values()) for b in got if id(b) in want)
        wanted += sum(sum(b.words.values()) for b in own if id(b) in want)
    assert right / kept > 0.97 and right / wanted > 0.97, (right / kept, right / wanted)
