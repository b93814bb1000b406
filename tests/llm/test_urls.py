import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import urls

PAGES = [
    (1, "https://a.example.com/en/1", None),
    (2, "https://a.example.com/en/7x", ""),
    (3, "http://other.example/x", '<link rel="canonical" href="https://a.example.com/en/1">'),
    (4, "http://third.example/y", "<meta http-equiv='refresh' content='0; url=http://other.example/x'>"),
    (5, "http://fourth.example/z", '<link href="/w" rel=canonical>'),
    (6, "http://fourth.example/w", "<p>none</p>"),
    (7, None, None),
    (8, "no scheme", '<link rel="canonical" href="https://a.example.com/en/1">'),
    (9, "HTTP://ORG/es/?q#f", None),
    (10, "https://xorg/es/1", None),
    (11, "https://sub.ORG/es/1#x", None),
    (12, "http://n.example.net/de/8", None),
    (13, "http://n.example.net/de/9", None),
    (14, "http://fifth.example/", '<link rel=canonical href="http://both.example/"><meta http-equiv=refresh content="1;URL=http://n.example.net/de/8">'),
    (15, "http://both.example/", '<link rel=canonical href="http://n.example.net/de/9">'),
    (16, "http://b.ex/?x://y", None),
    (17, "http://a.net/de/1", None),
    (18, "http://rel.example/a/b?q", '<link rel=canonical href="c">'),
    (19, "http://rel.example/a/c", '<link rel=canonical href="//example.net/de/8x">'),
    (19, "http://rel.example/a/c", '<link rel=canonical href="//example.net/de/8x">'),
]
WANT = {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "block", 12: "block", 13: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "allow", 18: "block", 19: "block"}
#: Rows 13 to 19: net/de/ allows, example.net/de/8 blocks; relative targets; a repeated row is judged each time.


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("verdict", F.lit("mine"))


@pytest.mark.parametrize("inline", [200, 0])
def test_verdicts(pages, inline, monkeypatch):
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    got = {r.page_id: r for r in urls.filter_pages(pages, urls.RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == WANT
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "") and got[9].host == "org" and got[9].path == "/es/"
    assert got[1].rule == "com/en/" and got[2].rule == "example.com/en/7" and got[3].rule is None


def test_sql_gives_the_same(pages):
    con = duckdb.connect()
    own = pages.select("page_id", "url", "html").toPandas()  # noqa: F841
    con.execute("create view pages as select * from own")
    rel = con.execute(urls.OP7_SQL)
    names = [d[0] for d in rel.description]
    assert sorted(rel.fetchall(), key=repr) == sorted((tuple(r) for r in urls.filter_pages(pages, urls.RULES).select(*names).collect()), key=repr)


def test_given_edges_and_empty_table(spark, pages):
    edges = spark.createDataFrame([("http://fourth.example/w", "https://a.example.com/en/1"), (None, "x")], "a string, b string")
    got = {r.page_id: r.verdict for r in urls.filter_pages(pages, urls.RULES, edges).collect()}
    assert got[5] == got[6] == "block"
    assert urls.filter_pages(pages.limit(0), urls.RULES).count() == 0


def test_components_of_chains_and_hubs(spark, tmp_path):
    from lodestone.llm.common import Tables, components

    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_many_aliases_and_a_hub(spark):
    """Chains of 3 to 40 redirects, and a hub that a third of the rows point to; brute force by union of sets."""
    import random

    r, rows, root = random.Random(4), [], {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(a, b):
        root[find(a)] = find(b)

    hub = "http://hub.example.com/en/1"
    for i in range(1500):
        rows.append((i, f"http://h{i}.example/p", f'<link rel="canonical" href="{hub}">'))
        link(rows[-1][1], hub)
    for c in range(120):
        ends = r.choice(["http://x.example/q", f"http://s{c}.net/de/8", f"http://example.net/de/8?{c}", f"http://s{c}.org/es/1"])
        urls_ = [f"http://c{c}.example/{j}" for j in range(r.randint(3, 40))] + [ends]
        for a, b in zip(urls_, urls_[1:]):
            rows.append((len(rows), a, f"<meta http-equiv=refresh content='0;url={b}'>"))
            link(a, b)
    rows += [(10_000 + i, None, None) for i in range(1000)]
    r.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    fits = {"http://hub.example.com/en/1": "block"}
    parts = {}
    for x in list(root):
        if x in fits or ".net/de/8" in x or ".org/es/" in x or "example.net/de/8" in x:
            parts.setdefault(find(x), set()).add("allow" if "http://s" in x and ".net/de/" in x else "block")
    want = {i: "allow" if u is None else ("allow" if "allow" in parts.get(find(u), {"allow"}) else "block") for i, u, _ in rows}
    got = {x.page_id: x.verdict for x in urls.filter_pages(pages, urls.RULES).collect()}
    assert got == want and sum(v == "block" for v in want.values()) > 1500
