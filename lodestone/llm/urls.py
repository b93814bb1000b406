"""URL filters with redirect equivalence; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, components

#: Rules (verdict, host, path) of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Up to so many rules become one expression; more are joined by host suffix.
INLINE_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """A page's node: host, path and query. Scheme and fragment don't tell pages apart."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a whole URL: absolute, without scheme, from the root, or from the base's folder."""
    t = F.trim(F.regexp_replace(F.regexp_replace(target, "&amp;", "&"), "[\\t\\r\\n]", ""))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    full = (
        F.when(t == "", None)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(site, t))
        .when(t.rlike(r"^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, folder, t))
    )
    return F.when(base.contains("://") | t.contains("://"), full)


def canonical_target(html: Column) -> Column:
    """href of the first <link rel=canonical>, in either order of attributes; else null."""
    tag = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)([^>]*)>", 1)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def refresh_target(html: Column) -> Column:
    """url of the first <meta http-equiv=refresh>; else null."""
    tag = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)([^>]*)>", 1)
    return F.nullif(F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): page addresses joined by redirects and canonical links in the html."""
    url, html = F.col("url"), F.col("html")
    targets = F.filter(F.array(resolved(canonical_target(html), url), resolved(refresh_target(html), url)), lambda t: t.isNotNull())
    may = html.rlike(r"(?i)canonical|refresh")
    return pages.where(may & url.contains("://")).select(address(url).alias("a"), F.explode(targets).alias("t")).select("a", address(F.col("t")).alias("b")).where("b is not null")


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def judged(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (with host, path) and ``hit``: struct(size, rule, verdict) of the longest rule that fits, else null.

    Of rules as long as each other allow comes first, then the longer host.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(rule_name(r)), r[0] != "allow", -len(r[1]), r))
    if len(ordered) <= INLINE_RULES:
        hit = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
        for r in reversed(ordered):
            fits = ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
            hit = F.when(fits, F.struct(F.lit(len(rule_name(r))).alias("size"), F.lit(rule_name(r)).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(hit)
        return rows.withColumn("hit", hit)
    table = rows.sparkSession.createDataFrame([(r[1], r[2], len(ordered) - i, len(rule_name(r)), rule_name(r), r[0]) for i, r in enumerate(ordered)], "suffix string, prefix string, place int, size int, rule string, verdict string")
    labels = F.split("host", r"\.")
    places = rows.select("host", "path").distinct()
    suffixes = places.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    best = suffixes.join(table, "suffix").where(F.col("path").startswith(F.col("prefix"))).groupBy("host", "path").agg(F.max_by(F.struct("size", "rule", "verdict"), "place").alias("hit"))
    return rows.join(best, ["host", "path"], "left")


def filter_pages(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A page that a rule fits gets the longest rule's verdict. Any other page gets its
    aliases' verdict: pages that redirects and canonical links (from the html, and of
    ``edges`` (a, b) of URLs if given) join are one component; if a rule allows a member,
    the component is allowed, else blocked if a rule blocks a member. Members that are
    only link targets count too. Without such a member the verdict is allow. Null URLs
    have empty host and path and no aliases; null html has no links. Repeated rows are
    each judged; other columns are ignored.
    """
    tables = Tables(pages.sparkSession, "urls")
    url = F.col("url")
    rows = judged(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("node")), rules)
    links = page_edges(pages.select("url", "html"))
    if edges is not None:
        links = links.union(edges.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    parts = tables.write(components(links, tables))
    whole = F.concat(F.lit("x://"), F.col("node"))
    named = judged(parts.withColumn("host", host_of(whole)).withColumn("path", path_of(whole)), rules)
    of_part = named.groupBy("component").agg(F.max(F.col("hit.verdict") == "allow").alias("allows"), F.max(F.col("hit.verdict") == "block").alias("blocks")).where("allows or blocks")
    alias = parts.join(of_part, "component").select("node", F.when(F.col("allows"), "allow").otherwise("block").alias("alias"))
    # Rows without an address have no aliases; a key of their own deals them over all tasks.
    own = F.concat(F.lit("\u0000"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))
    out = rows.withColumn("node", F.coalesce("node", own)).join(alias, "node", "left")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "alias", F.lit("allow")).alias("verdict"), F.when(F.col("hit").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("none").alias("reason"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict of every row of ``pages`` by RULES; see ``filter_pages`` for nulls, repeats and pages without a rule."""
    return filter_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _sql_host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"


def _sql_path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"


def _sql_address(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"case when contains({url}, '://') then {_sql_host(url)} || case when starts_with({rest}, '/') then '' else '/' end || {rest} end"


#: The closure of the links is a recursive query; in DuckDB UNION stops it on cycles.
OP7_SQL = f"""
with recursive base as (
    select row_number() over () as rid, page_id, url, {_sql_host("url")} as host, {_sql_path("url")} as path, {_sql_address("url")} as node,
        regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0) as canon,
        regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0) as meta
    from pages),
rules(verdict, h, p) as (values {", ".join(repr(r) for r in RULES)}),
raw as (
    select *, unnest([nullif(regexp_extract(canon, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), ''),
                      nullif(regexp_extract(meta, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1), '')]) as target
    from base where node is not null),
links as (
    select node, trim(replace(target, '&amp;', '&')) as t, regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, host,
        case when regexp_extract(path, '(?s)^(.*/)', 1) = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end as folder
    from raw where target is not null),
whole as (
    select node, case when t = '' then null
        when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t
        when starts_with(t, '//') then scheme || ':' || t
        when starts_with(t, '/') then scheme || '://' || host || t
        when regexp_matches(t, '^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:') then null
        else scheme || '://' || host || folder || t end as url
    from links),
edges as (select distinct a, b from (select node as a, {_sql_address("url")} as b from whole) where b is not null and a <> b),
both_ways as (select a, b from edges union select b, a from edges),
reach(node, other) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on r.other = e.a),
hits as (
    select a.*, r.h || r.p as rule, r.verdict, row_number() over (partition by a.rid order by length(r.h || r.p) desc) as k
    from base a left join rules r on (a.host = r.h or ends_with(a.host, '.' || r.h)) and starts_with(a.path, r.p)),
seen as (select distinct other as node, split_part(other, '/', 1) as host, regexp_extract(other, '^[^/]*([^?]*)', 1) as path from reach),
verdicts as (
    select s.node, arg_max(r.verdict, length(r.h || r.p)) as v
    from seen s join rules r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p) group by 1),
alias as (select r.node, case when bool_or(v.v = 'allow') then 'allow' else 'block' end as alias from reach r join verdicts v on r.other = v.node group by 1)
select h.page_id, h.host, h.path, h.rule, coalesce(h.verdict, a.alias, 'allow') as verdict,
    case when h.rule is not null then 'rule' when a.alias is not null then 'alias' else 'none' end as reason
from hits h left join alias a on h.node = a.node where k = 1
"""
