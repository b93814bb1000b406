"""Registered queries over the test tables, with the SQL that gives the same rows.

Query vectors are the rows whose vec_id is divisible by 50: a stated query set against all rows.
Pivots and pinned codebooks are other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cluster, evaluate, filters, generate, graph, models, mutate, quantize, search
from ..streaming import runbook

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("query"))


# --- SQL parts ----------------------------------------------------------------

E = "embeddings"
L2 = "pow(list_distance(q.embedding::double[], b.embedding::double[]), 2)"
FULL = "list_distance(q.embedding::double[], b.embedding::double[])"
IP = "-list_inner_product(q.embedding::double[], b.embedding::double[])"
COS = "1 - list_cosine_similarity(q.embedding::double[], b.embedding::double[])"
CN = "1 - list_inner_product(q.embedding::double[], b.embedding::double[])"


def pairs_sql(d: str = L2, where: str = "true", queries: str = "q.vec_id % 50 = 0", source: str = E) -> str:
    return f"select q.vec_id as qid, b.vec_id as id, round({d}, 6) + 0.0 as distance, b.label as label from {E} q, {source} b where {queries} and {where}"


def _metric_sql(d: str, source: str) -> str:
    """Pairs with a derived table (vec_id, embedding) that is named before."""
    return f"select q.vec_id as qid, b.vec_id as id, round({d}, 6) + 0.0 as distance from {E} q, {source} b where q.vec_id % 50 = 0"


def ranked_sql(pairs: str, k: int, low: int = 0) -> str:
    return f"select qid, id, rank, distance from (select *, row_number() over (partition by qid order by distance, id)::int as rank from ({pairs})) where rank <= {k} and rank > {low}"


# --- nearest neighbours by metric -----------------------------------------------


def _metric_query(name: str, metric: str, d: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = base(spark, sf)
        return search.knn(rows, asked(rows), 10, metric)

    run.__name__ = name
    query(ranked_sql(pairs_sql(d), 10))(run)


for _name, _metric, _d in (("knn_l2", "l2", L2), ("knn_full_l2", "full_l2", FULL), ("knn_ip", "InnerProduct", IP), ("knn_cosine", "cosine", COS), ("knn_cosine_normalized", "CosineNormalized", CN)):
    _metric_query(_name, _metric, _d)


@query(f"select vec_id as id, round(list_inner_product(embedding::double[], embedding::double[]), 6) as squared, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as l2, round(list_sum(list_transform(embedding::double[], lambda x: abs(x))), 6) as l1, list_max(list_transform(embedding::double[], lambda x: abs(x))) as largest from {E}")
def vector_norms(spark, sf):
    v = F.col("vec")
    return base(spark, sf).select("id", F.round(V.squared_norm(v), 6).alias("squared"), F.round(V.l2_norm(v), 6).alias("l2"), F.round(V.l1_norm(v), 6).alias("l1"), V.max_norm(v).alias("largest"))


@query(f"select q.vec_id as a, b.vec_id as b, round({L2}, 6) + 0.0 as l2, round({FULL}, 6) + 0.0 as full_l2, round({IP}, 6) + 0.0 as ip, round({COS}, 6) + 0.0 as cosine from {E} q join {E} b on b.vec_id = q.vec_id + 1")
def distance_columns(spark, sf):
    rows = base(spark, sf)
    a = rows.select(F.col("id").alias("a"), F.col("vec").alias("x"), (F.col("id") + 1).alias("b"))
    both = a.join(rows.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", *[(F.round(V.distance(m, F.col("x"), F.col("y")), 6) + F.lit(0.0)).alias(n) for m, n in (("l2", "l2"), ("full_l2", "full_l2"), ("innerproduct", "ip"), ("cosine", "cosine"))])


@query(f"""select qid, id, rank, bits from (select q.vec_id as qid, b.vec_id as id, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: case when (p[1] > 0) <> (p[2] > 0) then 1 else 0 end))::int as bits,
row_number() over (partition by q.vec_id order by list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: case when (p[1] > 0) <> (p[2] > 0) then 1 else 0 end)), b.vec_id)::int as rank from {E} q, {E} b where q.vec_id % 50 = 0) where rank <= 10""")
def hamming_sign_knn(spark, sf):
    rows = base(spark, sf)
    return search.bit_knn(rows, asked(rows), 10).select("qid", "id", "rank", F.col("distance").cast("int").alias("bits"))


_BOTH = "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: case when p[1] > 0 and p[2] > 0 then 1 else 0 end))"


@query(ranked_sql(pairs_sql(f"-{_BOTH}::double"), 10))
def bit_inner_product_knn(spark, sf):
    rows = base(spark, sf)
    return search.bit_knn(rows, asked(rows), 10, "innerproduct")


# --- filters ------------------------------------------------------------------


@query(ranked_sql(pairs_sql(where="b.label = 3"), 10))
def filtered_knn_label(spark, sf):
    rows = base(spark, sf)
    return search.filtered_knn(rows, asked(rows), F.col("label") == 3, 10)


@query(ranked_sql(pairs_sql(where="b.label in (1, 2) and not b.vec_id % 2 = 0"), 10))
def multihop_filtered_knn(spark, sf):
    rows = base(spark, sf)
    document = F.to_variant_object(F.struct("label", (F.col("id") % 2).alias("odd")))
    test = filters.to_column(filters.parse_filter('{"$or": [{"label": {"$eq": 1}}, {"label": {"$eq": 2}}], "$not": {"odd": {"$eq": 0}}}'), document)
    return search.filtered_knn(rows, asked(rows), test, 10)


def _events_filter(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "events").where(filters.json_filter(text, F.parse_json("props"))).select("event_id")

    run.__name__ = name
    query(f"select event_id from events where {where}")(run)


_K = "try_cast(json_extract_string(props, '$.k') as double)"
_events_filter("filter_eq", '{"k": {"$eq": 5}}', f"coalesce({_K} = 5, false)")
_events_filter("filter_range_numeric", '{"k": {"$gte": 10, "$lt": 20.5}}', f"coalesce({_K} >= 10 and {_K} < 20.5, false)")
_events_filter("filter_and_or_not", '{"$and": [{"$or": [{"k": {"$lt": 10}}, {"k": {"$gt": 90}}]}, {"$not": {"k": {"$eq": 95}}}]}', f"coalesce({_K} < 10 or {_K} > 90, false) and not coalesce({_K} = 95, false)")
_events_filter("filter_ne_missing", '{"missing": {"$ne": 3}}', "false")
_events_filter("filter_not_missing", '{"$not": {"missing": {"$eq": 3}}}', "true")


@query("select 'ne_null' as test, true as holds union all select 'ne_missing', false union all select 'int_not_real', false union all select 'real', true union all select 'text_range', false union all select 'array', true union all select 'path', true union all select 'not_missing', true")
def filter_truth_table(spark, sf):
    document = F.parse_json(F.lit('{"i": 1, "r": 1.5, "s": "1", "n": null, "a": [1, 2], "o": {"p": "x"}}'))
    tests = {"ne_null": '{"n": {"$ne": 3}}', "ne_missing": '{"m": {"$ne": 3}}', "int_not_real": '{"i": {"$eq": 1.0}}', "real": '{"r": {"$gt": 1}}', "text_range": '{"s": {"$gte": 0}}', "array": '{"a": {"$eq": [1, 2]}}', "path": '{"o.p": {"$eq": "x"}}', "not_missing": '{"$not": {"m": {"$ne": 3}}}'}
    rows = spark.range(1).select(F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in tests]), F.array(*[filters.json_filter(f, document) for f in tests.values()]))).alias("test", "holds"))
    return rows


@query(f"select 1::bigint as query_id, event_id as doc_id from events where coalesce({_K} < 3, false) union all select 2::bigint, event_id from events where coalesce({_K} = 50, false)")
def filter_bitmaps(spark, sf):
    docs = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.parse_json("props").alias("v"))
    return filters.matches(docs, F.col("v"), {1: '{"k": {"$lt": 3}}', 2: '{"k": {"$eq": 50}}'})


@query("select doc_id from documents where (lang = 'en' or lang = 'fr') and source = 'src1'")
def text_label_cnf_filter(spark, sf):
    docs = table(spark, sf, "documents").withColumn("labels", F.concat_ws(", ", "lang", "source"))
    return docs.where(filters.label_match("en|fr & src1", F.col("labels"))).select("doc_id")


@query("select event_id as doc_id, 'k' as path, 'int' as kind, json_extract_string(props, '$.k') as value from events")
def flatten_json(spark, sf):
    docs = table(spark, sf, "events")
    return filters.flatten_json(docs, "event_id", F.parse_json("props"))


def _attributes(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    parts = [docs.select("doc_id", F.lit(c).alias("path"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "int"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null")


_ATTR = "(select doc_id, 'lang' as path, 'string' as kind, lang as value from documents union all select doc_id, 'source', 'string', source from documents union all select doc_id, 'n_chars', 'int', n_chars::varchar from documents)"


@query(f"select path, kind, value, dense_rank() over (order by path, kind, value) - 1 as attr_id from (select distinct path, kind, value from {_ATTR} where value is not null)")
def attribute_dictionary(spark, sf):
    return filters.attribute_dictionary(_attributes(spark, sf))


@query(f"select path, value, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from {_ATTR} where path <> 'n_chars' group by 1, 2")
def inverted_index_postings(spark, sf):
    index = filters.postings(_attributes(spark, sf)).where("path <> 'n_chars'")
    return index.groupBy("path", "value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def _index_query(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index = filters.postings(_attributes(spark, sf))
        return filters.query_index(index, table(spark, sf, "documents"), filters.parse_filter(text))

    run.__name__ = name
    query(f"select distinct doc_id from documents where {where}")(run)


_index_query("posting_intersect", '{"lang": {"$eq": "en"}, "source": {"$eq": "src2"}}', "lang = 'en' and source = 'src2'")
_index_query("posting_union", '{"$or": [{"lang": {"$eq": "de"}}, {"source": {"$eq": "src2"}}]}', "lang = 'de' or source = 'src2'")
_index_query("posting_difference", '{"lang": {"$eq": "en"}, "$not": {"source": {"$eq": "src2"}}}', "lang = 'en' and not source = 'src2'")
_index_query("posting_range", '{"n_chars": {"$gte": 1000, "$lt": 2000}}', "n_chars >= 1000 and n_chars < 2000")


@query("select path, value, count(*) as n from (select doc_id, 'lang' as path, case when doc_id < 20 then 'xx' else lang end as value from documents where doc_id >= 10) group by 1, 2")
def inverted_index_update(spark, sf):
    attributes = _attributes(spark, sf).where("path = 'lang'")
    index = filters.remove_document(filters.postings(attributes), list(range(10)))
    new = attributes.where("doc_id between 10 and 19").withColumn("value", F.lit("xx"))
    return filters.update_document(index, new).groupBy("path", "value").agg(F.count("*").alias("n"))


# --- search modes ---------------------------------------------------------------


@query(ranked_sql(pairs_sql(f"{L2} * case when b.label = 4 then 0.5 else 1.0 end"), 10))
def beta_knn(spark, sf):
    rows = base(spark, sf)
    return search.beta_knn(rows, asked(rows), F.col("label") == 4, 10)


@query(f"with p as ({pairs_sql(L2 + ' * case when b.label = 4 then 0.5 else 1.0 end')}), best as (select *, row_number() over (partition by qid order by distance, id) as r from p) select qid, id, rank, distance from (select qid, id, distance, row_number() over (partition by qid order by distance, id)::int as rank from best where r <= 50 and label = 4) where rank <= 10")
def inline_beta_knn(spark, sf):
    rows = base(spark, sf)
    return search.beta_knn(rows, asked(rows), F.col("label") == 4, 10, final_filter=True, length=50)


@query(ranked_sql(f"select * from ({pairs_sql()}) where distance <= 1.6", 1000000))
def range_search(spark, sf):
    rows = base(spark, sf)
    return search.range_search(rows, asked(rows), 1.6)


@query(ranked_sql(f"select * from ({pairs_sql()}) where distance <= 1.7 and distance > 1.4", 20))
def range_search_annulus(spark, sf):
    rows = base(spark, sf)
    return search.range_search(rows, asked(rows), 1.7, 1.4, max_returned=20)


@query(ranked_sql(pairs_sql(), 20, 10))
def paged_knn_page2(spark, sf):
    rows = base(spark, sf)
    return search.knn(rows, asked(rows), 10, page=2)


@query(f"select qid, id, label::bigint as attribute, rank, distance from (select *, row_number() over (partition by qid order by distance, id)::int as rank from (select *, row_number() over (partition by qid, label order by distance, id) as place from ({pairs_sql()}) where label is not null) where place <= 2) where rank <= 10")
def diverse_knn(spark, sf):
    rows = base(spark, sf)
    return search.diverse_knn(rows, asked(rows), F.col("label"), 10, 2)


@query(ranked_sql(pairs_sql(where="b.vec_id <> q.vec_id", queries="q.vec_id in (3, 7)"), 10))
def knn_by_element(spark, sf):
    return search.knn_by_element(base(spark, sf), [3, 7], 10)


@query(ranked_sql(pairs_sql(), 10))
def hybrid_merge_knn(spark, sf):
    rows = base(spark, sf)
    index, fresh = rows.where("id % 5 <> 0 or id % 10 = 0"), rows.where("id % 5 = 0")
    return search.merge_hits([search.knn(index, asked(rows), 10), search.knn(fresh, asked(rows), 10)], 10)


@query(ranked_sql(pairs_sql(where="b.vec_id >= 50"), 10))
def skip_base_ground_truth(spark, sf):
    rows = base(spark, sf)
    return search.knn(rows.where("id >= 50"), asked(rows), 10)


@query(ranked_sql(pairs_sql(where="(b.vec_id % 3 = 0 or b.vec_id >= 400)"), 10))
def partial_bitmap_knn(spark, sf):
    rows = base(spark, sf)
    return search.bitmap_knn(rows, asked(rows), rows.where("id % 3 = 0 and id < 400").select("id"), 400, 10)


@query(ranked_sql(pairs_sql(where="b.vec_id not in (0, 1)"), 9))
def post_processed_knn(spark, sf):
    rows = base(spark, sf)
    hits = search.knn(rows, asked(rows), 11)
    return search.post_process(hits, search.without_start_points([0, 1]), lambda h: h.where("rank <= 9").select("qid", "id", "rank", "distance"))


@query("select id, vec_id as rank_id, vec from (select vec_id as id, vec_id, list_sum(embedding::double[])::varchar is not null as vec from embeddings where vec_id between 20 and 29)")
def range_scan(spark, sf):
    return base(spark, sf).where("id between 20 and 29").select("id", F.col("id").alias("rank_id"), F.col("vec").isNotNull().alias("vec"))


@query("select max(len(embedding))::int as dim, count(*) as n from embeddings")
def probe_table(spark, sf):
    return base(spark, sf).agg(F.max(F.size("vec")).alias("dim"), F.count("*").alias("n"))


@query(ranked_sql(pairs_sql(source=E), 5).replace("select qid, id, rank, distance from", "select r.qid, r.id, r.rank, r.distance, e.label from (select qid, id, rank, distance from") + ") r join embeddings e on r.id = e.vec_id")
def knn_with_payload(spark, sf):
    rows = base(spark, sf)
    hits = search.knn(rows, asked(rows), 5)
    return hits.join(rows.select("id", "label"), "id").select("qid", "id", "rank", "distance", "label")


# --- several vectors for one document -------------------------------------------

_MV = f"(select q.vec_id // 50 % 3 as qid, q.vec_id as qpos, b.label::bigint as doc, {{d}} as d from {E} q, {E} b where q.vec_id % 50 = 0)"
_MVQ = {"maxsim": None, "chamfer": "sum(low)", "mv_average_pairwise": None, "mv_min_pairwise": "min(low)", "mv_avg_of_mins": "avg(low)"}


def _multi(name: str, how: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = base(spark, sf)
        docs = rows.select(F.col("label").alias("doc"), F.col("id").alias("pos"), "vec")
        q = rows.where("id % 50 = 0").select((F.floor(F.col("id") / 50) % 3).alias("qid"), F.col("id").alias("pos"), F.col("vec").alias("query"))
        return search.multivector(docs, q, how)

    run.__name__ = name
    query(sql)(run)


_LOW = "(select qid, qpos, doc, min(d) as low from {t} group by 1, 2, 3)"
_multi("maxsim", "max_sim", f"select qid, qpos, doc, round(low, 6) + 0.0 as distance from {_LOW.format(t=_MV.format(d=IP))}")
_multi("chamfer", "chamfer", f"select qid, doc, round(sum(low), 6) + 0.0 as distance from {_LOW.format(t=_MV.format(d=IP))} group by 1, 2")
_multi("mv_average_pairwise", "average_pairwise", f"select qid, doc, round(avg(d), 6) + 0.0 as distance from {_MV.format(d=L2)} group by 1, 2")
_multi("mv_min_pairwise", "min_pairwise", f"select qid, doc, round(min(d), 6) + 0.0 as distance from {_MV.format(d=L2)} group by 1, 2")
_multi("mv_avg_of_mins", "avg_of_mins", f"select qid, doc, round(avg(low), 6) + 0.0 as distance from {_LOW.format(t=_MV.format(d=L2))} group by 1, 2")


# --- evaluation ---------------------------------------------------------------

_TRUTH, _FOUND = ranked_sql(pairs_sql(), 10), ranked_sql(pairs_sql(where="b.vec_id % 4 <> 1"), 10)
_HITS = f"with t as ({_TRUTH}), f as ({_FOUND}), h as (select t.qid, count(f.id) as hits, count(*) as n_truth from t left join f on t.qid = f.qid and t.id = f.id group by 1)"


def _truth_and_found(spark, sf, k: int = 10):
    rows = base(spark, sf)
    return search.knn(rows, asked(rows), k), search.knn(rows.where("id % 4 <> 1"), asked(rows), 10), asked(rows)


@query(f"{_HITS} select round(sum(hits) / (count(*) * 10), 6) as recall from h")
def recall_at_k(spark, sf):
    truth, found, _ = _truth_and_found(spark, sf)
    return evaluate.recall(found, truth, 10).select(F.round("recall", 6).alias("recall"))


@query(f"{_HITS} select qid, round(hits / 10, 6) as recall from h")
def recall_by_query(spark, sf):
    truth, found, _ = _truth_and_found(spark, sf)
    return evaluate.recall_by_query(found, truth, 10).select("qid", F.round("recall", 6).alias("recall"))


@query(f"with t as ({ranked_sql(pairs_sql(), 20)}), f as ({_FOUND}), l as (select qid, max(distance) as lim from t where rank <= 10 group by 1), w as (select t.qid, t.id from t join l using (qid) where distance <= lim), h as (select w.qid, least(count(f.id), 10) / 10 as r from w left join f on w.qid = f.qid and w.id = f.id group by 1) select round(avg(r), 6) as average, min(r) as least, max(r) as most from h")
def recall_ties(spark, sf):
    truth, found, _ = _truth_and_found(spark, sf, 20)
    return evaluate.recall_with_ties(found, truth, 10, 10).select(F.round("average", 6).alias("average"), "least", "most")


@query(f"with t as ({ranked_sql(pairs_sql(where='b.label = 2 and q.vec_id <> 50'), 10)}), f as ({ranked_sql(pairs_sql(where='b.label = 2 and b.vec_id % 3 <> 1'), 10)}), n as (select vec_id as qid from embeddings where vec_id % 50 = 0), a as (select n.qid, (select count(*) from t where t.qid = n.qid) as nt, (select count(*) from f where f.qid = n.qid) as nf, (select count(*) from t join f on t.qid = f.qid and t.id = f.id where t.qid = n.qid) as h from n) select qid, case when nt = 0 then 100.0 else round(100 * h / greatest(least(10, nt), nf), 6) end as recall from a")
def filtered_recall(spark, sf):
    rows = base(spark, sf)
    own = rows.where("label = 2")
    truth = search.knn(own, asked(rows).where("qid <> 50"), 10)
    found = search.knn(own.where("id % 3 <> 1"), asked(rows), 10)
    return evaluate.filtered_recall(found, truth, asked(rows), 10).select("qid", F.round("recall", 6).alias("recall"))


@query(f"with t as (select qid, id from ({pairs_sql()}) where distance <= 1.6), f as (select qid, id from ({pairs_sql(where='b.vec_id % 4 <> 1')}) where distance <= 1.6) select round((select count(*) from t join f using (qid, id)) / (select count(*) from t), 6) as recall")
def range_pooled_recall(spark, sf):
    rows = base(spark, sf)
    truth = search.range_search(rows, asked(rows), 1.6)
    found = search.range_search(rows.where("id % 4 <> 1"), asked(rows), 1.6)
    return evaluate.pooled_recall(found, truth).select(F.round("recall", 6).alias("recall"))


@query("with s as (select event_type, list_sort(list(value)) as v, avg(value) as a from events group by 1) select event_type, len(v)::bigint as n, round(a, 6) as avg, v[((len(v) - 1) * 50 // 100 + 1)::int] as p50, v[((len(v) - 1) * 95 // 100 + 1)::int] as p95, v[((len(v) - 1) * 99 // 100 + 1)::int] as p99 from s")
def latency_percentiles(spark, sf):
    return evaluate.latency_summary(table(spark, sf, "events"), "value", ["event_type"]).withColumn("avg", F.round("avg", 6))


@query("with s as (select list_sort(list(value)) as v, avg(value) as a, sum(value) as t from events) select len(v)::bigint as n, round(a, 6) as mean, round(t, 4) as total, v[(least(floor(0.9 * len(v)), len(v) - 1) + 1)::int] as value from s")
def percentile_stats(spark, sf):
    return evaluate.percentile_stats(table(spark, sf, "events"), "value", 0.9).select("n", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"), "value")


@query("with s as (select list_sort(list(value)) as v, avg(value) as a from events) select len(v)::bigint as n, round(a, 6) as mean, round((v[((len(v) - 1) // 2 + 1)::int] + v[(len(v) // 2 + 1)::int]) / 2, 6) as median, v[(least(9 * len(v) // 10, len(v) - 1) + 1)::int] as p90, v[(least(99 * len(v) // 100, len(v) - 1) + 1)::int] as p99, v[1] as minimum from s")
def benchmark_percentiles(spark, sf):
    return evaluate.benchmark_percentiles(table(spark, sf, "events"), "value").withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query(f"with p as (select q.vec_id as qid, b.vec_id as id, {L2} as d from {E} q, {E} b where q.vec_id % 50 = 0), n as (select qid, avg(d) as near from (select *, row_number() over (partition by qid order by round(d, 6), id) as r from p where id <> qid) where r <= 10 group by 1), f as (select qid, avg(d) as far from p group by 1) select round(avg(far / near), 4) as contrast from n join f using (qid)")
def relative_contrast(spark, sf):
    rows = base(spark, sf)
    return cluster.relative_contrast(rows, asked(rows), 10).select(F.round("contrast", 4).alias("contrast"))


@query("with m as (select event_type as metric, avg(value) filter (where event_id % 2 = 0) as before, avg(value) filter (where event_id % 2 = 1) as after from events group by 1) select metric, round(before, 6) as before, round(after, 6) as after, round((after - before) / before, 6) as change, (after - before) / before <= 0.0 as passes from m")
def run_comparison(spark, sf):
    events = table(spark, sf, "events")
    runs = [events.where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")) for r in (0, 1)]
    out = evaluate.compare_runs(*runs, tolerances={t: 0.0 for t in ("view", "signup", "error", "click", "purchase")})
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")], "passes")


@query("select round(count(*) * 1000.0 / sum(value), 6) as qps, round(sum((event_type = 'click')::int) / sum((event_type in ('click', 'view'))::int), 6) as hit_rate, 0.0::double as empty from events")
def rates(spark, sf):
    one = table(spark, sf, "events").agg(F.count("*").alias("n"), F.sum("value").alias("ms"), F.sum((F.col("event_type") == "click").cast("int")).alias("c"), F.sum((F.col("event_type") == "view").cast("int")).alias("v"))
    return one.select(F.round(evaluate.qps(F.col("n"), F.col("ms")), 6).alias("qps"), F.round(evaluate.share(F.col("c"), F.col("v")), 6).alias("hit_rate"), evaluate.share(F.lit(0), F.lit(0)).alias("empty"))


# --- codes ----------------------------------------------------------------------

_DIMS = "(select i, avg(x) as mean, var_pop(x) as variance from (select unnest(embedding::double[]) as x, unnest(range(64)) as i from embeddings) group by 1)"


@query(f"select i::int as dim, round(mean, 6) + 0.0 as mean, round(variance, 6) as variance from {_DIMS}")
def dim_stats(spark, sf):
    return quantize.dimension_stats(base(spark, sf)).select("dim", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"with d as {_DIMS}, p as (select 2.0 * sqrt(max(variance)) as p from d), x as (select vec_id as id, unnest(embedding::double[]) as x, unnest(range(64)) as i from embeddings) select id, sum(round(greatest(0.0, least(255.0, (x - (mean - p)) / (2 * p / 255))))::int)::bigint as total, min(round(greatest(0.0, least(255.0, (x - (mean - p)) / (2 * p / 255))))::int) as least, max(round(greatest(0.0, least(255.0, (x - (mean - p)) / (2 * p / 255))))::int) as most from x join d using (i), p group by 1")
def sq8_encode(spark, sf):
    rows = base(spark, sf)
    codes = rows.select("id", quantize.scalar_codes(F.col("vec"), *quantize.scalar_parameters(rows)).alias("c"))
    return codes.select("id", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min("c").alias("least"), F.array_max("c").alias("most"))


def _minmax_sql(low: str, high: str, top: int) -> str:
    return f"with v as (select vec_id as id, embedding::double[] as e from embeddings), m as (select *, list_avg(e) as a from v), r as (select id, e, {low} as lo, {high} as hi from m), s as (select *, greatest(hi - lo, 1e-8) / {top} as step from r) select id, round(lo, 6) + 0.0 as low, round(step, 9) as step, list_sum(list_transform(e, lambda x: round(greatest(0.0, least({top}.0, (x - lo) / step)))::int))::bigint as total from s"


def _minmax(name: str, bits: int, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = base(spark, sf).withColumn("p", quantize.minmax_parameters(F.col("vec"), bits))
        codes = rows.withColumn("c", quantize.minmax_codes(F.col("vec"), bits, F.col("p")))
        return codes.select("id", (F.round("p.low", 6) + F.lit(0.0)).alias("low"), F.round("p.step", 9).alias("step"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))

    run.__name__ = name
    query(sql)(run)


_minmax("minmax4_encode", 4, _minmax_sql("list_min(e)", "list_max(e)", 15))
_minmax("minmax1_encode", 1, _minmax_sql("list_avg(list_filter(e, lambda x: x < a))", "list_avg(list_filter(e, lambda x: x >= a))", 1))


@query(f"with v as (select vec_id as id, embedding::double[] as e, list_min(embedding::double[]) as lo, (list_max(embedding::double[]) - list_min(embedding::double[])) / 255 as step from embeddings), d as (select id, list_transform(e, lambda x: lo + round((x - lo) / step) * step) as y from v) select q.id as a, b.id as b, round(list_inner_product(q.y, b.y), 6) + 0.0 as ip from d q join d b on b.id = q.id + 1")
def minmax_compensated_ip(spark, sf):
    rows = base(spark, sf).select("id", "vec").withColumn("p", quantize.minmax_parameters(F.col("vec"), 8))
    codes = rows.select("id", "p", quantize.minmax_codes(F.col("vec"), 8, F.col("p")).alias("c"))
    a = codes.select(F.col("id").alias("a"), F.col("p").alias("pa"), F.col("c").alias("ca"), (F.col("id") + 1).alias("b"))
    both = a.join(codes.select(F.col("id").alias("b"), F.col("p").alias("pb"), F.col("c").alias("cb")), "b")
    return both.select("a", "b", (F.round(quantize.compensated_dot(F.col("ca"), F.col("pa"), F.col("cb"), F.col("pb")), 6) + F.lit(0.0)).alias("ip"))


@query("select id, list_sum(list_transform(c, lambda x: round(x * 15.0 / 255.0)::int))::bigint as total from (select vec_id as id, list_transform(embedding::double[], lambda x: round((x - list_min(embedding::double[])) / ((list_max(embedding::double[]) - list_min(embedding::double[])) / 255))) as c from embeddings)")
def minmax_recode(spark, sf):
    rows = base(spark, sf).withColumn("p", quantize.minmax_parameters(F.col("vec"), 8))
    codes, _ = quantize.minmax_recode(quantize.minmax_codes(F.col("vec"), 8, F.col("p")), F.col("p"), 8, 4)
    return rows.select("id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_DEC = "(select vec_id, label, list_transform(e, lambda x: lo + round((x - lo) / step) * step) as embedding from (select vec_id, label, embedding::double[] as e, list_min(embedding::double[]) as lo, (list_max(embedding::double[]) - list_min(embedding::double[])) / 15 as step from embeddings))"


@query(ranked_sql(pairs_sql(source=_DEC), 10))
def minmax_code_knn(spark, sf):
    rows = base(spark, sf)
    p = quantize.minmax_parameters(F.col("vec"), 4)
    codes = rows.withColumn("p", p).withColumn("code", quantize.minmax_codes(F.col("vec"), 4, F.col("p")))
    return quantize.decoded_knn(codes, asked(rows), 10)


@query(f"select round(sum(list_inner_product(embedding::double[], embedding::double[])), 4) as energy from {E}")
def singular_energy(spark, sf):
    values, _ = quantize.singular_values(base(spark, sf))
    return spark.createDataFrame([(round(float((values**2).sum()), 4),)], "energy double")


def _pinned(spark, sf):
    """A codebook pinned to rows 1 to 16, 8 chunks of 8: for its figures; ``trained_codes_recall`` learns one."""
    import numpy as np

    rows = base(spark, sf)
    first = sorted(rows.where("id between 1 and 16").select("id", "vec").collect(), key=lambda r: r.id)
    offsets = quantize.chunk_offsets(64, 8)
    return rows, quantize.train_codebook(np.array([r.vec for r in first], float), offsets, 16, 0, pinned=True), offsets


_PQ = "with s as (select vec_id as id, c, list_slice(embedding::double[], c * 8 + 1, c * 8 + 8) as p from embeddings, (select unnest(range(8)) as c)), d as (select s.id, s.c, b.id - 1 as code, round(pow(list_distance(s.p, b.p), 2), 12) as d from s join s b on s.c = b.c and b.id between 1 and 16), codes as (select id, c, code from (select *, row_number() over (partition by id, c order by d, code) as r from d) where r = 1)"
_ADC = f"{_PQ}, adc as (select q.id as qid, k.id as id, round(sum(pow(list_distance(q.p, b.p), 2)), 6) + 0.0 as distance from codes k join s b on b.id = k.code + 1 and b.c = k.c join s q on q.c = k.c and q.id % 50 = 0 group by 1, 2)"


@query(f"{_PQ} select id, c::int as chunk, code::int as code from codes")
def pq_encode_pinned(spark, sf):
    return quantize.encode(*_pinned(spark, sf)).select("id", F.posexplode("code").alias("chunk", "code"))


@query(f"{_ADC} select qid, id, rank, distance from (select *, row_number() over (partition by qid order by distance, id)::int as rank from adc) where rank <= 10")
def pq_adc_knn(spark, sf):
    rows, book, offsets = _pinned(spark, sf)
    return quantize.adc_knn(quantize.encode(rows, book, offsets), asked(rows), book, offsets, 10)


@query(f"{_ADC}, near as (select qid, id from (select *, row_number() over (partition by qid order by distance, id) as r from adc) where r <= 80), x as (select n.qid, n.id, round(pow(list_distance(q.embedding::double[], b.embedding::double[]), 2), 6) + 0.0 as distance from near n join embeddings q on q.vec_id = n.qid join embeddings b on b.vec_id = n.id) select qid, id, rank, distance from (select *, row_number() over (partition by qid order by distance, id)::int as rank from x) where rank <= 10")
def pq_rerank_knn(spark, sf):
    rows, book, offsets = _pinned(spark, sf)
    return quantize.reranked_knn(rows, quantize.encode(rows, book, offsets), asked(rows), book, offsets, 10)


@query(f"{_PQ} select k.id, round(sum(pow(list_distance(s.p, b.p), 2)), 6) + 0.0 as loss from codes k join s on s.id = k.id and s.c = k.c join s b on b.id = k.code + 1 and b.c = k.c group by 1")
def pq_decode_loss(spark, sf):
    rows, book, offsets = _pinned(spark, sf)
    back = quantize.decode(quantize.encode(rows, book, offsets), book).withColumnRenamed("vec", "near")
    return rows.join(back, "id").select("id", (F.round(V.squared_l2(F.col("vec"), F.col("near")), 6) + F.lit(0.0)).alias("loss"))


@query()
def spherical_encode(spark, sf):
    return quantize.spherical_codes(base(spark, sf), 4)


@query("select vec_id as id, round(list_inner_product(embedding::double[], embedding::double[]), 6) as norm from embeddings")
def random_rotation_norms(spark, sf):
    return quantize.transformed(base(spark, sf), "rotation").select("id", F.round(V.squared_norm(F.col("vec")), 6).alias("norm"))


@query("select vec_id as id, round(list_inner_product(embedding::double[], embedding::double[]), 6) as norm from embeddings")
def hadamard_norms(spark, sf):
    return quantize.transformed(base(spark, sf), "double_hadamard").select("id", F.round(V.squared_norm(F.col("vec")), 6).alias("norm"))


# --- centroids ------------------------------------------------------------------


def _pivots(rows: DataFrame) -> DataFrame:
    return rows.where("id between 1 and 8").select(F.col("id").alias("shard"), F.col("vec").cast("array<double>").alias("vec"))


_SHARD = f"select b.vec_id as id, q.vec_id as shard, row_number() over (partition by b.vec_id order by round({L2}, 6), q.vec_id)::int as rank, round({L2}, 6) + 0.0 as distance from {E} q, {E} b where q.vec_id between 1 and 8"


@query(f"select * from ({_SHARD}) where rank <= 2")
def ivf_assign(spark, sf):
    rows = base(spark, sf)
    return cluster.assign(rows, _pivots(rows), 2).select("id", "shard", "rank", (F.col("distance") + F.lit(0.0)).alias("distance"))


@query(f"with a as (select id, shard from ({_SHARD}) where rank = 1), x as (select vec_id as id, unnest(embedding::double[]) as x, unnest(range(64)) as dim from embeddings) select shard, dim::int as dim, round(avg(x), 6) + 0.0 as x, count(*) as n from x join a using (id) group by 1, 2")
def kmeans_one_lloyd_step(spark, sf):
    rows = base(spark, sf)
    return cluster.lloyd_step(rows, _pivots(rows)).select("shard", "dim", (F.round("x", 6) + F.lit(0.0)).alias("x"), "n")


_MEAN = "(select list(mean order by i) as m from " + _DIMS + ")"


@query(f"select vec_id as id, round(pow(list_distance(embedding::double[], m), 2), 6) as distance from embeddings, {_MEAN} order by 2, 1 limit 1")
def medoid(spark, sf):
    return cluster.medoid(base(spark, sf))


@query(f"with a as (select id, shard, rank from ({_SHARD})), w as (select id as qid, shard from a where id % 50 = 0 and rank <= 7), own as (select id, shard from a where rank = 1) {ranked_sql('select w.qid, o.id, round(' + L2 + ', 6) + 0.0 as distance from w join own o using (shard) join embeddings q on q.vec_id = w.qid join embeddings b on b.vec_id = o.id', 10)}")
def ivf_probe_knn(spark, sf):
    rows = base(spark, sf)
    pivots = _pivots(rows)
    return cluster.probe(cluster.sharded(rows, pivots), pivots, asked(rows), 10, 7)


# --- changes --------------------------------------------------------------------


@query("select event_type as id, event_id as seq, value from (select *, row_number() over (partition by event_type order by event_id desc) as r from events) where r = 1")
def upsert_last_write_wins(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("id"), F.col("event_id").alias("seq"), "value")
    return mutate.last_writes(log)


@query("select vec_id as id, label from embeddings where vec_id % 7 <> 0")
def tombstone_antijoin(spark, sf):
    rows = base(spark, sf).select("id", "label")
    return mutate.without(rows, rows.where("id % 7 = 0"))


@query("select vec_id as id, case when vec_id % 10 = 0 then 99 else label end as label from embeddings where vec_id % 7 <> 0 union all select 1000000 + vec_id, 99 from embeddings where vec_id < 5")
def compaction_merge(spark, sf):
    rows = base(spark, sf).select("id", "label")
    delta = rows.where("id % 10 = 0").unionByName(rows.where("id < 5").select((F.col("id") + 1000000).alias("id"), "label")).withColumn("label", F.lit(99))
    merged, _ = mutate.compact(rows, delta, rows.where("id % 7 = 0"))
    return merged.select("id", "label")


_RUNBOOK = """
test:
  max_pts: 120
  0:
    operation: insert
    start: 0
    end: 100
  1:
    operation: search
  2:
    operation: delete
    start: 20
    end: 40
  3:
    operation: search
  4:
    operation: replace
    ids_start: 100
    ids_end: 110
    tags_start: 0
    tags_end: 10
  5:
    operation: search
"""
_ALIVE = "select vec_id as id, case when vec_id < 10 then vec_id + 100 else vec_id end as source from embeddings where vec_id < 20 or vec_id between 40 and 99"


@query(f"{_ALIVE}")
def runbook_live_set(spark, sf):
    rows = base(spark, sf)
    log = runbook.change_log(spark, runbook.load(_RUNBOOK, "test"), rows)
    same = rows.select(F.col("id").alias("source"), F.xxhash64("vec").alias("h"))
    return mutate.live_set(log).select("id", F.xxhash64("vec").alias("h")).join(same, "h").select("id", "source")


def _stage(n: int, source: str) -> str:
    d = L2.replace("q.embedding", "q.e").replace("b.embedding", "b.e")
    return f"select {n} as stage, qid, id, rank, distance from (select *, row_number() over (partition by qid order by distance, id)::int as rank from (select q.vec_id as qid, b.id as id, round({d}, 6) + 0.0 as distance from (select vec_id, embedding as e from embeddings where vec_id % 50 = 0) q, ({source}) b)) where rank <= 5"


@query(" union all ".join([_stage(1, "select vec_id as id, embedding as e from embeddings where vec_id < 100"), _stage(3, "select vec_id as id, embedding as e from embeddings where vec_id < 100 and vec_id not between 20 and 39"), _stage(5, f"select a.id, e.embedding as e from ({_ALIVE}) a join embeddings e on e.vec_id = a.source")]))
def runbook_search_after_delete(spark, sf):
    rows = base(spark, sf)
    return runbook.run(spark, runbook.load(_RUNBOOK, "test"), rows, asked(rows), 5)


@query("select s.slot from (select unnest(range(600)) as slot) s where slot not in (select vec_id from embeddings where vec_id % 2 = 0)")
def free_slots(spark, sf):
    return mutate.slots(base(spark, sf).where("id % 2 = 0").select(F.col("id").alias("slot")), 600)


@query("select id, case when id in (select vec_id from embeddings where vec_id % 7 = 0) then 'deleted' when id in (select vec_id from embeddings) then 'valid' else 'unknown' end as status from (select unnest([0, 1, 7, 8, 99999999]) as id)")
def element_status(spark, sf):
    rows = base(spark, sf).select("id")
    ids = spark.createDataFrame([(x,) for x in (0, 1, 7, 8, 99999999)], "id long")
    return mutate.status(ids, rows, rows.where("id % 7 = 0"))


# --- graphs ---------------------------------------------------------------------

_EDGES = f"select qid as src, id as dst, rank as ord from ({ranked_sql(pairs_sql(where='b.vec_id <> q.vec_id', queries='true'), 6)})"


def _edges(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = base(spark, sf)
    return rows, graph.knn_edges(rows, 6).select("src", "dst", "ord")


@query(_EDGES)
def knn_graph_edges(spark, sf):
    return _edges(spark, sf)[1]


@query(f"with e as ({_EDGES}) select distinct src, dst from (select src, dst from e union all select dst, src from e)")
def undirected_edges(spark, sf):
    return graph.undirected(_edges(spark, sf)[1])


@query(f"with e as ({_EDGES}), i as (select v.vec_id as id, count(e.dst) as n from embeddings v left join e on e.dst = v.vec_id group by 1) select max(n) as max_degree, avg(n) as avg_degree, min(n) as min_degree, sum((n < 2)::int)::bigint as under_two from i")
def graph_degree_stats(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.degree_stats(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), rows)


_REACH = f"with recursive e as ({_EDGES}), r(id, level) as (select 0::bigint, 0 union select e.dst, r.level + 1 from r join e on e.src = r.id where r.level < 60), f as (select id, min(level)::int as level from r group by 1)"


@query(f"{_REACH} select * from f")
def graph_reachable(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.reachable(edges, rows.where("id = 0"))


@query(f"{_REACH} select v.vec_id as id, row_number() over (order by coalesce(f.level, 1 << 30), v.vec_id) - 1 as new_id from embeddings v left join f on f.id = v.vec_id")
def bfs_order_levels(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.bfs_order(edges, rows, rows.where("id = 0"))


@query(f"with e as ({_EDGES}) select round(avg(abs(src - dst)), 6) as locality from e")
def edge_locality(spark, sf):
    return graph.locality(_edges(spark, sf)[1]).select(F.round("locality", 6).alias("locality"))


@query(f"{_REACH}, o as (select v.vec_id as id, row_number() over (order by coalesce(f.level, 1 << 30), v.vec_id) - 1 as n from embeddings v left join f on f.id = v.vec_id) select round(avg(abs(a.n - b.n)), 6) as locality from e join o a on a.id = e.src join o b on b.id = e.dst")
def reordered_locality(spark, sf):
    rows, edges = _edges(spark, sf)
    order = graph.bfs_order(edges, rows, rows.where("id = 0"))
    return graph.locality(graph.renumbered(edges, order)).select(F.round("locality", 6).alias("locality"))


@query(f"with e as ({_EDGES}) select src, dst, ord from e where src % 5 <> 0 and dst % 5 <> 0")
def drop_deleted_neighbors(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.drop_deleted(edges, rows.where("id % 5 = 0")).select("src", "dst", "ord")


@query(f"with e as ({_EDGES}), o as (select a.src, b.dst from e a join e b on a.dst = b.src where a.dst % 5 = 0) select distinct src, dst from (select src, dst from e union all select src, dst from o) where src % 5 <> 0 and dst % 5 <> 0 and src <> dst")
def delete_and_repair(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.delete_and_repair(edges, rows.where("id % 5 = 0"))


@query(f"{_REACH} select id, level from f order by level, id limit 50")
def navigation_nodes(spark, sf):
    rows, edges = _edges(spark, sf)
    return graph.navigation_nodes(edges, rows.where("id = 0"), 50 * 2048)


@query()
def robust_prune(spark, sf):
    rows = base(spark, sf)
    return graph.robust_prune(graph.knn_edges(rows, 40), rows, 8)


@query()
def gorder_reorder(spark, sf):
    rows = base(spark, sf)
    edges = graph.knn_edges(rows, 6).select("src", "dst", "ord")
    return graph.greedy_order(edges, rows.select("id", (F.col("id") % 2).alias("part")), 16)


@query("with p as (select x * 25 + y * 5 + z as id, x, y, z from (select unnest(range(5)) as x), (select unnest(range(5)) as y), (select unnest(range(5)) as z)) select 0::bigint as qid, id::bigint as id, rank, distance from (select id, ((x + 1) ** 2 + (y + 1) ** 2 + (z + 1) ** 2)::double as distance, row_number() over (order by (x + 1) ** 2 + (y + 1) ** 2 + (z + 1) ** 2, id)::int as rank from p) where rank <= 10")
def lattice_knn(spark, sf):
    q = spark.createDataFrame([(0, [-1.0, -1.0, -1.0])], "qid long, query array<double>")
    return search.knn(generate.lattice(spark, 3, 5), q, 10)


@query("with p as (select unnest(range(16)) as id) select a.id::bigint as src, b.id::bigint as dst from p a, p b where abs(a.id // 4 - b.id // 4) + abs(a.id % 4 - b.id % 4) = 1")
def lattice_edges(spark, sf):
    return generate.lattice_edges(spark, 2, 4)


# --- models ---------------------------------------------------------------------

_GB = 1 << 30


@query(f"select kind, size, ram, case when kind = 'u8' then case when size >= 400 * {_GB}::bigint and ram between 80 * {_GB}::bigint and 128 * {_GB}::bigint then 'huge_bytes' when size >= 100 * {_GB}::bigint or size / ram >= 3 then 'tiered_bytes' else 'paged' end else case when size <= ram / 2 then 'resident' when size <= ram * 2 then 'hybrid' else 'paged' end end as profile from (select unnest(['u8', 'f32']) as kind), (select unnest([1, 20, 60, 500]) * {_GB}::bigint as size), (select unnest([8, 64, 100]) * {_GB}::bigint as ram)")
def memory_partition_profile(spark, sf):
    kinds = spark.createDataFrame([(k, s * _GB, r * _GB) for k in ("u8", "f32") for s in (1, 20, 60, 500) for r in (8, 64, 100)], "kind string, size long, ram long")
    return kinds.select("kind", "size", "ram", models.placement(F.col("kind"), F.col("size"), F.col("ram")).alias("profile"))


@query("select event_id, (event_id // 16 + case when event_type = 'view' then 64 else 0 end + case when value <= 64 then -16 when value >= 512 then 24 else 0 end)::bigint as score from events")
def eviction_score(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", models.eviction_score(F.col("event_id"), F.col("event_type") == "view", F.col("value")).cast("long").alias("score"))


@query("select user_id as id, event_id as at, nth from (select *, row_number() over (partition by user_id order by event_id)::int as nth from events) where nth >= 2")
def admission_second_miss(spark, sf):
    return models.admitted(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at")))


_TRACE = "(select user_id % 20 as trace, (event_id % 32)::double as fanout, event_type = 'view' as sequential, (event_id % 3)::int as layer from events)"


@query(f"with t as (select trace, avg(fanout) as f, stddev_pop(fanout) as s, avg(sequential::int) as q, avg((layer >= 1)::int) as h from {_TRACE} group by 1) select trace, round(f, 6) as mean_fanout, round(s, 6) as std_fanout, round(q, 6) as seq_locality, round(h, 6) as high_layer_share, round(f / 32 - 0.55 * q + 0.35 * h, 6) as score, (case when f / 32 - 0.55 * q + 0.35 * h < 0.42 then 0 else 1 end)::int as cluster from t")
def policy_cluster_score(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("trace"), (F.col("event_id") % 32).cast("double").alias("fanout"), (F.col("event_type") == "view").alias("sequential"), (F.col("event_id") % 3).alias("layer"))
    t = models.trace_features(e)
    score = models.policy_score(F.col("mean_fanout"), F.col("seq_locality"), F.col("high_layer_share"))
    return t.select("trace", *[F.round(c, 6).alias(c) for c in t.columns[1:]], F.round(score, 6).alias("score"), models.policy_cluster(score).alias("cluster"))


@query(f"with e as ({_EDGES}), p as (select src, dst from e where ord <= 3) select src, dst, r::int as repeat, row_number() over (partition by src, r order by dst)::int as place from p, (select unnest([1, 2]) as r)")
def prefetch_candidates(spark, sf):
    return models.prefetch_candidates(_edges(spark, sf)[1].withColumn("layer", F.lit(0)), 3, 2)


# The queries over stored indexes, files, stores and streams register themselves here too.
from . import stored  # noqa: E402, F401
