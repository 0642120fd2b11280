"""Registered queries of the search engine and their SQL.

Each runs over whole tables; a limit stands only where a page or a top-k facet is
what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.analysis import BUILT_IN, ENGLISH_STOPS, LETTERS, WORD
from quarry.functions.dates import iso
from quarry.operators.mapping import Join
from quarry.operators.search import Index, search
from quarry.session import ship
from quarry.sources.changes import latest
from quarry.sources.tables import scratch
from quarry.streaming.upserts import tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = iso("2024-01-20T12:30:00Z")[0]

KEYS = {
    "documents": "doc_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
    "events": "event_id", "benchmark": "item_id", "pages": "page_id", "labels": "doc_id", "conversations": ("conv_id", "turn"), "lineitem": ("l_orderkey", "l_linenumber"),
}
TEXT = {"documents": {"text": {"type": "text"}}, "benchmark": {"text": {"type": "text"}}, "part": {"p_name": {"type": "text", "fields": {"raw": {"type": "keyword"}}}, "p_type": {"type": "text"}}, "conversations": {"text": {"type": "text"}}}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, name: str, df: DataFrame | None = None, **declared: dict) -> Index:
    return Index.of_table(name, read(spark, sf_dir, name) if df is None else df, KEYS[name], **(declared or TEXT.get(name, {})))


_analysed: dict[tuple[str, str, str], Index] = {}


def analysed(spark: SparkSession, sf_dir: str, name: str) -> Index:
    """A table with its term tables, which are written by the first query on it and read by all others of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _analysed:
        _analysed[key] = index(spark, sf_dir, name).analysed(scratch(spark, f"index-{name}"))
    return _analysed[key]


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def hits(name: str, table: str, query: dict, keep: list[str], sql: str, *, sort=None, page: tuple[int, int] | None = None, score: bool = False) -> None:
    """A search on one table: its key and some columns; all that match, or a page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = (analysed if table in TEXT else index)(spark, sf_dir, table)
        if page is None:
            found = search(i, {"query": query, "sort": "_doc" if not score else None}, NOW)
            return found.everything.select(*keep, F.round("_score", 7).alias("_score")) if score else found.matching[0][1].select(*keep)
        body = {"query": query, "_source": keep, "from": page[0], "size": page[1]} | ({"sort": sort} if sort else {})
        return search(i, body, NOW).hits.select(*keep, *(["_score"] if score else []))

    register(name, run, sql)


def facet(name: str, table: str, aggs: dict, path: tuple[str, ...], sql: str, query: dict | None = None, prepare=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare(read(spark, sf_dir, table)) if prepare else None
        return search(index(spark, sf_dir, table, df), {"query": query or {"match_all": {}}, "size": 0, "aggs": aggs}, NOW).table(*path)

    register(name, run, sql)


# -- filters -----------------------------------------------------------------------------------

hits("match_all", "orders", {"match_all": {}}, ["o_orderkey"], "SELECT o_orderkey FROM orders")
hits("match_none", "orders", {"match_none": {}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE false")
hits("ids", "orders", {"ids": {"values": ["1", "7", "32", "no"]}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 7, 32)")
hits("term_status", "orders", {"term": {"o_orderstatus": "F"}}, ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
hits("terms_priority", "orders", {"terms": {"o_orderpriority": ["1-URGENT", "5-LOW"]}}, ["o_orderkey", "o_orderpriority"], "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
hits("range_price", "orders", {"range": {"o_totalprice": {"gte": 1000, "lt": "150000.5"}}}, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 150000.5")
hits("range_keyword", "customer", {"range": {"c_mktsegment": {"gt": "BUILDING", "lte": "HOUSEHOLD"}}}, ["c_custkey", "c_mktsegment"], "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'")
hits(
    "bool_filter_sort", "orders", {"bool": {"filter": [{"term": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gte": 1000}}}], "must_not": {"term": {"o_orderpriority": "5-LOW"}}}}, ["o_orderkey", "o_totalprice"],
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderpriority <> '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    sort=[{"o_totalprice": "desc"}], page=(5, 20),
)
hits(
    "constant_score", "orders", {"constant_score": {"filter": {"term": {"o_orderstatus": "P"}}, "boost": 2.5}}, ["o_orderkey"],
    "SELECT o_orderkey, CAST(2.5 AS DOUBLE) AS _score FROM orders WHERE o_orderstatus = 'P'", score=True,
)
hits(
    "msm_75pct", "orders", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gte": 100000}}}, {"term": {"o_orderpriority": "1-URGENT"}}, {"range": {"o_custkey": {"lt": 500}}}], "minimum_should_match": "75%"}},
    ["o_orderkey"],
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F')::INT + (o_totalprice >= 100000)::INT + (o_orderpriority = '1-URGENT')::INT + (o_custkey < 500)::INT >= 3",
)
hits(
    "msm_conditions", "orders", {"bool": {"must": {"match_all": {}}, "should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gte": 100000}}}, {"term": {"o_orderpriority": "1-URGENT"}}], "minimum_should_match": "1<-50% 5<2"}},
    ["o_orderkey"],
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F')::INT + (o_totalprice >= 100000)::INT + (o_orderpriority = '1-URGENT')::INT >= 2",
)
hits("must_not_only", "orders", {"bool": {"must_not": [{"terms": {"o_orderstatus": ["F", "O"]}}]}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
hits("unmapped_field", "orders", {"bool": {"should": [{"term": {"nowhere": 1}}, {"term": {"o_orderstatus": "P"}}]}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
hits("lenient_match", "orders", {"bool": {"should": [{"match": {"o_custkey": {"query": "many", "lenient": True}}}, {"match": {"o_orderstatus": "P"}}]}}, ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")

# -- dates ---------------------------------------------------------------------------------------

hits("range_datemath", "events", {"range": {"ts": {"gte": "2024-01-10||-2d/d", "lte": "2024-01-15||/d"}}}, ["event_id", "ts"], "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-15 23:59:59.999'")
hits("term_date_period", "events", {"term": {"ts": "2024-01-12"}}, ["event_id", "ts"], "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999'")
hits("range_now", "events", {"range": {"ts": {"gt": "now-1w/w", "lt": "now+1d/d"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-14 23:59:59.999' AND ts < TIMESTAMP '2024-01-21'")
hits("range_format", "events", {"range": {"ts": {"gte": "15/01/2024", "format": "dd/MM/yyyy"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")

# -- patterns ---------------------------------------------------------------------------------------

hits("prefix_name", "customer", {"prefix": {"c_name": {"value": "Customer#00000001"}}}, ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
hits("prefix_ci", "customer", {"prefix": {"c_mktsegment": {"value": "bU", "case_insensitive": True}}}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE starts_with(lower(c_mktsegment), 'bu')")
hits("wildcard_name", "customer", {"wildcard": {"c_name": {"value": "*1?7"}}}, ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE regexp_full_match(c_name, '.*1.7', 's')")
hits("wildcard_url", "pages", {"wildcard": {"url": "http*/*1*"}}, ["page_id"], "SELECT page_id FROM pages WHERE regexp_full_match(url, 'http.*/.*1.*', 's')")
hits("regexp_brand", "part", {"regexp": {"p_brand": {"value": "brand\\#[1-3](2|4)?@", "case_insensitive": True}}}, ["p_partkey", "p_brand"], "SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(lower(p_brand), 'brand#[1-3](2|4)?.*', 's')")
hits("fuzzy_brand", "part", {"fuzzy": {"p_brand": {"value": "Brand#1", "fuzziness": 1, "transpositions": False}}}, ["p_partkey", "p_brand"], "SELECT p_partkey, p_brand FROM part WHERE levenshtein(p_brand, 'Brand#1') <= 1")
hits("fuzzy_swaps", "customer", {"fuzzy": {"c_mktsegment": {"value": "BUIDLING"}}}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE damerau_levenshtein(c_mktsegment, 'BUIDLING') <= 2")

# -- full text ----------------------------------------------------------------------------------------


def tokens_sql(column: str, pattern: str = WORD) -> str:
    pattern = pattern.replace("'", "''")
    found = f"regexp_extract_all({column}, '{pattern}')"
    kept = f"list_filter({found}, lambda t: strlen(t) < 255 AND regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))"
    return f"list_transform({kept}, lambda t: lower(t))"


def bm25_sql(terms: list[str], table: str = "documents", key: str = "doc_id", text: str = "text", op: str = "OR", page: str = "") -> str:
    """All that match, with the published formula."""
    each = {t: f"list_count(list_filter(toks, lambda x: x = '{t}'))" for t in terms}
    stats = ", ".join(f"sum(CASE WHEN list_contains(toks, '{t}') THEN 1 ELSE 0 END) AS df{k}" for k, t in enumerate(terms))
    parts = " + ".join(f"ln(1 + (n - df{k} + 0.5) / (df{k} + 0.5)) * {each[t]} * 2.2 / ({each[t]} + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))" for k, t in enumerate(terms))
    match = f" {op} ".join(f"list_contains(toks, '{t}')" for t in terms)
    return (
        f"WITH d AS (SELECT {key}, {tokens_sql(text)} AS toks FROM {table}), s AS (SELECT count(*) FILTER (len(toks) > 0) AS n, sum(len(toks)) * 1.0 / count(*) FILTER (len(toks) > 0) AS avgdl, {stats} FROM d) "
        f"SELECT {key}, round({parts}, 7) AS _score FROM d, s WHERE {match}{page.format(raw=parts)}"
    )


hits("match_or_bm25", "documents", {"match": {"text": "That the nicht"}}, ["doc_id"], bm25_sql(["that", "the", "nicht"], page=" ORDER BY {raw} DESC, doc_id LIMIT 25"), page=(0, 25), score=True)
hits("match_and_bm25", "documents", {"match": {"text": {"query": "of with this", "operator": "AND"}}}, ["doc_id"], bm25_sql(["of", "with", "this"], op="AND"), score=True)
hits("match_conversations", "conversations", {"match": {"text": "and"}}, ["conv_id", "turn"], f"SELECT conv_id, turn FROM conversations WHERE list_contains({tokens_sql('text')}, 'and')")
_PAIRS = f"WITH d AS (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents), p AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM d))"
hits("phrase_docs", "documents", {"match_phrase": {"text": "of the"}}, ["doc_id"], f"{_PAIRS} SELECT DISTINCT doc_id FROM p WHERE t = 'of' AND nxt = 'the'")
hits(
    "phrase_scored", "documents", {"match_phrase": {"text": "of the"}}, ["doc_id"],
    f"{_PAIRS}, f AS (SELECT doc_id, count(*) AS tf FROM p WHERE t = 'of' AND nxt = 'the' GROUP BY 1), "
    "s AS (SELECT count(*) FILTER (len(toks) > 0) AS n, sum(len(toks)) * 1.0 / count(*) FILTER (len(toks) > 0) AS avgdl, sum(list_contains(toks, 'of')::INT) AS d1, sum(list_contains(toks, 'the')::INT) AS d2 FROM d) "
    "SELECT doc_id, round((ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl)), 7) AS _score FROM d JOIN f USING (doc_id), s",
    score=True,
)
hits(
    "phrase_prefix", "documents", {"match_phrase_prefix": {"text": "of th"}}, ["doc_id"],
    f"{_PAIRS} SELECT DISTINCT doc_id FROM p WHERE t = 'of' AND nxt IN (SELECT DISTINCT t FROM p WHERE starts_with(t, 'th') ORDER BY t LIMIT 50)",
)


def _two_fields(kind: str, combine: str) -> None:
    def leaf(c: str, term: str, k: int) -> str:
        tf = f"list_count(list_filter({c}, lambda x: x = '{term}'))"
        return f"(CASE WHEN list_contains({c}, '{term}') THEN ln(1 + (n{c} - d{k} + 0.5) / (d{k} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({c}) / a{c})) ELSE 0 END)"

    sql = (
        f"WITH d AS (SELECT p_partkey, {tokens_sql('p_name')} AS x, {tokens_sql('p_type')} AS y FROM part), "
        "s AS (SELECT count(*) FILTER (len(x) > 0) AS nx, sum(len(x)) * 1.0 / count(*) FILTER (len(x) > 0) AS ax, count(*) FILTER (len(y) > 0) AS ny, sum(len(y)) * 1.0 / count(*) FILTER (len(y) > 0) AS ay, "
        "sum(list_contains(x, 'small')::INT) AS d0, sum(list_contains(x, 'red')::INT) AS d1, sum(list_contains(y, 'small')::INT) AS d2, sum(list_contains(y, 'red')::INT) AS d3 FROM d) "
        f"SELECT p_partkey, round({combine.format(a='(' + leaf('x', 'small', 0) + ' + ' + leaf('x', 'red', 1) + ') * 2', b='(' + leaf('y', 'small', 2) + ' + ' + leaf('y', 'red', 3) + ')')}, 7) AS _score FROM d, s "
        "WHERE list_has_any(x, ['small', 'red']) OR list_has_any(y, ['small', 'red'])"
    )
    body = {"query": "small red", "fields": ["p_name^2", "p_type"], "type": kind}
    if kind == "best_fields":
        body["tie_breaker"] = 0.3
    hits(f"multi_match_{kind.split('_')[0]}", "part", {"multi_match": body}, ["p_partkey"], sql, score=True)


_two_fields("best_fields", "greatest({a}, {b}) + 0.3 * ({a} + {b} - greatest({a}, {b}))")
_two_fields("most_fields", "{a} + {b}")
hits(
    "dis_max_tie", "orders", {"dis_max": {"queries": [{"constant_score": {"filter": {"term": {"o_orderstatus": "F"}}, "boost": 2}}, {"constant_score": {"filter": {"range": {"o_totalprice": {"gte": 100000}}}, "boost": 3}}], "tie_breaker": 0.5}},
    ["o_orderkey"],
    "SELECT o_orderkey, CAST(round(greatest(a, b) + 0.5 * (a + b - greatest(a, b)), 7) AS DOUBLE) AS _score FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 0 END AS a, CASE WHEN o_totalprice >= 100000 THEN 3.0 ELSE 0 END AS b FROM orders) WHERE a + b > 0",
    score=True,
)
hits(
    "term_scored", "orders", {"bool": {"must": {"term": {"o_orderstatus": "P"}}, "should": {"term": {"o_orderpriority": {"value": "1-URGENT", "boost": 2}}}}}, ["o_orderkey"],
    "WITH s AS (SELECT count(*) AS n, sum((o_orderstatus = 'P')::INT) AS a, sum((o_orderpriority = '1-URGENT')::INT) AS b FROM orders) "
    "SELECT o_orderkey, round(ln(1 + (n - a + 0.5) / (a + 0.5)) + CASE WHEN o_orderpriority = '1-URGENT' THEN 2 * ln(1 + (n - b + 0.5) / (b + 0.5)) ELSE 0 END, 7) AS _score FROM orders, s WHERE o_orderstatus = 'P'",
    score=True,
)

# -- missing values -----------------------------------------------------------------------------------


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))


def _gap_search(body: dict, *keep: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(index(spark, sf_dir, "events", _gaps(read(spark, sf_dir, "events"))), body, NOW).hits.select(*keep)

    return run


_V = "(SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)"
register("sort_missing_last", _gap_search({"sort": [{"v": {"order": "desc"}}, "event_type"], "from": 9000, "size": 500}, "event_id", "v"), f"SELECT event_id, v FROM {_V} ORDER BY v DESC NULLS LAST, event_type, event_id LIMIT 500 OFFSET 9000")


def exists_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(index(spark, sf_dir, "events", _gaps(read(spark, sf_dir, "events"))), {"query": {"bool": {"must_not": {"exists": {"field": "v"}}}}, "sort": "_doc"}, NOW)
    return found.matching[0][1].select("event_id")


register("not_exists", exists_gaps, f"SELECT event_id FROM {_V} WHERE v IS NULL")
facet("stats_missing", "events", {"s": {"stats": {"field": "v", "missing": 0.5}}, "c": {"value_count": {"field": "v"}}}, (), f"SELECT count(*)::BIGINT AS s_count, min(coalesce(v, 0.5)) AS s_min, max(coalesce(v, 0.5)) AS s_max, round(sum(coalesce(v, 0.5)), 4) AS s_sum, round(avg(coalesce(v, 0.5)), 6) AS s_avg, count(v)::BIGINT AS c FROM {_V}", prepare=_gaps)
_stats = QUERIES["stats_missing"]
QUERIES["stats_missing"] = lambda spark, sf_dir: _stats(spark, sf_dir).withColumns({"s_sum": F.round("s_sum", 4), "s_avg": F.round("s_avg", 6)})

# -- facets -----------------------------------------------------------------------------------------------

facet("metrics", "orders", {"lo": {"min": {"field": "o_totalprice"}}, "hi": {"max": {"field": "o_totalprice"}}, "n": {"value_count": {"field": "o_orderstatus"}}, "first": {"min": {"field": "o_orderdate"}}}, (), "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_orderstatus)::BIGINT AS n, epoch_ms(min(o_orderdate))::DOUBLE AS first FROM orders")
facet("terms_status", "orders", {"by": {"terms": {"field": "o_orderstatus"}}}, ("by",), 'SELECT o_orderstatus AS "by", count(*)::BIGINT AS doc_count FROM orders GROUP BY 1')
facet("terms_topk", "orders", {"by": {"terms": {"field": "o_custkey", "size": 7}}}, ("by",), 'SELECT o_custkey AS "by", count(*)::BIGINT AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7')
facet("terms_key_order", "orders", {"by": {"terms": {"field": "o_custkey", "size": 5, "order": {"_key": "desc"}, "min_doc_count": 3}}}, ("by",), 'SELECT o_custkey AS "by", count(*)::BIGINT AS doc_count FROM orders GROUP BY 1 HAVING count(*) >= 3 ORDER BY 1 DESC LIMIT 5')


def terms_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"by": {"terms": {"field": "o_orderpriority"}, "aggs": {"price": {"avg": {"field": "o_totalprice"}}}}}
    return search(index(spark, sf_dir, "orders"), {"query": {"range": {"o_totalprice": {"gte": 2000}}}, "size": 0, "aggs": aggs}).table("by").withColumn("price", F.round("price", 4))


register("terms_avg", terms_avg, 'SELECT o_orderpriority AS "by", count(*)::BIGINT AS doc_count, round(avg(o_totalprice), 4) AS price FROM orders WHERE o_totalprice >= 2000 GROUP BY 1')
facet(
    "terms_terms_topk", "lineitem", {"flag": {"terms": {"field": "l_returnflag"}, "aggs": {"supp": {"terms": {"field": "l_suppkey", "size": 3}, "aggs": {"most": {"max": {"field": "l_quantity"}}}}}}}, ("flag", "supp"),
    "SELECT l_returnflag AS flag, l_suppkey AS supp, count(*)::BIGINT AS doc_count, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) <= 3",
)
facet(
    "three_levels", "lineitem", {"flag": {"terms": {"field": "l_returnflag"}, "aggs": {"line": {"terms": {"field": "l_linestatus"}, "aggs": {"n": {"terms": {"field": "l_linenumber", "size": 2, "order": {"_count": "asc"}}}}}}}}, ("flag", "line", "n"),
    "SELECT l_returnflag AS flag, l_linestatus AS line, l_linenumber AS n, count(*)::BIGINT AS doc_count FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY count(*), l_linenumber) <= 2",
)
facet(
    "range_facet", "orders", {"r": {"range": {"field": "o_totalprice", "ranges": [{"to": 50000}, {"from": 50000, "to": 100000}, {"from": 75000, "key": "dear"}, {"from": 1e12}]}}}, ("r",),
    "SELECT k AS r, sum((o_totalprice >= a AND o_totalprice < b)::INT)::BIGINT AS doc_count FROM orders, (VALUES ('*-50000.0', -1e300, 50000), ('50000.0-100000.0', 50000, 100000), ('dear', 75000, 1e300), ('1000000000000.0-*', 1e12, 1e300)) AS r(k, a, b) GROUP BY k",
)
facet(
    "histogram", "orders", {"h": {"histogram": {"field": "o_totalprice", "interval": 25000, "offset": 500, "min_doc_count": 1}}}, ("h",),
    "SELECT floor((o_totalprice - 500) / 25000) * 25000 + 500 AS h, count(*)::BIGINT AS doc_count FROM orders GROUP BY 1",
)
facet(
    "histogram_gaps", "part", {"h": {"histogram": {"field": "p_size", "interval": 1, "extended_bounds": {"min": -2, "max": 60}}}}, ("h",),
    "SELECT g.h::DOUBLE AS h, count(p_size)::BIGINT AS doc_count FROM (SELECT unnest(range(-2, 61)) AS h) g LEFT JOIN part ON p_size = g.h GROUP BY 1",
)
facet(
    "date_histogram", "events", {"d": {"date_histogram": {"field": "ts", "fixed_interval": "36h", "offset": "6h"}, "aggs": {"top": {"max": {"field": "value"}}}}}, ("d",),
    "WITH b AS (SELECT floor((epoch_ms(ts) - 21600000) / 129600000.0)::BIGINT * 129600000 + 21600000 AS d, value FROM events), g AS (SELECT unnest(range(min(d), max(d) + 1, 129600000)) AS d FROM b) "
    "SELECT g.d, count(b.d)::BIGINT AS doc_count, max(value) AS top FROM g LEFT JOIN b USING (d) GROUP BY 1",
)
facet(
    "filters_quick_counts", "orders",
    {"open": {"filter": {"term": {"o_orderstatus": "O"}}}, "dear": {"filter": {"range": {"o_totalprice": {"gt": 200000}}}, "aggs": {"last": {"max": {"field": "o_custkey"}}}}, "both": {"filter": {"bool": {"must": [{"term": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gt": 200000}}}]}}}},
    (), "SELECT count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open_doc_count, count(*) FILTER (o_totalprice > 200000)::BIGINT AS dear_doc_count, max(o_custkey) FILTER (o_totalprice > 200000)::DOUBLE AS dear_last, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000)::BIGINT AS both_doc_count FROM orders",
)
facet(
    "filter_then_terms", "orders", {"open": {"filter": {"term": {"o_orderstatus": "O"}}, "aggs": {"by": {"terms": {"field": "o_orderpriority"}}}}}, ("open", "by"),
    "SELECT o_orderpriority AS \"by\", count(*)::BIGINT AS doc_count FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
)
facet(
    "terms_array", "orders", {"tag": {"terms": {"field": "tags", "size": 20}}}, ("tag",),
    "SELECT tag, count(*)::BIGINT AS doc_count FROM (SELECT unnest(list_distinct([o_orderstatus, o_orderpriority])) AS tag FROM orders) GROUP BY 1", prepare=lambda df: df.withColumn("tags", F.array("o_orderstatus", "o_orderpriority")),
)

# -- nested and related documents ---------------------------------------------------------------------------


def with_lines(spark: SparkSession, sf_dir: str) -> Index:
    """Orders with their lines inside; grouping shuffles the lines once, by the key that they're grouped by."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))).alias("lines"))
    return Index.of_table("orders", read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey"), "o_orderkey", lines={"type": "nested"})


def nested(name: str, query: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(with_lines(spark, sf_dir), {"query": query, "sort": "_doc"}).matching[0][1].select("o_orderkey")

    register(name, run, sql)


nested("nested_same_element", {"nested": {"path": "lines", "query": {"bool": {"must": [{"term": {"lines.l_returnflag": "R"}}, {"range": {"lines.l_quantity": {"gte": 45}}}]}}}}, "SELECT DISTINCT o_orderkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag = 'R' AND l_quantity >= 45")
nested(
    "nested_msm", {"nested": {"path": "lines", "query": {"bool": {"should": [{"term": {"lines.l_returnflag": "A"}}, {"range": {"lines.l_quantity": {"lt": 5}}}, {"term": {"lines.l_linestatus": "F"}}], "minimum_should_match": 2, "must_not": {"term": {"lines.l_linenumber": 1}}}}}},
    "SELECT DISTINCT o_orderkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND (l_returnflag = 'A')::INT + (l_quantity < 5)::INT + (l_linestatus = 'F')::INT >= 2 AND l_linenumber <> 1",
)
nested("not_nested", {"bool": {"must_not": {"nested": {"path": "lines", "query": {"term": {"lines.l_returnflag": "R"}}}}}}, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")


def family(spark: SparkSession, sf_dir: str) -> Index:
    """Customers as parents and orders as children in one index."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit("customer").alias("kin"), F.lit(None).cast("string").alias("_join_parent"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("status"))
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("key"), F.lit("order").alias("kin"), F.concat(F.lit("c"), "o_custkey").alias("_join_parent"), F.lit(None).cast("string").alias("segment"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    out = Index.of_table("family", c.unionByName(o), "key")
    out.mapping.join = Join("kin", {"customer": ["order"]})
    return out


def related(name: str, query: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(family(spark, sf_dir), {"query": query, "sort": "_doc"}).matching[0][1].select("key")

    register(name, run, sql)


_CHILD = {"has_child": {"type": "order", "query": {"bool": {"filter": [{"range": {"price": {"gte": 150000}}}, {"term": {"status": "F"}}]}}}}
related("has_child", _CHILD, "SELECT 'c' || c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F')")
related("not_has_child", {"bool": {"must": {"term": {"kin": "customer"}}, "must_not": _CHILD}}, "SELECT 'c' || c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F')")
related("has_parent", {"has_parent": {"parent_type": "customer", "query": {"term": {"segment": "BUILDING"}}}}, "SELECT 'o' || o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
related("parent_id", {"parent_id": {"type": "order", "id": "c7"}}, "SELECT 'o' || o_orderkey AS key FROM orders WHERE o_custkey = 7")


# -- several indices ------------------------------------------------------------------------------------------


def parties(spark: SparkSession, sf_dir: str) -> list[Index]:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return [Index.of_table("customer", c, "key"), Index.of_table("supplier", s, "key")]


_PARTIES = "(SELECT 'customer' AS _index, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier)"
register(
    "multi_index_union",
    lambda spark, sf_dir: search(parties(spark, sf_dir), {"query": {"range": {"balance": {"gte": 5000}}}, "sort": [{"balance": "desc"}], "size": 200}).hits.select("_index", "key", "balance"),
    f"SELECT _index, key, balance FROM {_PARTIES} WHERE balance >= 5000 ORDER BY balance DESC, _index, key LIMIT 200",
)


def multi_index_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(parties(spark, sf_dir), {"query": {"bool": {"should": [{"term": {"segment": "BUILDING"}}, {"range": {"balance": {"lt": 0}}}]}}, "sort": "key"}, allow_unmapped=False)
    return found.everything.orderBy(*found.order).select("_index", "key")


register(
    "multi_index_unmapped",
    multi_index_unmapped,
    f"SELECT _index, key FROM {_PARTIES} WHERE segment = 'BUILDING' OR balance < 0",
)


def multi_index_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"mean": {"avg": {"field": "balance"}}, "n": {"value_count": {"field": "balance"}}}
    return search(parties(spark, sf_dir), {"size": 0, "aggs": aggs}).table().withColumn("mean", F.round("mean", 6))


register("multi_index_avg", multi_index_avg, f"SELECT round(avg(balance), 6) AS mean, count(balance)::BIGINT AS n FROM {_PARTIES}")

# -- analysis -----------------------------------------------------------------------------------------------------


def term_counts(analyzer: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = BUILT_IN[analyzer]
        terms = read(spark, sf_dir, "documents").select(F.explode(a.unstemmed(F.col("text"))).alias("term"))
        counted = terms.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
        # only distinct terms are stemmed
        return counted.select(a.stem(F.col("term")).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n")) if a.stemmer else counted

    return run


def _counts_sql(tokens: str) -> str:
    return f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest({tokens}) AS term FROM documents) GROUP BY 1"


_LETTERS_SQL = f"list_transform(list_filter(regexp_extract_all(text, '{LETTERS}'), lambda t: strlen(t) < 255), lambda t: lower(t))"
register("analyze_standard", term_counts("standard"), _counts_sql(tokens_sql("text")))
register("analyze_simple", term_counts("simple"), _counts_sql(_LETTERS_SQL))
register("analyze_whitespace", term_counts("whitespace"), _counts_sql("list_filter(regexp_extract_all(text, '\\S+'), lambda t: strlen(t) < 255)"))
_STOPS = ", ".join(f"'{w}'" for w in sorted(ENGLISH_STOPS))
register("analyze_stop", term_counts("stop"), _counts_sql(f"list_filter({_LETTERS_SQL}, lambda t: NOT list_contains([{_STOPS}], t))"))
register("analyze_english", term_counts("english"))
register("analyze_french", term_counts("french"))

# -- sources, projection, streams ------------------------------------------------------------------------------------

register(
    "latest_by_id",
    lambda spark, sf_dir: latest(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("_id"), F.col("event_id").alias("_seq_no"), F.col("event_type") == "none", "event_type", "value").toDF("_id", "_seq_no", "_deleted", "event_type", "value")).select("_id", "_seq_no", "event_type", "value", "_version"),
    "SELECT user_id::VARCHAR AS _id, event_id AS _seq_no, event_type, value, n::BIGINT AS _version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1",
)
register(
    "source_filter",
    lambda spark, sf_dir: search(with_lines(spark, sf_dir), {"_source": {"includes": ["o_orderkey", "lines.*", "o_t*"], "excludes": ["lines.l_line*"]}, "sort": [{"o_totalprice": "asc"}]}).all_hits().selectExpr("o_orderkey", "o_totalprice", "to_json(lines) AS lines"),
    "SELECT o_orderkey, o_totalprice, (SELECT '[' || string_agg('{\"l_quantity\":' || (l_quantity::DOUBLE)::VARCHAR || ',\"l_returnflag\":\"' || l_returnflag || '\"}', ',' ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) || ']' FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders",
)
register(
    "event_windows",
    lambda spark, sf_dir: tumbling(read(spark, sf_dir, "events"), "ts", "1 day", "event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
)
