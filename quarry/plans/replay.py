"""Registered queries that replay the write path, catalogs, exports, refusals and analysis, and their SQL.

Documents are made from the driver's tables, so that DuckDB can say what must
come out; where an answer doesn't depend on a table (which requests are refused,
what stems are), the SQL lists what a client of the query language expects.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import SearchError
from quarry.functions import analysis
from quarry.functions.stemmers import porter
from quarry.operators.search import Scrolls, count, duration, search
from quarry.plans.queries import NOW, analysed, bm25_sql, hits, index, read, register, tokens_sql
from quarry.sources.catalog import Catalog, check_name
from quarry.sources.tables import scratch

_PRIORITY = {"mappings": {"properties": {"status": {"type": "keyword"}, "price": {"type": "double"}, "more": {"properties": {"priority": {"type": "keyword"}, "customer": {"type": "long"}}}}}}


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, scratch(spark, "catalog"))


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values(columns: str, found: list[tuple]) -> str:
    """The rows as SQL."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in found)}) AS v({columns})"


# -- loads: every order is indexed, then some are updated, and some deleted --------------------


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    body = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")).alias("more")))
    change = F.lit('{"doc": {"price": 1, "more": {"priority": "changed"}}}')

    def some(where, step: int, op: str, what) -> DataFrame:
        return o.where(where).select((key * 3 + step).alias("position"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("index"), key.cast("string").alias("id"), what.cast("string").alias("body"))

    first = some(F.lit(True), 0, "index", body)
    return first.unionAll(some("o_orderstatus = 'P'", 1, "update", change)).unionAll(some("o_orderpriority = '5-LOW'", 2, "delete", F.lit(None)))


def loaded(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame]:
    c = catalog(spark)
    c.create("orders", _PRIORITY)
    return c, c.load("orders", actions(spark, sf_dir))


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a search sees after the load: objects merged, values coerced, deleted ones gone."""
    c, _ = loaded(spark, sf_dir)
    found = c.search("orders", {"sort": "_doc"}).matching[0][1]
    return found.select("_id", "status", F.col("price"), F.col("more.priority").alias("priority"), F.col("more.customer").alias("customer"), F.col("_version"))


register("bulk_load", bulk_load, "SELECT o_orderkey::VARCHAR AS _id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END AS priority, o_custkey AS customer, (1 + (o_orderstatus = 'P')::INT)::BIGINT AS _version FROM orders WHERE o_orderpriority <> '5-LOW'")
register("bulk_outcomes", lambda spark, sf_dir: loaded(spark, sf_dir)[1].groupBy("op", "result").agg(F.count("*").alias("n")), "SELECT op, result, n FROM (SELECT 'index' AS op, 'created' AS result, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'update', 'updated', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'delete', 'deleted', count(*) FROM orders WHERE o_orderpriority = '5-LOW') WHERE n > 0")


def create_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One `create` per order on its customer's id: the first makes the document, the others conflict."""
    c = catalog(spark)
    c.create("customers", {"mappings": {"properties": {"order": {"type": "long"}}}})
    o = read(spark, sf_dir, "orders")
    creates = o.select(F.col("o_orderkey").alias("position"), F.lit("create").alias("op"), F.lit(None).cast("string").alias("index"), F.col("o_custkey").cast("string").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("order"))).alias("body"))
    return c.load("customers", creates).select("_id", F.coalesce("result", F.substring_index("error", ":", 1)).alias("outcome"), F.col("position").alias("order"))


register("create_conflicts", create_conflicts, 'SELECT o_custkey::VARCHAR AS _id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN \'created\' ELSE \'version_conflict_engine_exception\' END AS outcome, o_orderkey AS "order" FROM orders')


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = loaded(spark, sf_dir)
    c.create("other")
    return c.overview().select("health", "status", "index", "docs", "deleted")


register("cat_overview", overview, "SELECT 'green' AS health, 'open' AS status, 'orders' AS \"index\", count(*) FILTER (o_orderpriority <> '5-LOW')::BIGINT AS docs, count(*) FILTER (o_orderpriority = '5-LOW')::BIGINT AS deleted FROM orders UNION ALL SELECT 'green', 'open', 'other', 0, 0")

# -- single writes: nations --------------------------------------------------------------------


def nations(spark: SparkSession, sf_dir: str) -> tuple[Catalog, list]:
    """Every nation indexed by one bulk request; odd ones then updated, those of region 4 deleted."""
    c, found = catalog(spark), sorted(read(spark, sf_dir, "nation").collect())  # 25 rows
    lines = []
    for r in found:
        lines += [{"index": {"_index": "nations", "_id": str(r[0])}}, {"name": r[1], "region": {"key": r[2], "seen": [r[2]]}}]
    lines += [x for r in found if r[0] % 2 for x in ({"update": {"_index": "nations", "_id": str(r[0])}}, {"doc": {"region": {"seen": []}}})]
    lines += [{"delete": {"_index": "nations", "_id": str(r[0])}} for r in found if r[2] == 4] + [{"delete": {"_index": "nations", "_id": "none"}}]
    done = c.bulk("\n".join(map(json.dumps, lines)))
    return c, [(next(iter(i.values()))["_id"], next(iter(i)), next(iter(i.values()))["result"], next(iter(i.values()))["status"]) for i in done["items"]]


register(
    "bulk_items", lambda spark, sf_dir: rows(spark, nations(spark, sf_dir)[1], "_id string, op string, result string, status int"),
    "SELECT n_nationkey::VARCHAR AS _id, 'index' AS op, 'created' AS result, 201::INT AS status FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'update', 'updated', 200 FROM nation WHERE n_nationkey % 2 = 1 "
    "UNION ALL SELECT n_nationkey::VARCHAR, 'delete', 'deleted', 200 FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'none', 'delete', 'not_found', 404",
)


def mget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations and one that never was, asked for in one request before any refresh."""
    c, _ = nations(spark, sf_dir)
    got = c.mget(ids=[str(k) for k in range(26)], index="nations")
    return rows(spark, [(d["_id"], d["found"], d.get("_version", 0), (d.get("_source") or {}).get("name"), json.dumps((d.get("_source") or {}).get("region", {}).get("seen"))) for d in got], "_id string, found boolean, _version bigint, name string, seen string")


register(
    "mget_realtime", mget,
    "SELECT k::VARCHAR AS _id, coalesce(n_regionkey <> 4, false) AS found, (CASE WHEN n_regionkey <> 4 THEN 1 + k % 2 ELSE 0 END)::BIGINT AS _version, CASE WHEN n_regionkey <> 4 THEN n_name END AS name, "
    "CASE WHEN n_regionkey = 4 OR n_regionkey IS NULL THEN 'null' WHEN k % 2 = 1 THEN '[]' ELSE '[' || n_regionkey || ']' END AS seen FROM range(26) r(k) LEFT JOIN nation ON n_nationkey = k",
)


def doc_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation at a time: written, written again, updated, read, deleted, read again."""
    c, out = catalog(spark), []
    for r in sorted(read(spark, sf_dir, "nation").collect()):
        i = str(r[0])
        steps = [c.write("n", "index", i, {"name": r[1]})["result"], c.write("n", "index", i, {"name": r[1] + "!"})["result"], c.write("n", "update", i, {"doc": {"region": r[2]}})["result"], c.write("n", "update", i, {"doc": {"region": r[2]}})["result"]]
        got = c.get("n", i)
        steps += [got["_source"]["name"], str(got["_version"])]
        steps += [c.write("n", "delete", i)["result"], str(c.get("n", i)["found"]).lower(), c.write("n", "delete", i)["result"]] if r[2] == 0 else []
        out.append((i, " ".join(steps)))
    return rows(spark, out, "_id string, steps string")


register("doc_writes", doc_writes, "SELECT n_nationkey::VARCHAR AS _id, 'created updated updated noop ' || n_name || '! 3' || CASE WHEN n_regionkey = 0 THEN ' deleted false not_found' ELSE '' END AS steps FROM nation")


def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that name the sequence number they saw; those of even nations name a wrong one."""
    c, out = nations(spark, sf_dir)[0], []
    for r in sorted(read(spark, sf_dir, "nation").collect()):
        seen = c.get("nations", str(r[0]))
        try:
            done = c.write("nations", "index", str(r[0]), {"name": "x"}, if_seq_no=seen.get("_seq_no", 0) + (r[0] % 2 == 0), if_primary_term=1)["result"]
        except SearchError as e:
            done = e.kind
        out.append((str(r[0]), done))
    return rows(spark, out, "_id string, outcome string")


register("optimistic_concurrency", concurrency, "SELECT n_nationkey::VARCHAR AS _id, CASE WHEN n_nationkey % 2 = 1 AND n_regionkey <> 4 THEN 'updated' ELSE 'version_conflict_engine_exception' END AS outcome FROM nation")

# -- expressions, aliases, index management ----------------------------------------------------


def _by_region(spark: SparkSession, sf_dir: str) -> Catalog:
    """An index of nations for each region, an alias over the first three, and one to write to."""
    c = catalog(spark)
    lines = []
    for r in sorted(read(spark, sf_dir, "nation").collect()):
        lines += [{"index": {"_index": f"r-{r[2]}", "_id": str(r[0])}}, {"name": r[1]}]
    c.bulk("\n".join(map(json.dumps, lines)))
    c.update_aliases([{"add": {"index": f"r-{k}", "alias": "few", "is_write_index": k == 1}} for k in range(3)] + [{"add": {"index": "r-4", "alias": "last"}}])
    c.refresh()
    return c


_EXPRESSIONS = {"r-*": "true", "few": "n_regionkey < 3", "r-*,-few": "n_regionkey >= 3", "few,last": "n_regionkey < 3 OR n_regionkey = 4", "_all,-r-0": "n_regionkey > 0", "r-3,last": "n_regionkey >= 3", "f*": "n_regionkey < 3"}


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _by_region(spark, sf_dir)
    return rows(spark, [(e, c.count(e), ",".join(s.name for s in c.resolve(e))) for e in _EXPRESSIONS], "expression string, n bigint, indices string")


register("index_expressions", expressions, " UNION ALL ".join(f"SELECT '{e}' AS expression, count(*)::BIGINT AS n, string_agg(DISTINCT 'r-' || n_regionkey, ',' ORDER BY 'r-' || n_regionkey) AS indices FROM nation WHERE {w}" for e, w in _EXPRESSIONS.items()))


def write_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _by_region(spark, sf_dir)
    landed = [c.write(name, "index", f"new{k}", {"name": "x"})["_index"] for k, name in enumerate(("few", "last", "r-0", "fresh"))]
    c.update_aliases([{"remove": {"index": "r-1", "alias": "few"}}, {"add": {"index": "fresh", "alias": "few"}}])
    c.refresh()
    return rows(spark, [("written", ",".join(landed)), ("few", ",".join(s.name for s in c.resolve("few"))), ("count", str(c.count("few,r-1")))], "what string, value string")


register("write_alias", write_alias, "SELECT 'written' AS what, 'r-1,r-4,r-0,fresh' AS value UNION ALL SELECT 'few', 'fresh,r-0,r-2' UNION ALL SELECT 'count', (count(*) + 3)::VARCHAR FROM nation WHERE n_regionkey < 3")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat and nested settings alike, mappings that grow, what a restart finds, and the cluster's settings."""
    c = catalog(spark)
    c.create("a", {"settings": {"index": {"number_of_replicas": 0}, "index.refresh_interval": "1s"}, "mappings": {"properties": {"t": {"type": "text"}}}, "aliases": {"other": {}}})
    c.put_mapping("a", {"properties": {"k": {"type": "keyword"}}})
    c.write("a", "index", "1", {"t": "x", "n": 5, "d": "2024-01-01", "deep": {"b": True}})
    c.refresh()
    c.put_settings({"persistent": {"action": {"destructive_requires_name": False}}})
    again = Catalog(spark, c.files.root)
    d = again.describe("other")["a"]
    found = [(f"setting {k}", str(v)) for k, v in d["settings"]["index"].items() if k not in ("uuid", "creation_date")]
    found += [(f"field {p}", f.type) for p, f in again.indices["a"].mapping.fields.items()]
    found += [("alias", ",".join(d["aliases"])), ("docs", str(again.count("a"))), ("health", again.health()["status"]), ("deleted", ",".join(again.delete("a*"))), ("left", str(len(again.indices)))]
    return rows(spark, found, "what string, value string")


register(
    "index_management", settings,
    values("what, value", [("setting number_of_replicas", "0"), ("setting refresh_interval", "1s"), ("field t", "text"), ("field k", "keyword"), ("field n", "long"), ("field d", "date"), ("field deep.b", "boolean"), ("alias", "other"), ("docs", "1"), ("health", "green"), ("deleted", "a"), ("left", "0")]),
)

# -- pages, totals, exports ---------------------------------------------------------------------


def scroll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen export of all that match: its first page, all others with their numbers, and the empty one at its end."""
    scrolls = Scrolls(scratch(spark, "scrolls"))
    size = 4000
    key, first, _ = scrolls.start(index(spark, sf_dir, "orders"), {"query": {"term": {"o_orderstatus": "F"}}, "sort": [{"o_totalprice": "desc"}], "size": size}, "1m")
    pages = first.select(F.lit(0).cast("bigint").alias("page"), "o_orderkey").unionAll(scrolls.rest(key, "1m").select(F.col("__page").alias("page"), "o_orderkey"))
    assert not scrolls.next(key).head(1) and scrolls.clear(key)
    return pages


register("scroll_pages", scroll_pages, "SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 4000 AS page, o_orderkey FROM orders WHERE o_orderstatus = 'F'")


def scroll_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetimes: an export ends when its time is over or when it's cleared, and lives on when it's asked for in time."""
    clock = [0.0]
    scrolls, i = Scrolls(scratch(spark, "scrolls"), lambda: clock[0]), index(spark, sf_dir, "region")
    out = [(d, str(duration(d))) for d in ("1d", "2h", "3m", "4s", "5ms")]
    key, first, _ = scrolls.start(i, {"size": 2, "sort": "_doc"}, "1m")
    out.append(("first", str(first.count())))
    clock[0] = 59.0
    out.append(("second", str(scrolls.next(key, "1m").count())))
    clock[0] = 118.0
    out.append(("third", str(scrolls.next(key).count())))
    clock[0] = 120.0
    for what, k in (("expired", key), ("unknown", "none")):
        try:
            scrolls.next(k)
        except SearchError as e:
            out.append((what, e.kind))
    return rows(spark, out, "what string, value string")


register("scroll_lifetime", scroll_ends, values("what, value", [("1d", "86400"), ("2h", "7200"), ("3m", "180"), ("4s", "4"), ("5ms", "0.005"), ("first", "2"), ("second", "2"), ("third", "1"), ("expired", "search_context_missing_exception"), ("unknown", "search_context_missing_exception")]))
register(
    "count_api", lambda spark, sf_dir: rows(spark, [(count(index(spark, sf_dir, "orders"), {"query": {"range": {"o_totalprice": {"gt": 100000}}}}), count(analysed(spark, sf_dir, "documents"), {"query": {"match": {"text": "nicht"}}}))], "dear bigint, nicht bigint"),
    f"SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 100000)::BIGINT AS dear, (SELECT count(*) FROM documents WHERE list_contains({tokens_sql('text')}, 'nicht'))::BIGINT AS nicht",
)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(analysed(spark, sf_dir, "documents"), {"query": {"match": {"text": "nicht that"}}, "size": 1}, NOW)
    return rows(spark, [(found.total(), found.max_score())], "total bigint, max_score double")


register("total_and_max_score", totals, f"SELECT count(*)::BIGINT AS total, max(_score) AS max_score FROM ({bm25_sql(['nicht', 'that'])})")


def assembled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as a client gets it, sorted by a list in one string."""
    answer = search(index(spark, sf_dir, "orders"), {"query": {"term": {"o_orderpriority": "2-HIGH"}}, "sort": "o_orderstatus,o_totalprice:desc", "from": 3, "size": 15, "_source": ["o_cust*", "o_orderstatus"]}, NOW).response()
    found = [(k, h["_index"], h["_id"], h["_score"], h["sort"][0], round(float(h["sort"][1]), 4), h["_source"]["o_custkey"], ",".join(sorted(h["_source"]))) for k, h in enumerate(answer["hits"]["hits"])]
    return rows(spark, found, "place bigint, _index string, _id string, _score double, status string, price double, customer bigint, kept string").withColumn("total", F.lit(answer["hits"]["total"]["value"]).cast("bigint"))


register(
    "hit_assembly", assembled_hits,
    "WITH h AS (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS r, count(*) OVER () AS total FROM orders WHERE o_orderpriority = '2-HIGH') "
    "SELECT (r - 3)::BIGINT AS place, 'orders' AS _index, o_orderkey::VARCHAR AS _id, NULL::DOUBLE AS _score, o_orderstatus AS status, round(o_totalprice, 4) AS price, o_custkey AS customer, 'o_custkey,o_orderstatus' AS kept, total::BIGINT AS total FROM h WHERE r >= 3 AND r < 18",
)


def per_index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indices in one search, each scored by its own statistics."""
    found = search([analysed(spark, sf_dir, "documents"), analysed(spark, sf_dir, "benchmark")], {"query": {"match": {"text": "therble"}}}, NOW)
    return found.everything.select("_index", "_id", F.round("_score", 7).alias("_score"))


register(
    "per_index_scores", per_index_scores,
    f"SELECT 'documents' AS _index, doc_id::VARCHAR AS _id, _score FROM ({bm25_sql(['therble'])}) UNION ALL SELECT 'benchmark', item_id::VARCHAR, _score FROM ({bm25_sql(['therble'], 'benchmark', 'item_id')})",
)

# -- more of the query language -------------------------------------------------------------------

hits("match_number", "documents", {"match": {"text": 2024}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({tokens_sql('text')}, '2024')")
hits("match_boolean", "documents", {"match": {"text": True}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE list_contains({tokens_sql('text')}, 'true')")
hits(
    "multi_match_phrase", "part", {"multi_match": {"query": "small widget", "fields": ["p_name", "p_type"], "type": "phrase"}}, ["p_partkey"],
    f"SELECT p_partkey FROM part WHERE array_to_string({tokens_sql('p_name')}, ' ') LIKE '%small widget%' OR array_to_string({tokens_sql('p_type')}, ' ') LIKE '%small widget%'",
)
hits(
    "multi_match_phrase_prefix", "part", {"multi_match": {"query": "small wi", "fields": ["p_name", "p_type"], "type": "phrase_prefix"}}, ["p_partkey"],
    f"SELECT p_partkey FROM part WHERE regexp_matches(array_to_string({tokens_sql('p_name')}, ' '), '(^| )small wi')",
)
hits("wildcard_text", "part", {"wildcard": {"p_type": {"value": "eco*"}}}, ["p_partkey"], f"SELECT p_partkey FROM part WHERE len(list_filter({tokens_sql('p_type')}, lambda t: starts_with(t, 'eco'))) > 0")
hits("exists_text", "documents", {"exists": {"field": "text"}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE len({tokens_sql('text')}) > 0")
hits("not_match", "documents", {"bool": {"must_not": {"match": {"text": "the that"}}}}, ["doc_id"], f"SELECT doc_id FROM documents WHERE NOT list_has_any({tokens_sql('text')}, ['the', 'that'])")
hits("regexp_no_flags", "part", {"regexp": {"p_brand": {"value": "Brand#1[0-3]?", "flags": "NONE"}}}, ["p_partkey"], "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-3]?')")
hits("partial_date", "events", {"range": {"ts": {"gte": "2024", "lte": "2024-01-15T10"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-15 10:59:59.999'")
hits("term_month", "events", {"term": {"ts": "2024-01"}}, ["event_id"], "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-01 23:59:59.999'")
hits("month_arithmetic", "events", {"range": {"ts": {"gte": "2023-11-30||+2M-15d", "lt": "2024-03-31||-1M-2w/d"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-02-15'")
hits("year_arithmetic", "events", {"range": {"ts": {"gt": "2020-02-29||+4y-1M-12d", "lte": "2024-01-22||+12h+30m"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-22 12:30:00'")
hits("epoch_bounds", "events", {"range": {"ts": {"gte": 1704844800000, "lt": "1705276800000"}}}, ["event_id"], "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'")


def rendered_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets as a client gets them, with their times written out."""
    answer = search(index(spark, sf_dir, "events"), {"size": 0, "aggs": {"d": {"date_histogram": {"field": "ts", "fixed_interval": "7d"}}, "last": {"max": {"field": "ts"}}}}, NOW).response()["aggregations"]
    return rows(spark, [(b["key"], b["key_as_string"], b["doc_count"]) for b in answer["d"]["buckets"]] + [(0, answer["last"]["value_as_string"], 0)], "key bigint, key_as_string string, doc_count bigint")


register(
    "rendered_dates", rendered_dates,
    "WITH b AS (SELECT epoch_ms(ts) // 604800000 * 604800000 AS key FROM events), g AS (SELECT unnest(range(min(key), max(key) + 1, 604800000)) AS key FROM b) "
    "SELECT g.key, strftime(epoch_ms(g.key), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS key_as_string, count(b.key)::BIGINT AS doc_count FROM g LEFT JOIN b USING (key) GROUP BY 1 UNION ALL SELECT 0, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 0 FROM events",
)

# -- what is refused, and how ------------------------------------------------------------------------

_ILLEGAL, _PARSING, _SHARD = "illegal_argument_exception", "parsing_exception", "query_shard_exception"
_REFUSED: list[tuple[str, dict, str]] = [
    ("nested field outside", {"query": {"term": {"lines.l_returnflag": "R"}}}, _SHARD),
    ("nested path unknown", {"query": {"nested": {"path": "o_custkey", "query": {"match_all": {}}}}}, _SHARD),
    ("nested inner clause", {"query": {"nested": {"path": "lines", "query": {"match_phrase": {"lines.l_returnflag": "R"}}}}}, _ILLEGAL),
    ("slop", {"query": {"match_phrase": {"o_orderstatus": {"query": "a b", "slop": 2}}}}, _ILLEGAL),
    ("relation unknown", {"query": {"has_child": {"type": "none", "query": {"match_all": {}}}}}, _SHARD),
    ("pattern on a number", {"query": {"wildcard": {"o_totalprice": "1*"}}}, _SHARD),
    ("unknown query", {"query": {"geo_shape": {}}}, _PARSING),
    ("two clauses", {"query": {"match_all": {}, "term": {}}}, _PARSING),
    ("bad minimum", {"query": {"match": {"o_totalprice": "many"}}}, _ILLEGAL),
    ("terms lookup", {"query": {"terms": {"o_custkey": {"index": "x"}}}}, _ILLEGAL),
    ("regexp flag", {"query": {"regexp": {"o_orderstatus": {"value": "F", "flags": "SOME"}}}}, _ILLEGAL),
    ("regexp complement", {"query": {"regexp": {"o_orderstatus": {"value": "~(F)"}}}}, _ILLEGAL),
    ("regexp interval", {"query": {"regexp": {"o_orderstatus": {"value": "<1-3>"}}}}, _ILLEGAL),
    ("regexp unreadable", {"query": {"regexp": {"o_orderstatus": {"value": "(F"}}}}, _ILLEGAL),
    ("cardinality", {"aggs": {"x": {"cardinality": {"field": "o_custkey"}}}}, _ILLEGAL),
    ("facet on unmapped", {"aggs": {"x": {"terms": {"field": "nowhere"}}}}, _ILLEGAL),
    ("average of words", {"aggs": {"x": {"avg": {"field": "o_orderstatus"}}}}, _ILLEGAL),
    ("metric with a child", {"aggs": {"x": {"avg": {"field": "o_totalprice"}, "aggs": {"y": {"max": {"field": "o_custkey"}}}}}}, _ILLEGAL),
    ("window too large", {"from": 9990, "size": 20}, _ILLEGAL),
    ("negative size", {"size": -1}, _ILLEGAL),
    ("sort by unmapped", {"sort": "nowhere"}, _SHARD),
    ("unknown key", {"highlight": {}}, _ILLEGAL),
]
_NAMES = [("", False), ("_x", False), ("Up", False), ("a b", False), ("..", False), ("-x", False), ("a,b", False), ("ok-1.x", True), ("x" * 255, True), ("x" * 256, False)]


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.queries import with_lines

    i, out = with_lines(spark, sf_dir), []
    for name, body, _ in _REFUSED:
        try:
            search(i, body, NOW)
            out.append((name, "answered"))
        except SearchError as e:
            out.append((name, e.kind))
    for k, (name, _) in enumerate(_NAMES):
        try:
            check_name(name)
            out.append((f"name {k}", "accepted"))
        except SearchError as e:
            out.append((f"name {k}", e.kind))
    return rows(spark, out, "request string, answer string")


register("refusals", refusals, values("request, answer", [(n, kind) for n, _, kind in _REFUSED] + [(f"name {k}", "accepted" if ok else "invalid_index_name_exception") for k, (_, ok) in enumerate(_NAMES)]))


def bucket_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram with more buckets than an answer may have, and one with as many as it may."""
    ids = spark.range(65_536).select("id", F.lit("x").alias("k"))
    from quarry.operators.search import Index

    out = []
    for name, body in (("over", {"match_all": {}}), ("within", {"range": {"id": {"lt": 65_535}}})):
        found = search(Index.of_table("t", ids, "id"), {"size": 0, "query": body, "aggs": {"h": {"histogram": {"field": "id", "interval": 1}}}}, NOW)
        try:
            out.append((name, str(len(found.response()["aggregations"]["h"]["buckets"]))))
        except SearchError as e:
            out.append((name, e.kind))
    return rows(spark, out, "facet string, answer string")


register("bucket_limit", bucket_limit, values("facet, answer", [("over", _ILLEGAL), ("within", "65535")]))

# -- analysis -------------------------------------------------------------------------------------------

_CUSTOM = {"analyzer": {"folded": {"type": "custom", "tokenizer": "whitespace", "filter": ["lowercase", "asciifolding", "few"]}, "own": {"type": "stop", "stopwords": ["the", "und"]}}, "filter": {"few": {"type": "stop", "stopwords": ["the", "und"]}}}


def custom_terms(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        terms = read(spark, sf_dir, "documents").select(F.explode(analysis.custom(_CUSTOM)[name].column(F.col("text"))).alias("term"))
        return terms.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))

    return run


_FOLDED = "strip_accents(replace(replace(replace(lower(t), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))"
register("analyze_custom", custom_terms("folded"), f"SELECT term, count(*)::BIGINT AS n FROM (SELECT {_FOLDED} AS term FROM (SELECT unnest(list_filter(regexp_extract_all(text, '\\S+'), lambda t: strlen(t) < 255)) AS t FROM documents)) WHERE term NOT IN ('the', 'und') GROUP BY 1")
register("analyze_custom_stop", custom_terms("own"), "SELECT lower(t) AS term, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda t: strlen(t) < 255)) AS t FROM documents) WHERE lower(t) NOT IN ('the', 'und') GROUP BY 1")


def analyze_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with offsets and positions of a text made from each part's name; removed words leave gaps."""
    names = sorted(r[0] for r in read(spark, sf_dir, "part").select("p_name").distinct().collect())  # a few words each, from a small stock
    out = []
    for n in names:
        for t in analysis.analyze(analysis.BUILT_IN["stop"], f"The {n} of it"):
            out.append((n, t["token"], t["start_offset"], t["end_offset"], t["position"]))
    return rows(spark, out, "name string, token string, start_offset int, end_offset int, position int")


register(
    "analyze_api", analyze_api,
    "WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part), t AS (SELECT name, w, unnest(range(1, len(w) + 1)) AS i FROM n) "
    "SELECT name, w[i] AS token, (4 + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x) + 1)), 0))::INT AS start_offset, (4 + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: len(x) + 1)), 0) + len(w[i]))::INT AS end_offset, i::INT AS position FROM t",
)

_STEMS = "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"
_STEM_PAIRS = [tuple(p.split(":")) for p in _STEMS.split()]
register("stem_english", lambda spark, sf_dir: rows(spark, [(w, porter(w)) for w, _ in _STEM_PAIRS], "word string, stem string"), values("word, stem", _STEM_PAIRS))
_ENGLISH = [("John's cats are hopping", "john cat hop"), ("The relational operators", "relat oper")]


def english_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possessives, stop words and stems together, as a column over a table."""
    t = rows(spark, [(x,) for x, _ in _ENGLISH], "text string")
    terms = F.filter(analysis.BUILT_IN["english"].column(F.col("text")), lambda x: x.isNotNull())
    return t.select("text", F.array_join(terms, " ").alias("terms"))


register("analyze_english_texts", english_texts, values("text, terms", _ENGLISH))
_FRENCH = [("l'ascension de l’Everest", "ascension everest"), ("qu'il s'arrête", "aret"), ("les chevaux et la forêt", "cheval foret")]


def french_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elisions, stop words and light stems together, as a column over a table."""
    t = rows(spark, [(x,) for x, _ in _FRENCH], "text string")
    terms = F.filter(analysis.BUILT_IN["french"].column(F.col("text")), lambda x: x.isNotNull())
    return t.select("text", F.array_join(terms, " ").alias("terms"))


register("analyze_french_texts", french_texts, values("text, terms", _FRENCH))
