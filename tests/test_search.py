"""The query language on small documents: semantics, refusals and answers."""

import pytest

from quarry.errors import IllegalArgument, Parsing, QueryShard, SearchError, Unsupported, ValueUnreadable
from quarry.operators.search import Scrolls, count, duration, parse_sort, search
from quarry.sources.catalog import Catalog

BOOKS = [
    {"title": "The old man and the sea", "author": "hemingway", "tags": ["classic", "sea"], "year": 1952, "note": 4.5, "paru": "1952-09-01", "ok": True},
    {"title": "Man of the sea", "author": "anon", "tags": "sea", "year": 1999, "paru": "1999-05-05T10:00:00Z", "ok": False},
    {"title": "The sea the sea", "author": "murdoch", "tags": [], "year": 1978, "note": 4.0, "paru": "1978-01-01"},
    {"title": "Old age", "author": "Hemingway", "year": 1960, "note": None},
]
MAPPING = {"properties": {"title": {"type": "text", "fields": {"raw": {"type": "keyword", "ignore_above": 14}}}, "author": {"type": "keyword"}, "tags": {"type": "keyword"}, "year": {"type": "integer"}, "note": {"type": "double"}, "paru": {"type": "date"}, "ok": {"type": "boolean"},
    "lines": {"type": "nested", "properties": {"ref": {"type": "keyword"}, "qty": {"type": "integer"}}}, "kin": {"type": "join", "relations": {"blog": "comment"}}}}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    c.create("books", {"mappings": MAPPING})
    for k, b in enumerate(BOOKS):
        c.write("books", "index", str(k), b)
    c.write("books", "index", "4", {"lines": [{"ref": "A", "qty": 1}, {"ref": "B", "qty": 9}], "kin": "blog"})
    c.write("books", "index", "5", {"lines": [{"ref": "A", "qty": 9}], "kin": {"name": "comment", "parent": "4"}, "year": 5})
    c.refresh()
    return c


def ids(catalog, query, **body):
    found = catalog.search("books", {"query": query, "size": 50, **body}, now=0)
    return [r["_id"] for r in found.hits.collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"term": {"tags": "sea"}}, "01"), ({"term": {"title": "Sea"}}, ""), ({"match": {"title": "Sea"}}, "012"), ({"match": {"title": {"query": "old sea", "operator": "and"}}}, "0"), ({"match_phrase": {"title": "the sea"}}, "012"),
        ({"match_phrase": {"title": "sea the"}}, "2"), ({"match_phrase_prefix": {"title": "old ma"}}, "0"), ({"match_phrase_prefix": {"title": "o"}}, "013"), ({"exists": {"field": "note"}}, "02"), ({"exists": {"field": "tags"}}, "01"), ({"exists": {"field": "title.raw"}}, "13"),
        ({"term": {"paru": "1952-09"}}, "0"), ({"range": {"paru": {"lte": "1978-01-01", "gt": "1952-09-01"}}}, "2"), ({"term": {"ok": "true"}}, "0"), ({"terms": {"year": [1952, "1999"]}}, "01"), ({"range": {"year": {"gt": 1959.5, "lte": 1978}}}, "23"),
        ({"prefix": {"author": {"value": "HEM", "case_insensitive": True}}}, "03"), ({"wildcard": {"author": "?em*"}}, "03"), ({"regexp": {"title": "ag?e"}}, "3"), ({"fuzzy": {"title": "sae"}}, "012"), ({"fuzzy": {"author": {"value": "anno", "transpositions": False, "fuzziness": 1}}}, ""),
        ({"bool": {"must_not": {"exists": {"field": "year"}}}}, "4"), ({"bool": {}}, "012345"), ({"bool": {"should": [{"term": {"author": "anon"}}], "must_not": [{"term": {"year": 1}}]}}, "1"), ({"bool": {"should": [{"term": {"author": "anon"}}, {"term": {"ok": False}}], "minimum_should_match": 3}}, ""),
        ({"nested": {"path": "lines", "query": {"bool": {"must": [{"term": {"lines.ref": "A"}}, {"term": {"lines.qty": 9}}]}}}}, "5"), ({"nested": {"path": "lines", "query": {"bool": {"must_not": {"term": {"lines.ref": "A"}}}}}}, "4"), ({"bool": {"must_not": {"nested": {"path": "lines", "query": {"term": {"lines.ref": "B"}}}}}}, "01235"),
        ({"has_child": {"type": "comment", "query": {"term": {"year": 5}}}}, "4"), ({"has_parent": {"parent_type": "blog", "query": {"match_all": {}}}}, "5"), ({"parent_id": {"type": "comment", "id": "4"}}, "5"), ({"bool": {"must_not": {"has_child": {"type": "comment", "query": {"match_all": {}}}}}}, "01235"),
        ({"ids": {"values": ["3", "9"]}}, "3"), ({"match_none": {}}, ""), ({"match": {"nowhere": "x"}}, ""), ({"multi_match": {"query": "old", "fields": ["title^2", "nowhere"]}}, "03"), ({"multi_match": {"query": "sea the", "fields": ["title"], "type": "phrase"}}, "2"), ({"match": {"year": {"query": "x", "lenient": True}}}, ""),
        ({"dis_max": {"queries": [{"term": {"author": "anon"}}, {"match": {"title": "age"}}]}}, "13"), ({"constant_score": {"filter": {"match": {"title": "man"}}}}, "01"), ({"match": {"title": "?!"}}, ""),
    ],
)
def test_queries(catalog, query, expected):
    assert sorted(ids(catalog, query)) == sorted(expected)


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ({"query_string": {"query": "x"}}, Parsing), ({"match": {"title": {"query": "x", "fuzziness": 1}}}, Unsupported), ({"match_phrase": {"title": {"query": "a b", "slop": 1}}}, Unsupported), ({"term": {"title": {"value": "x", "case_insensitive": True}}}, Unsupported),
        ({"range": {"title": {"gte": "a"}}}, Unsupported), ({"range": {"year": {"gte": 1, "gt": 1}}}, IllegalArgument), ({"range": {"year": {}}}, IllegalArgument), ({"term": {"year": "many"}}, ValueUnreadable), ({"term": {"ok": 1}}, ValueUnreadable), ({"prefix": {"year": "1"}}, QueryShard),
        ({"term": {"lines.ref": "A"}}, QueryShard), ({"nested": {"path": "lines", "query": {"term": {"year": 1}}}}, QueryShard), ({"nested": {"path": "lines", "query": {"wildcard": {"lines.ref": "*"}}}}, Unsupported), ({"nested": {"path": "title", "query": {"match_all": {}}}}, QueryShard), ({"has_child": {"type": "blog", "query": {"match_all": {}}}}, QueryShard),
        ({"terms": {"author": {"index": "x"}}}, Unsupported), ({"multi_match": {"query": "x", "fields": ["t*"]}}, Unsupported), ({"multi_match": {"query": "x", "fields": ["title"], "type": "cross_fields"}}, Unsupported), ({"bool": {"must": [], "boosting": 1}}, Unsupported), ({"match_all": {}, "term": {}}, Parsing), ({"match_phrase_prefix": {"author": "x"}}, QueryShard),
    ],
)
def test_refusals(catalog, query, error):
    with pytest.raises(error):
        ids(catalog, query)


def test_strict_unmapped(catalog):
    with pytest.raises(QueryShard, match="nowhere"):
        catalog.search("books", {"query": {"term": {"nowhere": 1}}}, allow_unmapped=False)


def test_scores(catalog):
    def score(query):
        return {r["_id"]: r["_score"] for r in catalog.search("books", {"query": query}).hits.collect()}

    one, twice = score({"match": {"title": "old"}}), score({"match": {"title": "old old"}})
    assert twice["3"] == pytest.approx(2 * one["3"], abs=1e-5) and one["3"] > one["0"]
    assert score({"bool": {"filter": {"match": {"title": "old"}}}}) == {"0": 0.0, "3": 0.0}
    assert set(score({"bool": {"must_not": {"match": {"title": "old"}}}}).values()) == {1.0}
    assert score({"match": {"title": {"query": "old", "boost": 3}}})["3"] == pytest.approx(3 * one["3"], abs=1e-5)


def test_sorting_paging_source(catalog):
    assert ids(catalog, {"match_all": {}}, sort=[{"note": "desc"}, "year"]) == ["0", "2", "5", "3", "1", "4"]
    assert ids(catalog, {"match_all": {}}, sort="tags") == ["0", "1", "2", "3", "4", "5"]
    found = catalog.search("books", {"sort": "year:desc", "from": 1, "size": 2, "_source": ["ti*", "year"]})
    answer = found.response()
    assert [h["_id"] for h in answer["hits"]["hits"]] == ["2", "3"] and answer["hits"]["total"] == {"value": 6, "relation": "eq"} and answer["hits"]["max_score"] is None
    assert answer["hits"]["hits"][0]["_source"] == {"title": "The sea the sea", "year": 1978} and answer["hits"]["hits"][0]["sort"] == ["1978"]
    assert catalog.search("books", {"_source": {"excludes": ["lines.q*", "title"]}}).hits.schema["lines"].dataType.elementType.names == ["ref"]
    assert catalog.search("books", {"_source": False}).hits.columns == ["_index", "_id", "_score"]
    assert catalog.search("books", {"query": {"match": {"title": "old"}}, "from": 1, "size": 1}).response()["hits"]["max_score"] > 0
    for bad in ({"size": -1}, {"from": 9999, "size": 2}, {"sort": "title"}, {"sort": {"year": {"mode": "min"}}}, {"track_total_hits": False}, {"q": "x"}, {"sort": "nowhere"}):
        with pytest.raises(SearchError):
            catalog.search("books", bad)
    assert catalog.count("books", {"query": {"match": {"title": "sea"}}}) == 3
    assert [s.descending for s in parse_sort(["_score", "a", {"b": "desc"}])] == [True, False, True]


def test_facets(catalog):
    body = {"size": 0, "aggs": {"tags": {"terms": {"field": "tags", "size": 1}, "aggs": {"y": {"avg": {"field": "year"}}, "ok": {"terms": {"field": "ok"}}}}, "s": {"stats": {"field": "note"}}, "n": {"value_count": {"field": "tags"}}, "first": {"min": {"field": "paru"}}, "m": {"sum": {"field": "note", "missing": 1}},
        "r": {"range": {"field": "year", "keyed": True, "ranges": [{"to": 1960}, {"from": 1960, "key": "late"}]}}, "h": {"histogram": {"field": "year", "interval": 20, "hard_bounds": {"min": 1940, "max": 2000}}}, "d": {"date_histogram": {"field": "paru", "fixed_interval": "3650d", "min_doc_count": 1}},
        "f": {"filter": {"match": {"title": "sea"}}, "aggs": {"top": {"max": {"field": "year"}}, "by": {"terms": {"field": "author"}}}}}}
    a = catalog.search("books", body).response()["aggregations"]
    assert a["tags"]["sum_other_doc_count"] == 1 and [(b["key"], b["doc_count"], b["y"]["value"]) for b in a["tags"]["buckets"]] == [("sea", 2, 1975.5)]
    assert [(b["key"], b["key_as_string"]) for b in a["tags"]["buckets"][0]["ok"]["buckets"]] == [(0, "false"), (1, "true")]
    assert a["s"]["count"] == 2 and a["s"]["avg"] == 4.25 and a["n"]["value"] == 3 and a["m"]["value"] == 12.5
    assert a["first"]["value_as_string"] == "1952-09-01T00:00:00.000Z"
    assert {k: b["doc_count"] for k, b in a["r"]["buckets"].items()} == {"*-1960.0": 2, "late": 3}
    assert [(b["key"], b["doc_count"]) for b in a["h"]["buckets"]] == [(1940.0, 1), (1960.0, 2), (1980.0, 1)]
    assert sum(b["doc_count"] for b in a["d"]["buckets"]) == 3 and "key_as_string" in a["d"]["buckets"][0]
    assert a["f"]["doc_count"] == 3 and a["f"]["top"]["value"] == 1999.0 and len(a["f"]["by"]["buckets"]) == 3
    empty = catalog.search("books", {"query": {"match_none": {}}, "size": 0, "aggs": {"s": {"stats": {"field": "note"}}, "t": {"terms": {"field": "tags"}}, "m": {"max": {"field": "year"}}}}).response()["aggregations"]
    assert empty["s"] == {"count": 0, "min": None, "max": None, "avg": None, "sum": 0.0} and empty["t"]["buckets"] == [] and empty["m"]["value"] is None
    for bad in ({"cardinality": {"field": "tags"}}, {"terms": {"field": "title"}}, {"avg": {"field": "author"}}, {"terms": {"field": "nowhere"}}, {"terms": {"field": "tags", "order": {"y": "asc"}}}, {"terms": {"field": "tags"}, "aggs": {"f": {"filter": {"match_all": {}}}}}, {"avg": {"field": "year"}, "aggs": {"x": {"max": {"field": "year"}}}}, {"percentiles": {"field": "year"}}):
        with pytest.raises(SearchError):
            catalog.search("books", {"aggs": {"x": bad}})


def test_several_indices(catalog):
    catalog.create("films", {"mappings": {"properties": {"title": {"type": "text"}, "year": {"type": "long"}, "place": {"type": "keyword"}}}})
    catalog.write("films", "index", "f", {"title": "sea", "year": 2001, "place": "rome"})
    catalog.refresh()
    found = catalog.search("books,films", {"query": {"bool": {"should": [{"term": {"place": "rome"}}, {"match": {"title": "age"}}]}}, "aggs": {"y": {"avg": {"field": "year"}}}})
    assert {(r["_index"], r["_id"]) for r in found.hits.collect()} == {("films", "f"), ("books", "3")}
    assert found.response()["aggregations"]["y"]["value"] == (2001 + 1960) / 2
    partial = catalog.search("books,films", {"sort": "place"})
    assert [i for i, _ in partial.failures] == ["books"] and partial.hits.count() == 1


def test_scrolls(spark, catalog, tmp_path):
    now = [0.0]
    scrolls = Scrolls(str(tmp_path), lambda: now[0])
    index = catalog.index(catalog.one("books"))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    key, first, _ = scrolls.start(index, {"size": 2, "sort": "_doc"}, "1m")
    pages = [[r["_id"] for r in first.collect()]]
    while page := [r["_id"] for r in scrolls.next(key, "1m").collect()]:
        pages.append(page)
    assert pages == [["0", "1"], ["2", "3"], ["4", "5"]]
    now[0] = 61
    with pytest.raises(SearchError):
        scrolls.next(key)
    key, _, _ = scrolls.start(index, {"size": 1}, "5s")
    assert scrolls.clear(key) and not scrolls.clear(key)
    for bad in (({"from": 1}, "1m"), ({"size": 0}, "1m"), ({}, "25h"), ({}, "soon")):
        with pytest.raises(IllegalArgument):
            scrolls.start(index, *bad)
    assert duration("90s") == 90 and duration("2d") == 172800


def test_rest_of_a_scroll(spark, catalog, tmp_path):
    scrolls = Scrolls(str(tmp_path))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    key, _, _ = scrolls.start(catalog.index(catalog.one("books")), {"size": 1, "sort": "_doc"}, "1m")
    assert [r["_id"] for r in scrolls.next(key).collect()] == ["1"]
    assert sorted((r["__page"], r["_id"]) for r in scrolls.rest(key).collect()) == [(k, str(k)) for k in range(2, 6)]
    assert not scrolls.next(key).head(1) and not scrolls.rest(key).head(1) and scrolls.clear(key)
    with pytest.raises(SearchError):
        scrolls.rest(key)


def test_plans_reach_the_scan(spark, tmp_path):
    from quarry.operators.search import Index

    spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id as double) AS v", "'x' AS other").write.parquet(f"{tmp_path}/t")
    i = Index.of_table("t", spark.read.parquet(f"{tmp_path}/t"), "id")
    found = search(i, {"query": {"bool": {"filter": [{"term": {"k": 3}}, {"range": {"v": {"gte": 500}}}]}}, "sort": "v", "_source": ["v"], "size": 5})
    plan = found.hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "GreaterThanOrEqual(v,500.0)" in plan and "TakeOrderedAndProject" in plan and "other" not in plan.split("ReadSchema")[1]
    assert count(i, {"query": {"term": {"k": 3}}}) == 143
