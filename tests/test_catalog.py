"""Documents, bulk loads, aliases, expressions and streams."""

import json
import os

import pytest

from quarry.errors import AlreadyExists, IllegalArgument, IndexNotFound, SearchError, Unsupported, VersionConflict
from quarry.sources.catalog import Catalog, InvalidName, check_name
from quarry.sources.documents import DocumentMissing, deep_merge, read_bulk
from quarry.streaming.upserts import refresh, tumbling


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "c"))


def test_versions_and_conflicts(catalog):
    w = lambda *a, **k: catalog.write("i", *a, **k)
    first = w("index", "1", {"a": 1})
    assert (first["_version"], first["result"]) == (1, "created")
    assert w("index", "1", {"a": 2})["result"] == "updated"
    with pytest.raises(VersionConflict):
        w("create", "1", {"a": 3})
    assert w("update", "1", {"doc": {"a": 2}})["result"] == "noop" and catalog.get("i", "1")["_version"] == 2
    assert w("update", "1", {"doc": {"o": {"x": 1}}})["_version"] == 3
    seq = catalog.get("i", "1")["_seq_no"]
    with pytest.raises(VersionConflict):
        w("index", "1", {"a": 4}, if_seq_no=seq + 5, if_primary_term=1)
    catalog.refresh()
    assert w("delete", "1", if_seq_no=seq, if_primary_term=1)["_version"] == 4 and not catalog.get("i", "1")["found"]
    assert w("delete", "1")["result"] == "not_found" and w("index", "1", {"a": 9})["_version"] == 6
    with pytest.raises(DocumentMissing):
        w("update", "2", {"doc": {"a": 1}})
    assert w("update", "2", {"doc": {"a": 1}, "doc_as_upsert": True})["result"] == "created"
    with pytest.raises(Unsupported):
        w("update", "2", {"script": "x"})
    with pytest.raises(SearchError):
        w("index", "3", {"a": "words"})
    assert [d.get("found", d.get("error", {}).get("type")) for d in catalog.mget([{"_index": "i", "_id": "1"}, {"_index": "no", "_id": "1"}, {"_index": "i", "_id": "99"}])] == [True, "index_not_found_exception", False]
    assert deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_dynamic_fields_and_restart(catalog, spark):
    catalog.write("i", "index", "1", {"t": "2026-03-15", "n": 5, "o": {"x": "text here"}, "l": [1, 2], "s": [{"r": "a"}, {"r": "b"}]})
    catalog.refresh()
    again = Catalog(spark, catalog.files.root)
    found = again.search("i", {"query": {"bool": {"must": [{"term": {"l": 2}}, {"match": {"o.x": "here"}}, {"term": {"s.r.keyword": "b"}}, {"range": {"t": {"gte": "2026-03"}}}]}}})
    assert found.total() == 1 and again.get("i", "1")["_source"]["n"] == 5
    again.put_mapping("i", {"properties": {"new": {"type": "keyword"}}})
    with pytest.raises(IllegalArgument):
        again.put_mapping("i", {"properties": {"n": {"type": "keyword"}}})
    assert again.search("i", {"query": {"exists": {"field": "new"}}}).total() == 0 and "new" in again.describe("i")["i"]["mappings"]["properties"]


def lines(*actions):
    return "\n".join(json.dumps(x) for x in actions) + "\n"


BULK = lines(
    {"index": {"_index": "b", "_id": "1"}}, {"a": 1}, {"create": {"_index": "b", "_id": "1"}}, {"a": 2}, {"update": {"_index": "b", "_id": "1"}}, {"doc": {"c": "x"}},
    {"index": {"_index": "b", "_id": "2"}}, {"a": "no number"}, {"delete": {"_index": "b", "_id": "9"}}, {"index": {"_index": "b", "_id": "3"}}, {"a": 3}, {"delete": {"_index": "b", "_id": "3"}},
)


def test_bulk_in_order(catalog):
    done = catalog.bulk(BULK)
    assert done["errors"] and [next(iter(i.values()))["status"] for i in done["items"]] == [201, 409, 200, 400, 404, 201, 200]
    with pytest.raises(SearchError):
        catalog.bulk(lines({"index": {"_index": "b", "_id": "7"}}, {"a": 7}, {"destroy": {"_index": "b"}}))
    assert catalog.get("b", "7")["found"]
    with pytest.raises(Unsupported):
        catalog.bulk(lines({"index": {"_index": "b", "routing": 1}}, {}))
    catalog.refresh()
    assert catalog.count("b") == 2 and catalog.overview("b").first()["docs"] == 2


def test_bulk_load_equals_bulk(catalog, spark, tmp_path):
    (tmp_path / "x.ndjson").write_text(BULK)
    done = catalog.load("b", read_bulk(spark, str(tmp_path / "x.ndjson")))
    got = {r["position"] % 2**40: (r["result"], (r["error"] or "").split(":")[0]) for r in done.collect()}
    assert got == {0: ("created", ""), 1: (None, "version_conflict_engine_exception"), 2: ("updated", ""), 3: (None, "document_parsing_exception"), 4: ("not_found", ""), 5: ("created", ""), 6: ("deleted", "")}
    assert catalog.get("b", "1")["_source"] == {"a": 1, "c": "x"} and catalog.search("b", {"query": {"match": {"c": "x"}}}).total() == 1
    assert catalog.write("b", "index", "1", {"a": 5})["_version"] == 3


def test_expressions_and_aliases(catalog):
    for n in ("logs-1", "logs-2", "other"):
        catalog.create(n)
    catalog.update_aliases([{"add": {"index": "logs-*", "alias": "all-logs"}}, {"add": {"index": "other", "alias": "o"}}])
    names = lambda e, **k: [s.name for s in catalog.resolve(e, **k)]
    assert names("logs-*,-logs-1") == ["logs-2"] and names("_all") == ["logs-1", "logs-2", "other"] and names("all-*,o") == ["logs-1", "logs-2", "other"] and names("gone,o", ignore_unavailable=True) == ["other"] and names("x*") == []
    for bad, how in (("gone", {}), ("x*", {"allow_no_indices": False})):
        with pytest.raises(IndexNotFound):
            catalog.resolve(bad, **how)
    with pytest.raises(IllegalArgument):
        catalog.write("all-logs", "index", "1", {})
    catalog.update_aliases([{"add": {"index": "logs-2", "alias": "all-logs", "is_write_index": True}}])
    assert catalog.write("all-logs", "index", "1", {})["_index"] == "logs-2"
    with pytest.raises(SearchError):
        catalog.update_aliases([{"remove": {"index": "other", "alias": "o"}}, {"add": {"index": "none", "alias": "z"}}])
    assert "o" in catalog.aliases
    with pytest.raises(Unsupported):
        catalog.update_aliases([{"add": {"index": "other", "alias": "f", "filter": {}}}])
    with pytest.raises(IllegalArgument):
        catalog.delete("logs-*")
    catalog.put_settings({"transient": {"action": {"destructive_requires_name": False}}})
    assert catalog.delete("logs-*") == ["logs-1", "logs-2"] and "all-logs" not in catalog.aliases and catalog.health()["active_shards"] == 1
    with pytest.raises(AlreadyExists):
        catalog.create("other")
    for bad in ("", "_x", "Up", "a b", "..", "-x", "a,b", "x" * 256):
        with pytest.raises(InvalidName):
            check_name(bad)
    assert catalog.analyze({"analyzer": "stop", "text": "the cat"})[0]["token"] == "cat"


def test_stream_of_writes(catalog, spark, tmp_path):
    os.makedirs(tmp_path / "in")
    schema = "_id string, _seq_no bigint, _version bigint, _deleted boolean, _source string"
    catalog.create("s", {"mappings": {"properties": {"a": {"type": "long"}}}})
    for batch in ([("1", 0, 1, False, '{"a": 1}'), ("1", 1, 2, False, '{"a": 2}')], [("1", 2, 3, True, None), ("2", 3, 1, False, '{"a": 7}')]):
        spark.createDataFrame(batch, schema).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        refresh(stream, catalog.files.at("s/log"), str(tmp_path / "check"), once=True).awaitTermination()
    catalog.refresh("s")
    assert [r["_id"] for r in catalog.search("s").hits.collect()] == ["2"]


def test_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("a", "2024-01-01 01:00:00")], "k string, t string").selectExpr("k", "cast(t as timestamp) t")
    assert sorted(r["n"] for r in tumbling(rows, "t", "1 hour", "k", late="10 minutes").collect()) == [1, 2]


def test_fields_added_after_a_refresh_and_a_root_given_as_uri(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/root")
    c.write("i", "index", "1", {"t": "some text"})
    c.refresh()
    c.write("i", "index", "2", {"t": "more text", "new": 5})
    assert c.search("i", {"query": {"bool": {"must": {"match": {"t": "text"}}, "must_not": {"exists": {"field": "new"}}}}}).total() == 1
    c.refresh()
    again = Catalog(spark, f"file://{tmp_path}/root")
    assert again.search("i", {"query": {"range": {"new": {"gte": 5}}}}).total() == 1 and again.count("i", {"query": {"match": {"t": "text"}}}) == 2
    assert [d["found"] for d in again.mget(ids=["1", "3", "2"], index="i")] == [True, False, True]
