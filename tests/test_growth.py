"""What a query holds at a time, and what it plans, doesn't grow with its input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quarry.functions.analysis import BUILT_IN
from quarry.operators import mapping as maps
from quarry.operators.search import Index, search
from quarry.plans.queries import QUERIES
from quarry.sources import documents, terms
from quarry.sources.catalog import Catalog


def test_postings_are_made_of_a_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(terms, "AT_ONCE", 100, raising=False)
    texts = [[f"t{k % 7}" if k % 5 else None for k in range(n)] for n in (30, 0, 90, 1, 250, 40, 40)] + [None, ["x"]]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["__row", "tokens"])
    made = list(terms._postings("f")(iter([b, b.slice(0, 0)])))
    assert len(made) > 3 and max(len({*m.column("__row").to_pylist()}) for m in made) <= 4
    got = [r for m in made for r in m.to_pylist()]
    want = []
    for row, text in enumerate(texts):
        places = {}
        for k, t in enumerate(text or []):
            if t is not None:
                places.setdefault(t, []).append(k)
        want += [(row, t, sum(map(len, places.values())), p) for t, p in places.items()]
    assert sorted((r["__row"], r["term"], r["length"], r["positions"]) for r in got) == sorted(want)
    assert sorted(r["__row"] for r in got if r["first"]) == sorted({w[0] for w in want}) and {r["field"] for r in got} == {"f"}


@pytest.mark.parametrize("text", ["of th", "th", "one of th", "of of th"])
def test_many_expansions_share_a_column(spark, tmp_path, text):
    made = [(k, f"one of th{k % 40} and of th{k % 3} th th{k % 11} " + "of " * (k % 4) + ("th" if k % 6 else "no")) for k in range(120)] + [(200, "nothing here"), (201, None), (202, "of")]
    plain = Index.of_table("t", spark.createDataFrame(made, "id bigint, x string"), "id", x={"type": "text"})
    query = {"match_phrase_prefix": {"x": text}}
    whole = plain.analysed(str(tmp_path))
    found = search(whole, {"query": query}).everything
    assert found._jdf.queryExecution().optimizedPlan().toString().count("max(CASE") <= 6
    want = search(plain, {"query": query}).everything
    score = lambda df: sorted((r["id"], round(r["_score"], 7)) for r in df.select("id", "_score").collect())
    assert score(found) == score(want) and score(found)
    rest = search(whole, {"query": {"bool": {"must_not": query}}, "sort": "_doc"}).total()
    assert rest == len(made) - len(score(want))


def test_only_distinct_terms_are_stemmed(spark, tmp_path):
    spark.createDataFrame([(1, "les chevaux, le cheval"), (2, None), (3, "l'ascension des chevaux")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["analyze_french"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("ascension", 1), ("cheval", 3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("EvalPython") < plan.index("count(1)") < plan.index("Generate")


def test_stems_of_a_column(spark):
    df = spark.createDataFrame([("the ponies of John's cats",), (None,), ("",), ("the",), ("cats ponies",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(BUILT_IN["english"].column(F.col("t"))).collect()]
    assert got == [[None, "poni", None, "john", "cat"], None, [], [None], ["cat", "poni"]]


_PROPERTIES = {"t": {"type": "text"}, "k": {"type": "keyword"}, "d": {"type": "double"}, "f": {"type": "float"}, "b": {"type": "byte"}, "l": {"type": "long"}, "y": {"type": "boolean"}, "w": {"type": "date"}, "o": {"properties": {"k": {"type": "keyword"}, "p": {"properties": {"l": {"type": "long"}}}}}, "n": {"type": "nested", "properties": {"k": {"type": "keyword"}}}, "j": {"type": "join", "relations": {"a": "c"}}}
_VALUES = [None, True, False, 0, 1, -1, 127, 128, -128, -129, 2**63 - 1, 2**63, -(2**63), 10**400, 1.0, 1.5, float("inf"), "", "x", "5", "true", "2024-01-01", [], [1], ["x"], {}, {"k": "x"}, {"k": None}, {"p": {"l": 3}}, {"p": {"l": None}}, {"p": 1}, {"q": 1}, {"name": "a"}, [{"k": "x"}]]


def test_plain_documents_are_those_that_change_no_mapping(monkeypatch):
    mapping = maps.parse({"properties": _PROPERTIES})
    read = documents.plain(mapping)
    found = {}
    for name in [*_PROPERTIES, "o.k", "new"]:
        for v in _VALUES:
            doc = {name: v}
            row = read(doc)
            if row is not None:
                assert repr(row) == repr(documents.typed(mapping, doc)) and maps.grown(mapping, doc).fields == mapping.fields
                found.setdefault(name, []).append(v)
    assert {n: len(v) for n, v in found.items()} == {"t": 6, "k": 6, "d": 13, "f": 13, "b": 6, "l": 10, "y": 3, "w": 1, "o": 5}
    assert read([]) is None and read({}) == {}
    monkeypatch.setattr(documents, "checked", None)  # it isn't asked about plain ones
    state, result, same = documents.apply(documents.State(), "index", {"k": "x", "o": {"k": "y"}}, mapping, 0, known=read)
    state, result, same = documents.apply(state, "update", {"doc": {"o": {"p": {"l": 1}}}}, mapping, 1, known=read)
    assert (state.source, state.version, result) == ({"k": "x", "o": {"k": "y", "p": {"l": 1}}}, 2, "updated") and same is mapping


def test_states_share_nothing_with_what_is_written():
    mapping, body = maps.parse({"properties": {"o": {"properties": {"l": {"type": "long"}, "m": {"type": "long"}}}}}), {"o": {"l": [1]}}
    first, _, mapping = documents.apply(documents.State(), "index", body, mapping, 0)
    second, _, _ = documents.apply(first, "update", {"doc": {"o": {"m": 2}}}, mapping, 1)
    body["o"]["l"].append(9)
    second.source["o"]["l"].append(8)
    assert first.source == {"o": {"l": [1]}} and second.source == {"o": {"l": [1, 8], "m": 2}}


def test_overview_reads_no_sources(catalog_of_two):
    ran = []
    collect = DataFrame.collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(DataFrame, "collect", lambda df: (ran.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
        counted = catalog_of_two.overview()
    assert [(r["docs"], r["deleted"]) for r in counted.collect()] == [(1, 1)]
    assert ran and not any("_source:" in p for p in ran)


@pytest.fixture
def catalog_of_two(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "root"))
    c.write("i", "index", "1", {"t": "x"})
    c.write("i", "index", "2", {"t": "y"})
    c.write("i", "delete", "1")
    c.refresh()
    return c
