"""Functions that run on the driver: facts from the documented behaviour."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.errors import IllegalArgument, MapperParsing, Parsing, Unsupported
from quarry.functions import analysis, dates, patterns
from quarry.functions.msm import minimum_should_match
from quarry.functions.stemmers import french_light, porter
from quarry.operators import mapping as maps


@pytest.mark.parametrize(
    ("spec", "total", "expected"),
    [("75%", 4, 3), ("70%", 4, 2), ("150%", 4, 6), ("+75%", 4, 3), ("50%", 3, 1), ("-25%", 4, 3), ("-33%", 3, 3), ("-99%", 4, 1), (-1, 4, 3), ("-200%", 4, 0), (-9, 4, 0), ("75", 4, 75),
     ("3<90%", 4, 3), ("3<90%", 3, 3), ("2<90%", 3, 2), ("2<-25% 9<-3", 4, 3), ("5<2 8<3", 3, 3), ("1<2", 4, 2), (None, 4, 9)],
)
def test_minimum_should_match(spec, total, expected):
    assert minimum_should_match(spec, total, 9) == expected


@pytest.mark.parametrize("spec", ["abc", "", "75.5%", 1.5, True, ["75%"], "2<25%,9<3", "1<70%  3<50%", "1<", "<2", "75%x", " 75 % "])
def test_minimum_should_match_refuses(spec):
    with pytest.raises(IllegalArgument, match="minimum_should_match"):
        minimum_should_match(spec, 4, 1)


NOW = dates.iso("2026-03-15T10:20:30.5Z")[0]


def shown(text, up=False, fmt=None):
    return dates.DateFormat().write(dates.resolve(text, dates.DateFormat(fmt or dates.DEFAULT), NOW, up))


@pytest.mark.parametrize(
    ("text", "expected"),
    [("now-90m", "2026-03-15T08:50:30.500Z"), ("now/w", "2026-03-09T00:00:00.000Z"), ("now+1d+1d+1d", "2026-03-18T10:20:30.500Z"), ("2026-03-31||-1M", "2026-02-28T00:00:00.000Z"),
     ("2024-02-29||+1y", "2025-02-28T00:00:00.000Z"), ("2026-08-02T12:00:00Z||+1w/w", "2026-08-03T00:00:00.000Z"), ("now-1d/d", "2026-03-14T00:00:00.000Z"), ("2026-03-15T10:00+02:00", "2026-03-15T08:00:00.000Z")],
)
def test_date_math(text, expected):
    assert shown(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2026-03-15", "2026-03-15T23:59:59.999Z"), ("2026-03-15T12", "2026-03-15T12:59:59.999Z"), ("2026", "2026-01-01T23:59:59.999Z"), ("2026-03-15||/d", "2026-03-15T23:59:59.999Z"),
     ("2026-03-14||+1d", "2026-03-15T00:00:00.000Z"), ("now", "2026-03-15T10:20:30.500Z"), ("2026-03-15T10:00:00Z||/M/d", "2026-03-31T23:59:59.999Z")],
)
def test_upper_bounds(text, expected):
    assert shown(text, True) == expected


@pytest.mark.parametrize("text", ["now-1q", "now/D", "now-1", "now/", "now+1d/", "nowX", "now1d", "now/dd", "||+1d", "now-99999999999999d"])
def test_date_math_refuses(text):
    with pytest.raises(Parsing):
        shown(text)


def test_formats():
    f = dates.DateFormat("dd/MM/yyyy HH:mm||yyyyMMdd||epoch_second")
    assert f.read("15/03/2026 10:20")[0] == dates.iso("2026-03-15T10:20")[0] and f.read("20260315") == (dates.iso("2026-03-15")[0], dates.DAY)
    assert f.read(12) == (12000, 999) and f.write(dates.iso("2026-03-15T10:20")[0]) == "15/03/2026 10:20"
    assert dates.DateFormat("yyyy-MM-dd'T'hh:mm a").read("2026-03-15T12:05 AM")[0] == dates.iso("2026-03-15T00:05")[0]
    with pytest.raises(MapperParsing):
        dates.DateFormat("yyyy-QQ")
    with pytest.raises(MapperParsing):
        dates.DateFormat("yyyy-MM-dd").read(5)
    assert dates.iso("2026-02-30") is None and dates.iso("2026-3-4") is None


def test_date_columns(spark):
    f = dates.DateFormat("dd/MM/yyyy||strict_date_optional_time||epoch_millis")
    values = ["15/03/2026", "2026-03", "2026", "2026-03-15T10:20:30.123Z", "86400000", "junk", None]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.unix_millis(f.column(F.col("v")))).collect()]
    assert got == [f.read(v)[0] if v and v != "junk" else None for v in values]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("ab*c", ["ac", "abbc"], ["xac", "acx"]), ("a.c|d", ["abc", "d"], ["ad"]), ("a{2,3}", ["aa", "aaa"], ["a", "aaaa"]), ('"a.b"c', ["a.bc"], ["axbc"]), ("x@y", ["xy", "xzzy"], ["xz"]), ("[^a-c]", ["d"], ["b"]),
     (r"\d\w", ["1a"], ["a1", "é1"]), ("^a$", ["^a$"], ["a"]), ("(a|)b", ["ab", "b"], ["a"]), ("a?+", ["", "aaa"], ["b"]), ("", [""], ["a"]), ("[a\\-]", ["-", "a"], ["b"])],
)
def test_term_regexps(spark, pattern, yes, no):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(x,) for x in yes + no], "v string").select("v", F.col("v").rlike(patterns.regexp(pattern))).collect()
    assert {r[0] for r in got if r[1]} == set(yes)


@pytest.mark.parametrize("pattern", ["~a", "a&b", "<1-3>", "#", r"\p", "(a", "[b", "a{x}", '"a', "*a"])
def test_term_regexps_refused(pattern):
    with pytest.raises((Unsupported, IllegalArgument)):
        patterns.regexp(pattern)


def test_flags_and_folding():
    assert patterns.regexp("a~", "NONE") and patterns.regexp("a&b", "ANYSTRING|EMPTY".replace("EMPTY", "INTERVAL"))
    with pytest.raises(IllegalArgument):
        patterns.regexp("a", "WHAT")
    assert re.match(patterns.wildcard("aB?*", True).replace("\\z", "\\Z"), "AbcX") and "É" not in patterns.prefix("é", True)


def test_stemmers():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "controll": "control", "sky": "sky", "be": "be"}
    assert {w: porter(w) for w in known} == known
    known = {"chevaux": "cheval", "organisation": "organis", "condition": "cond", "arriviste": "arivist", "homme": "home", "relative": "relatif", "naïve": "naïv", "noël": "noël", "eaux": "eau"}
    assert {w: french_light(w) for w in known} == known


TEXTS = ["Peter's dogs weren't running; the naïve cœur of 3.14 l'ascension!", "Bel-Ami exemple.fr 2.1.3 _ __ x_y", "", "L'homme qu'elles aimaient, jusqu'à l'été"]


@pytest.mark.parametrize("name", [*analysis.BUILT_IN, "folded", "nospace"])
def test_columns_equal_python(spark, name):
    from pyspark.sql import functions as F

    own = analysis.custom({"analyzer": {"folded": {"type": "custom", "tokenizer": "standard", "filter": ["lowercase", "asciifolding", "mine"]}, "nospace": {"tokenizer": "lowercase"}}, "filter": {"mine": {"type": "stop", "stopwords": ["of", "coeur"]}}})
    a = own[name]
    got = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select(a.column(F.col("t"))).collect()
    assert [r[0] for r in got] == [a.terms(t) for t in TEXTS] + [None]


def test_analyzers():
    terms = lambda n, t: [x for x in analysis.BUILT_IN[n].terms(t) if x]
    assert terms("standard", TEXTS[1]) == ["bel", "ami", "exemple.fr", "2.1.3", "x_y"]
    assert terms("simple", "a1b") == ["a", "b"] and terms("whitespace", "A b") == ["A", "b"] and terms("keyword", "A b") == ["A b"]
    assert terms("english", "Peter's the dogs") == ["peter", "dog"] and terms("french", "L'ascension des chevaux") == ["ascension", "cheval"]
    assert analysis.BUILT_IN["stop"].terms("The cat of")[0] is None
    got = analysis.analyze(analysis.BUILT_IN["stop"], ["The cat", "dog"])
    assert [(t["token"], t["start_offset"], t["position"]) for t in got] == [("cat", 4, 1), ("dog", 7, 0)]
    for bad in ({"char_filter": {}}, {"analyzer": {"x": {"type": "german"}}}, {"analyzer": {"x": {"tokenizer": "ngram"}}}, {"analyzer": {"x": {"tokenizer": "standard", "filter": ["synonym"]}}}):
        with pytest.raises(Unsupported):
            analysis.custom(bad)


def test_inference_and_mappings():
    kinds = {k: (f.type if (f := maps.infer(v)) else None) for k, v in {"a": 1, "b": 1.5, "c": True, "d": "2026-03-15", "e": "text", "f": "42", "g": None, "h": [None, 3], "i": "20260315"}.items()}
    assert kinds == {"a": "long", "b": "float", "c": "boolean", "d": "date", "e": "text", "f": "text", "g": None, "h": "long", "i": "text"}
    m = maps.parse({"dynamic": "strict", "properties": {"t": {"type": "text", "fields": {"raw": {"type": "keyword", "ignore_above": 8}}}, "o": {"properties": {"n": {"type": "byte"}}}, "l": {"type": "nested", "properties": {"q": {"type": "integer"}}}}})
    assert m.get("t.raw").source == "t" and m.get("o.n").type == "byte" and m.nested_root("l.q") == "l" and maps.parse(m.to_dict()).to_dict() == m.to_dict()
    for bad in ({"x": {"type": "geo_point"}}, {"x": {"type": "keyword", "analyzer": "simple"}}, {"_x": {"type": "text"}}, {"x": {"type": "text", "boost": 2}}, {"x": {"type": "long", "format": "yyyy"}}, {"x.y": {"type": "long"}}):
        with pytest.raises(MapperParsing):
            maps.parse({"properties": bad})
    with pytest.raises(IllegalArgument):
        m.get("o.n").read(200)
    assert m.get("o.n").read(" 7 ") == 7 and m.get("o.n").read(True) == 1 and m.get("o.n").read(3.0) == 3
    for path, doc in ((maps.StrictMapping, {"new": 1}), (maps.DocumentParsing, {"t": {"x": 1}})):
        with pytest.raises(path):
            maps.grown(m if path is maps.StrictMapping else maps.Mapping(fields={"t": maps.Field("text")}), doc)


def test_ideographs_stand_alone(spark):
    text = "日本語 abc中文def ひらカタカナ l'ascension 3.14 éte_1"
    expected = ["日", "本", "語", "abc", "中", "文", "def", "ひ", "ら", "カタカナ", "l'ascension", "3.14", "éte_1"]
    assert analysis.BUILT_IN["standard"].terms(text) == expected
    column = analysis.BUILT_IN["standard"].column(F.col("t"))
    assert spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"] == expected
