"""Query trees to columns: for every clause whether a document matches, and its score.

Both are plain expressions, so that Catalyst prunes scores nobody asks for and
pushes predicates to the scan.  Statistics for scores are taken over the whole
index in one aggregate before the query is compiled for good: the first pass
collects what is needed, the second puts the numbers in as literals.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import IllegalArgument, MapperParsing, Parsing, QueryShard, Unsupported, ValueUnreadable, expect_only
from quarry.functions import analysis, dates, patterns
from quarry.functions.msm import minimum_should_match
from quarry.operators.mapping import Field, Mapping, column
from quarry.sources.terms import ROW, Terms

K1, B = 1.2, 0.75


@dataclass
class Scored:
    match: Column
    score: Column

    def boosted(self, boost: float) -> Scored:
        return self if boost == 1.0 else Scored(self.match, self.score * F.lit(boost))

    def value(self) -> Column:
        """The score where it matches, else 0."""
        return F.when(self.match, self.score).otherwise(F.lit(0.0))


def nothing() -> Scored:
    return Scored(F.lit(False), F.lit(0.0))


@dataclass
class Context:
    """What a query is compiled against."""

    mapping: Mapping
    df: DataFrame
    now: int
    allow_unmapped: bool = True
    elsewhere: frozenset[str] = frozenset()  # fields that another searched index maps
    stats: dict[str, float] | None = None  # None while they are being collected
    needed: dict[str, Column] = field(default_factory=dict)
    token_columns: dict[str, tuple[str, Column]] = field(default_factory=dict)
    markers: list[tuple[str, str, DataFrame]] = field(default_factory=list)  # name, key column, keys
    element: Column | None = None
    root: str | None = None
    terms: Terms | None = None  # of the index, if its texts were analysed at refresh
    postings: dict[tuple[str, str | tuple[str, ...]], str] = field(default_factory=dict)  # column of the positions of (field, term), or of those of several terms
    lengths: dict[str, str] = field(default_factory=dict)
    joined: frozenset[str] = frozenset()  # of those columns the ones that `df` has already
    frequencies: dict[tuple[str, str], int] = field(default_factory=dict)

    # -- fields ----------------------------------------------------------------

    def field(self, path: str) -> Field | None:
        """The field, or None if a leaf on it matches nothing."""
        root = self.mapping.nested_root(path)
        if root and self.root != root:
            raise QueryShard(f"[{path}] is inside the nested object [{root}] and needs a [nested] query")
        if self.root and root != self.root:
            raise QueryShard(f"[{path}] is outside the nested object [{self.root}]")
        f = self.mapping.get(path)
        if f is None and not self.allow_unmapped and path not in self.elsewhere:
            raise QueryShard(f"No field mapping can be found for the field with name [{path}]")
        return f

    def any(self, path: str, f: Field, test: Callable[[Column], Column]) -> Column:
        """Some value of the field passes."""
        if self.element is not None:
            c = self.element
            for part in path[len(self.root) + 1 :].split("."):
                c = c.getField(part)
            return test(c)
        c = column(path, f)
        return F.exists(c, test) if f.array else test(c)

    def tokens(self, path: str, f: Field) -> Column:
        """The terms of a text field by position."""
        if path not in self.token_columns:
            analyzer = self.mapping.analyzers[f.analyzer]
            c = column(path, f)
            # several values: one after the other, a position apart
            expr = F.flatten(F.transform(c, lambda x: F.concat(analyzer.column(x), F.array(F.lit(None).cast("string"))))) if f.array else analyzer.column(c)
            self.token_columns[path] = (f"__tokens_{len(self.token_columns)}", expr)
        return F.col(self.token_columns[path][0])

    def indexed(self, path: str) -> bool:
        return self.terms is not None and self.element is None and path in self.terms.totals

    def positions(self, path: str, term: str | tuple[str, ...]) -> Column:
        """Where a term stands in an analysed text, NULL if nowhere; of several terms (term, positions) of each that it has, NULL or none if it has none."""
        name = self.postings.setdefault((path, term), f"__at_{len(self.postings)}")
        return F.col(name)

    def has(self, path: str, f: Field, term: str) -> Column:
        """Whether the text has the term."""
        if self.indexed(path):
            return self.positions(path, term).isNotNull()
        return F.array_contains(self.tokens(path, f), term)

    def length(self, path: str, f: Field) -> Column:
        if self.indexed(path):
            return F.coalesce(F.col(self.lengths.setdefault(path, f"__length_{len(self.lengths)}")), F.lit(1))
        return F.size(F.filter(self.tokens(path, f), lambda t: t.isNotNull()))

    def nonempty(self, path: str, f: Field) -> Column:
        """Whether the text has any term."""
        if self.indexed(path):
            return F.col(self.postings.setdefault((path, ""), f"__at_{len(self.postings)}")).isNotNull()  # no term is empty: a text's first posting
        return self.length(path, f) > 0

    # -- statistics --------------------------------------------------------------

    def stat(self, name: str, expr: Callable[[], Column]) -> float:
        if self.stats is None:
            self.needed.setdefault(name, expr())
            return 1.0
        return float(self.stats[name] or 0)

    def idf(self, name: str, match: Callable[[], Column], n: float) -> float:
        df = self.stat(f"df {name}", lambda: F.count_if(match()))
        return math.log(1 + max(0.0, n - df + 0.5) / (df + 0.5))

    def corpus(self, path: str, f: Field) -> tuple[float, float]:
        """Texts with terms, and their mean length."""
        if self.indexed(path):
            n, total = self.terms.totals[path]
        else:
            n = self.stat(f"n {path}", lambda: F.count_if(self.length(path, f) > 0))
            total = self.stat(f"len {path}", lambda: F.sum(self.length(path, f)))
        return n, total / n if n else 1.0

    def rarity(self, path: str, f: Field, term: str, n: float) -> float:
        """The term's inverse document frequency."""
        if self.indexed(path):
            df = self.frequencies.setdefault((path, term), 0)
            return math.log(1 + max(0.0, n - df + 0.5) / (df + 0.5))
        return self.idf(f"{path} {term}", lambda: F.array_contains(self.tokens(path, f), term), n)

    def internal(self) -> list[str]:
        """Columns that `prepared` adds."""
        return [name for name, _ in self.token_columns.values()] + [name for name, _, _ in self.markers] + list(self.postings.values()) + list(self.lengths.values())

    def prepared(self) -> DataFrame:
        """The index with the columns that the compiled query uses.

        Where a match asks for a term, the left join on the postings becomes an
        inner one, and only documents with one of the terms are read on.
        """
        df = self.df
        new = {k: v for k, v in self.postings.items() if v not in self.joined}
        if new:
            found = self.terms.columns(new, {k: v for k, v in self.lengths.items() if v not in self.joined and any(p == k for p, _ in new)})
            df = df.join(found.withColumnRenamed(ROW, "__found"), F.col(ROW) == F.col("__found"), "left").drop("__found")
        for name, expr in self.token_columns.values():
            df = df.withColumn(name, expr)
        for name, key, keys in self.markers:
            df = df.join(keys.select(keys.columns[0]).distinct().select(F.col(keys.columns[0]).alias(f"{name}_key"), F.lit(True).alias(name)), F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        return df

    def inner(self, **other) -> Context:
        return Context(self.mapping, self.df, self.now, self.allow_unmapped, self.elsewhere, **other)

    def again(self, df: DataFrame) -> Context:
        """A context for further queries on rows that this one's query has prepared."""
        out = Context(self.mapping, df, self.now, self.allow_unmapped, self.elsewhere, terms=self.terms, postings=dict(self.postings), lengths=dict(self.lengths))
        out.joined = frozenset([*self.postings.values(), *self.lengths.values()])
        return out


def boost_of(spec: dict) -> float:
    b = spec.get("boost")
    if b is None:
        return 1.0
    if isinstance(b, bool) or not isinstance(b, (int, float)):
        raise Parsing(f"[boost] must be a number, not [{b}]")
    return float(b)


def flag_of(spec: dict, name: str, default: bool = False) -> bool:
    v = spec.get(name)
    if v is None:
        return default
    if v in (True, "true"):
        return True
    if v in (False, "false"):
        return False
    raise IllegalArgument(f"[{name}] must be true or false, not [{v}]")


def one_field(clause: str, spec: dict) -> tuple[str, object]:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise Parsing(f"[{clause}] query needs exactly one field")
    return next(iter(spec.items()))


def short(clause: str, spec: dict, key: str, *allowed: str) -> tuple[str, dict]:
    """Field and parameters of `{f: v}` or `{f: {key: v, ...}}`."""
    path, body = one_field(clause, spec)
    if not isinstance(body, dict):
        body = {key: body}
    expect_only(clause, body, key, *allowed)
    if body.get(key) is None:
        raise IllegalArgument(f"[{clause}] query on [{path}] needs [{key}]")
    return path, body


def instant(f: Field, ms: int) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    moment = dates.from_millis(ms)
    if f.zoneless:
        return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(moment)


# -- leaves --------------------------------------------------------------------------


def equals(ctx: Context, path: str, f: Field, value) -> Column:
    """Equality; a date stands for the period that it names."""
    if f.type == "date":
        try:
            low, high = (dates.resolve(value, f.dates, ctx.now, up) for up in (False, True))
        except MapperParsing as e:
            raise ValueUnreadable(str(e)) from None
        return ctx.any(path, f, lambda c: c.between(instant(f, low), instant(f, high)))
    if f.type == "text":
        term = str(value).lower() if isinstance(value, bool) else str(value)
        return ctx.has(path, f, term)
    wanted = F.lit(f.read(value))
    return ctx.any(path, f, lambda c: c == wanted)


def term_score(ctx: Context, path: str, f: Field, term: str) -> Column:
    n, average = ctx.corpus(path, f)
    if ctx.indexed(path):
        tf = F.when(ctx.has(path, f, term), F.size(ctx.positions(path, term))).otherwise(0)
    else:
        tf = F.size(F.filter(ctx.tokens(path, f), lambda t: t == term))
    return bm25(ctx.rarity(path, f, term, n), tf, ctx.length(path, f), average)


def bm25(idf: float | Column, tf: Column, length: Column, average: float) -> Column:
    average = average or 1.0
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def term_leaf(ctx: Context, path: str, f: Field, value) -> Scored:
    match = equals(ctx, path, f, value)
    if ctx.element is not None:
        return Scored(match, F.lit(1.0))
    if f.type == "text":
        return Scored(match, term_score(ctx, path, f, str(value).lower() if isinstance(value, bool) else str(value)))
    n = ctx.stat("n *", lambda: F.count("*"))
    return Scored(match, F.lit(ctx.idf(f"{path} = {value!r}", lambda: equals(ctx, path, f, value), n)))


def term_query(ctx: Context, spec: dict) -> Scored:
    path, body = short("term", spec, "value", "boost")
    f = ctx.field(path)
    return term_leaf(ctx, path, f, body["value"]).boosted(boost_of(body)) if f else nothing()


def terms_query(ctx: Context, spec: dict) -> Scored:
    spec = dict(spec)
    boost = boost_of({"boost": spec.pop("boost", None)})
    path, values = one_field("terms", spec)
    if isinstance(values, dict):
        raise Unsupported("[terms] lookup is not supported")
    if not isinstance(values, list):
        raise Parsing("[terms] query needs a list of values")
    f = ctx.field(path)
    if not f or not values:
        return nothing()
    if f.type in ("date", "text"):
        match = any_of([equals(ctx, path, f, v) for v in values])
    else:
        wanted = [f.read(v) for v in values]
        match = ctx.any(path, f, lambda c: c.isin(wanted))
    return Scored(match, F.lit(boost))


def range_query(ctx: Context, spec: dict) -> Scored:
    path, body = one_field("range", spec)
    expect_only("range", body, "gte", "gt", "lte", "lt", "boost", "format")
    for a, b in (("gte", "gt"), ("lte", "lt")):
        if body.get(a) is not None and body.get(b) is not None:
            raise IllegalArgument(f"[range] query can't have both [{a}] and [{b}]")
    bounds = {k: body[k] for k in ("gte", "gt", "lte", "lt") if body.get(k) is not None}
    if not bounds:
        raise IllegalArgument(f"[range] query on [{path}] needs a bound")
    f = ctx.field(path)
    if not f:
        return nothing()
    if f.type == "text":
        raise Unsupported(f"[range] on the text field [{path}] is not supported")
    if body.get("format") is not None and f.type != "date":
        raise Unsupported(f"[range] format is for dates only, not [{path}]")
    fmt = dates.DateFormat(body["format"]) if body.get("format") is not None else f.dates
    literals = {}
    for k, v in bounds.items():
        literals[k] = instant(f, dates.resolve(v, fmt, ctx.now, up=k in ("gt", "lte"))) if f.type == "date" else F.lit(_bound(f, k, v))
    compare = {"gte": operator.ge, "gt": operator.gt, "lte": operator.le, "lt": operator.lt}
    return Scored(ctx.any(path, f, lambda c: all_of([compare[k](c, v) for k, v in literals.items()])), F.lit(boost_of(body)))


def _bound(f: Field, side: str, value):
    """A bound; of an integer field it may have decimals."""
    from quarry.operators.mapping import INTEGERS

    if f.type in INTEGERS and not isinstance(value, bool):
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueUnreadable(f'For input string: "{value}"') from None
        if number != int(number):
            return number
    return f.read(value)


def exists_query(ctx: Context, spec: dict) -> Scored:
    expect_only("exists", spec, "field", "boost")
    path = spec.get("field")
    if not isinstance(path, str):
        raise IllegalArgument("[exists] query needs [field]")
    below = [p for p in ctx.mapping.fields if p.startswith(path + ".")]
    if below and ctx.mapping.get(path) is None:  # an object: any of its leaves
        return Scored(any_of([_has_value(ctx, p) for p in below if ctx.mapping.nested_root(p) == ctx.root]), F.lit(boost_of(spec)))
    return Scored(_has_value(ctx, path), F.lit(boost_of(spec))) if ctx.field(path) else nothing()


def _has_value(ctx: Context, path: str) -> Column:
    f = ctx.field(path)
    if f.type == "text" and ctx.element is None:
        return ctx.nonempty(path, f)
    return ctx.any(path, f, lambda c: c.isNotNull())


def ids_query(ctx: Context, spec: dict) -> Scored:
    expect_only("ids", spec, "values", "boost")
    values = spec.get("values")
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise Parsing("[ids] query needs [values], a list of strings")
    return Scored(F.col("_id").isin(values), F.lit(boost_of(spec)))


# -- patterns -------------------------------------------------------------------------


def over_terms(ctx: Context, path: str, f: Field, test: Callable[[Column], Column]) -> Column:
    if f.type == "text":
        return F.exists(ctx.tokens(path, f), test)
    return ctx.any(path, f, test)


def pattern_field(ctx: Context, clause: str, path: str) -> Field | None:
    f = ctx.field(path)
    if f and f.type not in ("keyword", "text"):
        raise QueryShard(f"Can only use {clause} queries on keyword and text fields - not on [{path}] which is of type [{f.type}]")
    return f


def pattern_query(clause: str, test: Callable[[dict, bool], Callable[[Column], Column]], *allowed: str):
    def compiled(ctx: Context, spec: dict) -> Scored:
        path, body = short(clause, spec, "value", "boost", "case_insensitive", *allowed)
        f = pattern_field(ctx, clause, path)
        check = test(body, flag_of(body, "case_insensitive"))
        return Scored(over_terms(ctx, path, f, check), F.lit(boost_of(body))) if f else nothing()

    return compiled


def _prefix_test(body: dict, fold: bool):
    value = str(body["value"])
    return (lambda c: c.rlike(patterns.prefix(value, True))) if fold else (lambda c: c.startswith(value))


def _regexp_test(body: dict, fold: bool):
    pattern = patterns.regexp(str(body["value"]), body.get("flags"), fold)
    return lambda c: c.rlike(pattern)


def _osa(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, each stretch edited once."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def fuzzy_query(ctx: Context, spec: dict) -> Scored:
    path, body = short("fuzzy", spec, "value", "boost", "fuzziness", "transpositions")
    f = pattern_field(ctx, "fuzzy", path)
    value = str(body["value"])
    fuzziness = body.get("fuzziness", "AUTO")
    if isinstance(fuzziness, str) and fuzziness.upper() == "AUTO":
        edits = 0 if len(value) <= 2 else 1 if len(value) <= 5 else 2
    elif not isinstance(fuzziness, bool) and str(fuzziness).isdigit():
        edits = min(2, int(fuzziness))
    else:
        raise IllegalArgument(f"[fuzziness] must be AUTO, 0, 1 or 2, not [{fuzziness}]")
    swaps = flag_of(body, "transpositions", True)
    if not f:
        return nothing()

    @F.pandas_udf("boolean")
    def close(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: t is not None and _osa(t, value, edits) <= edits)

    @F.pandas_udf("boolean")
    def some_close(terms: pd.Series) -> pd.Series:
        return terms.map(lambda ts: ts is not None and any(t is not None and _osa(t, value, edits) <= edits for t in ts))

    far = 2 * edits if swaps else edits  # a swap is two plain edits
    maybe = over_terms(ctx, path, f, lambda c: F.levenshtein(c, F.lit(value), far) >= 0)
    if not swaps or edits == 0:
        return Scored(maybe, F.lit(boost_of(body)))
    many = f.type == "text" or f.array
    source = ctx.tokens(path, f) if f.type == "text" else column(path, f)
    # only what passes the cheap test goes to Python
    exact = (some_close if many else close)(F.when(maybe, source))
    return Scored(F.coalesce(maybe, F.lit(False)) & F.coalesce(exact, F.lit(False)), F.lit(boost_of(body)))


# -- full text -------------------------------------------------------------------------


def as_text(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (str, int, float)):
        return str(value)
    raise Parsing(f"unexpected query value [{value}]")


def operator_of(body: dict) -> str:
    op = body.get("operator") or "or"
    if not isinstance(op, str) or op.lower() not in ("or", "and"):
        raise IllegalArgument(f"[operator] must be or or and, not [{op}]")
    return op.lower()


def match_field(ctx: Context, path: str, f: Field, value, op: str, lenient: bool) -> Scored:
    if f.type != "text":
        try:
            return term_leaf(ctx, path, f, value)
        except ValueUnreadable:
            if lenient:
                return nothing()
            raise
    terms = [t for t in ctx.mapping.analyzers[f.analyzer].terms(as_text(value)) if t is not None]
    if not terms:
        return nothing()
    if ctx.indexed(path):
        match = (all_of if op == "and" else any_of)([ctx.has(path, f, t) for t in dict.fromkeys(terms)])
        return Scored(match, total([term_score(ctx, path, f, t) for t in terms]))
    tokens = ctx.tokens(path, f)
    if op == "and":
        match = let(tokens, lambda toks: all_of([F.array_contains(toks, t) for t in dict.fromkeys(terms)]))
    else:
        match = F.arrays_overlap(tokens, F.array(*map(F.lit, dict.fromkeys(terms)))) if len(set(terms)) > 1 else F.array_contains(tokens, terms[0])
    return Scored(F.coalesce(match, F.lit(False)) if op == "or" else match, total([term_score(ctx, path, f, t) for t in terms]))


def match_query(ctx: Context, spec: dict) -> Scored:
    path, body = short("match", spec, "query", "operator", "boost", "lenient")
    f, lenient, op = ctx.field(path), flag_of(body, "lenient"), operator_of(body)
    return match_field(ctx, path, f, body["query"], op, lenient).boosted(boost_of(body)) if f else nothing()


def slop_of(body: dict) -> None:
    if body.get("slop") not in (None, 0):
        raise Unsupported("[slop] over 0 is not supported")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def phrase_tf(tokens: Column, terms: list[tuple[int, str]]) -> Column:
    """Places where all terms stand at their distances."""
    def places(toks: Column) -> Column:
        def here(i: Column) -> Column:
            return all_of([F.get(toks, i + k) == t for k, t in terms])

        return F.when(F.size(toks) > 0, F.size(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), here))).otherwise(0)

    return let(tokens, places)


def _shifted(k: int) -> Callable[[Column], Column]:
    return lambda position: position - k


def phrase_leaf(ctx: Context, path: str, f: Field, terms: list[tuple[int, str]]) -> Scored:
    n, average = ctx.corpus(path, f)
    idf = sum(ctx.rarity(path, f, t, n) for _, t in terms)
    if ctx.indexed(path):
        has = all_of([ctx.has(path, f, t) for t in dict.fromkeys(t for _, t in terms)])
        begins = [F.transform(ctx.positions(path, t), _shifted(k)) for k, t in terms]  # where the phrase would begin
        tf = F.when(has, F.size(functools.reduce(F.array_intersect, begins))).otherwise(0)
        return Scored(has & (tf > 0), bm25(idf, tf, ctx.length(path, f), average))
    tokens = ctx.tokens(path, f)

    def found(toks: Column) -> Column:
        has = all_of([F.array_contains(toks, t) for t in dict.fromkeys(t for _, t in terms)])
        return F.when(has, phrase_tf(toks, terms) > 0).otherwise(F.lit(False))

    return Scored(let(tokens, found), bm25(idf, phrase_tf(tokens, terms), ctx.length(path, f), average))


def phrase_field(ctx: Context, path: str, f: Field, value, lenient: bool = False) -> Scored:
    if f.type != "text":
        return match_field(ctx, path, f, value, "or", lenient)
    terms = analysis.neighbours(ctx.mapping.analyzers[f.analyzer].terms(as_text(value)))
    if len(terms) < 2:
        return match_field(ctx, path, f, value, "or", lenient)
    return phrase_leaf(ctx, path, f, terms)


def match_phrase_query(ctx: Context, spec: dict) -> Scored:
    path, body = short("match_phrase", spec, "query", "slop", "boost")
    slop_of(body)
    f = ctx.field(path)
    return phrase_field(ctx, path, f, body["query"]).boosted(boost_of(body)) if f else nothing()


def expansions_of(body: dict) -> int:
    n = body.get("max_expansions", 50)
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise IllegalArgument(f"[max_expansions] must be a positive integer, not [{n}]")
    return n


def expanded(ctx: Context, path: str, f: Field, prefix: str, most: int) -> list[str]:
    """The first terms of the index with this prefix: at most `most` rows reach the driver."""
    if ctx.indexed(path):
        return ctx.terms.starting(path, prefix, most)
    own = ctx.inner()
    tokens = own.tokens(path, f)
    terms = own.prepared().select(F.explode(tokens).alias("t")).where(F.col("t").startswith(prefix))
    return [r[0] for r in terms.distinct().orderBy("t").limit(most).collect()]


def phrase_prefix_field(ctx: Context, path: str, f: Field, value, most: int) -> Scored:
    if f.type != "text":
        raise QueryShard(f"Can only use phrase prefix queries on text fields - not on [{path}] which is of type [{f.type}]")
    terms = analysis.neighbours(ctx.mapping.analyzers[f.analyzer].terms(as_text(value)))
    if not terms:
        return nothing()
    *before, (at, prefix) = terms
    key = f"__expanded {path} {prefix} {most}"
    if key not in ctx.needed:
        ctx.needed[key] = expanded(ctx, path, f, prefix, most)
    found = ctx.needed[key]
    if found and ctx.indexed(path):
        return expanded_leaf(ctx, path, f, before, at, found)
    parts = [phrase_leaf(ctx, path, f, [*before, (at, t)]) if before else match_terms(ctx, path, f, t) for t in found]
    return either(parts)


def expanded_leaf(ctx: Context, path: str, f: Field, before: list[tuple[int, str]], at: int, ends: list[str]) -> Scored:
    """A phrase whose last term is any of several: they share one column and one expression, however many they are. The scores of those that match are added up."""
    n, average = ctx.corpus(path, f)
    rest = sum(ctx.rarity(path, f, t, n) for _, t in before)
    idf = F.create_map(*[F.lit(x) for t in ends for x in (t, rest + ctx.rarity(path, f, t, n))])
    found, length = ctx.positions(path, tuple(ends)), ctx.length(path, f)
    has = all_of([ctx.has(path, f, t) for t in dict.fromkeys(t for _, t in before)]) if before else F.lit(True)
    some = has & found.isNotNull() & (F.size(found) > 0)

    def scored(tf: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.sort_array(found), F.lit(0.0), lambda sum_, x: sum_ + bm25(F.element_at(idf, x["term"]), tf(x), length, average))

    if not before:
        return Scored(some, scored(lambda x: F.size(x["positions"])))
    begins = functools.reduce(F.array_intersect, [F.transform(ctx.positions(path, t), _shifted(k)) for k, t in before])

    def shifted(x: Column) -> Column:
        return F.transform(x["positions"], _shifted(at))

    match = let(begins, lambda b: F.arrays_overlap(b, F.flatten(F.transform(found, shifted))))
    score = let(begins, lambda b: scored(lambda x: F.size(F.array_intersect(b, shifted(x)))))
    return Scored(some & F.coalesce(match, F.lit(False)), F.when(some, score).otherwise(0.0))


def match_terms(ctx: Context, path: str, f: Field, term: str) -> Scored:
    return Scored(ctx.has(path, f, term), term_score(ctx, path, f, term))


def either(parts: list[Scored]) -> Scored:
    """Any of them; the scores of those that match are added up."""
    if not parts:
        return nothing()
    return parts[0] if len(parts) == 1 else Scored(any_of([p.match for p in parts]), total([p.value() for p in parts]))


def match_phrase_prefix_query(ctx: Context, spec: dict) -> Scored:
    path, body = short("match_phrase_prefix", spec, "query", "slop", "max_expansions", "boost")
    slop_of(body)
    most, f = expansions_of(body), ctx.field(path)
    return phrase_prefix_field(ctx, path, f, body["query"], most).boosted(boost_of(body)) if f else nothing()


def multi_match_query(ctx: Context, spec: dict) -> Scored:
    expect_only("multi_match", spec, "query", "fields", "type", "operator", "boost", "tie_breaker", "lenient", "slop", "max_expansions")
    if spec.get("query") is None:
        raise IllegalArgument("[multi_match] needs [query]")
    kind, lenient, op = spec.get("type", "best_fields"), flag_of(spec, "lenient"), operator_of(spec)
    if kind not in ("best_fields", "most_fields", "phrase", "phrase_prefix"):
        raise Unsupported(f"[multi_match] type [{kind}] is not supported")
    if kind == "most_fields" and spec.get("tie_breaker") is not None:
        raise Unsupported("[multi_match] tie_breaker with most_fields is not supported")
    slop_of(spec)
    parts = []
    fields = spec.get("fields")
    if not isinstance(fields, list) or not fields:
        raise IllegalArgument("[multi_match] needs [fields]")
    for name in fields:
        path, _, weight = name.partition("^")
        if "*" in path:
            raise Unsupported("[multi_match] fields with [*] are not supported")
        f = ctx.field(path)
        if f is None:
            continue
        if kind == "phrase":
            part = phrase_field(ctx, path, f, spec["query"], lenient)
        elif kind == "phrase_prefix":
            part = phrase_prefix_field(ctx, path, f, spec["query"], expansions_of(spec))
        else:
            part = match_field(ctx, path, f, spec["query"], op, lenient)
        parts.append(part.boosted(float(weight)) if weight else part)
    if not parts:
        return nothing()
    out = either(parts) if kind == "most_fields" else best(parts, tie_of(spec))
    return out.boosted(boost_of(spec))


# -- compounds ---------------------------------------------------------------------------


def total(columns: list[Column]) -> Column:
    return functools.reduce(operator.add, columns) if columns else F.lit(0.0)


def all_of(columns: list[Column]) -> Column:
    return functools.reduce(operator.and_, columns)


def any_of(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns) if columns else F.lit(False)


def tie_of(spec: dict) -> float:
    tie = spec.get("tie_breaker")
    if tie is None:
        return 0.0
    if isinstance(tie, bool) or not isinstance(tie, (int, float)):
        raise Parsing(f"[tie_breaker] must be a number, not [{tie}]")
    return float(tie)


def best(parts: list[Scored], tie: float) -> Scored:
    values = [p.value() for p in parts]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return Scored(any_of([p.match for p in parts]), top + F.lit(tie) * (total(values) - top) if tie else top)


def dis_max_query(ctx: Context, spec: dict) -> Scored:
    expect_only("dis_max", spec, "queries", "tie_breaker", "boost")
    queries = spec.get("queries")
    if not isinstance(queries, list) or not queries:
        raise Parsing("[dis_max] needs [queries]")
    return best([build(ctx, q) for q in queries], tie_of(spec)).boosted(boost_of(spec))


def constant_score_query(ctx: Context, spec: dict) -> Scored:
    expect_only("constant_score", spec, "filter", "boost")
    if not isinstance(spec.get("filter"), dict):
        raise Parsing("[constant_score] needs [filter]")
    return Scored(build(ctx, spec["filter"]).match, F.lit(boost_of(spec)))


def clauses_of(spec: dict, name: str) -> list[dict]:
    given = spec.get(name)
    return [c for c in (given if isinstance(given, list) else [given]) if c is not None]


def bool_query(ctx: Context, spec: dict) -> Scored:
    expect_only("bool", spec, "must", "should", "filter", "must_not", "minimum_should_match", "boost")
    must, should, also, never = ([build(ctx, c) for c in clauses_of(spec, k)] for k in ("must", "should", "filter", "must_not"))
    default = 1 if should and not must and not also else 0
    least = minimum_should_match(spec.get("minimum_should_match"), len(should), default)
    if least > len(should):
        return nothing()
    match = [p.match for p in must + also]
    if should and least == len(should):
        match += [p.match for p in should]
    elif should and least == 1:
        match.append(any_of([p.match for p in should]))
    elif least:
        match.append(total([F.when(p.match, 1).otherwise(0) for p in should]) >= least)
    match += [~F.coalesce(p.match, F.lit(False)) for p in never]
    score = total([p.score for p in must] + [p.value() for p in should])
    if not must and not should and not also:
        score = F.lit(1.0)
    return Scored(all_of(match) if match else F.lit(True), score).boosted(boost_of(spec))


def match_all_query(ctx: Context, spec: dict) -> Scored:
    expect_only("match_all", spec, "boost")
    return Scored(F.lit(True), F.lit(boost_of(spec)))


def match_none_query(ctx: Context, spec: dict) -> Scored:
    expect_only("match_none", spec)
    return nothing()


# -- relations -----------------------------------------------------------------------------

_IN_NESTED = ("match_all", "match_none", "term", "match", "terms", "range", "exists", "prefix", "bool")


def nested_query(ctx: Context, spec: dict) -> Scored:
    """Documents with one element that passes the whole inner tree."""
    expect_only("nested", spec, "path", "query", "score_mode", "boost")
    if spec.get("score_mode", "avg") not in ("none", "avg"):
        raise Unsupported(f"[nested] score_mode [{spec['score_mode']}] is not supported")
    path, query = spec.get("path"), spec.get("query")
    if not isinstance(path, str) or not isinstance(query, dict):
        raise Parsing("[nested] needs [path] and [query]")
    if ctx.root:
        raise Unsupported("[nested] within [nested] is not supported")
    if path not in ctx.mapping.nested:
        if ctx.mapping.get(path) or any(p.startswith(path + ".") for p in ctx.mapping.fields):
            raise QueryShard(f"[nested] nested object under path [{path}] is not of nested type")
        if not ctx.allow_unmapped and path not in ctx.elsewhere:
            raise QueryShard(f"[nested] failed to find nested object under path [{path}]")
        return nothing()

    def check(q: dict) -> None:
        kind, body = one_clause(q)
        if kind not in _IN_NESTED:
            raise Unsupported(f"[{kind}] within [nested] is not supported")
        if kind == "bool":
            for name in ("must", "should", "filter", "must_not"):
                for c in clauses_of(body, name):
                    check(c)
        elif kind not in ("match_all", "match_none"):
            target = body.get("field") if kind == "exists" else next((k for k in body if k != "boost"), None)
            f = ctx.mapping.get(target) if isinstance(target, str) else None
            if f and f.type == "text":
                raise Unsupported(f"the text field [{target}] within [nested] is not supported")

    check(query)
    match = F.exists(F.col(path), lambda e: F.coalesce(build(ctx.inner(element=e, root=path), query).match, F.lit(False)))
    return Scored(match, F.lit(1.0)).boosted(boost_of(spec))


def relation_of(ctx: Context, clause: str) -> str:
    if not ctx.mapping.join:
        raise QueryShard(f"[{clause}] no join field has been configured")
    return ctx.mapping.join.name


def related(ctx: Context, query: dict, relation: str) -> tuple[DataFrame, Column]:
    """The index with what `query` needs, and which documents of a relation match it."""
    inner = ctx.inner()
    found = compiled(inner, query, scores=False)
    return inner.prepared(), found.match & (F.col(inner.mapping.join.name) == relation)


def marked(ctx: Context, key: str, keys: DataFrame) -> Scored:
    name = f"__related_{len(ctx.markers)}"
    ctx.markers.append((name, key, keys))
    return Scored(F.col(name), F.lit(1.0))


def _refuse_modes(clause: str, spec: dict) -> None:
    if spec.get("score_mode", "none") != "none":
        raise Unsupported(f"[{clause}] score_mode [{spec['score_mode']}] is not supported")


def has_child_query(ctx: Context, spec: dict) -> Scored:
    expect_only("has_child", spec, "type", "query", "score_mode", "boost")
    _refuse_modes("has_child", spec)
    join, child = relation_of(ctx, "has_child"), spec.get("type")
    if ctx.mapping.join.parent_of(child) is None:
        raise QueryShard(f"[has_child] join field [{join}] doesn't hold [{child}] as a child")
    df, match = related(ctx, spec.get("query") or {}, child)
    parent = ctx.mapping.join.parent_of(child)
    out = marked(ctx, "_id", df.where(match & F.col("_join_parent").isNotNull()).select("_join_parent"))
    return Scored(out.match & (F.col(join) == parent), out.score).boosted(boost_of(spec))


def has_parent_query(ctx: Context, spec: dict) -> Scored:
    expect_only("has_parent", spec, "parent_type", "query", "score_mode", "boost")
    _refuse_modes("has_parent", spec)
    join, parent = relation_of(ctx, "has_parent"), spec.get("parent_type")
    if parent not in ctx.mapping.join.relations:
        raise QueryShard(f"[has_parent] join field [{join}] doesn't hold [{parent}] as a parent")
    df, match = related(ctx, spec.get("query") or {}, parent)
    out = marked(ctx, "_join_parent", df.where(match).select("_id"))
    return Scored(out.match & F.col(join).isin(ctx.mapping.join.relations[parent]), out.score).boosted(boost_of(spec))


def parent_id_query(ctx: Context, spec: dict) -> Scored:
    expect_only("parent_id", spec, "type", "id", "boost")
    join, child = relation_of(ctx, "parent_id"), spec.get("type")
    if ctx.mapping.join.parent_of(child) is None:
        raise QueryShard(f"[parent_id] no relation found for child [{child}]")
    if not isinstance(spec.get("id"), str):
        raise Parsing("[parent_id] needs [id]")
    return Scored((F.col(join) == child) & (F.col("_join_parent") == spec["id"]), F.lit(boost_of(spec)))


# -- the dispatcher --------------------------------------------------------------------------

CLAUSES: dict[str, Callable[[Context, dict], Scored]] = {
    "match_all": match_all_query,
    "match_none": match_none_query,
    "ids": ids_query,
    "constant_score": constant_score_query,
    "term": term_query,
    "terms": terms_query,
    "range": range_query,
    "exists": exists_query,
    "prefix": pattern_query("prefix", _prefix_test),
    "wildcard": pattern_query("wildcard", lambda body, fold: lambda c: c.rlike(patterns.wildcard(str(body["value"]), fold))),
    "regexp": pattern_query("regexp", _regexp_test, "flags"),
    "fuzzy": fuzzy_query,
    "match": match_query,
    "multi_match": multi_match_query,
    "match_phrase": match_phrase_query,
    "match_phrase_prefix": match_phrase_prefix_query,
    "bool": bool_query,
    "dis_max": dis_max_query,
    "nested": nested_query,
    "has_child": has_child_query,
    "has_parent": has_parent_query,
    "parent_id": parent_id_query,
}


def one_clause(query: dict) -> tuple[str, dict]:
    if not isinstance(query, dict) or len(query) != 1:
        raise Parsing("a query is an object with exactly one clause")
    kind, body = next(iter(query.items()))
    if kind not in CLAUSES:
        raise Parsing(f"unknown query [{kind}]")
    if not isinstance(body, dict):
        raise Parsing(f"[{kind}] query malformed, an object is expected")
    return kind, body


def build(ctx: Context, query: dict) -> Scored:
    kind, body = one_clause(query)
    return CLAUSES[kind](ctx, body)


def compiled(ctx: Context, query: dict, scores: bool = True) -> Scored:
    """The query for good: statistics are looked up, or taken over the whole index, first, if a score will be read."""
    build(ctx, query)
    wanted = {k: v for k, v in ctx.needed.items() if not k.startswith("__expanded")}
    ctx.markers.clear()
    if scores and wanted:
        names = list(wanted)
        row = ctx.prepared().agg(*[wanted[n].alias(f"s{k}") for k, n in enumerate(names)]).first()
        ctx.stats = {n: row[k] for k, n in enumerate(names)}
    else:
        ctx.stats = dict.fromkeys(wanted, 1.0)
    if scores and ctx.frequencies:
        ctx.frequencies |= ctx.terms.frequencies(list(ctx.frequencies))
    ctx.postings, ctx.lengths = {k: v for k, v in ctx.postings.items() if v in ctx.joined}, {k: v for k, v in ctx.lengths.items() if v in ctx.joined}
    out = build(ctx, query)
    if not scores:
        ctx.lengths = {k: v for k, v in ctx.lengths.items() if v in ctx.joined}
    return out
