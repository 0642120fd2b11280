"""Facets: metrics and buckets, nested to any depth, over the documents that a query matches.

Every bucket node of the request is one grouped aggregate: the keys of its
ancestors and its own are the grouping columns, its metrics sit in the same
pass.  Metrics and filters of one level share a scan.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import IllegalArgument, Parsing, Unsupported
from quarry.operators.mapping import Field, Mapping, column

METRICS = ("min", "max", "sum", "avg", "value_count", "stats")
BUCKETS = {
    "terms": ("field", "size", "shard_size", "min_doc_count", "order"),
    "range": ("field", "ranges", "keyed"),
    "histogram": ("field", "interval", "offset", "min_doc_count", "hard_bounds", "extended_bounds", "keyed"),
    "date_histogram": ("field", "fixed_interval", "offset", "min_doc_count", "hard_bounds", "extended_bounds", "keyed"),
}
MOST_BUCKETS = 65_535
_ORDERS = {("_count", "desc"), ("_count", "asc"), ("_key", "asc"), ("_key", "desc")}


@dataclass
class Node:
    name: str
    kind: str
    spec: dict
    field: Field | None = None
    children: list[Node] = dataclasses.field(default_factory=list)


def parse(mapping: Mapping, aggs: dict, under: str = "") -> list[Node]:
    """The request's tree, checked: what isn't computed faithfully is refused."""
    out = []
    for name, body in (aggs or {}).items():
        if not isinstance(body, dict):
            raise Parsing(f"aggregation [{name}] must be an object")
        kinds = [k for k in body if k not in ("aggs", "aggregations")]
        if len(kinds) != 1:
            raise Parsing(f"aggregation [{name}] needs exactly one type")
        kind, spec = kinds[0], body[kinds[0]]
        subs = body.get("aggs", body.get("aggregations"))
        if kind == "filter":
            if under not in ("", "filter"):
                raise Unsupported(f"[filter] aggregation [{name}] under buckets is not supported")
            out.append(Node(name, kind, spec, None, parse(mapping, subs or {}, "filter")))
            continue
        if kind not in METRICS and kind not in BUCKETS:
            raise Unsupported(f"aggregation type [{kind}] is not supported")
        allowed = ("field", "missing") if kind in METRICS else BUCKETS[kind]
        for key in spec:
            if key not in allowed:
                raise Unsupported(f"[{kind}] aggregation [{name}] does not support [{key}]")
        f = mapping.get(spec.get("field", ""))
        if f is None:
            raise IllegalArgument(f"aggregation [{name}] is on the unmapped field [{spec.get('field')}]")
        if f.type == "text":
            raise IllegalArgument(f"Fielddata is disabled on [{spec['field']}]: text fields can't be aggregated")
        if kind in METRICS and kind != "value_count" and not (f.numeric or f.type == "date"):
            raise IllegalArgument(f"Field [{spec['field']}] of type [{f.type}] is not supported for aggregation [{kind}]")
        if kind in ("range", "histogram") and not f.numeric:
            raise IllegalArgument(f"Field [{spec['field']}] of type [{f.type}] is not supported for aggregation [{kind}]")
        if kind == "date_histogram" and f.type != "date":
            raise IllegalArgument(f"Field [{spec['field']}] of type [{f.type}] is not supported for aggregation [{kind}]")
        if kind in METRICS and subs:
            raise IllegalArgument(f"Aggregator [{name}] of type [{kind}] cannot accept sub-aggregations")
        if kind == "terms":
            _terms_order(spec)
            if spec.get("size", 10) <= 0:
                raise IllegalArgument("[size] must be greater than 0")
        out.append(Node(name, kind, spec, f, parse(mapping, subs or {}, kind)))
    return out


def _terms_order(spec: dict) -> list[tuple[str, str]]:
    given = spec.get("order", {"_count": "desc"})
    pairs = [next(iter(o.items())) for o in (given if isinstance(given, list) else [given])]
    for by, way in pairs:
        if (by, way) not in _ORDERS:
            raise Unsupported(f"[terms] order [{by} {way}] is not supported")
    return pairs


def _number(c: Column, f: Field) -> Column:
    """Values as numbers; dates as milliseconds."""
    return F.unix_millis(c.cast("timestamp")) if f.type == "date" else c


def _values(n: Node) -> tuple[Column, bool]:
    f, path = n.field, n.spec["field"]
    c = column(path, f)
    missing = n.spec.get("missing")
    if f.array:
        values = F.filter(F.transform(c, lambda x: _number(x, f)), lambda x: x.isNotNull())
        if missing is not None:
            default = F.array(F.lit(f.read(missing)))
            values = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(default)
        return values, True
    c = _number(c, f)
    return (F.coalesce(c, F.lit(f.read(missing))) if missing is not None else c), False


def metric(n: Node) -> dict[str, Column]:
    """Aggregates of a metric node by their column names; several values of a document are folded before the group's."""
    return _metric_over(n, *_values(n))


_INTERVAL = re.compile(r"(\d+)(ms|s|m|h|d)")
_UNIT = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def interval_ms(text: str, name: str = "fixed_interval") -> int:
    sign = -1 if isinstance(text, str) and text.startswith("-") else 1
    m = _INTERVAL.fullmatch(text.lstrip("+-")) if isinstance(text, str) else None
    if not m or int(m[1]) == 0 and name == "fixed_interval":
        raise IllegalArgument(f"[{name}] can't read [{text}]")
    return sign * int(m[1]) * _UNIT[m[2]]


def _width(n: Node) -> tuple[float, float]:
    if n.kind == "date_histogram":
        if "fixed_interval" not in n.spec:
            raise IllegalArgument("[date_histogram] needs [fixed_interval]")
        return interval_ms(n.spec["fixed_interval"]), interval_ms(n.spec["offset"], "offset") if n.spec.get("offset") else 0
    width = n.spec.get("interval")
    if not isinstance(width, (int, float)) or width <= 0:
        raise IllegalArgument("[interval] must be > 0")
    return float(width), float(n.spec.get("offset", 0))


def _bounds(n: Node, name: str) -> tuple[float | None, float | None]:
    given = n.spec.get(name) or {}
    read = (lambda v: None if v is None else n.field.read(v)) if n.kind == "date_histogram" else (lambda v: v)
    return read(given.get("min")), read(given.get("max"))


def _label(x: float | None) -> str:
    return "*" if x is None else str(float(x))


def _ranges(n: Node) -> list[tuple[str, float | None, float | None]]:
    out = []
    for r in n.spec.get("ranges") or []:
        if set(r) - {"key", "from", "to"}:
            raise Unsupported("[range] aggregation: only key, from and to are supported")
        a, b = r.get("from"), r.get("to")
        out.append((r.get("key") or f"{_label(a)}-{_label(b)}", a, b))
    if not out:
        raise IllegalArgument("[range] aggregation needs [ranges]")
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, r[2] or 0))


def keys_of(n: Node) -> Column:
    """The distinct bucket keys of a document, as an array."""
    f, path = n.field, n.spec["field"]
    c = column(path, f)
    one = c if f.array else F.array(c)
    if n.kind == "terms":
        keys = F.transform(one, lambda x: _number(x, f)) if f.type == "date" else one
    elif n.kind == "range":
        hits = [F.when(F.exists(one, functools.partial(_inside, a, b)), F.lit(k)) for k, a, b in _ranges(n)]
        keys = F.array(*hits)
    else:
        width, offset = _width(n)
        if n.kind == "date_histogram":
            keys = F.transform(one, lambda x: (F.floor((_number(x, f) - offset) / F.lit(width)) * width + offset).cast("bigint"))
        else:
            keys = F.transform(one, lambda x: (F.floor((x - offset) / F.lit(width)) * F.lit(width) + F.lit(offset)).cast("double"))
        low, high = _bounds(n, "hard_bounds")
        if low is not None:
            keys = F.filter(keys, lambda k: k >= low)
        if high is not None:
            keys = F.filter(keys, lambda k: k <= high)
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def _inside(a, b, x: Column) -> Column:
    test = F.lit(True)
    if a is not None:
        test = test & (x >= F.lit(float(a)))
    if b is not None:
        test = test & (x < F.lit(float(b)))
    return test


@dataclass
class Table:
    """Buckets of one node: key columns of its ancestors and its own (`<name>`), doc_count, and the metrics below it."""

    path: tuple[str, ...]
    df: DataFrame
    node: Node | None
    totals: DataFrame | None = None  # per parent, documents of all terms buckets, kept or not


def tables(df: DataFrame, nodes: list[Node], matches: Callable[[dict], Column] | None = None) -> list[Table]:
    """The tables of a tree over matching documents; the first is the top level's one row of metrics and filter counts."""
    out: list[Table] = []
    top = {}
    for n in nodes:
        if n.kind in METRICS:
            top |= metric(n)
    filters = [n for n in nodes if n.kind == "filter"]
    flags = {}
    for n in filters:
        assert matches is not None
        match = matches(n.spec)
        flags[n.name] = match
        top[f"{n.name}_doc_count"] = F.count_if(F.coalesce(match, F.lit(False))).cast("bigint")
        for sub in n.children:  # metrics of a filter share the pass
            if sub.kind in METRICS:
                c, many = _values(sub)
                kept = F.when(match, c)
                top |= {f"{n.name}_{k}": v for k, v in _metric_over(sub, kept, many).items()}
    if top:
        out.append(Table((), df.agg(*[c.alias(k) for k, c in top.items()]), None))
    for n in nodes:
        if n.kind in BUCKETS:
            out += _buckets(df, n, [], ())
    for n in filters:
        rest = [s for s in n.children if s.kind not in METRICS]
        if rest:
            for t in tables(df.where(flags[n.name]), rest, matches):
                out.append(Table((n.name, *t.path), t.df, t.node, t.totals))
    return out


def _metric_over(n: Node, c: Column, many: bool) -> dict[str, Column]:
    """Aggregates of a metric node over a column, of arrays if `many`."""
    count = F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))) if many else F.count(c), F.lit(0)).cast("bigint")
    own = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) if many else c.cast("double")
    low, high = (F.array_min(c), F.array_max(c)) if many else (c, c)
    parts = {"min": F.min(low).cast("double"), "max": F.max(high).cast("double"), "sum": F.coalesce(F.sum(own), F.lit(0.0)), "avg": F.try_divide(F.sum(own), count)}
    if n.kind == "value_count":
        return {n.name: count}
    if n.kind == "stats":
        return {f"{n.name}_count": count, **{f"{n.name}_{k}": v for k, v in parts.items()}}
    return {n.name: parts[n.kind]}


def _buckets(df: DataFrame, n: Node, parents: list[str], path: tuple[str, ...]) -> list[Table]:
    key = f"{n.name}_key" if n.name in df.columns or n.name in parents else n.name
    single = not n.field.array and n.kind != "range"
    exploded = df.withColumn(key, F.get(keys_of(n), F.lit(0))).where(F.col(key).isNotNull()) if single else df.withColumn(key, F.explode(keys_of(n)))
    measures = {}
    for sub in n.children:
        if sub.kind in METRICS:
            measures |= metric(sub)
    grouped = exploded.groupBy(*parents, key).agg(F.count("*").alias("doc_count"), *[c.alias(k) for k, c in measures.items()])
    totals = None
    if n.kind == "terms":
        least = n.spec.get("min_doc_count", 1)
        totals = grouped.groupBy(*parents).agg(F.sum("doc_count").alias("all_docs"))
        order = []
        for by, way in _terms_order(n.spec):
            c = F.col("doc_count" if by == "_count" else key)
            order.append(c.desc() if way == "desc" else c.asc())
        order.append(F.col(key).asc())
        kept = grouped.where(F.col("doc_count") >= least)
        size = min(n.spec.get("size", 10), 2**31 - 1)
        if parents:
            w = Window.partitionBy(*parents).orderBy(*order)
            kept = kept.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= size).drop("__rank")
        else:
            kept = kept.orderBy(*order).limit(size)
    elif n.kind == "range":
        names = [(k,) for k, _, _ in _ranges(n)]
        kept = _filled(grouped, df, parents, key, df.sparkSession.createDataFrame(names, f"`{key}` string"), measures)
    else:
        kept = grouped
        least = n.spec.get("min_doc_count", 0)
        if least == 0:
            kept = _filled(grouped, df, parents, key, None, measures, n)
        elif least > 1:
            kept = grouped.where(F.col("doc_count") >= least)
    out = [Table((*path, n.name), kept, n, totals)]
    deeper = [s for s in n.children if s.kind in BUCKETS]
    if deeper:
        alive = exploded
        if n.kind == "terms":  # below, only documents of buckets that were kept
            cols = [*parents, key]
            right = kept.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cols)])
            alive = exploded.join(right, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(cols)]), "left_semi")
        for s in deeper:
            out += _buckets(alive, s, [*parents, key], (*path, n.name))
    return out


def _filled(grouped: DataFrame, df: DataFrame, parents: list[str], key: str, names: DataFrame | None, measures: dict, n: Node | None = None) -> DataFrame:
    """With the empty buckets: the given keys, or all steps between the first bucket and the last, of each parent."""
    if names is None:
        width, offset = _width(n)
        low, high = _bounds(n, "extended_bounds")
        if low is None and high is None and not parents:
            span = grouped.agg(F.min(key).alias("a"), F.max(key).alias("b"))
        else:
            first, last = F.min(key), F.max(key)
            if low is not None:
                first = F.least(first, F.lit((low - offset) // width * width + offset))
            if high is not None:
                last = F.greatest(last, F.lit((high - offset) // width * width + offset))
            span = (grouped.groupBy(*parents) if parents else grouped).agg(first.alias("a"), last.alias("b"))
        steps = F.sequence(F.lit(0), F.round((F.col("b") - F.col("a")) / width).cast("int"))
        kind = dict(grouped.dtypes)[key]
        axis = span.where("a IS NOT NULL").select(*parents, F.explode(F.transform(steps, lambda i: (F.col("a") + i.cast("bigint") * F.lit(width)).cast(kind))).alias(key))
    else:
        axis = names if not parents else grouped.select(*parents).distinct().crossJoin(names)
    joined = axis.join(grouped, [*parents, key], "left")
    zero = {"doc_count"} | {m for m in measures if m.endswith("_count") or m in measures and dict(grouped.dtypes)[m] == "bigint"}
    cols = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in zero else F.col(c) for c in ["doc_count", *measures]]
    return joined.select(*parents, key, *cols)


# -- answers as nested objects -------------------------------------------------------------


def _plain(v):
    return float(v) if isinstance(v, Decimal) else v


def _metric_answer(n: Node, row: dict, prefix: str = "") -> dict:
    def one(v, name="value"):
        out = {name: _plain(v)}
        if n.field.type == "date" and n.kind != "value_count" and v is not None:
            out[f"{name}_as_string"] = n.field.dates.write(int(v))
        return out

    if n.kind == "stats":
        out = {"count": row[f"{prefix}{n.name}_count"]}
        for k in ("min", "max", "avg", "sum"):
            out |= one(row[f"{prefix}{n.name}_{k}"], k)
        return out
    return one(row[f"{prefix}{n.name}"])


def response(found: list[Table], nodes: list[Node], under: tuple[str, ...] = ()) -> dict:
    """Tables as the nested answer; one with more than MOST_BUCKETS rows is refused, not cut."""
    by_path = {t.path: (t, [r.asDict() for r in t.df.limit(MOST_BUCKETS + 1).collect()]) for t in found}
    for path, (_, rows) in by_path.items():
        if len(rows) > MOST_BUCKETS:
            raise IllegalArgument(f"[{'.'.join(path)}] has more than {MOST_BUCKETS} buckets")
    totals = {t.path: [r.asDict() for r in t.totals.collect()] for t in found if t.totals is not None}

    def buckets(n: Node, path: tuple[str, ...], parents: dict) -> dict:
        t, rows = by_path[path]
        key = f"{n.name}_key" if n.name not in (t.df.columns) else n.name
        own = [r for r in rows if all(r[k] == v for k, v in parents.items())]
        if n.kind == "terms":
            for by, way in reversed([*_terms_order(n.spec), ("_key", "asc")]):
                own.sort(key=lambda r: r["doc_count" if by == "_count" else key], reverse=way == "desc")
        elif n.kind == "range":
            names = [k for k, _, _ in _ranges(n)]
            own.sort(key=lambda r: names.index(r[key]))
        else:
            own.sort(key=lambda r: r[key])
        out = []
        for r in own:
            b: dict = {"key": r[key], "doc_count": r["doc_count"]}
            if n.field.type == "date" and n.kind in ("terms", "date_histogram"):
                b["key_as_string"] = n.field.dates.write(int(r[key]))
            if n.field.type == "boolean" and n.kind == "terms":
                b |= {"key": int(r[key]), "key_as_string": str(r[key]).lower()}
            if n.kind == "range":
                _, low, high = next(x for x in _ranges(n) if x[0] == r[key])
                b |= {k: float(v) for k, v in (("from", low), ("to", high)) if v is not None}
            for sub in n.children:
                b[sub.name] = _metric_answer(sub, r) if sub.kind in METRICS else buckets(sub, (*path, sub.name), {**parents, key: r[key]})
            out.append(b)
        answer: dict = {"buckets": out}
        if n.spec.get("keyed"):
            answer = {"buckets": {str(b.get("key_as_string", b["key"])): b for b in out}}
        if n.kind == "terms":
            whole = sum(r["all_docs"] or 0 for r in totals[path] if all(r[k] == v for k, v in parents.items()))
            answer = {"doc_count_error_upper_bound": 0, "sum_other_doc_count": whole - sum(b["doc_count"] for b in out), **answer}
        return answer

    top = by_path.get(under, (None, [{}]))[1][0]
    out = {}
    for n in nodes:
        if n.kind in METRICS:
            out[n.name] = _metric_answer(n, top)
        elif n.kind == "filter":
            answer = {"doc_count": top[f"{n.name}_doc_count"]}
            answer |= {s.name: _metric_answer(s, top, f"{n.name}_") for s in n.children if s.kind in METRICS}
            rest = [s for s in n.children if s.kind not in METRICS]
            if rest:
                answer |= response([Table(t.path[1:], t.df, t.node, t.totals) for t in found if t.path[:1] == (n.name,)], rest)
            out[n.name] = answer
        else:
            out[n.name] = buckets(n, (*under, n.name), {})
    return out
