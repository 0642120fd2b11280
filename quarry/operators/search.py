"""Searches: a query over one or several indices, sorted, paged and projected, with facets."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import IllegalArgument, Parsing, QueryShard, ScrollMissing, SearchError, Unsupported
from quarry.functions.patterns import glob
from quarry.operators import aggs as facets
from quarry.operators.mapping import Mapping, column, of_schema
from quarry.plans.compiler import Context, Scored, compiled
from quarry.sources.tables import saved
from quarry.sources.terms import ROW, Terms, build, reopened

WINDOW = 10_000
_BODY = ("query", "from", "size", "sort", "_source", "aggs", "aggregations", "track_total_hits")


@dataclass
class Index:
    """A named table with its mapping. `_id` names a document, `_seq_no` (or the columns of `tie`) orders equals."""

    name: str
    df: DataFrame
    mapping: Mapping
    tie: tuple[str, ...] = ("_seq_no",)
    hidden: tuple[str, ...] = ("_seq_no",)
    terms: Terms | None = None

    def analysed(self, path: str, spread: bool = True) -> Index:
        """The index with its texts analysed once: its rows, numbered, and the term tables are written below `path`.

        Without `spread` the rows are taken to be dealt to tasks already; to ask would run the shuffles that they come from.
        """
        ctx = Context(self.mapping, self.df, 0)
        texts = [p for p, f in self.mapping.fields.items() if f.type == "text" and not self.mapping.nested_root(p)]
        for p in texts:
            ctx.tokens(p, self.mapping.fields[p])
        least = self.df.sparkSession.sparkContext.defaultParallelism
        df = self.df if not spread or self.df.rdd.getNumPartitions() >= least else self.df.repartition(least)  # few large files: analysis is the work
        df = saved(df.withColumn(ROW, F.monotonically_increasing_id()), f"{path}/rows")
        return replace(self, df=df, hidden=(*self.hidden, ROW), terms=build(df, {p: ctx.token_columns[p][1] for p in texts}, f"{path}/terms"))

    def reopened(self, path: str) -> Index:
        """The index as `analysed` has written it below `path`."""
        spark = self.df.sparkSession
        df = spark.read.schema(T.StructType([*self.df.schema.fields, T.StructField(ROW, T.LongType())])).parquet(f"{path}/rows")
        texts = any(f.type == "text" and not self.mapping.nested_root(p) for p, f in self.mapping.fields.items())
        return replace(self, df=df, hidden=(*self.hidden, ROW), terms=reopened(spark, f"{path}/terms") if texts else None)

    @staticmethod
    def of_table(name: str, df: DataFrame, key: str | Sequence[str], **declared: dict) -> Index:
        """A table as an index: `key` columns make the `_id`; `declared` overrides the mapping of columns."""
        keys = (key,) if isinstance(key, str) else tuple(key)
        mapping = of_schema(df.schema, **declared)
        whole = df.withColumn("_id", F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
        return Index(name, whole, mapping, keys, ())


@dataclass
class Sort:
    path: str
    descending: bool


def parse_sort(given) -> list[Sort]:
    """`f`, `f:desc,g`, `{f: desc}`, `{f: {order: desc}}`, or a list of them."""
    if given is None:
        return []
    items: list = []
    for g in given if isinstance(given, list) else [given]:
        items += g.split(",") if isinstance(g, str) and (":" in g or "," in g) else [g]
    out = []
    for item in items:
        if isinstance(item, str):
            path, _, way = item.partition(":")
        elif isinstance(item, dict) and len(item) == 1:
            path, way = next(iter(item.items()))
            if isinstance(way, dict):
                if set(way) - {"order"}:
                    raise Unsupported(f"[sort] on [{path}] supports [order] only")
                way = way.get("order", "")
        else:
            raise Parsing(f"[sort] can't read [{item}]")
        way = (way or ("desc" if path == "_score" else "asc")).lower()
        if way not in ("asc", "desc"):
            raise IllegalArgument(f"[sort] order must be asc or desc, not [{way}]")
        out.append(Sort(path, way == "desc"))
    return out


def page_of(body: dict) -> tuple[int, int]:
    start, size = body.get("from", 0), body.get("size", 10)
    for name, v in (("from", start), ("size", size)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise IllegalArgument(f"[{name}] must be a non-negative integer, not [{v}]")
    if start + size > WINDOW:
        raise IllegalArgument(f"Result window is too large, from + size must be less than or equal to: [{WINDOW}] but was [{start + size}]")
    return start, size


def projected(schema: T.StructType, given) -> list[Column] | None:
    """Columns that `_source` keeps: globs over dotted paths, a parent keeps what is below, excludes win; None for all."""
    if given is None or given is True:
        return None
    if given is False:
        return []
    if isinstance(given, dict):
        if set(given) - {"includes", "excludes", "include", "exclude"}:
            raise Parsing("[_source] takes includes and excludes")
        includes, excludes = (given.get(k + "s", given.get(k)) or [] for k in ("include", "exclude"))
    else:
        includes, excludes = given, []
    includes, excludes = ([x] if isinstance(x, str) else list(x) for x in (includes, excludes))

    def hit(patterns: list[str], path: str) -> bool:
        parts = path.split(".")
        return any(glob(p, ".".join(parts[: k + 1])) for p in patterns for k in range(len(parts)))

    def keep(kind: T.DataType, c: Column, path: str) -> Column | None:
        if hit(excludes, path):
            return None
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType):
            return c if not includes or hit(includes, path) else None

        def pruned(value: Column) -> Column | None:
            parts = [(f.name, keep(f.dataType, value.getField(f.name), f"{path}.{f.name}")) for f in inner.fields]
            left = [p.alias(name) for name, p in parts if p is not None]
            return F.when(value.isNotNull(), F.struct(*left)) if left else None

        if not isinstance(kind, T.ArrayType):
            return pruned(c)
        if pruned(F.lit(None).cast(inner)) is None:
            return None
        return F.transform(c, pruned)

    out = []
    for f in schema.fields:
        c = keep(f.dataType, F.col(f"`{f.name}`"), f.name)
        if c is not None:
            out.append(c.alias(f.name))
    return out


@dataclass
class Found:
    """What a search found; every member is lazy until it is asked for."""

    hits: DataFrame
    matching: list[tuple[Index, DataFrame]]
    nodes: list[facets.Node]
    tables: list[facets.Table]
    sorted_by: list[Sort]
    failures: list[tuple[str, str]] = field(default_factory=list)
    scored: DataFrame | None = None
    everything: DataFrame | None = None  # all hits, with the columns of a page and those of the order
    order: list[Column] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)

    def all_hits(self) -> DataFrame:
        """All hits with the columns of a page, in no order."""
        return self.everything.select(*self.columns)

    def in_order(self) -> DataFrame:
        """All hits with their places from 1 in a column `__row`, beyond any window."""
        return numbered(self.everything, self.order).select("__row", *self.columns)

    def total(self) -> int:
        return sum(df.count() for _, df in self.matching)

    def max_score(self) -> float | None:
        if self.scored is None or self.sorted_by:
            return None
        return self.scored.agg(F.round(F.max("_score"), 7)).first()[0]

    def table(self, *path: str) -> DataFrame:
        """Buckets of the facet at a path; without one, the top level's metrics and filter counts."""
        return next(t.df for t in self.tables if t.path == path)

    def response(self) -> dict:
        """The answer as one object, for pages and facets of the size that was asked for."""
        out: dict = {"hits": {"total": {"value": self.total(), "relation": "eq"}, "max_score": self.max_score(), "hits": []}}
        meta = ("_index", "_id", "_score", "sort")
        for r in self.hits.collect():
            d = r.asDict(recursive=True)
            out["hits"]["hits"].append({k: d[k] for k in meta if k in d} | {"_source": {k: v for k, v in d.items() if k not in meta and v is not None}})
        if self.nodes:
            out["aggregations"] = facets.response(self.tables, self.nodes)
        if self.failures:
            out["_shards"] = {"failed": len(self.failures), "failures": [{"index": i, "reason": r} for i, r in self.failures]}
        return out


def _sort_column(index: Index, s: Sort) -> Column:
    if s.path == "_score":
        return F.col("_score")
    if s.path == "_doc":
        return F.lit(0)
    f = index.mapping.get(s.path)
    if f is None:
        raise QueryShard(f"No mapping found for [{s.path}] in order to sort on")
    if f.type == "text":
        raise IllegalArgument(f"Fielddata is disabled on [{s.path}]: text fields can't be sorted by")
    c = column(s.path, f)
    return F.get(F.filter(c, lambda x: x.isNotNull()), F.lit(0)) if f.array else c


def search(indices: Index | Sequence[Index], body: dict | None = None, now: int | None = None, allow_unmapped: bool = True) -> Found:
    """Hits of `body` over the indices: `_index`, `_id`, `_score`, the kept columns; facets over all that match.

    Scores are each index's own.  An index on which the request fails is left out
    and reported; if all fail, so does the search.  Without a sort, hits come by
    falling score; equals come by index name and order of entry.
    """
    body = dict(body or {})
    for key in body:
        if key not in _BODY:
            raise Unsupported(f"[_search] does not support [{key}]")
    if body.get("track_total_hits", True) is not True:
        raise Unsupported("[track_total_hits] other than true is not supported: totals are exact")
    indices = sorted([indices] if isinstance(indices, Index) else indices, key=lambda i: i.name)
    now = int(time.time() * 1000) if now is None else now
    start, size = page_of(body)
    sorts = parse_sort(body.get("sort"))
    query = body.get("query") or {"match_all": {}}
    need_score = (not sorts or any(s.path == "_score" for s in sorts)) and size > 0
    asked = body.get("aggs", body.get("aggregations")) or {}
    matching, pages, failures, trees, facet_inputs, error = [], [], [], None, [], None
    mapped = frozenset(p for i in indices for p in i.mapping.fields)
    for index in indices:
        try:
            ctx = Context(index.mapping, index.df, now, allow_unmapped, mapped - index.mapping.fields.keys(), terms=index.terms)
            found: Scored = compiled(ctx, query, need_score)
            nodes = facets.parse(index.mapping, asked)
            keys = [_sort_column(index, s) for s in sorts]
        except SearchError as e:
            failures.append((index.name, str(e)))
            error = e
            continue
        match = ctx.prepared().where(found.match)
        internal = ctx.internal()
        matching.append((index, match.drop(*internal)))
        scored = match.withColumn("_score", found.score.cast("double") if need_score else F.lit(None).cast("double"))
        scored = scored.withColumn("_index", F.lit(index.name)).drop(*internal)
        for k, c in enumerate(keys):
            scored = scored.withColumn(f"__sort{k}", c)
        ties = [F.col(t) for t in index.tie]
        pages.append(scored.withColumn("__tie", F.struct(*ties) if len(indices) == 1 else F.to_json(F.struct(*ties)) if len(index.tie) > 1 else F.col(index.tie[0]).cast("bigint")))
        trees = nodes
        facet_inputs.append((index, match, ctx))
    if error is not None and not pages:
        raise error
    hits = pages[0] if pages else None
    for p in pages[1:]:
        hits = hits.unionByName(p, allowMissingColumns=True)
    if hits is None:
        raise IllegalArgument("no index to search")
    order = [F.col(f"__sort{k}").desc_nulls_last() if s.descending else F.col(f"__sort{k}").asc_nulls_last() for k, s in enumerate(sorts)] or [F.col("_score").desc()]
    order += [F.col("_index"), F.col("__tie")] if len(pages) > 1 else [F.col("__tie")]
    page = hits.orderBy(*order).offset(start).limit(size) if start else hits.orderBy(*order).limit(size)
    skip = {"_index", "_id", "_score", "__tie", *(f"__sort{k}" for k in range(len(sorts))), *(h for i in indices for h in i.hidden), "_seq_no", "_version"}
    source = T.StructType([f for f in hits.schema.fields if f.name not in skip])
    kept = projected(source, body.get("_source"))
    kept = [F.col(f"`{f.name}`") for f in source.fields] if kept is None else kept
    sort_values = [F.array(*[F.col(f"__sort{k}").cast("string") for k in range(len(sorts))]).alias("sort")] if sorts else []
    shown = F.round("_score", 7).alias("_score")  # the order is by the whole score
    columns = [F.col("_index"), F.col("_id"), shown, *sort_values, *kept]
    return Found(page.select(*columns), matching, trees or [], _facet_tables(facet_inputs, trees or []), sorts, failures, hits if need_score else None, hits, order, columns)


def _facet_tables(inputs: list[tuple[Index, DataFrame, Context]], nodes: list[facets.Node]) -> list[facets.Table]:
    """Facets over the union of what matches in all indices: partial states merge once, as in any grouped aggregate."""
    if not nodes:
        return []
    parts, flags = [], {}

    def note(ns: list[facets.Node]) -> None:
        for n in ns:
            if n.kind == "filter":
                flags.setdefault(str(n.spec), (f"__filter{len(flags)}", n.spec))
                note(n.children)

    note(nodes)
    for _, match, ctx in inputs:
        own = ctx.again(match)
        own.token_columns = dict(ctx.token_columns)
        made = {name: compiled(own, spec, scores=False).match for name, spec in flags.values()}
        ready = match
        for path, (name, expr) in own.token_columns.items():
            if path not in ctx.token_columns:
                ready = ready.withColumn(name, expr)
        own.df, own.token_columns = ready, {}
        ready = own.prepared()
        for name, c in made.items():
            ready = ready.withColumn(name, F.coalesce(c, F.lit(False)))
        parts.append(ready.drop(*[c for c in ready.columns if c.startswith(("__tokens", "__related", "__at_", "__length_"))]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return facets.tables(whole, nodes, lambda spec: F.col(flags[str(spec)][0]))


def count(indices: Index | Sequence[Index], body: dict | None = None, **how) -> int:
    for key in body or {}:
        if key != "query":
            raise Unsupported(f"[_count] does not support [{key}]")
    return search(indices, {**(body or {}), "size": 0}, **how).total()


# -- scrolls ----------------------------------------------------------------------------------

_DURATION = re.compile(r"(\d+)(d|h|m|s|ms|micros|nanos)")
_SECONDS = {"d": 86_400, "h": 3600, "m": 60, "s": 1, "ms": 1e-3, "micros": 1e-6, "nanos": 1e-9}
MOST_SCROLLS, LONGEST = 500, 86_400


def duration(text: str) -> float:
    """Seconds of `1m`, `30s` and the like."""
    if text in ("0", "-1"):
        return float(text)
    m = _DURATION.fullmatch(text) if isinstance(text, str) else None
    if not m:
        raise IllegalArgument(f"failed to parse setting [{text}] as a time value: unit is missing or unrecognized")
    return int(m[1]) * _SECONDS[m[2]]


@dataclass
class _Scroll:
    df: DataFrame
    size: int
    at: int
    ends: float


class Scrolls:
    """Frozen exports: all hits in order are written once, numbered, and read page by page."""

    def __init__(self, folder: str, clock=time.time):
        self.folder, self.clock = folder, clock
        self.open: dict[str, _Scroll] = {}

    def start(self, indices: Index | Sequence[Index], body: dict, keep: str) -> tuple[str, DataFrame, Found]:
        body = dict(body)
        if "from" in body:
            raise IllegalArgument("using [from] is not allowed in a scroll context")
        size = body.get("size", 10)
        if size == 0:
            raise IllegalArgument("[size] cannot be [0] in a scroll context")
        self._expire()
        if len(self.open) >= MOST_SCROLLS:
            raise IllegalArgument(f"Trying to create too many scroll contexts. Must be less than or equal to: [{MOST_SCROLLS}].")
        ends = self._until(keep)
        found = search(indices, {**body, "size": min(size, WINDOW)})
        ordered = found.in_order()
        scroll_id = uuid.uuid4().hex
        path = f"{self.folder}/scroll-{scroll_id}"
        ordered.write.parquet(path)
        df = ordered.sparkSession.read.schema(ordered.schema).parquet(path)
        self.open[scroll_id] = _Scroll(df, size, size, ends)
        return scroll_id, self._page(df, 0, size), found

    def _until(self, keep: str) -> float:
        seconds = duration(keep)
        if seconds > LONGEST:
            raise IllegalArgument(f"Keep alive for request ({keep}) is too large. It must be less than (1d).")
        return self.clock() + seconds

    def _expire(self) -> None:
        self.open = {k: s for k, s in self.open.items() if s.ends > self.clock()}

    @staticmethod
    def _page(df: DataFrame, start: int, size: int) -> DataFrame:
        return df.where((F.col("__row") > start) & (F.col("__row") <= start + size)).orderBy("__row").drop("__row")

    def next(self, scroll_id: str, keep: str | None = None) -> DataFrame:
        self._expire()
        s = self.open.get(scroll_id)
        if s is None:
            raise ScrollMissing(f"No search context found for id [{scroll_id}]")
        page = self._page(s.df, s.at, s.size)
        s.at += s.size
        if keep:
            s.ends = self._until(keep)
        return page

    def rest(self, scroll_id: str, keep: str | None = None) -> DataFrame:
        """All pages that `next` would still give, as one table: each row with its page, counted from the export's first as 0, in `__page`.

        However many pages are left, they are one scan; the export is at its end afterwards.
        """
        self.next(scroll_id, keep)
        s = self.open[scroll_id]
        start = s.at - s.size
        s.at = max(s.at, s.df.agg(F.max("__row")).first()[0] or 0)
        return s.df.where(F.col("__row") > start).withColumn("__page", F.expr(f"(__row - 1) div {s.size}")).drop("__row")

    def clear(self, scroll_id: str) -> bool:
        return self.open.pop(scroll_id, None) is not None


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in a total order, without putting them all through one task.

    Sorted ranges are counted, and each row's place is its range's start plus its
    place within it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id())
    ranged = ranged.checkpoint()
    sizes = ranged.groupBy("__part").count().collect()  # a row per partition
    before, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r[0]):
        starts[r[0]] = before
        before += r[1]
    if not starts:
        return ranged.withColumn("__row", F.lit(0).cast("bigint")).drop("__part", "__in")
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "__part int, __before bigint")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__in"))
    return ranged.join(offsets, "__part").withColumn("__row", F.col("__before") + inside).drop("__part", "__in", "__before")
