"""JSON documents: actions applied in order, typed columns made from a mapping, and the NDJSON bulk format."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.errors import DocumentParsing, IllegalArgument, MapperParsing, Parsing, SearchError, Unsupported, VersionConflict
from quarry.functions.dates import from_millis
from quarry.operators.mapping import FLOATS, INTEGERS, SPARK, Field, Mapping, grown, leaves

OPS = ("index", "create", "update", "delete")
LOG = "_id string, _seq_no bigint, _version bigint, _deleted boolean, _source string"
ACTIONS = "position bigint, op string, index string, id string, body string"


@dataclass
class State:
    """What is known of one `_id`: its newest version, or that it never was."""

    version: int = 0
    seq_no: int = -1
    source: dict | None = None  # None: deleted or never written

    @property
    def live(self) -> bool:
        return self.source is not None


def deep_merge(old: dict, new: dict) -> dict:
    """Objects are merged, everything else is replaced; what stays as it was is shared with the old and the new one."""
    out = dict(old)
    for k, v in new.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def checked(mapping: Mapping, doc) -> Mapping:
    """The mapping with what the document adds; raises if the document doesn't fit."""
    if not isinstance(doc, dict):
        raise MapperParsing("a document must be a JSON object")
    mapping = grown(mapping, doc)
    typed(mapping, doc)
    return mapping


def plain(mapping: Mapping) -> Callable[[dict], dict | None]:
    """What `typed` gives of a document that `grown` adds nothing for, found at once; None if it isn't as plain as that.

    Plain are single values of mapped fields that have their JSON type already.
    """
    tree: dict = {}
    for path, f in mapping.fields.items():
        if not f.array and not mapping.nested_root(path) and not (mapping.join and path.split(".")[0] == mapping.join.name):
            kind = "text" if f.type in ("text", "keyword") else "float" if f.type in FLOATS else INTEGERS.get(f.type, f.type)
            _put(tree, path, kind)

    def read(doc: dict, node: dict) -> dict | None:
        out = {}
        for name, v in doc.items():
            kind = node.get(name)
            if kind is None:
                return None
            if v is None and type(kind) is not dict:
                continue
            t = type(v)
            if t is str:
                if kind != "text":
                    return None
            elif t is float or t is int:
                if kind == "float":
                    if t is int:
                        if not -(2**63) <= v < 2**63:
                            return None
                        v = float(v)
                elif t is float or type(kind) is not int or not -(1 << kind - 1) <= v < 1 << kind - 1:
                    return None
            elif t is bool:
                if kind != "boolean":
                    return None
            elif t is dict and type(kind) is dict:
                v = read(v, kind)
                if v is None:
                    return None
                if not v:
                    continue
            else:
                return None
            out[name] = v
        return out

    return lambda doc: read(doc, tree) if type(doc) is dict else None


def apply(state: State, op: str, body: dict | None, mapping: Mapping, seq_no: int, if_seq_no: int | None = None, if_primary_term: int | None = None, known: Callable[[dict], dict | None] | None = None) -> tuple[State, str, Mapping]:
    """The state after one action, its result (created, updated, deleted, not_found, noop), and the mapping as grown.

    With `known`, a mapping's `plain`, documents that it reads aren't checked
    further, and the body becomes part of the state as it is.
    """
    if (if_seq_no is None) != (if_primary_term is None):
        raise IllegalArgument("if_seq_no and if_primary_term go together")
    if if_seq_no is not None and (not state.live or state.seq_no != if_seq_no or if_primary_term != 1):
        raise VersionConflict(f"version conflict, required seqNo [{if_seq_no}], current document has seqNo [{state.seq_no}]")
    if op == "delete":
        if not state.live and state.version == 0:
            return State(1, seq_no, None), "not_found", mapping
        return State(state.version + 1, seq_no, None), "deleted" if state.live else "not_found", mapping
    if op == "create" and state.live:
        raise VersionConflict(f"version conflict, document already exists (current version [{state.version}])")
    source = body
    if op == "update":
        body = body or {}
        for key in body:
            if key == "script":
                raise Unsupported("scripts are not supported")
            if key not in ("doc", "upsert", "doc_as_upsert", "detect_noop"):
                raise Unsupported(f"[update] does not support [{key}]")
        if state.live:
            if not isinstance(body.get("doc"), dict):
                raise IllegalArgument("[update] needs [doc]")
            source = deep_merge(state.source, body["doc"])
            if source == state.source:
                return state, "noop", mapping
        else:
            source = body.get("upsert") or (body.get("doc") if body.get("doc_as_upsert") else None)
            if source is None:
                raise DocumentMissing("document missing")
    if known is None or known(source) is None:
        mapping = checked(mapping, source)
    return State(state.version + 1, seq_no, copy.deepcopy(source) if known is None else source), "updated" if state.live else "created", mapping


class DocumentMissing(SearchError):
    kind, status = "document_missing_exception", 404


# -- typed columns -----------------------------------------------------------------------------------


def _value(f: Field, v):
    out = f.read(v)
    return from_millis(out) if f.type == "date" else out


def _put(root: dict, path: str, value) -> None:
    *parents, leaf = path.split(".")
    for p in parents:
        root = root.setdefault(p, {})
    root[leaf] = value


def typed(mapping: Mapping, doc: dict) -> dict:
    """The document's mapped values as nested dicts for `schema_of`; null and [] are absent."""
    out: dict = {}
    join = mapping.join.name if mapping.join else None
    for path, value in leaves(doc, mapping.nested):
        if join and path.split(".")[0] == join:
            _join(mapping, out, doc[join])
            continue
        if path in mapping.nested:
            elements = value if isinstance(value, list) else [value]
            _put(out, path, [_element(mapping, path, e) for e in elements if e is not None])
            continue
        f = mapping.fields.get(path)
        if f is None:
            continue
        try:
            values = [_value(f, v) for v in (value if isinstance(value, list) else [value]) if v is not None]
        except SearchError as e:
            raise DocumentParsing(f"failed to parse field [{path}] of type [{f.type}]: {e}") from None
        if values:
            _put(out, path, values if f.array else values[0])
    return out


def _element(mapping: Mapping, root: str, element) -> dict:
    if not isinstance(element, dict):
        raise DocumentParsing(f"object mapping for [{root}] tried to parse a value as an object")
    inner: dict = {}
    for p, v in leaves(element):
        f = mapping.fields.get(f"{root}.{p}")
        if f and v is not None:
            values = v if isinstance(v, list) else [v]
            try:
                _put(inner, p, _value(f, values[0]) if values else None)
            except SearchError as e:
                raise DocumentParsing(f"failed to parse field [{root}.{p}] of type [{f.type}]: {e}") from None
    return inner


def _join(mapping: Mapping, out: dict, given) -> None:
    name = given if isinstance(given, str) else (given or {}).get("name")
    parent = given.get("parent") if isinstance(given, dict) else None
    children = [c for cs in mapping.join.relations.values() for c in cs]
    if name not in mapping.join.relations and name not in children:
        raise DocumentParsing(f"unknown join name [{name}] for field [{mapping.join.name}]")
    if name in children and parent is None:
        raise DocumentParsing(f"[parent] is missing for join field [{mapping.join.name}]")
    out[mapping.join.name] = name
    if parent is not None:
        out["_join_parent"] = str(parent)


_HEAD = ("_id", "_seq_no", "_version", "_source")


def schema_of(mapping: Mapping) -> T.StructType:
    tree: dict = {}
    for path, f in sorted(mapping.fields.items()):
        kind = SPARK[f.type]
        root = mapping.nested_root(path)
        _put(tree, path, T.ArrayType(kind) if f.array and root is None else kind)

    def build(node, path: str = "") -> T.DataType:
        if not isinstance(node, dict):
            return node
        inner = T.StructType([T.StructField(k, build(v, f"{path}.{k}".lstrip("."))) for k, v in node.items()])
        return T.ArrayType(inner) if path in mapping.nested else inner

    fields = list(build(tree).fields)
    if mapping.join:
        fields += [T.StructField(mapping.join.name, T.StringType()), T.StructField("_join_parent", T.StringType())]
    head = [T.StructField("_id", T.StringType()), T.StructField("_seq_no", T.LongType()), T.StructField("_version", T.LongType()), T.StructField("_source", T.StringType())]
    return T.StructType(head + fields)


def typed_documents(live: DataFrame, mapping: Mapping) -> DataFrame:
    """Live documents of a log as typed columns."""
    schema = schema_of(mapping)
    names = [f.name for f in schema.fields if f.name not in _HEAD]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plain(mapping)
        for b in batches:
            rows = []
            for text in b.column("_source").to_pylist():
                doc = json.loads(text)
                row = known(doc)
                rows.append(typed(mapping, doc) if row is None else row)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in _HEAD], *[pa.array([r.get(n) for r in rows], arrow.field(n).type) for n in names]], names=[*_HEAD, *names])

    return live.select(*_HEAD).mapInArrow(run, schema)


# -- bulk -----------------------------------------------------------------------------------------------


def parse_bulk(text: str, default_index: str | None = None) -> Iterator[tuple[str, str, str, dict | None]]:
    """(op, index, id, body) in order; a faulty line raises after the actions before it have been given."""
    lines = iter(enumerate(text.split("\n"), 1))
    for number, line in lines:
        if not line.strip():
            continue
        try:
            action = json.loads(line)
        except ValueError:
            raise Parsing(f"[_bulk] line {number} is no JSON") from None
        if not isinstance(action, dict) or len(action) != 1:
            raise Parsing(f"[_bulk] line {number}: exactly one action is expected")
        op, meta = next(iter(action.items()))
        if op not in OPS:
            raise Parsing(f"[_bulk] line {number}: unknown action [{op}]")
        if not isinstance(meta, dict):
            raise Parsing(f"[_bulk] line {number}: metadata must be an object")
        for key in meta:
            if key not in ("_index", "_id"):
                raise Unsupported(f"[_bulk] line {number}: metadata [{key}] is not supported")
        index, doc_id = meta.get("_index", default_index), meta.get("_id")
        if index is None:
            raise IllegalArgument(f"[_bulk] line {number}: [_index] is missing")
        if op == "delete":
            if doc_id is None:
                raise IllegalArgument(f"[_bulk] line {number}: [_id] is missing")
            yield op, index, doc_id, None
            continue
        number, line = next(lines, (number + 1, ""))
        try:
            body = json.loads(line)
        except ValueError:
            raise Parsing(f"[_bulk] line {number}: a document is expected") from None
        yield op, index, doc_id or uuid.uuid4().hex, body


def read_bulk(spark: SparkSession, path: str, default_index: str | None = None) -> DataFrame:
    """Actions of NDJSON files, each file read by one task in its order; positions order the files by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rank, text in zip(b["rank"], b["value"]):
                found = list(parse_bulk(text, default_index))
                yield pd.DataFrame({"position": [int(rank) * 2**40 + k for k in range(len(found))], "op": [f[0] for f in found], "index": [f[1] for f in found], "id": [f[2] for f in found], "body": [json.dumps(f[3]) for f in found]})

    files = spark.read.format("binaryFile").load(path).selectExpr("path", "cast(content as string) AS value")
    names = [r[0] for r in files.select("path").orderBy("path").collect()]  # a name per file
    ranks = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "path string, rank bigint")
    return files.join(ranks, "path").select("rank", "value").mapInPandas(run, ACTIONS)


#: Actions that one group folds; a group has whole `_id`s.
IDS_AT_ONCE = 5_000
_OUTCOME = "_id string, _seq_no bigint, _version bigint, _deleted boolean, _source string, position bigint, op string, result string, error string"


def fold(live: DataFrame, actions: DataFrame, mapping: Mapping, base: int) -> DataFrame:
    """Every action's outcome, each `_id`'s in order: the new log rows, what came of it, and the error if it failed.

    Actions on different `_id`s don't meet, so groups of `_id`s run side by side.
    """
    known = live.selectExpr("_id AS id", "_seq_no", "_version", "_deleted", "_source")
    groups = max(1, actions.count() // IDS_AT_ONCE)
    arrow = to_arrow_schema(T._parse_datatype_string(_OUTCOME))

    def run(key, old: pa.Table, new: pa.Table) -> pa.Table:
        known = plain(mapping)
        states = {
            i: State(v, s, None if d else json.loads(text)) for i, s, v, d, text in zip(*(old.column(c).to_pylist() for c in ("id", "_seq_no", "_version", "_deleted", "_source")))
        }
        own: dict[str, Mapping] = {}
        out = []
        for doc_id, position, op, given in zip(*(new.sort_by("position").column(c).to_pylist() for c in ("id", "position", "op", "body"))):
            seq, error, result = base + position, None, None
            before = state = states.get(doc_id) or State()
            try:
                body = json.loads(given) if given is not None else None  # the text of a document that is written as it came stays
                state, result, grew = apply(state, op, body, own.get(doc_id, mapping), seq, known=known)
                if grew is not mapping:
                    own[doc_id] = grew
                wrote = state is not before
            except SearchError as e:
                error, wrote = f"{e.kind}: {e}", False
            states[doc_id] = state
            out.append((doc_id, seq if wrote else None, state.version if wrote else None, not state.live if wrote else None, (given if state.source is body else json.dumps(state.source)) if wrote and state.live else None, position, op, result, error))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    bucket = F.pmod(F.xxhash64("id"), F.lit(groups)).alias("bucket")
    spark = actions.sparkSession
    # by number, as few tasks of unlike work that Spark would merge them into run in uneven waves
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    old, new = (t.select("*", bucket).repartition(tasks, "bucket").groupBy("bucket") for t in (known, actions))
    return old.cogroup(new).applyInArrow(run, _OUTCOME)


def new_fields(actions: DataFrame, mapping: Mapping) -> dict[str, Field]:
    """Fields that the documents of a load add, each as the first document with it has it; one row per path comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plain(mapping)
        for b in batches:
            rows = []
            for position, op, body in zip(*(b.column(c).to_pylist() for c in ("position", "op", "body"))):
                body = json.loads(body) if body else None
                if op == "update":
                    docs = [body[k] for k in ("doc", "upsert") if isinstance((body or {}).get(k), dict)]
                else:
                    docs = [body] if isinstance(body, dict) else []
                for doc in docs:
                    if known(doc) is not None:
                        continue
                    try:
                        added = grown(mapping, doc).fields
                    except SearchError:
                        continue
                    rows += [(p, position, f.type, bool(f.array), "keyword" in f.fields) for p, f in added.items() if mapping.fields.get(p) != f]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    added = "path string, position bigint, type string, array boolean, sub boolean"
    arrow = to_arrow_schema(T._parse_datatype_string(added))
    documents = actions.where("op <> 'delete'").select("position", "op", "body")
    least = actions.sparkSession.sparkContext.defaultParallelism
    if documents.rdd.getNumPartitions() < 2 * least:  # few large files: reading the documents is the work
        documents = documents.repartition(2 * least, "position")
    found = documents.mapInArrow(run, added)
    first = found.groupBy("path").agg(F.min_by(F.struct("type", "sub"), "position").alias("first"), F.max("array").alias("array"))
    out = {}
    for r in first.collect():
        known = mapping.fields.get(r["path"])
        base = known or Field(r["first"]["type"], fields={"keyword": Field("keyword", ignore_above=256)} if r["first"]["sub"] else {})
        out[r["path"]] = Field(base.type, base.analyzer, base.format, base.ignore_above, base.fields, r["array"] or base.array)
    return out
