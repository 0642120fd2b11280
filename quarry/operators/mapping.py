"""Mappings: what a field is, how its values are read, and how a Spark schema or a JSON document gives one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import DocumentParsing, IllegalArgument, MapperParsing, StrictMapping, Unsupported, ValueUnreadable
from quarry.functions import analysis
from quarry.functions.dates import DEFAULT, DateFormat, iso

INTEGERS = {"byte": 8, "short": 16, "integer": 32, "long": 64}
FLOATS = ("float", "double")
TYPES = ("text", "keyword", *INTEGERS, *FLOATS, "boolean", "date")
SPARK = {"text": T.StringType(), "keyword": T.StringType(), "byte": T.ByteType(), "short": T.ShortType(), "integer": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType()}
DYNAMIC = ("true", "false", "strict")


@dataclass(frozen=True)
class Field:
    """A leaf: its type and parameters, and further fields over the same value."""

    type: str
    analyzer: str = "standard"
    format: str = DEFAULT
    ignore_above: int | None = None
    fields: dict[str, Field] = field(default_factory=dict, hash=False)
    array: bool = False
    source: str | None = None  # path of the value, for a field over another's
    zoneless: bool = False  # a column without time zone, read as UTC

    @cached_property
    def dates(self) -> DateFormat:
        return DateFormat(self.format)

    @property
    def numeric(self) -> bool:
        return self.type in INTEGERS or self.type in FLOATS

    def read(self, value):
        """A JSON value as this type's; `ValueUnreadable` if it can't be."""
        if isinstance(value, (dict, list)):
            raise ValueUnreadable(f"a [{self.type}] can't hold [{value}]")
        if self.type in ("text", "keyword"):
            return str(value).lower() if isinstance(value, bool) else str(value)
        if self.type == "boolean":
            known = {True: True, False: False, "true": True, "false": False}
            if isinstance(value, (bool, str)) and value in known:
                return known[value]
            raise ValueUnreadable(f"Failed to parse value [{value}] as only [true] or [false] are allowed.")
        if self.type == "date":
            return self.dates.read(value)[0]
        if isinstance(value, bool):
            value = int(value)
        try:
            if self.type in FLOATS:
                return float(value.strip() if isinstance(value, str) else value)
            text = value.strip() if isinstance(value, str) else value
            number = int(text) if isinstance(text, int) or (isinstance(text, str) and text.lstrip("+-").isdigit()) else float(text)
            if number != int(number):
                raise ValueError
            number = int(number)
        except (ValueError, OverflowError):
            raise ValueUnreadable(f'For input string: "{value}"') from None
        if not -(2 ** (INTEGERS[self.type] - 1)) <= number < 2 ** (INTEGERS[self.type] - 1):
            raise ValueUnreadable(f"Value [{value}] is out of range for [{self.type}]")
        return number

    def spec(self) -> dict:
        out: dict = {"type": self.type}
        if self.type == "text" and self.analyzer != "standard":
            out["analyzer"] = self.analyzer
        if self.type == "date" and self.format != DEFAULT:
            out["format"] = self.format
        if self.ignore_above is not None:
            out["ignore_above"] = self.ignore_above
        if self.fields:
            out["fields"] = {k: f.spec() for k, f in self.fields.items()}
        return out


@dataclass
class Join:
    """The one field that relates parents and children within an index."""

    name: str
    relations: dict[str, list[str]]

    def parent_of(self, child: str) -> str | None:
        return next((p for p, cs in self.relations.items() if child in cs), None)


@dataclass
class Mapping:
    fields: dict[str, Field] = field(default_factory=dict)
    nested: set[str] = field(default_factory=set)
    join: Join | None = None
    dynamic: str = "true"
    analyzers: dict[str, analysis.Analyzer] = field(default_factory=lambda: dict(analysis.BUILT_IN))
    allow_unmapped: bool = True

    def get(self, path: str) -> Field | None:
        """The field of a path; `parent.sub` finds a further field over the parent's value."""
        if path in self.fields:
            return self.fields[path]
        parent, _, sub = path.rpartition(".")
        if parent in self.fields and sub in self.fields[parent].fields:
            whole = self.fields[parent]
            return replace(whole.fields[sub], source=parent, array=whole.array)
        return None

    def nested_root(self, path: str) -> str | None:
        return next((r for r in self.nested if path == r or path.startswith(r + ".")), None)

    def to_dict(self) -> dict:
        root: dict = {}
        for path, f in sorted(self.fields.items()):
            at = root
            *parents, leaf = path.split(".")
            for k, p in enumerate(parents):
                at = at.setdefault(p, {"properties": {}})
                if ".".join(parents[: k + 1]) in self.nested:
                    at["type"] = "nested"
                at = at["properties"]
            at[leaf] = f.spec()
        if self.join:
            root[self.join.name] = {"type": "join", "relations": {p: c[0] if len(c) == 1 else c for p, c in self.join.relations.items()}}
        return {"properties": root} if self.dynamic == "true" else {"dynamic": self.dynamic, "properties": root}


def _parse_field(path: str, spec: dict, analyzers: dict, sub: bool = False) -> Field:
    kind = spec.get("type")
    if kind not in TYPES:
        raise MapperParsing(f"No handler for type [{kind}] declared on field [{path}]")
    for key in spec:
        if key not in ("type", "analyzer", "fields", "ignore_above", "format"):
            raise MapperParsing(f"unknown parameter [{key}] on mapper [{path}] of type [{kind}]")
    if "analyzer" in spec and kind != "text":
        raise MapperParsing(f"[analyzer] on field [{path}] is for text only")
    if "ignore_above" in spec and kind != "keyword":
        raise MapperParsing(f"[ignore_above] on field [{path}] is for keyword only")
    if "format" in spec and kind != "date":
        raise MapperParsing(f"[format] on field [{path}] is for date only")
    if spec.get("analyzer", "standard") not in analyzers:
        raise MapperParsing(f"analyzer [{spec['analyzer']}] has not been configured in mappings")
    if sub and "fields" in spec:
        raise MapperParsing(f"[fields] of field [{path}] can't have [fields]")
    fields = {k: _parse_field(f"{path}.{k}", v, analyzers, True) for k, v in spec.get("fields", {}).items()}
    out = Field(kind, spec.get("analyzer", "standard"), spec.get("format", DEFAULT), spec.get("ignore_above"), fields)
    if kind == "date":
        _ = out.dates
    return out


def parse(spec: dict | None, analyzers: dict[str, analysis.Analyzer] | None = None) -> Mapping:
    """A mapping from its JSON form."""
    spec = spec or {}
    analyzers = analyzers or dict(analysis.BUILT_IN)
    for key in spec:
        if key not in ("properties", "dynamic"):
            raise MapperParsing(f"root mapping has unsupported parameter [{key}]")
    dynamic = str(spec.get("dynamic", "true")).lower()
    if dynamic not in DYNAMIC:
        raise Unsupported(f"[dynamic: {dynamic}] is not supported")
    out = Mapping(dynamic=dynamic, analyzers=analyzers)

    def walk(properties: dict, prefix: str, in_nested: bool) -> None:
        for name, s in properties.items():
            if not name or "." in name or (not prefix and name.startswith("_")):
                raise MapperParsing(f"field name [{name}] can't be used")
            path = prefix + name
            if "properties" in s or s.get("type") in ("object", "nested"):
                if set(s) - {"type", "properties"}:
                    raise MapperParsing(f"unsupported parameters on object [{path}]")
                if s.get("type") == "nested":
                    if in_nested:
                        raise Unsupported(f"[nested] within [nested] is not supported: [{path}]")
                    out.nested.add(path)
                walk(s.get("properties", {}), path + ".", in_nested or s.get("type") == "nested")
            elif s.get("type") == "join":
                if out.join or prefix:
                    raise MapperParsing("only one [join] field can be defined per index, at its root")
                relations = {p: [c] if isinstance(c, str) else list(c) for p, c in s.get("relations", {}).items()}
                out.join = Join(name, relations)
            else:
                out.fields[path] = _parse_field(path, s, analyzers)

    walk(spec.get("properties", {}), "", False)
    return out


def infer(value) -> Field | None:
    """Type of a JSON value that no mapping names; None for null, {} and []."""
    if value is None or isinstance(value, dict):
        return None
    if isinstance(value, list):
        return next((replace(f, array=True) for f in map(infer, value) if f), None)
    if isinstance(value, bool):
        return Field("boolean")
    if isinstance(value, int):
        return Field("long")
    if isinstance(value, float):
        return Field("float")
    text = value.strip()
    if len(text) >= 8 and text.count("-") >= 2 and iso(text):
        return Field("date")
    return Field("text", fields={"keyword": Field("keyword", ignore_above=256)})


def leaves(doc: dict, nested: set[str] = frozenset(), prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of a document's leaves; objects are flattened, also those in lists, but for nested ones."""
    for name, value in doc.items():
        path = prefix + name
        if path in nested:
            yield path, value
        elif isinstance(value, dict):
            yield from leaves(value, nested, path + ".")
        elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
            if not all(isinstance(x, dict) or x is None for x in value):
                raise DocumentParsing(f"field [{path}] mixes objects and other values")
            found: dict[str, list] = {}
            for x in value:
                for p, v in leaves(x or {}, nested, path + "."):
                    found.setdefault(p, []).extend(v if isinstance(v, list) else [v])
            yield from found.items()
        else:
            yield path, value


def grown(mapping: Mapping, doc: dict) -> Mapping:
    """The mapping with the fields that a new document adds, as its dynamic mode has it."""
    fields = dict(mapping.fields)
    for path, value in leaves(doc, mapping.nested):
        values = value if isinstance(value, list) else [value]
        if path in mapping.nested:
            inner = [(f"{path}.{p}", v) for x in values if isinstance(x, dict) for p, v in leaves(x)]
        else:
            inner = [(path, value)]
        for p, v in inner:
            known = fields.get(p)
            if mapping.join and p.split(".")[0] == mapping.join.name:
                continue
            if known:
                if isinstance(v, list) and not known.array:
                    fields[p] = replace(known, array=True)
                continue
            new = infer(v)
            if new is None:
                continue
            if any(q.startswith(p + ".") for q in fields) or any(p.startswith(q + ".") for q in fields):
                raise DocumentParsing(f"object mapping for [{p}] tried to parse a path that is both a value and an object")
            if mapping.dynamic == "strict":
                raise StrictMapping(f"mapping set to strict, dynamic introduction of [{p.rpartition('.')[2]}] within [{p.rpartition('.')[0] or '_doc'}] is not allowed")
            if mapping.dynamic == "true":
                fields[p] = new
    return replace(mapping, fields=fields)


def merged(old: Mapping, new: Mapping) -> Mapping:
    """Fields added to a mapping; none may change."""
    for path, f in new.fields.items():
        was = old.fields.get(path)
        if was and (was.type, was.analyzer, was.format) != (f.type, f.analyzer, f.format):
            raise IllegalArgument(f"mapper [{path}] cannot be changed from type [{was.type}] to [{f.type}]")
    if new.dynamic not in (old.dynamic, "true"):
        raise Unsupported("[dynamic] can't be changed")
    if old.join and new.join and old.join.relations != new.join.relations:
        raise IllegalArgument("[join] relations can't be changed")
    return replace(old, fields={**old.fields, **{p: f for p, f in new.fields.items() if p not in old.fields}}, nested=old.nested | new.nested, join=old.join or new.join)


def of_schema(schema: T.StructType, **declared: dict) -> Mapping:
    """Mapping of a table: strings are keywords unless `declared` says more."""
    out = Mapping(dynamic="strict")

    def kind(t: T.DataType) -> str | None:
        names = {T.StringType: "keyword", T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "integer", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "date", T.TimestampNTZType: "date"}
        return "double" if isinstance(t, T.DecimalType) else names.get(type(t))

    def walk(s: T.StructType, prefix: str, array: bool) -> None:
        for f in s.fields:
            path, t, many = prefix + f.name, f.dataType, array
            if isinstance(t, T.ArrayType):
                t, many = t.elementType, True
            if isinstance(t, T.StructType):
                if many and declared.get(path, {}).get("type") == "nested":
                    out.nested.add(path)
                walk(t, path + ".", many)
            elif path in declared:
                out.fields[path] = replace(_parse_field(path, declared[path], out.analyzers), array=many, zoneless=isinstance(t, (T.TimestampNTZType, T.DateType)))
            elif kind(t):
                out.fields[path] = Field(kind(t), array=many, zoneless=isinstance(t, (T.TimestampNTZType, T.DateType)))

    walk(schema, "", False)
    return out


def column(path: str, f: Field) -> Column:
    """The field's values: for a keyword those that aren't too long."""
    c = F.col(".".join(f"`{p}`" for p in (f.source or path).split(".")))
    if f.type == "keyword" and f.ignore_above is not None:
        limit = f.ignore_above
        c = F.filter(c, lambda x: F.length(x) <= limit) if f.array else F.when(F.length(c) <= limit, c)
    return c
