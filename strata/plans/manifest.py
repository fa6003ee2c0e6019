"""Dataset manifests: a frozen tree of entities with typed fields, read from and written to JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from enum import Enum

from pyspark.sql import types as T

from strata.errors import ManifestError
from strata.functions.formats import java_pattern

#: Fixed limits: characters of a string key column without maxLength, and the most that one may have.
KEY_LENGTH, MOST_KEY_LENGTH, MOST_LENGTH = 400, 850, 4000


class Kind(str, Enum):
    STRING = "string"
    INT32 = "int32"
    INT64 = "int64"
    DECIMAL = "decimal"
    DOUBLE = "double"
    BOOLEAN = "boolean"
    DATE = "date"
    DATETIME = "dateTime"
    TIME = "time"
    GUID = "guid"


class Source(str, Enum):
    ELEMENT = "element"
    ATTRIBUTE = "attribute"
    CONSTANT = "constant"


class Missing(str, Enum):
    REJECT_RECORD = "rejectRecord"
    REJECT_FILE = "rejectFile"
    USE_DEFAULT = "useDefault"
    AUTO_CREATE = "autoCreate"


@dataclass(frozen=True)
class Lookup:
    list: str = ""
    provider: str = "codelist"
    on_missing: Missing = Missing.REJECT_RECORD
    case_insensitive: bool = True
    value_kind: Kind = Kind.INT32
    default: str | None = None


@dataclass(frozen=True)
class Field:
    name: str = ""
    column: str | None = None
    type: Kind = Kind.STRING
    source: Source = Source.ELEMENT
    required: bool = False
    max_length: int | None = None
    precision: int = 18
    scale: int = 6
    format: str | None = None
    default: str | None = None
    lookup: Lookup | None = None

    @property
    def target(self) -> str:
        return self.column or self.name

    def spark_type(self) -> T.DataType:
        kind = self.lookup.value_kind if self.lookup else self.type
        if kind is Kind.DECIMAL:
            return T.DecimalType(self.precision, self.scale)
        return {
            Kind.STRING: T.StringType(), Kind.INT32: T.IntegerType(), Kind.INT64: T.LongType(), Kind.DOUBLE: T.DoubleType(),
            Kind.BOOLEAN: T.BooleanType(), Kind.DATE: T.DateType(), Kind.DATETIME: T.TimestampNTZType(), Kind.TIME: T.LongType(), Kind.GUID: T.StringType(),
        }[kind]


@dataclass(frozen=True)
class Entity:
    name: str = ""
    table: str = ""
    schema: str = "dbo"
    key_column: str = "Id"
    parent_key_column: str | None = None
    natural_key: tuple[str, ...] = ()
    required: bool = False
    fields: tuple[Field, ...] = ()
    children: tuple[Entity, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    def child(self, name: str) -> Entity | None:
        return next((c for c in self.children if c.name.lower() == name.lower()), None)

    def key_fields(self) -> list[Field]:
        return [f for k in self.natural_key for f in self.fields if f.target.lower() == k.lower()]

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.table}"

    def table_schema(self, parent: bool) -> T.StructType:
        """Target columns: the key, the parent's key for a child, then the fields."""
        columns = [T.StructField(self.key_column, T.LongType(), False)]
        if parent:
            columns.append(T.StructField(self.parent_key_column, T.LongType(), False))
        return T.StructType(columns + [T.StructField(f.target, f.spark_type(), not f.required) for f in self.fields])


@dataclass(frozen=True)
class Queue:
    name: str | None = None
    max_attempts: int = 3
    retry_base_delay_seconds: int = 30
    concurrency: int = 1


@dataclass(frozen=True)
class XmlOptions:
    root_element: str | None = None


@dataclass(frozen=True)
class JsonOptions:
    root_property: str | None = None


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    has_header_row: bool = True
    key_column: str = "_key"
    parent_key_column: str = "_parentKey"
    encoding: str = "utf-8"
    allow_ragged_rows: bool = False


@dataclass(frozen=True)
class SourceOptions:
    formats: tuple[str, ...] = ()
    xml: XmlOptions = field(default_factory=XmlOptions)
    json: JsonOptions = field(default_factory=JsonOptions)
    csv: CsvOptions = field(default_factory=CsvOptions)

    def allows(self, name: str) -> bool:
        return not self.formats or name.lower() in {f.lower() for f in self.formats}


@dataclass(frozen=True)
class Manifest:
    name: str = ""
    version: str = "1"
    description: str | None = None
    queue: Queue = field(default_factory=Queue)
    source: SourceOptions = field(default_factory=SourceOptions)
    root: Entity | None = None

    @property
    def queue_name(self) -> str:
        return self.queue.name or self.name

    def entities(self) -> list[tuple[Entity, Entity | None]]:
        """(entity, parent), level by level, parents first."""
        found: list[tuple[Entity, Entity | None]] = [(self.root, None)] if self.root else []
        for entity, _ in found:
            found += [(child, entity) for child in entity.children]
        return found

    def entity(self, name: str) -> Entity | None:
        return next((e for e, _ in self.entities() if e.name.lower() == name.lower()), None)

    def has_lookups(self) -> bool:
        return any(f.lookup for e, _ in self.entities() for f in e.fields)

    def job_scoped(self) -> bool:
        """Must one import be one transaction, whatever the batches? Reported only: commits always are."""
        return any(not e.natural_key or any(f.lookup and f.lookup.on_missing in (Missing.REJECT_FILE, Missing.AUTO_CREATE) for f in e.fields) for e, _ in self.entities())

    def problems(self) -> list[str]:
        """Every broken rule."""
        return list(_problems(self))

    def check(self) -> Manifest:
        if found := self.problems():
            raise ManifestError(found)
        return self


def _twice(names: list[str]) -> list[str]:
    low = [n.lower() for n in names]
    return sorted({n for n in low if n and low.count(n) > 1})


def _problems(manifest: Manifest) -> Iterator[str]:
    if not manifest.name.strip():
        yield "a dataset needs a name"
    if manifest.root is None:
        yield "a dataset needs a root entity"
        return
    entities = manifest.entities()
    for name in _twice([e.name for e, _ in entities]):
        yield f"more than one entity is called {name}"
    if len(manifest.source.csv.delimiter) != 1:
        yield "source.csv.delimiter must be one character"
    for entity, parent in entities:
        yield from (f"{entity.name or 'an entity'}: {x}" for x in _entity_problems(entity, parent))


def _entity_problems(entity: Entity, parent: Entity | None) -> Iterator[str]:
    if not entity.name.strip():
        yield "name is missing"
    if not entity.table.strip():
        yield "table is missing"
    if not entity.key_column.strip():
        yield "keyColumn is missing"
    if parent and not (entity.parent_key_column or "").strip():
        yield "a child needs a parentKeyColumn"
    if not entity.fields:
        yield "at least one field is needed"
    for what, names in (("field", [f.name for f in entity.fields]), ("column", [f.target for f in entity.fields])):
        for name in _twice(names):
            yield f"more than one {what} is called {name}"
    for f in entity.fields:
        name = f.name or "a field"
        if not f.name.strip():
            yield "a field has no name"
        if f.target.lower() == entity.key_column.lower():
            yield f"column {f.target} collides with keyColumn"
        if parent and f.target.lower() == (entity.parent_key_column or "").lower():
            yield f"column {f.target} collides with parentKeyColumn"
        if f.lookup and not f.lookup.list.strip():
            yield f"{name}: a lookup needs a list"
        if f.lookup and f.lookup.on_missing is Missing.USE_DEFAULT and not (f.lookup.default or "").strip():
            yield f"{name}: useDefault needs lookup.default"
        if not f.lookup and f.type is Kind.DECIMAL:
            if not 1 <= f.precision <= 38:
                yield f"{name}: precision must be 1 to 38"
            if not 0 <= f.scale <= f.precision:
                yield f"{name}: scale must be 0 to precision"
        if f.max_length is not None and not 1 <= f.max_length <= MOST_LENGTH:
            yield f"{name}: maxLength must be 1 to {MOST_LENGTH}"
        if f.format and f.type in (Kind.DATE, Kind.DATETIME, Kind.TIME):
            try:
                java_pattern(f.format)
            except ValueError as e:
                yield f"{name}: {e}"
    for key in entity.natural_key:
        f = next((f for f in entity.fields if f.target.lower() == key.lower()), None)
        if f is None:
            yield f"natural key column {key} is no field's column"
        elif f.spark_type() == T.StringType() and (f.max_length or 0) > MOST_KEY_LENGTH:
            yield f"natural key column {key}: maxLength must be at most {MOST_KEY_LENGTH}"


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


#: Nested classes by (class, property).
_NESTED = {
    (Manifest, "root"): Entity, (Manifest, "queue"): Queue, (Manifest, "source"): SourceOptions, (Entity, "fields"): [Field], (Entity, "children"): [Entity],
    (Field, "lookup"): Lookup, (SourceOptions, "xml"): XmlOptions, (SourceOptions, "json"): JsonOptions, (SourceOptions, "csv"): CsvOptions,
}
_ENUMS = {(Field, "type"): Kind, (Field, "source"): Source, (Lookup, "on_missing"): Missing, (Lookup, "value_kind"): Kind}


def _build(cls, value, where: str):
    if not isinstance(value, dict):
        raise ManifestError([f"{where}: an object is expected"])
    given = {k.lower(): v for k, v in value.items()}
    out = {}
    for f in fields(cls):
        v = given.get(_camel(f.name).lower())
        if v is None:
            continue
        at, nested = f"{where}.{_camel(f.name)}", _NESTED.get((cls, f.name))
        if isinstance(nested, list):
            if not isinstance(v, list):
                raise ManifestError([f"{at}: an array is expected"])
            v = tuple(_build(nested[0], x, f"{at}[{i}]") for i, x in enumerate(v))
        elif nested:
            v = _build(nested, v, at)
        elif (cls, f.name) in _ENUMS:
            names = {x.value.lower(): x for x in _ENUMS[cls, f.name]}
            if str(v).lower() not in names:
                raise ManifestError([f"{at}: {v} is none of {', '.join(x.value for x in _ENUMS[cls, f.name])}"])
            v = names[str(v).lower()]
        elif isinstance(v, list):
            v = tuple(v)
        elif "int" in str(f.type) and (isinstance(v, bool) or not isinstance(v, int)):
            raise ManifestError([f"{at}: a whole number is expected"])
        elif str(f.type).startswith("bool") and not isinstance(v, bool):
            raise ManifestError([f"{at}: true or false is expected"])
        elif str(f.type).startswith("str") and not isinstance(v, str):
            raise ManifestError([f"{at}: a string is expected"])
        out[f.name] = v
    return cls(**out)


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)


def loads(text: str, check: bool = True) -> Manifest:
    """A manifest from JSON; comments and trailing commas are fine, property names ignore case."""
    try:
        value = json.loads(_TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else " ", text.removeprefix("\ufeff")))
    except ValueError as e:
        raise ManifestError([f"not JSON: {e}"]) from e
    found = _build(Manifest, value, "manifest")
    return found.check() if check else found


def _plain(value):
    if is_dataclass(value):
        return {_camel(f.name): _plain(v) for f in fields(value) if (v := getattr(value, f.name)) is not None}
    if isinstance(value, tuple):
        return [_plain(v) for v in value]
    return value.value if isinstance(value, Enum) else value


def dumps(manifest: Manifest) -> str:
    """JSON that ``loads`` reads back as the same manifest; nulls are left out."""
    return json.dumps(_plain(manifest), indent=2, ensure_ascii=False)
