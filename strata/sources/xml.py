"""XML: every subtree of the root entity, wherever it is, read by events; a record at a time is in memory."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

from strata.errors import SourceError
from strata.plans.manifest import Entity, Manifest, Source


class _Record:
    __slots__ = ("children", "entity", "line", "path", "raw", "rec_id")

    def __init__(self, entity: Entity, line: int, path: str):
        self.entity, self.line, self.path = entity, line, path
        self.raw: dict[str, str] = {}
        self.children: list[_Record] = []


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


class _Handler:
    """Names are matched without namespace or case. Elements that are neither entity nor field are skipped with all
    below; an entity wins over a field of the same name; of repeated fields the last counts."""

    def __init__(self, manifest: Manifest):
        self.root, self.wrapper = manifest.root, (manifest.source.xml.root_element or "").lower()
        self.open_wrappers = 0 if self.wrapper else 1
        self.stack: list[_Record] = []
        self.names: list[str] = []
        self.skip = 0
        self.field, self.text = None, []
        self.done: list[_Record] = []
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler = self.characters
        self.parser.StartDoctypeDeclHandler = self.doctype

    def doctype(self, *_):
        raise SourceError(f"line {self.parser.CurrentLineNumber}: a document type is not allowed")

    def start(self, name: str, attributes: dict[str, str]):
        name = _local(name)
        if self.skip:
            self.skip += 1
            return
        if self.field is not None:
            raise SourceError(f"line {self.parser.CurrentLineNumber}: {self.field.name} holds elements where text is expected")
        self.names.append(name)
        if not self.stack:
            if self.wrapper and name.lower() == self.wrapper:
                self.open_wrappers += 1
            elif self.open_wrappers and name.lower() == self.root.name.lower():
                self.enter(self.root, attributes)
            return
        entity = self.stack[-1].entity
        if child := entity.child(name):
            self.enter(child, attributes)
        elif (field := entity.field(name)) and field.source is Source.ELEMENT:
            self.field, self.text = field, []
        else:
            self.names.pop()
            self.skip = 1

    def enter(self, entity: Entity, attributes: dict[str, str]):
        record = _Record(entity, self.parser.CurrentLineNumber, "/".join(self.names))
        by_name = {_local(k).lower(): v for k, v in attributes.items()}
        for field in entity.fields:
            if field.source is Source.ATTRIBUTE and field.name.lower() in by_name:
                record.raw[field.name.lower()] = by_name[field.name.lower()]
        if self.stack:
            self.stack[-1].children.append(record)
        self.stack.append(record)

    def characters(self, text: str):
        if self.field is not None and not self.skip:
            self.text.append(text)

    def end(self, name: str):
        if self.skip:
            self.skip -= 1
            return
        name = self.names.pop()
        if self.field is not None:
            self.stack[-1].raw[self.field.name.lower()] = "".join(self.text)
            self.field = None
        elif self.stack:
            record = self.stack.pop()
            if not self.stack:
                self.done.append(record)
        elif self.wrapper and name.lower() == self.wrapper:
            self.open_wrappers -= 1


def _rows(record: _Record, root_ord: int, rec_id: str, parent: str | None) -> Iterator[tuple]:
    yield record.entity.name, root_ord, rec_id, parent, record.line, record.path, record.raw, None
    count: dict[str, int] = {}
    for child in record.children:
        n = count[child.entity.name] = count.get(child.entity.name, -1) + 1
        yield from _rows(child, root_ord, f"{rec_id}/{child.entity.name}[{n}]", rec_id)


def records(stream, manifest: Manifest) -> Iterator[tuple]:
    """entity, root_ord, rec_id, parent_rec_id, line, path, raw, fault of every record."""
    handler, i = _Handler(manifest), 0
    try:
        while True:
            piece = stream.read(1 << 16)
            handler.parser.Parse(piece, not piece)
            for record in handler.done:
                yield from _rows(record, i, str(i), None)
                i += 1
            handler.done.clear()
            if not piece:
                return
    except expat.ExpatError as e:
        raise SourceError(f"line {e.lineno}: {expat.errors.messages[e.code]}") from e
