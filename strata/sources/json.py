"""JSON: a top-level array element by element, or an array wrapped in an object."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

from strata.errors import SourceError
from strata.plans.manifest import Entity, Manifest, Source

_SPACE = " \t\r\n"
_decoder = json.JSONDecoder(strict=False)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACE:
        at += 1
    return at


def _end(text: str, at: int) -> int:
    """Where the value that begins at a place ends."""
    return _decoder.raw_decode(text, at)[1]


def members(text: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """(name, source text of the value) of the object that begins at a place."""
    at = _skip(text, at + 1)
    while text[at] != "}":
        name, at = _decoder.raw_decode(text, at)
        at = _skip(text, _skip(text, at) + 1)
        end = _end(text, at)
        yield name, text[at:end]
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def elements(text: str) -> Iterator[str]:
    """Source texts of an array's elements."""
    at = _skip(text, 1)
    while text[at] != "]":
        end = _end(text, at)
        yield text[at:end]
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def scalar(text: str) -> str | None:
    """A string's value; anything else as it is written; null is null."""
    return json.loads(text, strict=False) if text[0] == '"' else None if text == "null" else text


def record(text: str, entity: Entity, root_ord: int, rec_id: str, parent: str | None, path: str) -> Iterator[tuple]:
    """Rows of an object and of its child records, the object first. Of repeated properties the last counts."""
    raw: dict[str, str | None] = {}
    children: list[tuple[Entity, str, str]] = []
    for name, value in members(text):
        if child := entity.child(name):
            if value[0] == "[":
                children += [(child, x, f"{path}.{name}[{i}]") for i, x in enumerate(elements(value)) if x[0] == "{"]
            elif value[0] == "{":
                children.append((child, value, f"{path}.{name}"))
        elif (field := entity.field(name)) and field.source is not Source.CONSTANT:
            raw[field.name.lower()] = scalar(value)
    yield entity.name, root_ord, rec_id, parent, None, path, raw, None
    count: dict[str, int] = {}
    for child, value, at in children:
        n = count[child.name] = count.get(child.name, -1) + 1
        yield from record(value, child, root_ord, f"{rec_id}/{child.name}[{n}]", rec_id, at)


def _array(read, text: str, done: bool) -> Iterator[tuple[int, str]]:
    """(index, source text) of a top-level array that is read piece by piece; memory holds a piece and an element."""
    at, index = _skip(text, 0) + 1, 0
    more = 1 << 16

    def fill():
        nonlocal text, at, done, more
        piece = read(more)
        done = not piece
        text, at = text[at:] + piece, 0

    while True:
        at = _skip(text, at)
        while at >= len(text) and not done:
            fill()
            at = _skip(text, at)
        if at >= len(text):
            raise SourceError("the JSON array is not closed")
        if text[at] == "]":
            rest = text[at + 1 :] + ("" if done else read(-1))
            if rest.strip(_SPACE):
                raise SourceError("there is more after the JSON array")
            return
        if index:
            if text[at] != ",":
                raise SourceError(f"a comma is expected before element {index}")
            at = _skip(text, at + 1)
            while at >= len(text) and not done:
                fill()
                at = _skip(text, at)
        while True:
            try:
                end = _end(text, at)
                # A number may go on in the next piece.
                if end < len(text) or done:
                    break
            except (ValueError, IndexError) as e:
                if done:
                    raise SourceError(f"element {index} is not JSON: {e}") from e
            more = max(1 << 16, len(text) - at)
            fill()
        more = 1 << 16
        yield index, text[at:end]
        at, index = end, index + 1


def records(stream, manifest: Manifest) -> Iterator[tuple]:
    """entity, root_ord, rec_id, parent_rec_id, line, path, raw, fault of every record. Elements that are no objects are
    left out but count. A top-level object must have an array under source.json.rootProperty or the root's name."""
    text = codecs.getreader("utf-8-sig")(stream)
    try:
        head = text.read(1 << 16)
        while head and not head.strip(_SPACE):
            head = text.read(1 << 16)
        at = _skip(head, 0)
        if head[at : at + 1] == "[":
            found = _array(lambda n: text.read(n), head[at:], False)
            prefix = "$"
        elif head[at : at + 1] == "{":
            whole = head[at:] + text.read()
            end = _end(whole, 0)
            if whole[end:].strip(_SPACE):
                raise SourceError("there is more after the JSON object")
            wrapped = {}
            for name, value in members(whole):
                wrapped[name.lower()] = (name, value)
            wanted = [n.lower() for n in (manifest.source.json.root_property, manifest.root.name) if n]
            hit = next((wrapped[n] for n in wanted if n in wrapped), None)
            if hit is None or hit[1][0] != "[":
                raise SourceError(f"the JSON object has no array called {' or '.join(wanted)}")
            found, prefix = enumerate(elements(hit[1])), f"$.{hit[0]}"
        else:
            raise SourceError("a JSON array or object is expected")
        for i, value in found:
            if value[0] == "{":
                yield from record(value, manifest.root, i, str(i), None, f"{prefix}[{i}]")
    except SourceError:
        raise
    except (ValueError, IndexError) as e:
        raise SourceError(f"not JSON: {e}") from e
