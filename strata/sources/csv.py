"""CSV: flat files, and zip archives with one file an entity."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterable, Iterator

from strata.errors import SourceError
from strata.plans.manifest import Entity, Manifest


_LINE_END = re.compile(r"\r\n|\r|\n")
_QUOTED = re.compile(r'(?:[^"]|"")*')


def lines(chunks: Iterable[str]) -> Iterator[str]:
    """Physical lines without their ends (CR, LF or CRLF); the last one may be empty."""
    held = ""
    for chunk in chunks:
        held += chunk
        # A CR at the end may be half of a line end.
        whole = held[:-1] if held.endswith("\r") else held
        *done, last = _LINE_END.split(whole)
        yield from done
        held = last + held[len(whole) :]
    yield from _LINE_END.split(held)


def rows(chunks: Iterable[str], delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """(line that the row starts on, fields). A field that begins with a quote runs to its closing quote, over lines
    if need be, joined by LF; what follows up to the delimiter is kept, as is a quote within other fields. A quote
    that is never closed runs to the end. Empty lines are no rows."""
    numbered = enumerate(lines(chunks), 1)
    for start, text in numbered:
        if not text:
            continue
        fields, at = [], 0
        while True:
            body = ""
            if text.startswith('"', at):
                found = at + 1
                while (end := _QUOTED.match(text, found).end()) == len(text):
                    _, more = next(numbered, (0, None))
                    if more is None:
                        break
                    text, found = f"{text}\n{more}", end
                body, at = text[at + 1 : end].replace('""', '"'), end + 1
            stop = text.find(delimiter, at)
            fields.append(body + text[at : stop if stop >= 0 else len(text)])
            if stop < 0:
                break
            at = stop + 1
        yield start, fields


def decoded(stream, encoding: str) -> io.TextIOWrapper:
    """Text of a byte stream; a byte order mark wins over the encoding that is configured."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError as e:
        raise SourceError(f"encoding {encoding} is not known") from e
    stream = io.BufferedReader(stream) if not hasattr(stream, "peek") else stream
    head = stream.peek(4)[:4]
    for mark, own in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            name = own
            break
    return io.TextIOWrapper(stream, encoding=name, errors="replace", newline="")


def _chunks(text) -> Iterator[str]:
    while chunk := text.read(1 << 16):
        yield chunk


def table(stream, entity: Entity, manifest: Manifest, keyed: bool = False) -> Iterator[tuple[int, int, dict[str, str], str | None, str | None, str | None]]:
    """(ord, line, raw by lower-case name, key, parent key, fault) of each row."""
    options = manifest.source.csv
    found = rows(_chunks(decoded(stream, options.encoding)), options.delimiter)
    names = [f.name.lower() for f in entity.fields]
    if options.has_header_row:
        head = next(found, None)
        if head is None:
            return
        names = [n.strip().lower() for n in head[1]]
        if len(set(names)) < len(names):
            raise SourceError(f"{entity.name}: a column name occurs twice in the header")
    known = {f.name.lower() for f in entity.fields}
    for i, (line, fields) in enumerate(found):
        fault = None
        if len(fields) != len(names) and not options.allow_ragged_rows:
            fault = f"{len(fields)} fields where {len(names)} are expected"
        by_name = dict(zip(names, fields, strict=False))
        raw = {k: v for k, v in by_name.items() if k in known}
        yield i, line, raw, by_name.get(options.key_column.lower()) if keyed else None, by_name.get(options.parent_key_column.lower()) if keyed else None, fault


def flat_records(stream, manifest: Manifest) -> Iterator[tuple]:
    """entity, root_ord, rec_id, parent_rec_id, line, path, raw, fault."""
    entity = manifest.root
    for i, line, raw, _, _, fault in table(stream, entity, manifest):
        yield entity.name, i, str(i), None, line, None, raw, fault


def check_shape(head: bytes, manifest: Manifest) -> bool:
    """Is the file an archive? Raises if it is not what the dataset needs."""
    archive = head.startswith(b"PK")
    if manifest.root.children and not archive:
        raise SourceError(f"{manifest.name} has child entities: a zip archive with one CSV file an entity is expected")
    if archive and manifest.root.children and not manifest.source.csv.has_header_row:
        raise SourceError("an archive's files need a header row")
    return archive


def archive_rows(stream, entity: Entity, manifest: Manifest) -> Iterator[tuple]:
    """ord, line, raw, key, parent_key, fault of the archive's file of one entity; none if it isn't there."""
    with zipfile.ZipFile(stream) as archive:
        names = {n.rsplit("/", 1)[-1].lower(): n for n in archive.namelist()}
        member = names.get(f"{entity.name}.csv".lower())
        if member is None:
            if entity is manifest.root or entity.name == manifest.root.name:
                raise SourceError(f"the archive has no {entity.name}.csv")
            return
        with archive.open(member) as file:
            yield from table(io.BufferedReader(file), entity, manifest, True)
