"""Opening files of any file system on executors; formats by file name."""

from __future__ import annotations

import io
from pathlib import PurePosixPath

from strata.errors import SourceError
from strata.plans.manifest import Manifest

#: Extensions of each format; fixed values.
EXTENSIONS = {".xml": "xml", ".json": "json", ".csv": "csv", ".zip": "csv", ".parquet": "parquet"}


def infer_format(path: str, given: str | None = None) -> str:
    """The format given, or that of the extension."""
    found = (given or EXTENSIONS.get(PurePosixPath(path.rstrip("/")).suffix.lower()) or "").lower()
    if found == "zip":
        found = "csv"
    if found not in set(EXTENSIONS.values()):
        raise SourceError(f"the format of {path} is not known")
    return found


def allowed_format(path: str, manifest: Manifest, given: str | None = None) -> str:
    found = infer_format(path, given)
    if not manifest.source.allows(found):
        raise SourceError(f"{manifest.name} does not take {found} files")
    return found


def open_bytes(path: str) -> io.BufferedIOBase:
    """A binary stream; local paths are opened as they are, URIs by pyarrow's file systems."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])
    return io.BufferedReader(where.open_input_file(name))
