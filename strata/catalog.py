"""Registered datasets, kept as JSON manifests in a folder, and options of the engine."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass
from pathlib import Path

from strata.errors import ManifestError, UnknownDataset
from strata.plans.manifest import Manifest, dumps, loads

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """Checked when made."""

    poll_seconds: int = 2
    abandoned_after_seconds: int = 1800
    heartbeat_seconds: float = 60
    on_duplicate_key: str = "fail"
    retry_file_faults: bool = True
    delete_imported_files: bool = False

    def __post_init__(self):
        if self.poll_seconds < 1:
            raise ValueError("poll_seconds must be at least 1")
        if self.abandoned_after_seconds < 120:
            raise ValueError("abandoned_after_seconds must be at least 120")
        if not 0 < self.heartbeat_seconds < self.abandoned_after_seconds:
            raise ValueError("heartbeat_seconds must be above 0 and below abandoned_after_seconds")
        if self.on_duplicate_key not in ("fail", "last_wins"):
            raise ValueError("on_duplicate_key is fail or last_wins")


class Catalog:
    """Datasets by name, whatever the case. With a folder, each is kept there before it is registered."""

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder) if folder else None
        self._by_name: dict[str, Manifest] = {}
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            for file in sorted(self.folder.glob("*.json")):
                try:
                    manifest = loads(file.read_text("utf-8-sig"))
                    self._by_name[manifest.name.lower()] = manifest
                except ManifestError as e:
                    log.warning("%s is left out: %s", file.name, e)

    def _file(self, name: str) -> Path:
        return self.folder / (re.sub(r"[^A-Za-z0-9._-]", "_", name).strip(".") + ".json")

    def put(self, manifest: Manifest | str, name: str | None = None) -> Manifest:
        """Registers or replaces; a name that is given must be the manifest's own."""
        manifest = loads(manifest) if isinstance(manifest, str) else manifest.check()
        if name is not None and name.lower() != manifest.name.lower():
            raise ManifestError([f"the manifest is called {manifest.name}, not {name}"])
        if self.folder:
            draft = self._file(manifest.name).with_suffix(".draft")
            draft.write_text(dumps(manifest), "utf-8")
            os.replace(draft, self._file(manifest.name))
        self._by_name[manifest.name.lower()] = manifest
        return manifest

    def get(self, name: str) -> Manifest:
        if name.lower() not in self._by_name:
            raise UnknownDataset(name)
        return self._by_name[name.lower()]

    def remove(self, name: str) -> bool:
        found = self._by_name.pop(name.lower(), None)
        if found and self.folder:
            self._file(found.name).unlink(missing_ok=True)
        return found is not None

    def all(self) -> list[Manifest]:
        return [self._by_name[k] for k in sorted(self._by_name)]

    def summaries(self) -> list[dict]:
        return [{"name": m.name, "version": m.version, "description": m.description, "queue": m.queue_name, "entities": [e.name for e, _ in m.entities()]} for m in self.all()]
