"""Failures that end an import. Faults of single records are data, never exceptions."""


class StrataError(Exception):
    """Base of all."""


class ManifestError(StrataError):
    """A manifest breaks rules; ``problems`` lists every one."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class SourceError(StrataError):
    """A file cannot be read in the shape that the manifest describes."""


class LookupRejected(StrataError):
    """A value is unknown and its policy rejects the whole file."""


class DuplicateKey(StrataError):
    """Two staged rows have the same natural key within one parent."""


class MissingParent(StrataError):
    """A staged child has no parent row; this is a bug in the frames."""


class Conflict(StrataError):
    """Another writer committed first."""


class NotFree(StrataError):
    """A job is held by another run, or done."""


class UnknownDataset(StrataError):
    """No dataset of that name."""
