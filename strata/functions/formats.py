"""Custom date and time formats of the manifest, translated to Java patterns."""

from __future__ import annotations

import re

#: Letters of the manifest's formats and their Java spellings; fixed values.
JAVA = {
    "yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a", "zzz": "XXX", "K": "XXX",
}


def java_pattern(text: str) -> str:
    """Raises ValueError for letters that have no counterpart, and for one-letter (standard) formats."""
    if len(text) == 1:
        raise ValueError(f"format {text} is a standard format; write it out")
    out = []
    for m in re.finditer(r"'[^']*'|\"[^\"]*\"|\\(.)|([A-Za-z])\2*|[^A-Za-z'\"\\]+|.", text, re.S):
        part = m[0]
        if part[0] in "'\"" and len(part) > 1:
            out.append("'" + part[1:-1].replace("'", "''") + "'")
        elif m[1]:
            out.append("'" + m[1].replace("'", "''") + "'")
        elif part[0] in "fF":
            out.append("S" * len(part))
        elif part[0].isalpha():
            if part not in JAVA:
                raise ValueError(f"format letters {part} are not supported")
            out.append(JAVA[part])
        elif part in "'\"\\":
            raise ValueError(f"format {text} has an open quote")
        else:
            out.append(re.sub(r"[\[\]{}#']", lambda x: "'" + x[0].replace("'", "''") + "'", part))
    return "".join(out)
