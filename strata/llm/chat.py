"""Chat formatting by schema fingerprints.

A record is JSON of some layout. Its nested field paths (array steps as ``[]``), as far as any known layout uses
them, are sorted and hashed; the hash selects a declarative mapping that yields canonical (role, text) turns. Turns
are then written with a template that marks their borders and the text that counts for the loss.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """``each``: the path of a list of turns, with ``role`` and ``text`` below it; or ``fixed``: (role, path) pairs.

    ``required`` paths are in every record of this layout, ``optional`` ones in some. ``order`` sorts the list.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: dict = field(default_factory=dict)

    def fingerprints(self) -> list[str]:
        return [fingerprint([*self.required, *more]) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.fixed:
            return [(role, _text(record.get(path))) for role, path in self.fixed if path in self.required or record.get(path) not in (None, "")]
        found = [x for x in record.get(self.each) or [] if isinstance(x, dict)]
        if self.order:
            found.sort(key=lambda x: (x.get(self.order) is None, x.get(self.order) or 0, _text(x.get(self.role)), _text(x.get(self.text))))
        return [(self.roles.get(x.get(self.role), _text(x.get(self.role))), _text(x.get(self.text))) for x in found]


#: Layouts in common use; a caller may give others.
LAYOUTS = (
    Layout("turn rows", ("turns[].turn", "turns[].role", "turns[].text"), each="turns", role="role", text="text", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fixed=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), ("system",), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("prompt", "completion"), ("system",), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), ("system",), fixed=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def paths(value, prefix: str = "") -> set[str]:
    """Paths of the leaves below a JSON value."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(set(found))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def escape(text: str) -> str:
    """Puts one more backslash into every ``<`` backslashes ``|``, so that no control string is left; reversible."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def write(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[int]]:
    """The formatted conversation, and the flat (start, end, start, end ...) code points that count for the loss."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == learned:
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """id, layout, fingerprint, formatted, loss_spans (flat list of code points) of every JSON record.

    Fields that no layout knows don't count for the fingerprint. A record that is null, no JSON object or of no known
    layout keeps its row, with a null layout and an empty conversation. Null and missing texts are empty, as are null
    roles. Repeated rows are formatted each; other columns are ignored; an empty table gives no rows.
    """
    by_hash = {h: layout for layout in reversed(layouts) for h in layout.fingerprints()}
    known = {p for layout in layouts for p in (*layout.required, *layout.optional)}

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("layout", "fingerprint", "formatted", "loss_spans")}
        for record in batch["record"].to_pylist():
            try:
                record = json.loads(record or "null")
            except ValueError:
                record = None
            record = record if isinstance(record, dict) else {}
            mark = fingerprint(paths(record) & known)
            layout = by_hash.get(mark)
            formatted, mask = write(layout.turns(record) if layout else [])
            for k, v in zip(out, (layout and layout.name, mark, formatted, mask), strict=True):
                out[k].append(v)
        return {"id": batch["id"]} | out

    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("string").alias("record"))
    return map_batches(rows, run, "id long, layout string, fingerprint string, formatted string, loss_spans array<long>")


def turn_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, record: rows by turn gathered as one JSON record a conversation, the unit that is formatted. Rows
    with a null id are one conversation. Turns of equal number are ordered by role and text."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    grouped = rows.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.collect_list(turn).alias("turns"))
    return grouped.select("conv_id", F.to_json(F.struct("turns"), {"ignoreNullFields": "false"}).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted text."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for text, mask in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
            turns = read(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
            for k, v in zip(out, (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)), strict=True):
                out[k].append(v)
        return {"conv_id": batch["id"]} | out

    return map_batches(formatted.select("id", "formatted", "loss_spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
