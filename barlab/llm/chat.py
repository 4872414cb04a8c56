"""Chat formatting: records of different layouts become canonical turns, then one marked text with a loss mask.

A record's layout is the set of its nested field paths (``messages[].role``); the hash of that set, its fingerprint, selects
a mapping. Mappings are declarations: which path holds the list of turns with their role and text fields, or which single
fields are the turns of which roles, and which paths may be missing or be ignored. Layouts without a mapping are reported
with a null text, not dropped.

Template: ``<|im_start|>role`` line feed ``text<|im_end|>`` line feed per turn. Inside texts every ``<|`` gets a backslash
between its two characters, and one more where backslashes already stand there, so no control string can be written by a
text and reading back is exact. Roles are escaped the same way, with line feeds and backslashes written as ``\\\\n`` and ``\\\\\\\\``.
The loss mask is the list of character spans of assistant texts.

Defined cases: a null text is empty; a null role is an empty role; repeated rows are repeated turns; turns of equal
number are ordered by role and text; a null conversation id is a conversation; an empty table gives an empty result;
other columns are not read. A conversation is one output text, so its turns meet in one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns.

    ``turns`` names a list of records with ``role`` and ``text`` fields; otherwise ``fields`` lists (role, path) in order, a
    missing or null one being left out. ``roles`` renames roles. ``ignored`` paths may be there or not.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def layouts(self) -> Iterable[frozenset[str]]:
        """Every set of paths that this mapping understands."""
        if self.turns:
            needed = {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
            free = self.ignored
        else:
            needed = {p for _, p in self.fields if p not in self.optional}
            free = self.optional + self.ignored
        for n in range(len(free) + 1):
            for some in combinations(free, n):
                yield frozenset(needed | set(some))


RENAMED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Layouts known from public instruction and chat data sets.
MAPPINGS = (
    Mapping("messages", turns="messages", ignored=("id", "source", "messages[].name")),
    Mapping("dialogue", turns="conversations", role="from", text="value", ignored=("id", "source"), roles=RENAMED),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input"), ignored=("id", "source")),
    Mapping("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",), ignored=("id", "source")),
    Mapping("completion", fields=(("user", "prompt"), ("assistant", "completion")), ignored=("id", "source")),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer")), ignored=("id", "source")),
)


def paths(value, at: str = "") -> set[str]:
    """Field paths of a parsed record; list items share ``[]``, an empty list or record is its own path."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def index(mappings: Iterable[Mapping]) -> dict[str, Mapping]:
    """Mapping by fingerprint; the first of equals wins."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for layout in m.layouts():
            out.setdefault(fingerprint(layout), m)
    return out


def field(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, m: Mapping) -> list[tuple[str, str]]:
    if m.turns:
        pairs = [(t.get(m.role), t.get(m.text)) for t in field(record, m.turns)]
    else:
        pairs = [(role, v) for role, path in m.fields if (v := field(record, path)) is not None]
    names = dict(m.roles)
    return [(names.get(r, r) if r is not None else "", v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)) for r, v in pairs]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Marked text and the spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(marked: str) -> list[tuple[str, str]]:
    """The turns of a marked text."""
    out = []
    for part in marked.split(START)[1:]:
        role, _, text = part.partition("\n")
        if not text.endswith(f"{END}\n"):
            raise ValueError("a turn without its end")
        out.append((unescape_role(role), unescape(text[: -len(END) - 1])))
    return out


_OUT = "conv_id bigint, layout string, fingerprint string, formatted string, loss array<struct<start:int,end:int>>"


def _format(batches, known: dict[str, Mapping]):
    for batch in batches:
        rows = []
        for conv, raw in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist()):
            try:
                record = json.loads(raw or "{}")
            except ValueError:
                record = {}
            mark = fingerprint(paths(record))
            m = known.get(mark)
            text, spans = render(turns_of(record, m)) if m else (None, None)
            rows.append({"conv_id": conv, "layout": m.name if m else None, "fingerprint": mark, "formatted": text, "loss": spans and [{"start": a, "end": b} for a, b in spans] if spans is not None else None})
        kind = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("fingerprint", pa.string()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        yield pa.RecordBatch.from_pylist(rows, kind)


def format_records(records: DataFrame, mappings: Iterable[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, layout, fingerprint, formatted, loss) of (conv_id, record as JSON)."""
    known = index(mappings)
    return records.select(F.col("conv_id").cast("bigint"), "record").mapInArrow(lambda b: _format(b, known), _OUT)


def records_of(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation of a table of turns, in the leanest layout that holds it: prompt and response for a
    user and an assistant turn, instruction for a system turn before these, messages for all others."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    t = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).withColumn("roles", F.col("t.role"))
    says = lambda i: F.element_at("t", i)["content"]
    record = (F.when(F.col("roles") == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(says(1).alias("prompt"), says(2).alias("response"))))
              .when(F.col("roles") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(says(1).alias("system"), says(2).alias("instruction"), says(3).alias("output"))))
              .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))))
    return t.select("conv_id", record.alias("record"))


def _digest(batches):
    for batch in batches:
        rows = []
        for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, taken from the formatted texts."""
    return formatted.where("formatted is not null").select("conv_id", "formatted", "loss").mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
