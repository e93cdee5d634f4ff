"""Chat formatting: layouts recognised by their field paths, canonical turns, a marked template.

A record is JSON text. The sorted paths of its non-null leaves (``messages[].role``) are
hashed; the fingerprint picks a declared mapping, which yields canonical turns. The template
marks each turn's start, role and end. Control strings in texts are escaped reversibly: every
``<``, backslashes, ``|`` gets one more backslash, so ``<|`` occurs in the output at marks only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_MARKED = re.compile(r"<\|im_start\|>([^\n]*)\n((?:[^<]++|<(?!\|))*+)<\|im_end\|>\n")


@dataclass(frozen=True)
class Mapping:
    """``paths`` a record must have and ``optional`` ones; ``turns``: role and the paths joined to its text,
    or with ``each``: the list whose items are turns, with the names of their role and text fields.
    """

    name: str
    paths: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Mapping("turn", optional=("role", "text"), each=("", "role", "text")),
    Mapping("prompt", paths=("prompt", "response"), optional=("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", paths=("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", paths=("instruction", "output"), optional=("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", optional=("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Mapping("conversations", paths=("conversations[].from",), optional=("conversations[].value",), each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
)


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")}
    return set() if value is None else {at}


def registry(layouts: tuple[Mapping, ...] = LAYOUTS) -> dict[str, Mapping]:
    """Fingerprints of each layout with each choice of its optional fields; the first layout wins.

    A record without any field set has no layout, so it becomes no turn.
    """
    found: dict[str, Mapping] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for chosen in combinations(layout.optional, n):
                if layout.paths or chosen:
                    found.setdefault(fingerprint({*layout.paths, *chosen}), layout)
    return found


def turns_of(record: dict, layout: Mapping) -> Iterator[tuple[str, str]]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.each:
        inside, role, said = layout.each
        for item in record.get(inside) or [] if inside else [record]:
            own = text((item or {}).get(role))
            yield layout.roles.get(own, own), text((item or {}).get(said))
    else:
        for role, paths in layout.turns:
            parts = [text(record[p]) for p in paths if record.get(p) is not None]
            if parts:
                yield role, "\n\n".join(parts)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the span of its text, in code points, if the loss counts there; else an empty span."""
    head, body = f"{START}{_escape_role(role)}\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return (head + body + END, *span)


def parsed_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they went in."""
    found, at = [], 0
    for m in _MARKED.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn starts at {at}")
        found.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn starts at {at}")
    return found


TURNS = "conv_id long, turn long, part int, fingerprint string, layout string, formatted string, loss_start int, loss_end int"


def chat_formatted(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, record`` to one row per canonical turn, with its marked text and loss span.

    A conversation's text is its rows' ``formatted`` in the order of turn, part and text, so
    no conversation needs to fit into one row. Defined cases: null texts and roles are empty;
    a record that is not a JSON object, has no field set, or whose fingerprint has no mapping,
    gives one row with null ``layout`` and ``formatted`` and its fingerprint; repeated records give repeated
    turns; null ids are one conversation; empty tables give an empty result.
    """
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, raw in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
                try:
                    record = json.loads(raw or "")
                except ValueError:
                    record = None
                print_ = fingerprint(field_paths(record)) if isinstance(record, dict) else None
                layout = known.get(print_)
                if layout is None:
                    rows.append((conv, turn, 0, print_, None, None, None, None))
                    continue
                for part, (role, text) in enumerate(turns_of(record, layout)):
                    rows.append((conv, turn, part, print_, layout.name, *formatted_turn(role, text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "part", "fingerprint", "layout", "formatted", "loss_start", "loss_end"])

    return records.select("conv_id", "turn", "record").mapInArrow(run, TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back, a conversation's in order, and digest what they say.

    Conversations stream through their task turn by turn: only running digests are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = said = loss = None
        n = chars = total = 0
        rows: list[tuple] = []

        def done() -> None:
            if said is not None:
                rows.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), total))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for own, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if said is None or own != conv:
                    done()
                    conv, n, chars, total, said, loss = own, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, spoken in parsed_turns(text):
                    n += 1
                    said.update(f"{role}\n{spoken}\n".encode())
                masked = unescape(text[a:b])
                chars, total = chars + len(masked), total + len(text)
                loss.update(masked.encode())
            yield out()
            rows = []
        done()
        yield out()

    order = ["conv_id", "turn", "part", "formatted"]
    rows = turns.where("formatted IS NOT NULL").select("conv_id", "turn", "part", "formatted", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, DIGESTS)
