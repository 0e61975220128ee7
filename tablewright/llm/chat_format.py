"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record's nested field paths are hashed; the hash selects the mapping of a layout. Mappings are data:
where the turns are, which fields hold role and text, and how roles are named. Canonical turns are
put into a template that marks each turn; control strings inside texts and roles are escaped
reversibly, so the output can be read back without knowing the input.

A formatted conversation is a sequence of parts, one a turn, in order: nothing needs a whole
conversation in memory, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

#: Fields that say nothing about the layout.
IGNORED = ("id", "source", "lang")

#: Layouts by name: paths that a record must have, paths that it may have, how roles are renamed, and either a
#: list of turns or parts that each become a turn.
LAYOUTS = {
    "turn": {"paths": ["role", "text"], "may": [], "turns": [], "role": "role", "text": "text"},
    "messages": {"paths": ["messages"], "may": ["messages[].content", "messages[].role"], "turns": ["messages"], "role": "role", "text": "content"},
    "shared": {"paths": ["conversations"], "may": ["conversations[].from", "conversations[].value"], "turns": ["conversations"], "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    "instruction": {"paths": ["instruction", "output"], "may": ["input"], "parts": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "prompt": {"paths": ["completion", "prompt"], "may": [], "parts": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "question": {"paths": ["answer", "question"], "may": ["system"], "parts": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])]},
}


def field_paths(record, at: str = "") -> set[str]:
    if isinstance(record, dict):
        out = set()
        for name, value in record.items():
            if at or name not in IGNORED:
                path = f"{at}.{name}" if at else name
                out |= {path} | field_paths(value, path)
        return out
    if isinstance(record, list):
        return set().union(*(field_paths(x, at + "[]") for x in record)) if record else set()
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_BY_PRINT = {fingerprint({*x["paths"], *some}): name for name, x in LAYOUTS.items() for n in range(len(x["may"]) + 1) for some in combinations(x["may"], n)}
_KNOWN = {p for x in LAYOUTS.values() for p in x["paths"] + x["may"]}


def layout_of(record) -> str | None:
    """The layout whose fingerprint the record's paths have; else, without paths that no layout knows; else the one with the most of its paths there."""
    paths = field_paths(record)
    name = _BY_PRINT.get(fingerprint(paths)) or _BY_PRINT.get(fingerprint(paths & _KNOWN))
    if name is None:
        held = [(len(x["paths"]) + len(paths & set(x["may"])), n) for n, x in LAYOUTS.items() if paths >= set(x["paths"])]
        name = max(held, key=lambda x: x[0])[1] if held else None
    return name


def canonical(record) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns as (role, text)); an unknown layout is None and has no turns. Null texts are empty; empty parts are left out."""
    name = layout_of(record)
    if name is None:
        return None, []
    layout, show = LAYOUTS[name], lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x)
    if "parts" in layout:
        parts = [(role, "\n".join(t for f in fields if (t := show(record.get(f))))) for role, fields in layout["parts"]]
        return name, [p for p in parts if p[1]]
    turns = [record] if not layout["turns"] else record[layout["turns"][0]] or []
    roles = layout.get("roles", {})
    return name, [(roles.get(r := show(t.get(layout["role"])), r), show(t.get(layout["text"]))) for t in turns]


#: The template's control strings: an assistant's turn, and any other turn.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled, and a control string gets a single one after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(part, from, to): the template's text of a turn, and the code points under the loss mask."""
    if role == "assistant":
        body = escape(text)
        return f"<s>{body}</s>", 3, 3 + len(body)
    return f"[INST]{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}[/INST]", 0, 0


def read_turn(part: str) -> tuple[str, str]:
    m = _TURN.fullmatch(part)
    if m[1] is not None:
        return "assistant", unescape(m[1])
    return unescape(re.sub(r"(?<!\\)((?:\\\\)*)\\n", r"\1" + "\n", m[2])), unescape(m[3])


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, sub, layout, role, text, reason) of records (conv_id, turn, record as JSON).

    A record without a turn is kept as one row without role and text; reason says why: not an object in
    JSON, no known layout, or no turns in it.
    """

    def run(batches):
        for b in batches:
            out = []
            for conv, turn, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    record = json.loads(raw)
                    layout, turns = canonical(record)
                    reason = "unknown layout" if layout is None else "no turns"
                    reason = reason if isinstance(record, dict) else "not an object"
                except (TypeError, ValueError, AttributeError, RecursionError):
                    layout, turns, reason = None, [], "not readable"
                out += [(conv, turn, i, layout, r, t, None) for i, (r, t) in enumerate(turns)] or [(conv, turn, 0, layout, None, None, reason)]
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "turn", "sub", "layout", "role", "text", "reason"])

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("record")).mapInArrow(run, "conv_id long, turn long, sub int, layout string, role string, text string, reason string")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, sub, part, loss_from, loss_to, reason): a conversation is its parts in the order of turn and sub.

    A row with a reason has no part; it stays, so that no record is lost without a trace.
    """

    def run(batches):
        for b in batches:
            parts = [(None, None, None) if why else format_turn(r or "", t or "") for r, t, why in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)))]
            part, low, high = zip(*parts) if parts else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(part, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), b.column(5)], names=["conv_id", "turn", "sub", "part", "loss_from", "loss_to", "reason"])

    return turns.select("conv_id", "turn", "sub", "role", "text", "reason").mapInArrow(run, "conv_id long, turn long, sub int, part string, loss_from int, loss_to int, reason string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone.

    Conversations are dealt by id and streamed in order; hashes run along, so a conversation that
    holds a third of all turns needs no memory (a digest of one text is one stream, whoever reads it).
    Rows without a part count for no turn; a conversation of nothing else has no turns.
    """

    def run(batches):
        now, state, out = object(), None, []

        def close():
            if state:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, part, low, high in zip(*(b.column(i).to_pylist() for i in range(4))):
                if conv != now or state is None:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if part is None:
                    continue
                role, text = read_turn(part)
                under = unescape(part[low:high])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(part)
            if len(out) > 1000:
                yield batch(out)
                out.clear()
        close()
        if out:
            yield batch(out)

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _DIGEST.split(", ")])

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "sub", "part")
    return dealt.select("conv_id", "part", "loss_from", "loss_to").mapInArrow(run, _DIGEST)


def format_records(records: DataFrame) -> DataFrame:
    """Digests of the formatted conversations of records (conv_id, turn, record as JSON) in any of the layouts.

    Records of a conversation follow each other by ``turn`` (null first, ties by their formatted text). Records
    without a readable turn add nothing, but their conversation stays. An empty table gives an empty result.
    """
    prepare(records.sparkSession)
    return read_back(format_turns(canonical_turns(records)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of the formatted conversations of a table of turns (conv_id, turn, role, text; others are ignored).

    A null text or role is empty, roles are kept as they are; turns are in the order of ``turn`` (null first,
    ties by their formatted text); repeated rows are turns of their own. Rows without conv_id are one
    conversation. An empty table gives an empty result.
    """
    record = F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")), {"ignoreNullFields": "false"})
    return format_records(conversations.select("conv_id", "turn", record.alias("record")))
