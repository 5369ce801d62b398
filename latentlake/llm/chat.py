"""Chat formatting with a finite-state machine and a declarative template.

A template names the roles, what is written before and after a turn, which roles are learnt from, and which role may
follow which. Conversations are formatted turn by turn: rows are dealt by conversation, sorted by turn and streamed
through the tasks, so a conversation of any length needs the memory of a few turns. Every turn gives three segments
(opening, body, closing) with a loss flag each; the machine's verdict comes with them.

Control strings cannot occur in a body: backslashes, hash signs and slashes after '<' are escaped with a backslash and
restored when the output is read back.

Nulls and edges: null texts are empty; a null role is a role of its own, marked '?'; null conversation ids form one
conversation; rows without turn come first; rows of equal turn are ordered by role and text, so repeated rows repeat; an
empty table gives no segments. Unknown roles are formatted and make the conversation invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### {role}: "
    close: str = "</turn>\n"
    shown: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learnt: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)


TEMPLATE = Template()
SEGMENTS = "conv_id {id}, turn_no long, part int, role string, segment string, loss boolean, in_order boolean"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def shown_role(role: str | None, t: Template) -> str:
    """Known roles by their shown name; others in brackets, null as a question mark."""
    if role is None:
        return "?"
    return t.shown[role] if role in t.shown else "[" + escape(role).replace("]", "\\]") + "]"


def read_turn(s: str, t: Template) -> tuple[str | None, str]:
    """(role, text) of one formatted turn."""
    before, after = t.open.split("{role}")
    if not s.startswith(before) or not s.endswith(t.close):
        raise ValueError("not a formatted turn")
    at = len(before)
    if s.startswith("?" + after, at):
        role, at = None, at + 1
    elif s.startswith("[", at):
        m = re.compile(r"\[((?:[^\\\]]|\\.)*)\]", re.S).match(s, at)
        role, at = unescape(m[1]), m.end()
    else:
        name = s[at:s.index(after, at)]
        role, at = next(k for k, v in t.shown.items() if v == name), at + len(name)
    body = s[at + len(after):len(s) - len(t.close)]
    if t.close.strip() in body or before.strip() in body:
        raise ValueError("control string inside a turn")
    return role, unescape(body)


def allowed(state: str, role: str | None, t: Template) -> bool:
    return role in t.follows.get(state, ())


def _same(a, b) -> bool:
    return a is b or a == b or (pd.isna(a) and pd.isna(b))


def segments(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn_no, part, role, segment, loss, in_order) in the order of the output within each partition.

    ``turns`` has conv_id, turn, role, text. in_order is the machine's verdict on the turn. A conversation is valid if all
    of its turns are in order and the last one's role is final.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, number, begun = None, "start", 0, False
        for b in batches:
            out = []
            for conv, role, text in zip(b["conv_id"].tolist(), b["role"].tolist(), b["text"].tolist()):
                role = None if role is None or role != role else role
                if not begun or not _same(conv, now):
                    now, state, number, begun = conv, "start", 0, True
                good = allowed(state, role, template)
                loss = role in template.learnt
                for part, (s, flag) in enumerate(((template.open.replace("{role}", shown_role(role, template)), False), (escape(text), loss), (template.close, False))):
                    out.append((conv, number, part, role, s, flag, good))
                state, number = role if role is not None else "?", number + 1
            yield pd.DataFrame(out, columns=["conv_id", "turn_no", "part", "role", "segment", "loss", "in_order"])

    return rows.mapInPandas(run, SEGMENTS.format(id=kind))


def read_back(parts: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests per conversation, from the segments alone (as ``segments`` gives them, or written and read again).

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid)
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    rows = parts.select("conv_id", "turn_no", "part", "segment", "loss", "in_order").repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, acc, turn = None, False, None, []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": 0, "learnt": hashlib.sha256(), "chars": 0, "ok": True, "last": None}

        def ended():
            return (now, acc["n"], acc["turns"].hexdigest(), acc["loss"], acc["learnt"].hexdigest(), acc["chars"], acc["ok"] and acc["last"] in template.final)

        for b in batches:
            out = []
            for conv, _, part, s, loss, good in b.itertuples(index=False):
                if not begun or not _same(conv, now):
                    if begun:
                        out.append(ended())
                    now, begun, acc, turn = conv, True, fresh(), []
                acc["chars"] += len(s)
                acc["ok"] &= bool(good)
                if loss:
                    plain = unescape(s)
                    acc["loss"] += len(plain)
                    acc["learnt"].update(plain.encode())
                turn.append(s)
                if part == 2:
                    role, text = read_turn("".join(turn), template)
                    acc["turns"].update(f"{role if role is not None else ''}\n{text}\n".encode())
                    acc["n"], acc["last"], turn = acc["n"] + 1, role, []
            if out:
                yield pd.DataFrame(out)
        if begun:
            yield pd.DataFrame([ended()])

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return rows.mapInPandas(run, schema)
