"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Segments of a turn, in order, and the turn orders that are valid.

    ``segments`` holds (kind, string, loss): kind ``mark`` is a control string,
    ``role`` and ``text`` stand for the turn's values. A segment has loss when its
    flag is set and the turn's role is in ``loss_roles``. A turn starts with the
    mark ``open`` and ends with the mark ``close``; all marks contain ``<|`` or
    are one newline, so an escaped text holds no mark.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    segments: Sequence[tuple[str, str, bool]] = (
        ("mark", "<|im_start|>", False), ("role", "", False), ("mark", "\n", False),
        ("text", "", True), ("mark", "<|im_end|>", False), ("mark", "\n", False),
    )
    loss_roles: Sequence[str] = ("assistant",)
    start: str = "start"
    moves: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("tool", "assistant"),
    })
    final: Sequence[str] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """Text without ``<|``: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` got. After ``<`` a lone backslash can only be an inserted one."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """``escape``, and newlines become ``<\\n``: a role ends at the first newline."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(unescape_marks(role), F.lit("\\\\"), F.lit("\\"))


def unescape_marks(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("<\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))


def walk(roles: Column, template: Template = CHATML) -> Column:
    """State after each role, the start included; ``invalid`` from the first wrong turn on."""
    moves = {f"{state}\n{role}": role for state, after in template.moves.items() for role in after}
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in moves.items()))

    def step(states: Column, role: Column) -> Column:
        key = F.concat(F.element_at(states, -1), F.lit("\n"), role)
        return F.concat(states, F.array(F.coalesce(F.try_element_at(table, key), F.lit("invalid"))))

    return F.aggregate(roles, F.array(F.lit(template.start)), step)


def format_conversations(
    turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: segments with loss flags, the formatted string and the verdict.

    Columns: ``conv``, n_turns, segments (array of turn number, kind, string, loss),
    formatted, valid (the roles walk from start to a final state), bad_turn (number
    of the first wrong turn from 0; the number of turns when only the end is wrong;
    null when valid). Invalid conversations are formatted too.

    Turns are ordered by ``turn`` (null first), then role, then text, so ties and
    repeated rows have one order; repeated rows are turns of their own. Null texts
    and roles are empty; rows with a null ``conv`` form one conversation. No rows,
    no result. A conversation is one string by nature, so its turns meet in one row;
    nothing else is gathered.
    """
    rows = turns.select(
        turns[conv].alias(conv), turns[turn].alias("n"), F.coalesce(turns[role], F.lit("")).alias("r"),
        F.coalesce(turns[text], F.lit("")).alias("t"),
    )
    each = rows.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct("n", "r", "t"))).alias("turns"))
    each = each.select(conv, "turns", walk(F.transform("turns", lambda x: x["r"]), template).alias("states"))

    def of_turn(x: Column, i: Column) -> Column:
        parts = []
        for kind, mark, loss in template.segments:
            said = {"mark": F.lit(mark), "role": escape_role(x["r"]), "text": escape(x["t"])}[kind]
            flag = x["r"].isin(list(template.loss_roles)) if loss else F.lit(False)
            parts.append(F.struct(i.alias("turn"), F.lit(kind).alias("kind"), said.alias("string"), flag.alias("loss")))
        return F.array(*parts)

    first_bad = F.array_position("states", "invalid") - 2
    ends_well = F.element_at("states", -1).isin(list(template.final))
    bad = F.when(first_bad >= 0, first_bad).when(~ends_well, F.size("turns").cast("long"))
    return each.select(
        conv, F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"), bad.alias("bad_turn"),
    ).select(
        conv, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["string"]), "").alias("formatted"),
        F.col("bad_turn").isNull().alias("valid"), "bad_turn",
    )


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Array of (role, text) read from a formatted string; the inverse of formatting."""
    pieces = F.filter(F.split(formatted, "\\Q" + template.open + "\\E"), lambda _, i: i > 0)

    def read(piece: Column) -> Column:
        name = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.char_length(name) + 2)
        return F.struct(
            unescape_role(name).alias("role"),
            unescape(F.substring_index(rest, template.close, 1)).alias("text"),
        )

    return F.transform(pieces, read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, segment by segment."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["string"])), "")
