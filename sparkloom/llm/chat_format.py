"""Chat formatting with DataFrame functions only.

A declarative template names the marks of a turn, the roles under the loss and
the transitions of a finite-state machine over roles. A conversation becomes a
list of text segments, each with its loss flag; their texts joined are the
formatted conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``before`` and ``after`` enclose a turn's text; ``{role}`` stands for its role.

    ``escapes`` replaces, in this order, the characters from which the marks
    are made, so that no text or role can hold a mark; undone in reverse order.
    """

    before: tuple[str, str] = ("<|", "|>\n")
    after: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;"))
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        for char, instead in self.escapes:
            text = F.replace(text, F.lit(char), F.lit(instead))
        return text

    def unescape(self, text: Column) -> Column:
        for char, instead in reversed(self.escapes):
            text = F.replace(text, F.lit(instead), F.lit(char))
        return text


def _quoted(mark: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in mark)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each ``conv_id`` of ``turns(conv_id, turn, role, text, ...)``.

    Returns ``conv_id, n_turns, segments, formatted, state, valid``: segments is
    an array of ``(text, loss)``, state the last state of the machine (``error``
    once a role had no transition), valid whether it accepts. Conversations with
    a wrong order are formatted all the same and only flagged.

    Rows are ordered by turn, then role, then text (null turns first); null
    roles and texts are empty; repeated rows are turns of their own; rows with a
    null conv_id form one conversation. A conversation is one output value, so
    its turns meet in one task; nothing larger does. Very long texts are taken
    whole; an empty table gives an empty result; other columns are not read, so
    their names don't matter.
    """
    t = template or Template()
    empty = F.lit("")
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    never = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda r: F.array(
        segment(F.concat(F.lit(t.before[0]), t.escape(r["role"]), F.lit(t.before[1])), never),
        segment(t.escape(r["text"]), r["role"].isin(*t.loss_roles)),
        segment(F.lit(t.after), never),
    )))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}>{role}", to)])
    state = F.aggregate("turns", F.lit(t.start), lambda at, r: F.coalesce(F.try_element_at(moves, F.concat(at, F.lit(">"), r["role"])), F.lit("error")))
    return grouped.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), state.alias("state")
    ).select(
        "conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "state", F.col("state").isin(*t.accepting).alias("valid"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, as an array of ``(role, text)``."""
    t = template or Template()
    parts = F.split(formatted, _quoted(t.after))
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        halves = F.split(part, _quoted(t.before[1]), 2)
        role = F.substring(halves[0], len(t.before[0]) + 1, 1 << 30)
        return F.struct(t.unescape(role).alias("role"), t.unescape(halves[1]).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
