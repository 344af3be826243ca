"""Chat formatting from a declarative template, in DataFrame functions only.

A template names the marks around a turn, the roles whose text is learnt, and a finite-state
machine over the roles. ``format_chats`` gives one row per conversation: its segments in
order, each with a loss flag, the formatted text (the segments joined), and where the turn
order first breaks the machine. ``read_back`` parses the formatted text into turns again and
takes the learnt text from the flagged segments.

Escaping: the template's escape character is doubled, and put into the ``guard`` that all
control strings begin with, so no control string can stand inside a text; a role's line ends
are escaped too. Reading takes every escape character off again, so any text comes back.

A conversation travels as one row per input partition (partial lists) and is one output row,
as a training sample has to be; nothing else is grouped.

Rows go by turn, then role, then text; null turns come first. A null text or role is empty;
rows with a null conv_id are one conversation. Repeated rows are turns of their own. An
unknown or null role is formatted like any other, never learnt, and breaks the order. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: State of a conversation whose turn order is broken; nothing leads out of it.
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """Marks, learnt roles and turn order of a chat format."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    #: What every control string begins with.
    guard: str = "<|"
    escape: str = "\\"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> next state.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    #: States in which a conversation may end.
    complete: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if not (self.opening.startswith(self.guard) and self.closing.startswith(self.guard)):
            raise ValueError("control strings have to begin with the guard")
        if len(self.guard) < 2 or len(self.escape) != 1 or self.escape in self.opening + self.closing:
            raise ValueError("a guard of two characters or more, and an escape character apart from the marks")
        if self.after_role != "\n" or "\n" in self.opening:
            raise ValueError("a role ends at its line's end")


CHATML = Template()


def escaped(text: Column, template: Template) -> Column:
    """``text`` without the guard; undone by ``unescaped``."""
    e, g = template.escape, template.guard
    return F.replace(F.replace(text, F.lit(e), F.lit(e + e)), F.lit(g), F.lit(g[0] + e + g[1:]))


def escaped_role(role: Column, template: Template) -> Column:
    """A role on one line: its line ends are escaped as well."""
    return F.replace(escaped(role, template), F.lit("\n"), F.lit(template.escape + "\n"))


def unescaped(text: Column, template: Template) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, "(?s)" + re.escape(template.escape) + "(.)", "$1")


def _walk(roles: Column, template: Template) -> Column:
    """(state, turn) after all ``roles``; ``turn`` is the first one that has no move, from 0."""
    moves = F.create_map(*[
        F.lit(x) for state, by in template.moves.items() for role, then in by.items()
        for x in (f"{state}\n{role}", then)
    ])

    def step(at: Column, role: Column) -> Column:
        then = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role))
        broken = at["broken"].isNotNull() | then.isNull()
        return F.struct(
            F.when(broken, F.lit(BROKEN)).otherwise(then).alias("state"),
            (at["n"] + 1).alias("n"),
            F.when(broken, F.coalesce(at["broken"], at["n"])).alias("broken"),
        )

    begin = F.struct(
        F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken")
    )
    return F.aggregate(roles, begin, step)


def _segments(turn: Column, template: Template) -> Column:
    """Head, text and end of a turn, with their loss flags."""
    flag = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = F.concat(F.lit(template.opening), escaped_role(turn["role"], template), F.lit(template.after_role))
    return F.array(
        flag(head, F.lit(False)),
        flag(escaped(turn["text"], template), turn["role"].isin(*template.learnt)),
        flag(F.lit(template.closing), F.lit(False)),
    )


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, segments, formatted, state, broken_at, valid) of every conversation."""
    turns = rows.select(
        c("conv_id").cast("long").alias("conv_id"),
        F.struct(
            c("turn").cast("long").alias("turn"), F.coalesce(c("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(c("text").cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    made = chats.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda x: _segments(x, template))).alias("segments"),
        _walk(F.transform("turns", lambda x: x["role"]), template).alias("walk"),
    )
    return made.select(
        "conv_id", "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        c("walk.state").alias("state"), c("walk.broken").alias("broken_at"),
        c("walk.state").isin(*template.complete).alias("valid"),
    )


def parsed_turns(formatted: Column, template: Template = CHATML) -> Column:
    """(role, text) of the turns of a formatted text."""
    e = re.escape(template.escape)
    head = rf"(?s)^((?:[^{e}\n]++|{e}.)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, head, 1)
        skip = F.length(role) + 1
        text = F.substr(piece, skip + 1, F.length(piece) - skip - len(template.closing))
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    # Java's quoting, so the mark is no pattern; what stands before the first mark is empty.
    pieces = F.split(formatted, rf"\Q{template.opening}\E", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_back(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turns, learnt, formatted_chars, valid, broken_at), from the output alone."""
    spoken = F.filter("segments", lambda x: x["loss"])
    return chats.select(
        "conv_id", parsed_turns(c("formatted"), template).alias("turns"),
        F.array_join(F.transform(spoken, lambda x: unescaped(x["text"], template)), "").alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "broken_at",
    )


def report(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """Counts and digests of what reading the formatted conversations gives."""
    back = read_back(format_chats(rows, template), template)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(c("learnt"), 256).alias("loss_sha256"),
        "formatted_chars", "valid",
    )
