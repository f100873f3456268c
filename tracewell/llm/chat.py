"""Chat formatting: a role automaton and a declarative template, in column functions only.

A conversation's turns, in order, run through a finite-state machine that says whether the order of
roles is allowed, and become text segments. Each segment says whether its text counts in the loss.
Control strings inside a text are escaped and can be recovered, so a text can't forge a turn.

Defined results: a null role or text is the empty string; a null conversation id is one conversation;
turns with equal numbers are ordered by role, then text; a repeated row is a turn of its own; an
empty table gives no rows. Roles that the automaton doesn't know make a conversation invalid, but it
is formatted all the same. Other columns of the input are not read.

One conversation becomes one text, so its turns meet in one row; it must fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the roles whose text counts in the loss, and the role automaton.

    ``moves`` lists (state, role, next state). The first state is ``start``; a conversation is
    valid if every role has a move and it ends in a state of ``accept``. Both marks begin with
    ``<|``, the control string that is escaped inside texts.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    accept: tuple[str, ...] = ("answered",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "instructed"),
        ("begin", "user", "asked"),
        ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )


CHATML = Template()


def escape(text: Column) -> Column:
    r"""One backslash more after a ``<`` that begins ``<|``, ``<\|``, ``<\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role stays on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _walk(turns: Column, template: Template) -> Column:
    """Folds the roles through the automaton: the last state and the first turn without a move."""
    moves = F.create_map(*[F.lit(x) for state, role, after in template.moves
                           for x in (f"{state}/{role}", after)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("bigint").alias("at"),
                     F.lit(None).cast("bigint").alias("bad"))

    def step(acc, turn):
        after = F.element_at(moves, F.concat(acc["state"], F.lit("/"), turn["role"]))
        return F.struct(
            F.coalesce(after, F.lit("error")).alias("state"), (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(after.isNull(), acc["at"])).alias("bad"))

    return F.aggregate(turns, begin, step)


def format_conversations(
    rows: DataFrame,
    template: Template = CHATML,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``segments`` (text, loss), ``valid``
    and ``bad_turn``, the position from 0 of the first turn without a move."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (
        rows.select(F.col(conv).alias("conv_id"),
                    F.struct(F.col(turn).alias("turn"), blank(role).alias("role"),
                             blank(text).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.open), _escape_role(t["role"]), F.lit("\n")), F.lit(False)),
        segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.close + "\n"), F.lit(False)))))
    return (
        turns.withColumns({"segments": segments, "_walk": _walk(F.col("turns"), template)})
        .select("conv_id",
                F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                "segments",
                (F.col("_walk.bad").isNull() & F.col("_walk.state").isin(*template.accept))
                .alias("valid"),
                F.col("_walk.bad").alias("bad_turn")))


def parse_formatted(formatted: Column, template: Template = CHATML) -> Column:
    """The turns (role, text) that a formatted text stands for."""
    tail = template.close + "\n"
    pattern = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.open)

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        at = F.length(role) + 2
        body = F.substring(piece, at, F.length(piece) - at + 1 - len(tail))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, pattern, -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
