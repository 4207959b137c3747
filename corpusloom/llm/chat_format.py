"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions.

``format_conversations`` returns one row per conversation: the text segments with their loss
flags, the formatted text, and whether the machine accepts the order of turns. ``read_back``
parses formatted text into turns again.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text is
empty; a null conv_id is one conversation; repeated rows are repeated turns; an order that the
machine rejects is formatted all the same, with ``valid`` false and the index of the first
rejected turn; an empty table gives no row. Columns other than the four named ones are ignored.
One conversation is one output string, so its turns meet in one row; turns are gathered once,
with partial gathering before the shuffle, and every step on them is linear in their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, control strings to escape, roles under the loss mask, and role order.

    ``opening`` + role + ``role_end`` + text + ``closing`` is one turn. ``control`` is a pattern
    of two groups, first character and rest, of every string that must not occur inside a text;
    an escape character goes between the two, and every escape character is doubled.
    """

    opening: str = "<s>"
    role_end: str = "\n"
    closing: str = "</s>"
    after: str = "\n"
    control: str = r"([<\[])(/?s>|/?INST\])"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


def escape(text: Column, t: Template) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), t.control, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column, t: Template) -> Column:
    """As a text, with line feeds written as an escape character and an n."""
    return F.replace(escape(role, t), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(
        F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\"
    )


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, first_error, segments (array of text, loss), formatted."""
    t = template or Template()
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    step = F.create_map(*[F.lit(x) for (s, r), to in t.transitions.items() for x in (f"{s}\n{r}", to)])
    # a rejected turn leaves the state and sets the first error; the machine goes on in the role's own state
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("error")),
        lambda acc, x: F.struct(
            F.coalesce(F.try_element_at(step, F.concat(acc["state"], F.lit("\n"), x["role"])), x["role"]).alias("state"),
            (acc["i"] + 1).alias("i"),
            F.when(acc["error"].isNotNull(), acc["error"])
            .when(F.try_element_at(step, F.concat(acc["state"], F.lit("\n"), x["role"])).isNull(), acc["i"])
            .alias("error"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(
                    F.concat(F.lit(t.opening), escape_role(x["role"], t), F.lit(t.role_end)).alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.closing + t.after).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        machine.alias("fsm"),
        segments.alias("segments"),
    )
    return out.select(
        "conv_id",
        "n_turns",
        (F.col("fsm.error").isNull() & F.col("fsm.state").isin(*t.accepting)).alias("valid"),
        F.col("fsm.error").alias("first_error"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Turns (array of role, text) parsed from formatted text alone."""
    t = template or Template()
    pieces = F.slice(F.split(formatted, _quoted(t.closing + t.after), -1), 1, F.greatest(F.size(F.split(formatted, _quoted(t.closing + t.after), -1)) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate(t.role_end, p)
        head = F.substring(p, F.lit(len(t.opening) + 1), at - F.lit(len(t.opening) + 1))
        return F.struct(
            unescape_role(head).alias("role"),
            unescape(F.substring(p, at + F.lit(len(t.role_end)), F.length(p))).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"
