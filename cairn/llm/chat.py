"""Chat formatting: a declared template and a machine over roles turn conversations into text segments with loss flags.

Built-in column functions only.  A conversation is one row here, since its formatted text is one value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import pick

_TURN = T.StructType([T.StructField(c, t) for c, t in (("role", T.StringType()), ("text", T.StringType()))])


@dataclass(frozen=True)
class Template:
    """How turns are marked, which texts count for the loss, and which role may follow which.

    `marks` maps a role to what stands before and after its text; any other role is written between
    `other` and `named`.  Control strings start with `<` or `[` and hold neither elsewhere, nor `escape`.
    `follows` maps (state, role) to the next state; a role is a state too, and after a turn that no entry
    allows the machine goes on from that turn's role.
    """

    start: str = "<s>"
    end: str = "</s>"
    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("[ANS]", "[/ANS]"),
        }
    )
    other: str = "[ROLE]"
    named: str = "[/ROLE]"
    escape: str = "\\"
    loss: frozenset[str] = frozenset({"assistant"})
    begin: str = "begin"
    follows: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    complete: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        return [self.start, self.end, self.other, self.named, *(m for pair in self.marks.values() for m in pair)]


CHAT = Template()


def escaped(text: Column, template: Template = CHAT) -> Column:
    """text without control strings: the escape character twice, and once after the first character of a control string."""
    rest = "|".join(re.escape(c[1:]) for c in template.controls())
    twice = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    return F.regexp_replace(twice, rf"([<\[])(?=(?:{rest}))", "$1" + re.escape(template.escape))


def unescaped(text: Column, template: Template = CHAT) -> Column:
    """What escaped() was given."""
    mark = re.escape(template.escape)
    return F.regexp_replace(text, f"{mark}({mark}?)", "$1")


def _of(template: Template, role: Column, of_known: int) -> Column:
    """The mark before (0) or after (1) the text of a role."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pair in template.marks.items():
        out = out.when(role == name, pair[of_known])
    if of_known:
        return out.otherwise("")
    return out.otherwise(F.concat(F.lit(template.other), escaped(role, template), F.lit(template.named)))


def segments(turns: Column, template: Template = CHAT) -> Column:
    """array<struct(text, loss)> of turns (array<struct(role, text)>): marks, and each text by itself, escaped.

    Joined, the texts are the formatted conversation.  Only texts of the template's loss roles carry the flag.
    """

    def of_turn(t: Column) -> Column:
        role = t["role"]
        mark = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escaped(t["text"], template).alias("text"), role.isin(*template.loss).alias("loss"))
        return F.array(
            mark(F.concat(F.lit(template.start), _of(template, role, 0))),
            body,
            mark(F.concat(_of(template, role, 1), F.lit(template.end))),
        )

    return F.flatten(F.transform(turns, of_turn))


def order_faults(turns: Column, template: Template = CHAT) -> Column:
    """struct(n_faults, first_fault, complete): turns out of order, the place of the first (from 0), a complete end."""
    allowed = F.create_map(
        *(x for (state, role), to in template.follows.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to)))
    )
    begin = F.struct(
        F.lit(template.begin).alias("state"),
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("first"),
        F.lit(0).cast("long").alias("at"),
    )

    def turn(s: Column, t: Column) -> Column:
        to = F.element_at(allowed, F.concat(s["state"], F.lit("\n"), t["role"]))
        return F.struct(
            F.coalesce(to, t["role"]).alias("state"),
            (s["n"] + to.isNull().cast("long")).alias("n"),
            F.when(s["first"].isNull() & to.isNull(), s["at"]).otherwise(s["first"]).alias("first"),
            (s["at"] + 1).alias("at"),
        )

    return F.aggregate(
        turns,
        begin,
        turn,
        lambda s: F.struct(
            s["n"].alias("n_faults"), s["first"].alias("first_fault"), s["state"].isin(*template.complete).alias("complete")
        ),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct(role, text)> of a formatted conversation, the inverse of joined segments()."""
    parts = F.split(formatted, re.escape(template.end), -1)

    def turn(part: Column) -> Column:
        inner = F.substr(part, F.lit(len(template.start) + 1))
        out = F.when(F.lit(False), F.lit(None).cast(_TURN))
        pair = lambda role, text: F.struct(role.alias("role"), unescaped(text, template).alias("text"))
        for name, (before, after) in template.marks.items():
            text = F.substr(inner, F.lit(len(before) + 1), F.length(inner) - len(before) - len(after))
            out = out.when(F.startswith(inner, F.lit(before)), pair(F.lit(name), text))
        named = F.substring_index(F.substr(inner, F.lit(len(template.other) + 1)), template.named, 1)
        text = F.substr(inner, F.length(named) + len(template.other) + len(template.named) + 1)
        return out.otherwise(pair(unescaped(named, template), text))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_chats(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, formatted, segments, n_faults, first_fault, complete: one row per conversation (conv_id, turn, role, text).

    Turns out of order are formatted like any other and counted.  Rows stand by turn, those without one
    first, equal turns by role and text; repeated rows are turns of their own.  Null roles and texts
    are empty; rows without conv_id are one conversation; an empty table gives no rows.  Any other column
    stays behind.
    """
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    # A conversation's formatted text is one value, so its rows meet in one row here.
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    made = whole.select("conv_id", segments(F.col("turns"), template).alias("segments"), order_faults(F.col("turns"), template).alias("f"))
    return made.select(
        "conv_id",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        F.col("f.n_faults").alias("n_faults"),
        F.col("f.first_fault").alias("first_fault"),
        F.col("f.complete").alias("complete"),
    )


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of format_chats()'s result: the turns read from the formatted text, what the loss flags select."""
    turns = F.transform(
        read_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    selected = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    read = formatted.select(
        "conv_id", turns.alias("turns"), F.array_join(selected, "").alias("loss"), "formatted", "n_faults", "first_fault", "complete"
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_faults",
        "first_fault",
        "complete",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations, and conversation -1, whose two texts are made of control strings."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").unionByName(probe)
