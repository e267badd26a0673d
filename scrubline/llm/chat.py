"""Chat formatting: a declarative template and a finite-state machine over roles, in SQL functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open`` label ``: `` text ``close`` newline for each turn.

    ``labels`` names the roles; any other role stands behind an ``@`` by its own
    name.  ``steps`` are the transitions of the role machine, ``ends`` the states
    in which a conversation may stop.  Texts of ``loss`` roles are learned.
    """

    open: str = "###"
    close: str = "</turn>"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    start: str = "start"
    steps: tuple = (("start", "system", "briefed"), ("start", "user", "asked"), ("briefed", "user", "asked"),
                    ("asked", "assistant", "answered"), ("answered", "user", "asked"))
    ends: tuple = ("answered",)


TEMPLATE = Template()
#: the state from which no step leads on
_BROKEN = ""


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    r"""Backslashes are doubled, and one goes behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (template.open, template.close):
        out = F.regexp_replace(out, f"(?<={re.escape(mark[0])})(?={re.escape(mark[1:])})", r"\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column, template: Template) -> Column:
    named = F.element_at(_map(template.labels.items()), role)
    other = F.concat(F.lit("@"), F.replace(escaped(role, template), F.lit(":"), F.lit("\\:")))
    return F.concat(F.lit(template.open + " "), F.coalesce(named, other), F.lit(": "))


def format_chats(turns: DataFrame, template: Template = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, valid, broken_at, segments, formatted) for every conversation.

    ``segments`` are the pieces of the formatted text in order, each with its
    loss flag; only a loss role's own text has it.  ``valid`` tells whether the
    role machine accepts the conversation, ``broken_at`` at which turn (from 0)
    it first stopped accepting; conversations that it rejects are formatted all
    the same.

    Turns go by ``turn``, ties by role and text; repeated rows are turns of their
    own.  Null roles and texts are empty, a null turn comes first, rows with a
    null id are one conversation.  A conversation is one row of output, so its
    turns meet in one task, pre-gathered by the tasks that read them.  Other
    columns are not read.  An empty table gives an empty result.
    """
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    chats = turns.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    chats = chats.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    steps = _map([(f"{a}\n{role}", b) for a, role, b in template.steps])
    # state and the number of turns accepted so far
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"))

    def step(acc, t):
        to = F.coalesce(F.element_at(steps, F.concat(acc["state"], F.lit("\n"), t["role"])), F.lit(_BROKEN))
        return F.struct(to.alias("state"), (acc["n"] + (to != _BROKEN).cast("int")).alias("n"))

    ended = F.aggregate("turns", start, step)

    def pieces(t):
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(piece(_head(t["role"], template), F.lit(False)), piece(escaped(t["text"], template), t["role"].isin(*template.loss)), piece(F.lit(template.close + "\n"), F.lit(False)))

    out = chats.select("id", F.size("turns").cast("long").alias("n_turns"), ended.alias("ended"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.select(
        F.col("id").alias(id_col), "n_turns", F.col("ended.state").isin(*template.ends).alias("valid"),
        F.when(F.col("ended.state") == _BROKEN, F.col("ended.n")).alias("broken_at"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, re.escape(template.close) + "\n")
    turn = rf"(?s)^{re.escape(template.open)} ((?:[^:\\]++|\\.)*+): (.*)$"
    roles = _map([(label, role) for role, label in template.labels.items()])

    def read(part):
        label = F.regexp_extract(part, turn, 1)
        role = F.when(F.substring(label, 1, 1) == "@", unescaped(F.substr(label, F.lit(2)))).otherwise(F.element_at(roles, label))
        return F.struct(role.alias("role"), unescaped(F.regexp_extract(part, turn, 2)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), read)


def chat_digest(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What ``format_chats`` wrote, read back from its output and condensed."""
    chats = format_chats(turns, template)
    chats = chats.withColumn("read", read_back(F.col("formatted"), template))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.select("conv_id", F.size("read").cast("long").alias("n_turns"), told.alias("told"), learned.alias("learned"), "formatted")
    return chats.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
