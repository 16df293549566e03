"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says how a turn begins and ends, for which roles loss is taken, and which role may follow which. The machine
goes over a conversation's turns once and gives its last state; a conversation it refuses is still formatted, with valid
false, so nothing is lost. Each turn becomes three segments: head (no loss), body (loss for some roles) and tail (no loss).
Control strings inside texts are escaped, so the formatted text can be parsed back exactly. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``mark`` begins every control string and occurs in no escaped text."""

    mark: str = "<|"
    head: str = "<|turn|>"
    after_role: str = "<|text|>"
    tail: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: role -> states in which it may speak; having spoken, a role's name is the state.
    turns: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"system": ("start",), "user": ("start", "system", "assistant"), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant", "user")


CHAT = Template()
REFUSED = "refused"


def escape(text: Column, template: Template = CHAT) -> Column:
    """Backslashes are doubled and the mark is split by one; nothing else changes."""
    first, rest = template.mark[0], template.mark[1:]
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(template.mark), F.lit(f"{first}\\{rest}"))


def unescape(text: Column, template: Template = CHAT) -> Column:
    """The inverse of ``escape``."""
    first, rest = template.mark[0], template.mark[1:]
    return F.replace(F.replace(text, F.lit(f"{first}\\{rest}"), F.lit(template.mark)), F.lit("\\\\"), F.lit("\\"))


def final_state(roles: Column, template: Template = CHAT) -> Column:
    """The machine's state after an array of roles; once refused, always refused."""

    def step(state: Column, role: Column) -> Column:
        allowed = F.lit(False)
        for name, after in template.turns.items():
            allowed = allowed | ((role == name) & state.isin(*after))
        return F.when((state != REFUSED) & F.coalesce(allowed, F.lit(False)), role).otherwise(F.lit(REFUSED))

    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, segments (role, kind, text, loss), valid; one row a conversation.

    Turns go by turn, then role, then text; null turns come first. Null roles and texts are empty; repeated rows are turns
    of their own; rows with a null conv_id are one conversation. An empty table gives an empty one. A formatted
    conversation is one value of one row, so its turns meet in one task, however many they are.
    """
    t = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        def part(kind: str, text: Column, loss: Column) -> Column:
            return F.struct(x["role"].alias("role"), F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.head), escape(x["role"], template), F.lit(template.after_role))
        return F.array(part("head", head, F.lit(False)), part("body", escape(x["text"], template), x["role"].isin(*template.loss_roles)), part("tail", F.lit(template.tail), F.lit(False)))

    t = t.withColumn("segments", F.flatten(F.transform("turns", segments)))
    state = final_state(F.col("turns.role"), template)
    return t.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", state.isin(*template.accepts).alias("valid"))


def parse_chats(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    pieces = F.filter(F.split(formatted, _literal(template.head)), lambda p: p != "")

    def turn(p: Column) -> Column:
        two = F.split(p, _literal(template.after_role))
        body = F.substring(two[1], F.lit(1), F.length(two[1]) - len(template.tail))
        return F.struct(unescape(two[0], template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped: the segments that are flagged, in order, nothing between them."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
