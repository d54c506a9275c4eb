"""Chat formatting: a state machine over roles, and text segments with loss flags.

A template declares per role the mark that opens a turn and whether its text bears loss, and
the mark that ends a turn. The machine is a table of allowed role changes; every turn is
checked against the turn before it by one window. Inside texts the escape sign, and the first
signs of the marks, are written as two letters without any of them, so a formatted string
splits at its marks without ambiguity and every text can be read back.

Nulls: a null text is empty, a null role is the empty role, turns without an order come last.
Roles outside the template are written under their own escaped name, bear no loss and are
invalid. Equal turns are kept, in the order of turn, role and text. An empty table gives an
empty result; extra columns are ignored. A conversation's output is one string, so a single
conversation is bounded by the size of a string; segments of turns are not gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import empty_if_null


@dataclass(frozen=True)
class Template:
    """Marks of turns, roles under loss, and the allowed changes of role ("" before the first)."""

    opening: str = "### "
    titles: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    after_title: str = ": "
    ending: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    changes: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)
    # Sign in a text and what is written for it; the escape sign comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\-"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, template: Template) -> Column:
    for sign, written in template.escapes:
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def unescape(text: Column, template: Template) -> Column:
    for sign, written in reversed(template.escapes):
        text = F.replace(text, F.lit(written), F.lit(sign))
    return text


def _named(role: Column, template: Template) -> Column:
    title = escape(role, template)
    for name, shown in template.titles.items():
        title = F.when(role == name, F.lit(shown)).otherwise(title)
    # A role that is called like a title would be read back as another: it keeps a marked name.
    shown_titles = list(template.titles.values())
    return F.when(role.isin(shown_titles), F.concat(F.lit("\\r"), role)).otherwise(title)


def _role_of(title: Column, template: Template) -> Column:
    role = unescape(title, template)
    for name, shown in template.titles.items():
        role = F.when(title == shown, F.lit(name)).otherwise(role)
    return F.when(title.startswith("\\r"), F.substring(title, 3, 1 << 30)).otherwise(role)


def turn_segments(turns: DataFrame, template: Template) -> DataFrame:
    """Per turn: conv_id, its place, ``valid`` and ``segments`` of text and loss flag."""
    rows = turns.select(
        "conv_id",
        "turn",
        empty_if_null(F.col("role")).alias("role"),
        empty_if_null(F.col("text")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    along = W.partitionBy("conv_id").orderBy(*order)
    before = F.coalesce(F.lag("role").over(along), F.lit(""))
    valid = F.lit(False)
    for state, following in template.changes.items():
        valid = valid | ((before == state) & F.col("role").isin(*following))
    bears = F.col("role").isin(*template.loss_roles)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = F.concat(F.lit(template.opening), _named(F.col("role"), template), F.lit(template.after_title))
    return rows.select(
        "conv_id",
        F.row_number().over(along).alias("place"),
        "role",
        valid.alias("valid"),
        F.array(
            piece(head, F.lit(False)),
            piece(escape(F.col("text"), template), bears),
            piece(F.lit(template.ending), F.lit(False)),
        ).alias("segments"),
    )


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: ``valid``, ``segments`` in order and ``formatted``, their text."""
    by_turn = turn_segments(turns, template)
    whole = by_turn.groupBy("conv_id").agg(
        F.bool_and("valid").alias("_valid"),
        F.max_by("role", "place").alias("_last"),
        F.array_sort(F.collect_list(F.struct("place", "segments"))).alias("_turns"),
    )
    segments = F.flatten(F.col("_turns.segments"))
    return whole.select(
        "conv_id",
        (F.col("_valid") & F.col("_last").isin(*template.last)).alias("valid"),
        segments.alias("segments"),
        F.array_join(segments.getField("text"), "").alias("formatted"),
    )


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns (role, text) and the text under loss, from the formatted output alone."""
    ends = F.split(F.col("formatted"), F.lit(f"\\Q{template.ending}\\E"), -1)
    bodies = F.slice(ends, F.lit(1), F.size(ends) - 1)  # nothing follows the last ending

    def turn(body: Column) -> Column:
        inner = F.substring(body, len(template.opening) + 1, 1 << 30)
        title = F.substring_index(inner, template.after_title, 1)
        text = F.substr(inner, F.length(title) + 1 + len(template.after_title))
        return F.struct(
            _role_of(title, template).alias("role"), unescape(text, template).alias("text")
        )

    under = F.filter("segments", lambda s: s["loss"])
    return chats.select(
        "conv_id",
        "valid",
        "formatted",
        F.transform(bodies, turn).alias("turns"),
        F.array_join(F.transform(under, lambda s: unescape(s["text"], template)), "").alias("loss_text"),
    )
