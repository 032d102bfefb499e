"""Chat formatting: a finite-state machine over roles and text segments with loss flags, from a declarative template.

DataFrame functions only. A turn is written as ``### role: text</turn>`` and a line break; backslash, marker and end
strings inside texts and roles are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, their escapes, the roles that are learned from, and the allowed moves (state, role) -> state."""

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("### ", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))   # after \ -> \\
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})
    final: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in t.escapes:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    def piece(x: Column) -> Column:
        for control, code in t.escapes:
            x = F.replace(x, F.lit(code), F.lit(control))
        return x
    # an escaped backslash is a pair; pairs split first, the codes between them are single
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def format_conversations(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn_order_ok, formatted, segments): one row per conversation of ``rows`` (conv_id, turn, role, text).

    Turns stand by turn number (null first; ties by role, then text; repeated rows are turns of their own). A null
    text or role is empty. ``segments`` holds (text, loss) pieces whose texts joined are ``formatted``; only the
    (escaped) texts of loss roles have the flag. ``turn_order_ok`` is the verdict of the machine: a role without a
    move from the state before leads to a dead state, the last state has to be final. Conversations out of order are
    formatted too. Null is a conv_id like any other; an empty table gives no rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}|{r}", to)])
    end = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(
        F.element_at(moves, F.concat(s, F.lit("|"), x["role"])), F.lit("dead")))

    def pieces(x: Column) -> Column:
        head = F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.colon))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                       F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")))

    out = convs.select("conv_id", end.isin(*t.final).alias("turn_order_ok"),
                       F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.select("conv_id", "turn_order_ok",
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation: what ``format_conversations`` wrote, unescaped."""
    # the close string never occurs inside an escaped text; the last piece after it is empty
    parts = F.split(formatted, "\\Q" + t.close + "\\E", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(t.open) + 1))
        cut = F.instr(body, t.colon)
        return F.struct(unescape(F.substr(body, F.lit(1), cut - 1), t).alias("role"),
                        unescape(F.substr(body, cut + len(t.colon)), t).alias("text"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """Per conversation, read back from the output: counts and digests of its turns and of the text under the mask."""
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    rows = formatted.select("conv_id", "turn_order_ok", "formatted", read_back(F.col("formatted"), t).alias("turns"),
                            F.array_join(masked, "").alias("masked"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                       F.length("masked").cast("long").alias("loss_chars"),
                       F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "turn_order_ok")
