"""Chat formatting: a role machine, a declarative template and a loss mask.

A machine reads the roles of a conversation in order; with each turn it moves to a
state and emits the turn's loss flag. The template says how a turn is written; the
conversation becomes one string and its segments, each with its flag. Control
strings that occur in a text are made inert by one backslash after their first
character (one more where there are some already), which can be undone exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    """As a pattern that means the text, for regular expressions of Java and RE2."""
    return re.sub(r"([\[\]|<>/()*+?.{}\\^$])", r"\\\1", text)


@dataclass(frozen=True)
class Template:
    """How turns are written: begin + role + after_role + text + end. Texts of loss_roles carry loss.

    A template that can't be read back for sure is refused: begin, end and the
    control strings need two characters at least, no backslash, and must not
    overlap each other or grow out of a text next to begin, after_role or end.
    """

    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that texts must not bring in, besides begin and end.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: From a state (the last role, or "start") to the roles that may follow; a sequence may end in final.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if not self.after_role or self.after_role[0] in "%0123456789ABCDEF":
            raise ValueError("after_role must begin with a character that roles can be rid of")
        for c in self.inert:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"{c!r} can't be made inert")
            for k in range(1, len(c)):
                if any(d.startswith(c[k:]) or c[k:].startswith(d) for d in (*self.inert, self.end)) or any(x.endswith(c[:k]) for x in (self.begin, self.after_role)):
                    raise ValueError(f"{c!r} overlaps another control string, or may grow out of a text's end")

    @property
    def inert(self) -> tuple[str, ...]:
        """The control strings with begin and end, without those that begin with another one."""
        every = sorted({*self.control, self.begin, self.end})
        return tuple(c for c in every if not any(c != d and c.startswith(d) for d in every))

    @property
    def patterns(self) -> list[tuple[str, str]]:
        """For each first character of control strings: its pattern, and that of all that may follow it."""
        return [(_literal(x), "|".join(_literal(c[1:]) for c in self.inert if c[0] == x)) for x in sorted({c[0] for c in self.inert})]


def escape(text: Column, template: Template) -> Column:
    """Adds a backslash after the first character of each control string, also where backslashes stand there."""
    for first, rest in template.patterns:
        text = F.regexp_replace(text, rf"({first})(\\*)({rest})", r"$1\\$2$3")
    return text


def unescape(text: Column, template: Template) -> Column:
    """Undoes escape()."""
    for first, rest in reversed(template.patterns):
        text = F.regexp_replace(text, rf"({first})\\(\\*)({rest})", r"$1$2$3")
    return text


def _role_out(role: Column, template: Template) -> Column:
    """A role without the first character of what ends it; that and % are written by their numbers."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(template.after_role[0]), F.lit(f"%{ord(template.after_role[0]):02X};"))


def _role_in(role: Column, template: Template) -> Column:
    return F.replace(F.replace(role, F.lit(f"%{ord(template.after_role[0]):02X};"), F.lit(template.after_role[0])), F.lit("%25"), F.lit("%"))


def _machine(template: Template) -> Column:
    """Reads the roles of the column rows: error (the first turn that may not follow, the number of turns if the end isn't final, else null) and flags (each turn's loss)."""
    moves = F.array(*[F.lit(f"{a}\n{b}") for a, to in sorted(template.moves.items()) for b in to])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error"), F.array().cast("array<boolean>").alias("flags"))

    def step(s: Column, r: Column) -> Column:
        wrong = ~F.array_contains(moves, F.concat_ws("\n", s["state"], r["role"]))
        return F.struct(
            r["role"].alias("state"), (s["n"] + 1).alias("n"), F.coalesce(s["error"], F.when(wrong, s["n"])).alias("error"),
            F.concat(s["flags"], F.array(r["role"].isin(*template.loss_roles))).alias("flags"),
        )

    return F.aggregate("rows", start, step, lambda s: F.struct(F.coalesce(s["error"], F.when(~s["state"].isin(*template.final), s["n"])).alias("error"), s["flags"].alias("flags")))


def format_chats(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text and loss), n_turns, order_valid, order_error.

    Turns are put in order of turn, then role, then text; repeated rows and ties
    stay as turns of their own. Null texts and roles are empty, a null turn
    comes first, and rows with a null conv_id make one conversation. The machine
    reads the roles in order; order_error has the number of the first turn that
    may not follow (or the number of turns if the end isn't final), else null.
    A conversation is one row by definition, so a single one must fit a task;
    many rows of other conversations never meet in one row. An empty table gives
    an empty result. Only the four named columns are read.
    """
    t = template
    body = escape(F.coalesce(F.col(text).cast("string"), F.lit("")), t)
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), who.alias("role"), body.alias("text")).alias("row"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows")).withColumn("read", _machine(t))
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    parts = F.flatten(F.zip_with("rows", "read.flags", lambda r, loss: F.array(
        segment(F.concat(F.lit(t.begin), escape(_role_out(r["role"], t), t), F.lit(t.after_role)), no),
        segment(r["text"], loss),
        segment(F.lit(t.end), no),
    )))
    out = chats.select(F.col("conv").alias(conv), parts.alias("segments"), F.size("rows").cast("long").alias("n_turns"), F.col("read.error").alias("order_error"))
    return out.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_turns", F.col("order_error").isNull().alias("order_valid"), "order_error")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted string was made from."""
    quoted = "\\Q" + template.end + "\\E"
    pieces = F.filter(F.split(formatted, quoted), lambda p: F.startswith(p, F.lit(template.begin)))
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(template.begin) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(
        _role_in(unescape(F.substring_index(p, template.after_role, 1), template), template).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, template.after_role, 1)) + 1 + len(template.after_role), F.length(p)), template).alias("text"),
    ))


def read_loss(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, in order, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
