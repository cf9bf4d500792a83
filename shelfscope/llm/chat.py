"""Chat formatting: a finite-state machine over roles checks turn order, a declarative template emits segments.

Only DataFrame expressions. A conversation's hash runs over all its turns, so a conversation is one row; turns are
formatted in place and never joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    role: str
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Control strings start with [ or <, hold no other of these, and none is the start of another."""

    begins: str = "<s>"
    turns: tuple[Turn, ...] = (Turn("system", "[SYS]", "[/SYS]"), Turn("user", "[INST]", "[/INST]"), Turn("assistant", "[ANS]", "</s>", True))
    #: Any other role: its name stands between these two, the text up to the third.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    #: state, role -> state. 0 is the start; states that may end a conversation are in `ends`.
    moves: tuple[tuple[int, str, int], ...] = ((0, "system", 1), (0, "user", 2), (1, "user", 2), (2, "assistant", 3), (3, "user", 2))
    ends: tuple[int, ...] = (3,)

    def controls(self) -> list[str]:
        return [self.begins, *(c for t in self.turns for c in (t.opens, t.closes)), *self.other]

    def control_pattern(self) -> str:
        """A control string split around the place where escapes go: its first character, backslashes, the rest."""
        rest = "|".join(sorted({quoted(c[1:]) for c in self.controls()}))
        return rf"([\[<])(\\*)({rest})"

    def turn_pattern(self) -> str:
        opens = "|".join(quoted(t.opens) for t in self.turns)
        closes = "|".join([*(quoted(t.closes) for t in self.turns), quoted(self.other[2])])
        return rf"(?s)({opens}|{quoted(self.other[0])}(.*?){quoted(self.other[1])})(.*?)(?:{closes})"


def quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\[](){}.*+?^$|" else c for c in s)


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """One backslash more after the first character of whatever reads as a control string, escaped or not."""
    return F.regexp_replace(text, template.control_pattern(), r"$1$2\\$3")


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    return F.regexp_replace(text, template.control_pattern().replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, segments (text, loss), valid, bad_turn.

    Turns are ordered by turn, then role and text; nulls come first. Null roles and texts count as empty. Unknown
    roles keep their names. Repeated rows stay. Invalid turn orders are formatted too: valid is false and bad_turn is
    the place (from 1) of the first turn without a move, or null if only the end is missing. A null conv_id is one
    conversation. Other columns are ignored; an empty table gives an empty one.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def three(opens: Column, closes: str, loss: bool) -> Column:
            pieces = ((opens, False), (escaped(t["text"], template), loss), (F.lit(closes), False))
            return F.array(*(F.struct(p.alias("text"), F.lit(x).alias("loss")) for p, x in pieces))

        out = three(F.concat(F.lit(template.other[0]), escaped(t["role"], template), F.lit(template.other[1])), template.other[2], False)
        for kind in template.turns:
            out = F.when(t["role"] == kind.role, three(F.lit(kind.opens), kind.closes, kind.loss)).otherwise(out)
        return out

    def move(state: Column, role: Column) -> Column:
        to = F.lit(-1)
        for a, name, b in template.moves:
            to = F.when((state == a) & (role == name), F.lit(b)).otherwise(to)
        return to

    def step(s: Column, t: Column) -> Column:
        to = F.when(s["state"] < 0, s["state"]).otherwise(move(s["state"], t["role"]))
        return F.struct(to.alias("state"), (s["at"] + F.when(s["state"] < 0, 0).otherwise(1)).alias("at"))

    run = F.aggregate("turns", F.struct(F.lit(0).alias("state"), F.lit(0).alias("at")), step)
    begin = F.array(F.struct(F.lit(template.begins).alias("text"), F.lit(False).alias("loss")))
    return (
        chats.withColumn("segments", F.concat(begin, F.flatten(F.transform("turns", segments))))
        .withColumn("run", run)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.col("run.state").isin(*template.ends).alias("valid"),
            F.when(F.col("run.state") < 0, F.col("run.at")).alias("bad_turn"),
        )
    )


def read_chats(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The inverse, from the formatted text and the loss flags: adds turns (role, text) and loss_text. Null and empty texts of
    turns come back as empty ones, repeated rows each by itself, an empty table as an empty one; columns of formatted named
    turns and loss_text are replaced, g1 to g3 dropped, others pass through."""
    pattern = F.lit(template.turn_pattern())

    def role(opens: Column, name: Column) -> Column:
        out = unescaped(name, template)
        for kind in template.turns:
            out = F.when(opens == kind.opens, F.lit(kind.role)).otherwise(out)
        return out

    parts = formatted.withColumns({f"g{k}": F.regexp_extract_all("formatted", pattern, F.lit(k)) for k in (1, 2, 3)})
    zipped = F.arrays_zip("g1", "g2", "g3")
    return parts.withColumns(
        {
            "turns": F.transform(zipped, lambda z: F.struct(role(z["g1"], z["g2"]).alias("role"), unescaped(z["g3"], template).alias("text"))),
            "loss_text": F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), ""),
        }
    ).drop("g1", "g2", "g3")


def chat_digest(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the formatted output holds, read back from it: counts and digests per conversation."""
    back = read_chats(format_chats(turns, template), template)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
