"""Chat formatting with a declarative template: DataFrame functions only.

A finite-state machine over roles validates turn order; every turn gives three segments (opening
mark, escaped text, closing mark), of which only the text of trained roles is under the loss mask.
Control strings inside texts are escaped reversibly: the escape character itself first, then each
control string, each by the escape character and a letter of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    opening: str = "<turn "
    opening_end: str = ">"
    closing: str = "</turn>"
    separator: str = "\n"
    escape: str = "\\"
    #: Letters that stand, after the escape character, for it and for the control strings.
    letters: str = "boc"
    role_letter: str = "g"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a missing entry rejects the conversation.
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def codes(self) -> list[tuple[str, str]]:
        return [(s, self.escape + c) for s, c in zip((self.escape, self.opening, self.closing), self.letters, strict=True)]

    def escaped(self, text: Column, role: bool = False) -> Column:
        for plain, code in [*self.codes, *([(self.opening_end, self.escape + self.role_letter)] if role else [])]:
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescaped(self, text: Column, role: bool = False) -> Column:
        for plain, code in reversed([*self.codes, *([(self.opening_end, self.escape + self.role_letter)] if role else [])]):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, state, first_invalid_turn, segments, formatted, loss_turns.

    Rows are ordered by turn, then role and text; null text or role counts as empty, null conv_id is
    a conversation of its own. `state` is the machine's last state, or "rejected" for a wrong order;
    rejected conversations are formatted all the same and their first wrong position (from 0) is given.
    `loss_turns` has a flag for each turn of `formatted`: whether its text is under the loss mask. An
    empty table gives no rows.
    """
    t = template or ChatTemplate()
    moves = F.create_map(*[F.lit(x) for s, to in t.moves.items() for r, n in to.items() for x in (f"{s}>{r}", n)])
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
        ).alias("turns")
    )
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        following = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"])), F.lit("rejected"))
        bad = F.when(acc["bad"].isNull() & (following == "rejected"), acc["seen"]).otherwise(acc["bad"])
        return F.struct(following.alias("state"), (acc["seen"] + 1).alias("seen"), bad.alias("bad"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    machine = F.aggregate("turns", start, step)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.opening), t.escaped(x["role"], role=True), F.lit(t.opening_end)), F.lit(False)),
                segment(t.escaped(x["text"]), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.closing + t.separator), F.lit(False)),
            ),
        )
    )
    return (
        grouped.select("conv_id", machine.alias("machine"), segments.alias("segments"))
        .select("conv_id", F.col("machine.state").alias("state"), F.col("machine.bad").alias("first_invalid_turn"), "segments")
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        # every third segment, from the second on, is the text of a turn
        .withColumn("loss_turns", F.transform(F.filter("segments", lambda s, i: i % 3 == 1), lambda s: s["loss"]))
    )


def parse_formatted(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """Array of (role, text) read back from formatted text."""
    t = template or ChatTemplate()
    pieces = F.split(formatted, "\\Q" + t.closing + t.separator + "\\E", -1)

    def turn(piece: Column) -> Column:
        mark = F.instr(piece, F.lit(t.opening_end))
        role = F.substring(piece, F.lit(len(t.opening) + 1), mark - F.lit(len(t.opening) + 1))
        return F.struct(t.unescaped(role, role=True).alias("role"), t.unescaped(F.substring(piece, mark + 1, F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and the probe conversation -7, then reads turns and loss text back.

    Also returns `state` and `first_invalid_turn` of the turn-order machine. An empty table leaves
    the probe conversation.
    """
    t = ChatTemplate()
    probe = "\\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    made = format_conversations(turns.unionByName(extra), t)
    back = made.select("conv_id", "state", "first_invalid_turn", "loss_turns", parse_formatted(F.col("formatted"), t).alias("back"), F.length("formatted").cast("long").alias("formatted_chars"))
    # the mask's flags pick the texts out of what was read back from the formatted text
    masked = F.zip_with("back", "loss_turns", lambda x, flag: F.when(flag, x["text"]).otherwise(""))
    read = back.withColumn("loss", F.array_join(masked, ""))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "state",
        "first_invalid_turn",
    )
