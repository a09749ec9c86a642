"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Template of one turn::

    <s>[ROLE]\\n text </s>\\n      with ROLE the escaped role

Inside texts and roles a backslash becomes ``\\\\`` and every ``<`` or ``[`` gets a
backslash in front, inside roles line ends too, so no control string can arise from a text,
a header ends at its first ``]\\n``, and unescaping is exact.

Every assistant turn becomes an example of its own: all preceding turns are its
context, and its reply alone is trainable. An example refers to its context by the
conversation's one formatted string and a length, so a conversation of n turns is
stored once, not n times; ``full_examples`` writes the contexts out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE, TURN_END = "<s>[", "]\n", "</s>\n"


def escape(text: Column) -> Column:
    """Mark every backslash, ``<`` and ``[`` with a backslash."""
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def escape_role(role: Column) -> Column:
    """The same, and line ends, so that none follows a ``]``."""
    return F.regexp_replace(role, r"([\\<\[\n])", r"\\$1")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    """One turn in the template."""
    return F.concat(F.lit(OPEN), escape_role(role), F.lit(CLOSE), escape(text), F.lit(TURN_END))


def conversations_formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, examples``.

    ``examples`` has a struct per assistant turn: its turn number, ``context_chars``
    (the formatted characters before the reply, its header included) and
    ``target_chars``, so the trainable span is
    ``formatted[context_chars : context_chars + target_chars]``.

    Null roles and texts are empty; turns of equal number follow each other by role and
    text, repeated rows are repeated turns; rows without a ``conv_id`` are one conversation
    without one. Texts and roles may hold anything, at any length. Other columns are ignored. An
    empty table gives an empty one. A conversation is one row, as its formatted text is one value.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            t["turn"].alias("turn"),
            (t["role"] == "assistant").alias("target"),
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    sized = F.transform("parts", lambda p: F.struct(p["turn"].alias("turn"), p["target"].alias("target"), F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body")))
    step = F.aggregate(
        "sized",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<turn:bigint,context_chars:bigint,target_chars:bigint>>)").alias("found")),
        lambda a, p: F.struct(
            (a["at"] + p["head"] + p["body"] + len(TURN_END)).alias("at"),
            F.when(p["target"], F.concat(a["found"], F.array(F.struct(p["turn"].alias("turn"), (a["at"] + p["head"]).alias("context_chars"), p["body"].cast("long").alias("target_chars"))))).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return (
        sorted_turns.withColumn("parts", parts)
        .withColumn("sized", sized)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "").alias("formatted"),
            step.alias("examples"),
        )
    )


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn, with the lengths of its context and its target; ``nth`` counts a conversation's."""
    return conversations.select("conv_id", "formatted", F.posexplode("examples").alias("nth", "e")).select("conv_id", "nth", "e.turn", "e.context_chars", "e.target_chars", "formatted")


def _target() -> Column:
    return F.substring("formatted", (F.col("context_chars") + 1).cast("int"), F.col("target_chars").cast("int"))


def full_examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, context, target``: each example written out.

    The output is quadratic in the turns of a conversation, as the format asks.
    """
    return examples(conversations).select(
        "conv_id",
        "turn",
        F.substring("formatted", F.lit(1), F.col("context_chars").cast("int")).alias("context"),
        _target().alias("target"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests read back from the written output: the formatted texts, and the target of every example.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, and
    ``n_examples``, a row for every conversation. The text under the loss mask is that of
    the exploded examples, each unescaped, in their order.
    """
    stored = written(conversations, "chat")
    targets = examples(stored).select(F.col("conv_id").alias("own"), F.struct("nth", unescape(_target()).alias("text")).alias("t"))
    loss = targets.groupBy("own").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["text"]), "").alias("loss"), F.count("*").alias("n_examples"))
    # every turn ends in the one unescaped "</s>\n"; an escaped one reads "\</s>"
    pieces = F.filter(F.split(F.concat(F.lit("\n"), "formatted"), r"(?<=\n)<s>\[", -1), lambda x: x != "\n")
    read = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^(.*?)\]\n", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)^.*?\]\n(.*)</s>\n$", 1)).alias("text"),
        ),
    )
    joined = stored.select("conv_id", "formatted", read.alias("read")).join(loss, F.col("conv_id").eqNullSafe(F.col("own")), "left").withColumn("loss", F.coalesce("loss", F.lit("")))
    return joined.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )
