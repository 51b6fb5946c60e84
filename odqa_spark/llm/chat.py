"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, that reply
as the only trainable text. What follows the last assistant turn, or a conversation without
one, becomes one more example with nothing to train on, so that no turn is lost.

Turns look like ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so a control string can only be a mark; reading
back takes each backslash off the character after it.

Defined cases: a null text or role is empty; rows are ordered by turn (null first), then role,
then text, so repeated rows stand side by side as turns of their own. Rows with a null
conversation id form one conversation. Empty input: no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, n_turns, formatted, loss): examples of every conversation.

    ``example`` counts from 0 in turn order, ``n_turns`` is the number of turns in the example,
    ``loss`` an array of (start, length) in code points of ``formatted``: the trainable reply.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # each turn is written once; an example is a prefix of the written conversation
    written = F.transform(
        "ts",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("reply"),
            F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    n = F.size("ws")
    place = F.posexplode("ws").alias("at", "w")
    marked = whole.select("conv", written.alias("ws")).select("conv", "ws", n.alias("n"), place)
    last = F.col("at") == F.col("n") - 1
    picked = marked.where(F.col("w.reply") | last)
    prefix = F.array_join(
        F.transform(F.slice("ws", F.lit(1), F.col("at")), lambda w: F.concat(w["head"], w["body"], F.lit(END))), ""
    )
    context = picked.select("conv", "at", "w", prefix.alias("context"))
    formatted = F.concat("context", "w.head", "w.body", F.lit(END))
    mask = F.struct((F.char_length("context") + F.char_length("w.head")).alias("start"), F.char_length("w.body").alias("length"))
    none = F.array().cast("array<struct<start int, length int>>")
    built = context.select(
        "conv", "at", formatted.alias("formatted"), F.when(F.col("w.reply"), F.array(mask)).otherwise(none).alias("loss")
    )
    return built.select(F.col("conv").alias(conv), F.col("at").alias("last_turn"), (F.col("at") + 1).alias("n_turns"), "formatted", "loss")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted example holds."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        sep = F.instr(piece, SEP)
        body = F.substr(piece, sep + len(SEP))
        return F.struct(
            unescape(F.substr(piece, F.lit(1), sep - 1)).alias("role"),
            unescape(F.substr(body, F.lit(1), F.char_length(body) - len(END))).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return F.array_join(F.transform(loss, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["length"]))), "")


def digests(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back of each conversation: its turns, its trainable text, its size."""
    longest = F.max_by("formatted", "last_turn")
    parts = F.sort_array(F.collect_list(F.struct("last_turn", loss_text(F.col("formatted"), F.col("loss")).alias("x"))))
    whole = examples.groupBy(conv).agg(
        longest.alias("longest"), parts.alias("parts"), F.sum(F.char_length("formatted").cast("bigint")).alias("formatted_chars")
    )
    turns = read_turns(F.col("longest"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.col("parts.x"), "")
    return whole.select(
        conv,
        F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
