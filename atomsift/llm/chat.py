"""Chat formatting: one training example for every assistant turn.

Only DataFrame functions are used. A turn is written as

    <|turn|>ROLE newline TEXT<|end|>

and every assistant turn becomes an example of its own: all turns before it as
context and its reply as the only part under the loss mask. Inside roles and
texts a backslash is doubled and every control string gets a backslash after its
first character, so no marker can be forged and dropping the backslashes gives
the text back. A newline in a role is escaped as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, REPLY = "<|turn|>", "<|end|>", "assistant"

# Strings that open or close something in a template or a vocabulary.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(turns: DataFrame) -> DataFrame:
    """Examples ``(conv_id, example, text, loss_start, loss_end)`` of a table of turns.

    ``loss_start`` and ``loss_end`` are code point offsets into ``text``, end
    exclusive. If a conversation does not end with a reply, its last example is
    the whole conversation with both offsets null, so no turn is lost.

    Turns go by ``turn`` (null first), ties by role and text; repeated rows are
    repeated turns. Null role or text is empty. A null ``conv_id`` is a
    conversation like any other. No rows give no rows; further columns are
    ignored. A conversation has to fit into a row, as its examples do.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    parts = talks.select(
        "conv_id",
        F.transform(
            "turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))
        ).alias("parts"),
    )
    blocks = parts.withColumn("blocks", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    each = blocks.select("conv_id", "blocks", F.size("blocks").alias("n"), F.posexplode("parts").alias("at", "part"))
    wanted = each.where((F.col("part.role") == REPLY) | (F.col("at") == F.col("n") - 1))
    whole = wanted.withColumn("text", F.array_join(F.slice("blocks", F.lit(1), F.col("at") + 1), ""))
    end = F.when(F.col("part.role") == REPLY, F.length("text") - len(END))
    return whole.select(
        "conv_id",
        F.col("at").alias("example"),
        "text",
        (end - F.length("part.body")).alias("loss_start"),
        end.alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations, parsed from the text of their examples alone."""
    masked = F.when(
        F.col("loss_end").isNotNull(), F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    )
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("full"),
        F.sort_array(F.collect_list(F.struct("example", masked.alias("loss")))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    blocks = F.slice(F.split("full", r"<\|turn\|>"), 2, 1 << 30)
    inner = F.transform(blocks, lambda b: F.substr(b, F.lit(1), F.length(b) - len(END)))
    role = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    turn = F.transform(
        inner,
        lambda b: F.concat(
            unescape(F.regexp_replace(b, role + ".*$", "$1")),
            F.lit("\n"),
            unescape(F.regexp_replace(b, role, "")),
            F.lit("\n"),
        ),
    )
    losses = F.transform(F.filter("losses", lambda x: x["loss"].isNotNull()), lambda x: unescape(x["loss"]))
    return per.select(
        "conv_id",
        F.size(blocks).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(losses, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(losses, ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )
