"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply
is trainable.  A conversation that does not end with an assistant turn gets one more example without a
target, so that the output holds every turn.

A turn is written ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can occur there, and unescaping
gives back the very text.  In roles a newline gets a backslash as well.

Edge cases: a null role or text counts as empty; turns with equal numbers follow each other by role, then
text; null turn numbers come first; repeated rows stay; rows with a null conversation id form one
conversation; extra columns are ignored.  A conversation is one row while its examples are made, and its
examples together grow with the square of its turns, which is inherent in the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chat_examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rows (conversation id, example, n_context, formatted, loss_start, loss_end, trainable, last).

    ``loss_start`` and ``loss_end`` (exclusive) are code points of ``formatted``; they enclose the escaped
    reply, and nothing if the example has no target.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = turns.groupBy(F.col(conv_col).alias("_conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def written(t: Column) -> Column:
        opening = F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
        body = escaped(t["text"])
        return F.struct(
            F.concat(opening, body, F.lit(END)).alias("out"),
            F.length(body).alias("n_body"),
            (t["role"] == TARGET_ROLE).alias("target"),
        )

    rendered = ordered.select("_conv", F.transform("turns", written).alias("w")).withColumn("n", F.size("w"))
    spots = F.expr("filter(sequence(1, n), i -> element_at(w, i).target or i = n)")
    examples = rendered.select("_conv", "w", "n", F.posexplode(spots).alias("example", "i"))
    formatted = examples.select(
        "_conv",
        "example",
        (F.col("i") - 1).alias("n_context"),
        F.expr("array_join(transform(slice(w, 1, i), t -> t.out), '')").alias("formatted"),
        F.expr("element_at(w, i).target").alias("trainable"),
        F.expr("element_at(w, i).n_body").alias("n_body"),
        (F.col("i") == F.col("n")).alias("last"),
    )
    stop = F.length("formatted") - len(END)
    return formatted.select(
        F.col("_conv").alias(conv_col),
        F.col("example"),
        F.col("n_context"),
        F.col("formatted"),
        F.when(F.col("trainable"), stop - F.col("n_body")).otherwise(0).alias("loss_start"),
        F.when(F.col("trainable"), stop).otherwise(0).alias("loss_end"),
        F.col("trainable"),
        F.col("last"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted example holds."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def parsed(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(
            unescaped(role).alias("role"),
            unescaped(F.substring(part, F.length(role) + F.lit(len(START) + 2), F.length(part))).alias("text"),
        )

    return F.transform(parts, parsed)


def loss_text(formatted: Column, loss_start: Column, loss_end: Column) -> Column:
    return unescaped(F.substring(formatted, loss_start + 1, loss_end - loss_start))
