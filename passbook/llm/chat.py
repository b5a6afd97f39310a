"""Chat formatting: every dialogue is rendered once for each participant.

In the view of a participant their turns are the assistant's and are trained on; the turns of all
others come from named users; system turns stay system turns and open no view of their own.  A view
is a set of rows, one per turn, so no cell or task grows with the length of a dialogue: the text of
a view is its ``rendered`` values in order of ``turn``, then ``speaker``, then text.

Defined results: a NULL text is empty; a NULL speaker is a user without a name and has no view; rows
with a NULL conversation form one conversation; a dialogue of system turns alone has no view.  Equal
rows are equal turns and are all rendered.  Marker openings ``<|`` inside a text are broken by a
space, so that a text cannot close its turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn and view: conv, ``perspective``, turn, ``speaker``, ``role`` (assistant, user
    or system), ``name`` (of a user), ``rendered``, ``mask`` (trained on or not) and the half-open
    character span ``mask_start``, ``mask_end`` of what is trained on inside ``rendered``.

    Views of a conversation come from a partial distinct of its speakers; the join on the
    conversation splits hot ones.
    """
    lines = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(speaker).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("_text"),
    )
    views = (
        lines.where(F.col("speaker") != SYSTEM)
        .select(F.col("_conv").alias("_view_conv"), F.col("speaker").alias("perspective")).distinct()
    )
    role = (
        F.when(F.col("speaker") == SYSTEM, SYSTEM)
        .when(F.col("speaker") == F.col("perspective"), "assistant")
        .otherwise("user")
    )
    name = F.when(
        F.col("role") == "user", F.regexp_replace(F.col("speaker"), "[^A-Za-z0-9_-]", "_")
    )
    head = F.concat(
        F.lit("<|im_start|>"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")),
        F.lit("\n"),
    )
    end = F.lit("<|im_end|>")
    mask = F.col("role") == "assistant"
    return (
        lines.join(views, F.col("_conv").eqNullSafe(F.col("_view_conv")))
        .withColumn("role", role)
        .withColumn("name", name)
        .select(
            F.col("_conv").alias(conv), "perspective", F.col("_turn").alias(turn), "speaker", "role", "name",
            F.concat(head, F.col("_text"), end, F.lit("\n")).alias("rendered"), mask.alias("mask"),
            F.when(mask, F.length(head)).cast("int").alias("mask_start"),
            F.when(mask, F.length(F.concat(head, F.col("_text"), end))).cast("int").alias("mask_end"),
        )
    )
