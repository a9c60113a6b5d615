"""Multi-party perspective rotation of conversations into training examples with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import need

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _safe(c: Column) -> Column:
    """Text that can't be taken for a control token."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = SYSTEM) -> DataFrame:
    """(conv_id, speaker, text, lengths, trained): each conversation once for every participant, seen from their side.

    The speaker's turns are rendered as the assistant's, those of the others as a user's with their name, and those of
    ``system``, who is no participant, as they are. ``lengths`` (in characters) and ``trained`` (0 or 1) are parallel and
    cut the text into segments, two a turn: the header, never trained on, and the content with its end mark, trained on in
    the speaker's own turns only.

    A null role is the participant "unknown"; a null text is empty; a null turn comes first; rows with a null
    conversation are one conversation. Turns with the same number go by role, then text; repeated rows are repeated turns.
    "<|" inside a name or text becomes "<\\|". Long texts are rendered whole. A conversation of system turns only, or an
    empty table, gives no rows. Extra columns are not read.
    """
    need(turns, conv, turn, role, text)
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("m"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    speakers = F.array_except(F.array_distinct(F.transform("ms", lambda m: m["r"])), F.array(F.lit(system)))
    seen = talks.select("conv_id", F.explode(speakers).alias("speaker"), "ms")

    def head(m: Column) -> Column:
        who = F.when(m["r"] == F.col("speaker"), F.lit("assistant")).when(m["r"] == system, F.lit(system)).otherwise(F.concat(F.lit("user name="), _safe(m["r"])))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    def body(m: Column) -> Column:
        return F.concat(_safe(m["x"]), F.lit(CLOSE))

    return seen.select(
        "conv_id",
        "speaker",
        F.array_join(F.transform("ms", lambda m: F.concat(head(m), body(m))), "").alias("text"),
        F.flatten(F.transform("ms", lambda m: F.array(F.length(head(m)), F.length(body(m))))).alias("lengths"),
        F.flatten(F.transform("ms", lambda m: F.array(F.lit(0), (m["r"] == F.col("speaker")).cast("int")))).alias("trained"),
    )
