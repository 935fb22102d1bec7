"""Chat formatting by perspective rotation: every dialogue once for each of its participants, in DataFrame functions.

In a participant's rendering its own turns are the assistant's and are trained on; the others' turns come from named users,
and system turns stay system turns.  ``rotate`` gives the rendering turn by turn, with running offsets and no group
held in memory; ``render`` joins the turns of each rendering to one text with its trained spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SYSTEM = "system"
END = "<|end|>\n"


def _content(text: Column) -> Column:
    """The turn's text; marks that would read as ours are opened up."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """The role with its UTF-8 bytes other than ASCII letters, digits, `.`, `_` and `-` as %XX, so that names stay different."""
    return F.replace(F.replace(F.url_encode(role), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, speaker, position, turn, role, segment, starts_at, trained_from, trained_to) per turn and perspective.

    ``speaker`` is the participant whose perspective it is: every role of the dialogue but `system`.  Offsets count
    characters of the rendering; trained_from and trained_to are null where the turn isn't the speaker's, and enclose
    its text and end mark where it is.  Turns go by turn number (null first), then role, then text; repeated rows are
    repeated turns.  Turns of a null role belong to one participant without a name (a null speaker, apart from any that
    has a name); a null text is empty; rows of a null conversation form one dialogue; a dialogue of system turns alone has
    no participant and no rendering; an empty table gives no rows.
    """
    t = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("_role"), _content(F.col(text_col).cast("string")).alias("_text")
    )
    speakers = t.where(~F.col("_role").eqNullSafe(SYSTEM)).select(F.col("_conv").alias("_of"), F.col("_role").alias("_speaker")).distinct()
    both = t.join(speakers, F.col("_conv").eqNullSafe(F.col("_of")))
    own = F.col("_role").eqNullSafe(F.col("_speaker"))
    head = F.when(own, "<|assistant|>\n").when(F.col("_role") == SYSTEM, "<|system|>\n").when(F.col("_role").isNull(), "<|user|>\n").otherwise(F.concat(F.lit("<|user name="), _name(F.col("_role")), F.lit("|>\n")))
    both = both.withColumn("_head", F.length(head)).withColumn("_segment", F.concat(head, "_text", F.lit(END)))
    order = Window.partitionBy("_conv", "_speaker").orderBy(F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), "_text")
    starts = F.coalesce(F.sum(F.length("_segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = both.withColumn("_position", F.row_number().over(order)).withColumn("_starts", starts)
    return both.select(
        F.col("_conv").alias("conv_id"), F.col("_speaker").alias("speaker"), F.col("_position").alias("position"), F.col("_turn").alias("turn"), F.col("_role").alias("role"),
        F.col("_segment").alias("segment"), F.col("_starts").alias("starts_at"), F.when(own, F.col("_starts") + F.col("_head")).alias("trained_from"),
        F.when(own, F.col("_starts") + F.length("_segment")).alias("trained_to"),
    )


def render(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, speaker, text, trained_spans, n_turns, n_trained_turns, trained_chars) per dialogue and participant.

    trained_spans is `from-to` of every trained span, comma-joined in order; the rows are those of ``rotate``.
    """
    place = lambda value: F.array_sort(F.collect_list(F.struct("position", value.alias("v"))))
    span = F.concat_ws("-", F.col("trained_from").cast("string"), F.col("trained_to").cast("string"))
    grouped = rotate(turns, **columns).groupBy("conv_id", "speaker").agg(
        place(F.col("segment")).alias("_segments"), F.array_sort(F.collect_list(F.when(F.col("trained_from").isNotNull(), F.struct("position", span.alias("v"))))).alias("_spans"),
        F.count("*").alias("n_turns"), F.count("trained_from").alias("n_trained_turns"), F.coalesce(F.sum(F.col("trained_to") - F.col("trained_from")), F.lit(0)).alias("trained_chars"),
    )
    return grouped.select("conv_id", "speaker", F.array_join("_segments.v", "").alias("text"), F.array_join("_spans.v", ",").alias("trained_spans"), "n_turns", "n_trained_turns", "trained_chars")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return render(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS DISTINCT FROM 'system'),
b AS (
  SELECT t.*, speaker, CASE WHEN role IS NOT DISTINCT FROM speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' WHEN role IS NULL THEN '<|user|>'
         ELSE '<|user name=' || replace(url_encode(role), '~', '%7E') || '|>' END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS seg FROM b),
o AS (
  SELECT *, row_number() OVER w AS pos, coalesce(sum(length(seg)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, speaker, string_agg(seg, '' ORDER BY pos) AS text,
       coalesce(string_agg((st + length(head)) :: VARCHAR || '-' || (st + length(seg)) :: VARCHAR, ',' ORDER BY pos) FILTER (WHERE role IS NOT DISTINCT FROM speaker), '') AS trained_spans,
       count(*) AS n_turns, count(*) FILTER (WHERE role IS NOT DISTINCT FROM speaker) AS n_trained_turns,
       CAST(coalesce(sum(length(seg) - length(head)) FILTER (WHERE role IS NOT DISTINCT FROM speaker), 0) AS BIGINT) AS trained_chars
FROM o GROUP BY conv_id, speaker
"""
