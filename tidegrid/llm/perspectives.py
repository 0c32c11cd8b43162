"""Multi-party perspective rotation, with DataFrame functions alone.

Each dialogue is rendered once for every participant: that speaker is the assistant, all others are named users, and
only the assistant's words and end marks count in the loss. A long dialogue comes as consecutive pieces of at most
`piece` turns, so that no task ever holds a whole conversation; joined in order the pieces are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Turns in one bucket of the two-level numbering.
BUCKET = 512


def _position(rows: DataFrame) -> DataFrame:
    """Adds pos, the turn's place in its conversation from 0. A hot conversation is numbered bucket by bucket."""
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("said")]
    # turns without a number are many buckets too, in the order in which they stand
    unnumbered = lambda c: F.when(F.col("turn").isNull(), c).otherwise(F.lit(""))
    rows = rows.withColumn("bucket", F.struct(F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit((1 << 62))), unnumbered(F.col("speaker")), unnumbered(F.substring("said", 1, 4))))
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("bucket") == F.col("_b")))
    return rows.withColumn("pos", F.col("first") + F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(*order)) - 1)


def _name(speaker: Column, me: Column, system: Column) -> Column:
    # marks and line ends in a name would forge a turn
    plain = F.translate(F.replace(speaker, F.lit("<|"), F.lit("< |")), "\n\r", "  ")
    return F.when(system, F.lit("system")).when(speaker == me, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), plain))


def rotate(conversations: DataFrame, piece: int = 64, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, text, mask, n_loss_chars) from conversations(conv_id, turn, role, text).

    The role names the speaker. Speakers in system_roles are rendered as system and have no perspective. mask lists the
    half-open character spans of `text` that count in the loss, as 'start-end' joined by commas (empty: none).
    Null role: a speaker named 'unknown'; null text: empty; null turn: after all others; turns with the same number
    stand by speaker and text; repeated rows each count; null conv_id: one conversation of its own. A conversation of
    system turns alone has no rows. Marks of the format inside texts and names are broken by a space, and line ends in
    names are spaces. A turn of any length stays whole, in one piece. Empty table: no rows. Other columns are ignored.
    """
    said = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), said.alias("said"))
    rows = _position(rows).select("conv_id", "pos", "speaker", "said", F.col("speaker").isin(*system_roles).alias("system"), F.floor(F.col("pos") / piece).alias("piece"))
    people = rows.where(~F.col("system")).select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    head = F.concat(F.lit(START), _name(F.col("speaker"), F.col("perspective"), F.col("system")), F.lit("\n"))
    mine = ~F.col("system") & (F.col("speaker") == F.col("perspective"))
    body = F.concat("said", F.lit(END))
    part = F.struct("pos", F.concat(head, body, F.lit("\n")).alias("shown"), mine.alias("mine"), F.length(head).alias("head"), F.length(body).alias("body"))
    grouped = seen.groupBy("conv_id", "perspective", "piece").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    # walk the parts of one piece (at most `piece`), keeping the length so far and the spans
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("mask"), F.lit(0).alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["shown"])).alias("at"),
            F.when(x["mine"], F.concat(acc["mask"], F.when(acc["mask"] == "", F.lit("")).otherwise(F.lit(",")), (acc["at"] + x["head"]).cast("string"), F.lit("-"), (acc["at"] + x["head"] + x["body"]).cast("string"))).otherwise(acc["mask"]).alias("mask"),
            (acc["loss"] + F.when(x["mine"], x["body"]).otherwise(F.lit(0))).alias("loss"),
        ),
    )
    return grouped.select("conv_id", "perspective", "piece", F.size("parts").cast("long").alias("n_turns"), F.array_join(F.transform("parts", lambda x: x["shown"]), "").alias("text"), spans.alias("s")).select(
        "conv_id", "perspective", "piece", "n_turns", "text", F.col("s.mask").alias("mask"), F.col("s.loss").cast("long").alias("n_loss_chars")
    )


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
with rows as (
  select conv_id, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as said,
         row_number() over (partition by conv_id order by turn nulls last, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) - 1 as pos
  from conversations
), people as (
  select distinct conv_id, speaker as perspective from rows where speaker <> 'system'
), seen as (
  select r.conv_id, p.perspective, r.pos, r.pos // 64 as piece, r.speaker <> 'system' and r.speaker = p.perspective as mine,
         '<|im_start|>' || case when r.speaker = 'system' then 'system' when r.speaker = p.perspective then 'assistant' else 'user name=' || translate(replace(r.speaker, '<|', '< |'), chr(10) || chr(13), '  ') end || chr(10) as head,
         r.said || '<|im_end|>' as body
  from rows r join people p on r.conv_id is not distinct from p.conv_id
), placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective, piece order by pos rows between unbounded preceding and 1 preceding), 0) as begins from seen
)
select conv_id, perspective, piece::bigint as piece, count(*)::bigint as n_turns,
       string_agg(head || body || chr(10), '' order by pos) as text,
       coalesce(string_agg(cast((begins + length(head))::bigint as varchar) || '-' || cast((begins + length(head) + length(body))::bigint as varchar), ',' order by pos) filter (where mine), '') as mask,
       coalesce(sum(length(body)) filter (where mine), 0)::bigint as n_loss_chars
from placed group by conv_id, perspective, piece
"""
