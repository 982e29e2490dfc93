"""Chat formatting after the collapse of cumulative snapshots.

A logged conversation that is the beginning of a longer one, or the same as another, is a snapshot of it. Each turn's
two 64-bit hashes cover its place, role and text; their running XOR along a conversation identifies its first k
turns. A conversation stays unless its whole hash is that of the first turns of a longer one (an anti-join); of equal
ones the least conv_id stays. What stays is rendered turn by turn, so no conversation is gathered in one value.

Places and running hashes are computed in blocks of turns and then over blocks, so a conversation with a very large
share of all rows is many small sorts; a first turn or a conversation that is logged very often meets in one
distinct row after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turns in a block.
BLOCK = 256
HASHES = ("h1", "h2")
#: The rendered form of a turn: before the role, after it, after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _hash(salt: str) -> Column:
    # a null hashes as nothing, so whether there is a value is hashed too
    return F.xxhash64(F.lit(salt), "position", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, position (from 1, without gaps) and the hashes h1, h2 of all turns up to this one.

    Turns are in order of turn, then role, then text, nulls first; rows that are repeated whole count once. Rows
    without a conv_id belong to no conversation and are left out.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)).cast("long")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.withColumn("place", F.row_number().over(inside)).join(sizes, ["conv_id", "block"]).withColumn("position", F.col("before") + F.col("place")).drop("before", "place")
    rows = rows.withColumns({h: _hash(h) for h in HASHES})
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(h).alias(h) for h in HASHES])
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0).cast("long")).alias(f"{h}_before") for h in HASHES])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({h: F.bit_xor(h).over(running) for h in HASHES}).join(blocks, ["conv_id", "block"])
    return rows.select("conv_id", "role", "text", "position", *[F.col(h).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in HASHES])


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no beginning of a longer one; of equal ones the least conv_id."""
    lengths = hashed.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    rows = hashed.select("conv_id", "position", *HASHES).join(lengths, "conv_id")
    whole = rows.where("position = n_turns").groupBy("n_turns", *HASHES).agg(F.min("conv_id").alias("conv_id"))
    begun = rows.where("position < n_turns").select(F.col("position").alias("n_turns"), *HASHES).distinct()
    return whole.join(begun, ["n_turns", *HASHES], "left_anti").select("conv_id", "n_turns")


def format_chats(conversations: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, position, rendered: the turns of all maximal conversations; joined in order of position they are the chat.

    `conversations` has conv_id, turn, role, text; more columns are not looked at. A null role or text is rendered
    as empty, but differs from an empty one when conversations are compared. An empty table has no rows.
    """
    from .common import written

    hashed = written(prefix_hashes(conversations), "turns")
    before, between, after = map(F.lit, template)
    rendered = F.concat(before, F.coalesce("role", F.lit("")), between, F.coalesce("text", F.lit("")), after)
    return hashed.join(maximal(hashed), "conv_id").select("conv_id", "n_turns", "position", rendered.alias("rendered"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, role, text, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg(coalesce('r' || role, '-') || chr(31) || coalesce('t' || text, '-') || chr(30), '') OVER w AS prefix
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, prefix FROM p WHERE position = n_turns GROUP BY n_turns, prefix),
kept AS (SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n_turns AND p.position = whole.n_turns AND p.prefix = whole.prefix))
SELECT p.conv_id AS conv_id, p.n_turns AS n_turns, p.position AS position,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN kept ON p.conv_id = kept.conv_id
"""
