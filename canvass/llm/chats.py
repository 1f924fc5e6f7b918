"""Chat formatting: logged snapshots that a longer conversation continues go (operator 6).

A conversation is the sequence of its (turn, role, text) by turn.  A running sum of hashes that
hold the turn, the role and the text names each prefix: equal prefixes have equal sums, and
since the turn is hashed the sum stands for the order too.  Two sums of 64 bits make an
accidental match of two different prefixes about 2**-128 likely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation summed by one task; longer ones are summed by blocks first.
BLOCK = 256
# The markers of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns, numbered within their conversation by blocks of turn numbers."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text",
    ).distinct().withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit((1 << 62))) / BLOCK))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, length and the two rolling hashes of each prefix, with ``whole`` at the last."""
    order = ["turn", "role", "text"]
    hashes = {f"h{i}": F.xxhash64(F.lit(i), *order, *(F.col(c).isNull() for c in order)).cast("decimal(38,0)") for i in range(2)}
    rows = turns.withColumns(hashes)
    sums = [F.sum(h).alias(h) for h in hashes]
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), *sums)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.sum("n").over(whole).alias("turns"),
        *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in ("n", *hashes)))
    inside = Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).asc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select(
        "conv_id", "turns", (F.col("n_before") + F.count("*").over(inside)).alias("length"),
        *((F.col(f"{h}_before") + F.sum(h).over(inside)).alias(h) for h in hashes))


def maximal(conversations: DataFrame) -> DataFrame:
    """Ids of the conversations that no other continues, the smallest id of equal ones."""
    known = prefixes(turns_of(conversations))
    key = ["length", "h0", "h1"]
    wholes = known.filter(F.col("length") == F.col("turns")).groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    continued = known.filter(F.col("length") < F.col("turns")).select(*key).distinct()
    return wholes.join(continued, key, "left_anti").select("conv_id", F.col("length").alias("n_turns"), "copies")


def rendered_turn() -> Column:
    blank = F.lit("")
    return F.concat(F.lit(OPEN), F.coalesce(F.col("role"), blank), F.lit("\n"), F.coalesce(F.col("text"), blank), F.lit(CLOSE))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of each maximal conversation.

    A conversation goes if its turns are the first turns of a longer one; of equal ones the
    smallest id stays and ``copies`` counts them.  Repeated rows count once; turns of one
    number come in the order of role and text; a NULL turn comes last; NULL role and text are
    rendered empty, but differ from empty ones when conversations are compared; rows without
    conv_id are one conversation, smaller than none.
    """
    kept = maximal(conversations)
    turns = turns_of(conversations).alias("t").join(
        kept.alias("k"), F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select("k.*", "t.turn", "t.role", "t.text")
    order = F.struct(F.coalesce(F.col("turn"), F.lit((1 << 63) - 1)).alias("turn"), F.col("role").isNull(), "role",
                     F.col("text").isNull(), "text", rendered_turn().alias("rendered"))
    pieces = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["rendered"])
    return turns.groupBy("conv_id", "n_turns", "copies").agg(F.array_join(pieces, "").alias("text"))
