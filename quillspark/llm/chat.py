"""Chat formatting: collapse of cumulative snapshots, then rendering, in DataFrame operations.

Logged conversations are often saved after every turn, so that one is a prefix
of the next. The hash of a prefix of n turns is the sum, over its turns, of a
hash of (position, role, text), modulo 2**61: sums can be taken in blocks of
turns, so a conversation of any length is never one task's work. Two sums with
different salts and the length identify a prefix. Conversations with the same
full hash are copies, and the smallest id stays; those whose full hash is among
the hashes of proper prefixes are left out by an anti-join.

Texts are dealt out once, by conversation and block; positions, hashes, offsets
and rendering all work on that one exchange, which Spark reads again for each of
them. What goes between blocks and conversations is one narrow row a block.

Each turn is rendered as one row with the offset of its first character, so a
long chat needs no row that holds all of it.

Defined cases: rows with a null conversation id take no part; repeated rows count
once; turns are ordered by turn, role and text, a null turn last; a null role is
``unknown`` and a null text empty; very long texts are rendered whole; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Turns whose number falls into one block are ranked together; longer conversations have more blocks.
BLOCK_TURNS = 1024
UNKNOWN_ROLE = "unknown"
#: Sums of hashes are kept modulo this; within a block they are sums of 40 bits.
MODULUS = 2**61

_BLOCK = ["conv_id", "block"]
_SUMS = ("one", "two", "ends")


def _inside() -> WindowSpec:
    """Turns of a block up to the present one."""
    return Window.partitionBy(*_BLOCK).orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, turn, role, text): the different turns, dealt out by conversation and block."""
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN_ROLE)).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(2**62)))
    return turns.repartition(*_BLOCK).distinct()  # equal rows are in one partition already


def numbered_turns(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The turns with their position from 1, what they render to, and running sums inside their block.

    ``one`` and ``two`` are sums of 40-bit hashes, which fit 64 bits for blocks
    of up to eight million different turns; the sum of a larger block is an
    error, not wrong.
    """
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tally = turns.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"))
    before = tally.select(*_BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("turns_before"))
    own = turns.withColumn("local", F.row_number().over(_inside())).join(before, _BLOCK)
    own = own.withColumn("position", F.col("local") + F.col("turns_before")).drop("local", "turns_before")
    own = own.withColumn("rendered", F.concat(F.lit(start), F.col("role"), F.lit("\n"), F.col("text"), F.lit(end + "\n")))
    hashes = {n: F.shiftrightunsigned(F.xxhash64("position", "role", "text", F.lit(salt)), 24) for n, salt in (("one", 1), ("two", 2))}
    return own.withColumns({n: F.sum(c).over(_inside()) for n, c in (hashes | {"ends": F.length("rendered").cast("long")}).items()})


def block_sums(numbered: DataFrame) -> DataFrame:
    """One row a block: the sums of earlier blocks, and those of the whole conversation with its length."""
    totals = numbered.groupBy(*_BLOCK).agg(F.max("position").alias("n"), *(F.max_by(c, "position").cast("decimal(38,0)").alias(c) for c in _SUMS))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = lambda c, over: F.pmod(F.coalesce(F.sum(c).over(over), F.lit(0).cast("decimal(38,0)")), F.lit(MODULUS).cast("decimal(38,0)")).cast("long")
    return totals.select(*_BLOCK, F.max("n").over(whole).alias("n_turns"), *(part(c, earlier).alias(f"{c}_before") for c in _SUMS), *(part(c, whole).alias(f"{c}_whole") for c in _SUMS[:2]))


def _prefix(c: str) -> Column:
    return F.pmod(F.col(c) % MODULUS + F.col(f"{c}_before"), F.lit(MODULUS))


def maximal_conversations(numbered: DataFrame, sums: DataFrame) -> DataFrame:
    """(conv_id): conversations that are neither copies of a smaller id nor proper prefixes of others."""
    whole = sums.groupBy("n_turns", F.col("one_whole").alias("one"), F.col("two_whole").alias("two")).agg(F.min("conv_id").alias("conv_id"))
    proper = numbered.select(*_BLOCK, "position", "one", "two").join(sums, _BLOCK).where("position < n_turns")
    proper = proper.select(F.col("position").alias("n_turns"), _prefix("one").alias("one"), _prefix("two").alias("two")).distinct()
    return whole.join(proper, ["n_turns", "one", "two"], "left_anti").select("conv_id")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", **columns: str) -> DataFrame:
    """(conv_id, n_turns, position, start, rendered): the turns of every maximal conversation.

    ``start`` counts the characters rendered before the turn; put together in
    order of position, ``rendered`` is the chat.
    """
    numbered = numbered_turns(turns_of(conversations, **columns), start, end)
    sums = block_sums(numbered)
    blocks = sums.join(maximal_conversations(numbered, sums), "conv_id").select(*_BLOCK, "n_turns", "ends_before")
    out = numbered.select(*_BLOCK, "position", "ends", "rendered").join(blocks, _BLOCK)
    return out.select("conv_id", "n_turns", "position", (F.col("ends") + F.col("ends_before") - F.length("rendered")).alias("start"), "rendered")
