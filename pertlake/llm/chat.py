"""Operator 8, chat formatting: cumulative-snapshot collapse, then rendering.

Logging systems store a conversation again after every turn. A conversation whose turns
are, in order, the first turns of a longer one (or all turns of another) is dropped.

1. Turns are numbered within their conversation in two levels (runs of ``RUN`` turn
   numbers, then the runs' sizes), so that one huge conversation spans many tasks.
2. Rolling prefix hashes: a turn's hash covers its number, role and text; the prefix hash
   is the exclusive-or of the hashes so far (two of 64 bits, also in two levels).
3. A conversation's last prefix is looked up among the distinct proper prefixes of all
   conversations (anti-join); of equal conversations the smallest conv_id stays.
4. The turns of the maximal conversations are rendered, one row per turn.

Defined results: turns are ordered by turn, role, text; rows that repeat all four columns
count once; a null role or text counts as empty, a null turn comes first; rows with a null
conv_id form one conversation; empty texts are turns like others and very long ones are whole;
other columns aren't read, so their names may clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertlake.llm.common import materialize

RUN = 64
TEMPLATE = ("<|{role}|>\n", "\n<|end|>\n")


def _two_hashes(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def _with(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Inner join on conv_id (null equals null) and ``on``; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in ("conv_id", *on) else F.col(c) for c in right.columns])
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id"))
    for c in on:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return left.join(other, same).drop("__conv_id", *[f"__{c}" for c in on])


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text, h1, h2: the hash of the turns up to each turn."""
    turns = conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).dropDuplicates()
    run = F.floor(F.coalesce("turn", F.lit(-1)) / RUN)
    numbered = turns.withColumn("run", run)
    inside = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = numbered.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "run", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    placed = numbered.withColumn("nth", F.row_number().over(inside))
    placed = _with(placed, offsets, "run").select(
        "conv_id", "run", "role", "text", (F.col("nth") + F.col("offset")).alias("position")
    )
    h1, h2 = _two_hashes(F.col("position"), F.col("role"), F.col("text"))
    hashed = materialize(placed.withColumn("t1", h1).withColumn("t2", h2), "op8-turns")
    per_run = hashed.groupBy("conv_id", "run").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = per_run.select(
        "conv_id", "run",
        *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
    )
    by_position = Window.partitionBy("conv_id", "run").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = hashed.select("*", *[F.bit_xor(f"t{i}").over(by_position).alias(f"r{i}") for i in (1, 2)])
    return _with(rolled, before, "run").select(
        "conv_id", "position", "role", "text",
        *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)],
    )


def collapse(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefix rows, maximal conversations with conv_id, turns and copies)."""
    rows = materialize(prefixes(conversations), "op8-prefixes")
    lengths = rows.groupBy("conv_id").agg(F.max("position").alias("turns"))
    placed = _with(rows, lengths)
    last = placed.filter("position = turns").select("conv_id", "turns", "h1", "h2")
    whole = last.groupBy("turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = placed.filter("position < turns").select(F.col("position").alias("turns"), "h1", "h2").distinct()
    return rows, whole.join(proper, ["turns", "h1", "h2"], "left_anti")


def render(conversations: DataFrame, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """conv_id, position, turns, copies, role, rendered: every turn of the conversations that stay."""
    rows, maximal = collapse(conversations)
    head, tail = template
    before, after = head.split("{role}")
    kept = _with(rows, maximal.select("conv_id", "turns", "copies"))
    return kept.select(
        "conv_id", "position", "turns", "copies", "role",
        F.concat(F.lit(before), F.col("role"), F.lit(after), F.col("text"), F.lit(tail)).alias("rendered"),
    )
