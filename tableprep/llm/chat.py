"""Chat formatting with cumulative-snapshot collapse (operator 10).

Logs hold a conversation many times over, once after each turn. A conversation is the sequence of its turns (role and
text) in turn order; it is dropped when another one begins with the whole of it. Of equal conversations the smallest
conv_id stays. What remains is rendered with role markers.

1. Turns get their position in the conversation (running totals in two levels, so that a conversation with very many
   turns is spread over ranges of its turn numbers).
2. Each turn is hashed with its position; the running sums of two such 64-bit hashes are the rolling hash of the prefix
   that ends there. A sum needs no order beyond the running total, so it is computed like the position.
3. A conversation is named by its length and whole hash. An anti-join of these names with the distinct prefixes that end
   before a conversation's last turn keeps the maximal conversations; equal ones meet in a partial minimum of conv_id.
4. Rendering: a turn is ``<|role|>\\n`` + text + ``<|end|>\\n``; a conversation is the turns in order. Parts of up to
   ``PART`` turns are put together, so no task holds a conversation of any length (nearly all are one part).

Null texts render as empty, null roles as ``user``; both differ from their rendered form in the hashes. Rows with a null
conv_id are dropped, a null turn number comes last. Repeated (conv_id, turn) rows are ordered by role and text; exactly
equal rows count once. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import hot_keys, running_total, salted_lookup, stage

CHUNK, PART = 1024, 1024


def _wrapped(value):
    """Running sums stay inside 64 bits: terms below 2^30 a turn, added exactly."""
    return F.pmod(value, F.lit(1 << 30))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, position, n_turns, h0..h3): position from 1 of n_turns, and the rolling hash of the turns up
    to this one. The number of turns comes with the parts' totals, so no row of a long conversation is joined by its id."""
    cols = ["conv", "turn", "role", "text"]
    rows = turns.select(*cols).where("conv is not null").distinct()
    rows = rows.withColumn("chunk", F.floor(F.coalesce(F.col("turn"), F.lit((1 << 62))) / CHUNK).cast("long"))
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    placed = stage(running_total(rows, ["conv"], "chunk", order, F.lit(1).cast("long"), "before").withColumn(
        "position", F.col("before") + 1).drop("before"))
    # four running sums of 30-bit hashes: 120 bits, exact up to 2^33 turns
    out = placed.withColumn("part", F.floor((F.col("position") - 1) / CHUNK).cast("long"))
    for i in range(4):
        term = _wrapped(F.xxhash64(F.lit(i), "position", F.coalesce("role", F.lit("\x00null")), F.col("role").isNull(),
                                   F.coalesce("text", F.lit("")), F.col("text").isNull()))
        out = out.withColumn(f"t{i}", term)
    # one scan for the four sums: local sums within a part, then the parts' starts
    from pyspark.sql import Window
    inside = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = out.groupBy("conv", "part").agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("c"))
    starts = totals.select("conv", "part", *[F.coalesce(F.sum(f"s{i}").over(across), F.lit(0)).alias(f"a{i}")
                                             for i in range(4)], F.sum("c").over(Window.partitionBy("conv")).alias("n_turns"))
    local = out.select(*cols, "position", "part", *[F.sum(f"t{i}").over(inside).alias(f"l{i}") for i in range(4)])
    joined = local.join(starts, ["conv", "part"])
    return joined.select(*cols, "position", "n_turns", *[(F.col(f"l{i}") + F.col(f"a{i}")).alias(f"h{i}") for i in range(4)])


NAME = ["position", "h0", "h1", "h2", "h3"]


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): conversations that no other one begins with; copies counts the equal ones."""
    ends = hashed.where("position = n_turns")
    whole = ends.groupBy(*NAME).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = hashed.where("position < n_turns")
    prefixes = inner.select(*NAME).distinct()
    kept = whole.join(prefixes, NAME, "left_anti")
    return kept.select("conv", F.col("position").alias("n_turns"), "copies")


def rendered_turn(role, text):
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")),
                    F.lit("<|end|>\n"))


def collapse_and_render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text") -> DataFrame:
    """One row a part of each maximal conversation: conv_id, part, n_parts, n_turns, copies, rendered."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    hashed = stage(prefix_hashes(rows))
    kept = stage(maximal_conversations(hashed))
    hot = hot_keys(kept, ["conv"], hashed.count(), "n_turns")
    body = salted_lookup(hashed.select("conv", "position", "role", "text"), kept, ["conv"], F.col("position"), hot=hot)
    part = F.floor((F.col("position") - 1) / PART).cast("long")
    piece = F.struct("position", rendered_turn(F.col("role"), F.col("text")).alias("r"))
    parts = body.withColumn("part", part).groupBy("conv", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.sort_array(F.collect_list(piece)).alias("pieces"))
    return parts.select(F.col("conv").alias("conv_id"), "part",
                        F.ceil(F.col("n_turns") / PART).cast("long").alias("n_parts"), "n_turns", "copies",
                        F.array_join(F.col("pieces.r"), "").alias("rendered"))
