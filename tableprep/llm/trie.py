"""Conversation prefix trie with subtree totals by depth bands (operator 13).

Conversations share their first turns. A node of depth d is a distinct sequence of first d turns (role and text); the
root (d = 0) has no turn. A conversation is a member of the nodes of all its prefixes.

``rebuilt_turns`` makes the conversations of the query: conversation c begins with the first h turns of conversation
``c - c % 5`` (all if that one is shorter, none if it is absent), followed by its own turns after its first h, with h the
unsigned CRC-32 of the decimal c, modulo 9. ``%`` is the remainder of SQL (it has the sign of c).

1. Turns are put in order by a range sort of (conversation, turn, role, text), so one conversation of any length is dealt
   out over tasks. Each task numbers its turns; a conversation that goes on in the next tasks gets its start from the
   totals of the tasks before (at most two numbers a task, summed on the driver). Texts move once, in that sort; from
   then on a turn is two 64-bit hashes and a length.
2. A prefix is named by its depth and two polynomial hashes modulo 2^61 - 1 over its turns, made by the same sort and
   carry. The name of a node's parent is the value one turn earlier.
3. Members of a node meet in partial aggregates: smallest member, number of members, of conversations that end there.
4. Depth bands: a band is ``BAND`` consecutive depths. A node explodes only to its ancestors within its band, so at most
   ``BAND`` rows a node, and each band sums its own part of every subtree. The tops of the bands form a trie of their
   own, lower by the factor ``BAND``, which is summed the same way; the completed totals of the tops then go to the nodes
   of the band above. That makes two rounds a level and about log(depth) / log(``BAND``) levels.
5. The members that end at a node are sorted over all tasks, joined to runs of at most ``RUN`` ids, and each node's runs
   stream through its SHA-256 in order. The hash itself is sequential, so one task reads a node's runs, one at a time.

Null roles and texts are empty, null turns come first, equal turn numbers are ordered by role and text (by UTF-8 bytes);
equal rows are separate turns. Rows with a null conv_id belong to no conversation. Extra columns are not read. An empty
table has no node. Texts of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.base import hot_keys, part_count, salted_lookup, stage

BAND, RUN = 16, 4096
SHARED_TURNS, FAMILY = 9, 5
PRIME = (1 << 61) - 1
# The two bases of the prefix hashes (any numbers far from 0 and the prime would do).
BASES = (1_152_921_504_606_846_883, 864_691_128_455_135_207)
NAME = ["depth", "k0", "k1"]


def _carried(staged: DataFrame, total: list[str], last: str) -> dict[tuple[int, int], list[tuple]]:
    """Totals that each task's first conversation has in the tasks before: {(task, conv): [totals, in task order]}.

    Only the first and last conversation of a task can go on elsewhere, so at most two rows a task reach the driver.
    """
    edges = {r["task"]: (r["lo"], r["hi"]) for r in staged.groupBy("task").agg(
        F.min("conv").alias("lo"), F.max("conv").alias("hi")).collect()}
    seen, torn = set(), set()
    for lo, hi in edges.values():
        torn |= {lo, hi} & seen
        seen |= {lo, hi}
    if not torn:
        return {}
    rows = staged.where(F.col("conv").isin(list(torn))).groupBy("conv", "task").agg(
        *[F.max_by(c, last).alias(c) for c in total]).collect()
    out, before = {}, {}
    for r in sorted(rows, key=lambda r: (r["conv"], r["task"])):
        out[r["task"], r["conv"]] = list(before.get(r["conv"], []))
        before.setdefault(r["conv"], []).append(tuple(r[c] for c in total))
    return out


def ordered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, position from 1, t0, t1, n_bytes): the turns of each conversation in order, hashed."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv is not null")
    parts = part_count(turns)
    dealt = rows.repartitionByRange(parts, "conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    placed = dealt.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select(
        "conv", *[F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in range(2)],
        F.octet_length("text").cast("long").alias("n_bytes"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                n = n + 1 if c == conv else 1
                conv = c
                places.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64()), pa.array([task] * len(places), pa.int32())],
                [*batch.schema.names, "place", "task"])

    staged = stage(placed.mapInArrow(number, "conv long, t0 long, t1 long, n_bytes long, place long, task int"))
    starts = {k: sum(x[0] for x in v) for k, v in _carried(staged, ["place"], "place").items()}
    carry = turns.sparkSession.createDataFrame([(t, c, n) for (t, c), n in starts.items()],
                                               "task int, conv long, start long")
    return staged.join(F.broadcast(carry), ["task", "conv"], "left").select(  # at most two rows a task
        "conv", (F.col("place") + F.coalesce("start", F.lit(0))).alias("position"), "t0", "t1", "n_bytes")


def rebuilt_turns(ordered: DataFrame) -> DataFrame:
    """(conv, part, position, t0, t1, n_bytes): a row (part 0) for each conversation, then the shared and the own turns."""
    conv = F.col("conv")
    shared = F.pmod(F.crc32(conv.cast("string")), F.lit(SHARED_TURNS)).cast("long")
    base = conv - conv % FAMILY
    own = ordered.where((conv == base) | (F.col("position") > shared)).select(
        "conv", F.lit(2).alias("part"), "position", "t0", "t1", "n_bytes")
    known = ordered.where("position = 1").select("conv", base.alias("base"), shared.alias("shared"))
    markers = known.select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"),
                           *[F.lit(0).cast("long").alias(c) for c in ("t0", "t1", "n_bytes")])
    heads = ordered.where((conv == base) & (F.col("position") < SHARED_TURNS)).withColumnRenamed("conv", "base")
    taken = known.where("conv <> base").join(heads, "base").where("position <= shared").select(
        "conv", F.lit(1).alias("part"), "position", "t0", "t1", "n_bytes")
    return markers.unionByName(taken).unionByName(own)


def whole_turns(ordered: DataFrame) -> DataFrame:
    """The conversations as they are, in the form of :func:`rebuilt_turns`."""
    markers = ordered.where("position = 1").select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("position"),
                                                   *[F.lit(0).cast("long").alias(c) for c in ("t0", "t1", "n_bytes")])
    return markers.unionByName(ordered.select("conv", F.lit(2).alias("part"), "position", "t0", "t1", "n_bytes"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, k0, k1, p0, p1, n_bytes, ends): each prefix of each conversation, named by depth, k0 and k1."""
    dealt = turns.repartitionByRange(part_count(turns), "conv", "part", "position").sortWithinPartitions(
        "conv", "part", "position").select("conv", "part", "t0", "t1", "n_bytes")
    schema = ("conv long, steps long, k0 long, k1 long, p0 long, p1 long, n_bytes long, ends boolean, task int, "
              "place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Steps and hashes since the start of the conversation or, where it began elsewhere, of this task."""
        task, conv, steps, k0, k1, place, held = TaskContext.get().partitionId(), None, 0, 0, 0, 0, None
        for batch in batches:
            out = [held] if held else []
            for c, part, t0, t1, size in zip(*[x.to_pylist() for x in batch.columns]):
                if c != conv:
                    conv, steps, k0, k1, place = c, 0, 0, 0, 0
                p0, p1 = k0, k1
                place += 1
                if part:  # the marker of a conversation is no turn
                    steps += 1
                    k0, k1 = (k0 * BASES[0] + t0) % PRIME, (k1 * BASES[1] + t1) % PRIME
                out.append((c, steps, k0, k1, p0, p1, size, True, task, place))
            out = [(*r[:7], i + 1 == len(out) or out[i + 1][0] != r[0], *r[8:]) for i, r in enumerate(out)]
            held = out.pop() if out else None
            yield _batch(out, schema)
        if held:
            yield _batch([held], schema)

    staged = stage(dealt.mapInArrow(run, schema))
    carried = _carried(staged, ["steps", "k0", "k1"], "place")
    starts, goes_on = {}, {}
    for (task, conv), before in carried.items():
        n, k = 0, [0, 0]
        for steps, *keys in before:
            n, k = n + steps, [(a * pow(b, steps, PRIME) + x) % PRIME for a, b, x in zip(k, BASES, keys)]
        starts[task, conv] = (n, *k)
        goes_on[conv] = max(goes_on.get(conv, task), task)
    names = ["conv", "depth", "k0", "k1", "p0", "p1", "n_bytes", "ends"]
    if not starts:
        return staged.select(F.col("steps").alias("depth"), *[c for c in names if c != "depth"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, steps, k0, k1, p0, p1, size, ends, task, _ in zip(*[x.to_pylist() for x in batch.columns]):
                n, s0, s1 = starts.get((task, c), (0, 0, 0))
                if n:
                    up, less = steps, max(steps - 1, 0)
                    k0, k1 = [(s * pow(b, up, PRIME) + k) % PRIME for s, b, k in zip((s0, s1), BASES, (k0, k1))]
                    p0, p1 = [(s * pow(b, less, PRIME) + p) % PRIME for s, b, p in zip((s0, s1), BASES, (p0, p1))]
                rows.append((c, steps + n, k0, k1, p0, p1, size, ends and goes_on.get(c, task) == task))
            yield _batch(rows, "conv long, depth long, k0 long, k1 long, p0 long, p1 long, n_bytes long, ends boolean")

    return stage(staged.mapInArrow(
        place, "conv long, depth long, k0 long, k1 long, p0 long, p1 long, n_bytes long, ends boolean"))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)],
                                      [n for n, _ in fields])


def trie_nodes(members: DataFrame) -> DataFrame:
    """One row a node: depth, k0, k1, p0, p1, conv (smallest member), n_convs, n_ends, n_bytes of its last text."""
    return members.groupBy(*NAME).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
        F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("n_bytes").alias("n_bytes"))


def _paths(steps: DataFrame, band: int) -> DataFrame:
    """(conv, band, keys): the names that a conversation passes in each band, in order; at most ``band`` of them."""
    return steps.groupBy("conv", F.expr(f"step div {band}").alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("step", *NAME))).alias("keys"))


def subtree_totals(nodes: DataFrame, steps: DataFrame, values: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """(depth, k0, k1, values): the sums of ``values`` over each node's subtree, its top included.

    ``nodes`` has (step, depth, k0, k1, conv, values), ``steps`` (conv, step, depth, k0, k1) with the names that ``conv``
    passes, steps counted from 0 without gaps, up to ``deepest`` for any conversation.
    """
    paths = stage(_paths(steps, band))
    sums = [F.sum(v).alias(v) for v in values]
    at = nodes.select("step", F.expr(f"step div {band}").alias("band"), F.col("conv").alias("c"), *NAME, *values)
    theirs = at.select("step", "band", "c", *values).join(
        paths, (F.col("c") == paths["conv"]) & (at["band"] == paths["band"])).select(
        F.explode(F.slice("keys", 1, (F.col("step") % band + 1).cast("int"))).alias("up"), *values)
    inside = theirs.select(*[f"up.{n}" for n in NAME], *values).groupBy(*NAME).agg(*sums)
    if deepest < band:
        return inside
    inside = stage(inside)
    tops = at.where(f"step % {band} = 0").select("step", "c", *NAME)
    tops = stage(tops.join(inside, NAME).select(F.expr(f"step div {band}").alias("step"), F.col("c").alias("conv"),
                                                *NAME, *values))
    whole = stage(subtree_totals(tops, paths.select("conv", F.col("band").alias("step"), F.col("keys")[0].alias("k"))
                                 .select("conv", "step", *[f"k.{n}" for n in NAME]), values, deepest // band, band))
    # a completed top adds to the nodes of the band above it, but for that band's own top, which is complete
    low = tops.where("step > 0").select(F.col("step").alias("below"), F.col("conv").alias("c"), *NAME).join(whole, NAME)
    above = low.select((F.col("below") - 1).alias("b"), "c", *values).join(
        paths, (F.col("c") == paths["conv"]) & (F.col("b") == paths["band"])).select(
        F.explode(F.slice("keys", 2, band - 1)).alias("up"), *values).select(*[f"up.{n}" for n in NAME], *values)
    own = inside.join(whole.select(*NAME), NAME, "left_anti")
    return own.unionByName(above).unionByName(whole).groupBy(*NAME).agg(*sums)


def end_hashes(members: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256) of the nodes where a conversation ends."""
    parts = part_count(members)
    keys = ["k0", "k1", "depth"]
    ends = stage(members.where("ends").select(*keys, "conv"))
    dealt = ends.repartitionByRange(parts, *keys, "conv").sortWithinPartitions(*keys, "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run = None, []
        for batch in batches:
            out = []
            for *k, conv in zip(*[x.to_pylist() for x in batch.columns]):
                if k != key or len(run) == RUN:
                    if run:
                        out.append((*key, run[0], ",".join(map(str, run))))
                    key, run = k, []
                run.append(conv)
            yield _batch(out, "k0 long, k1 long, depth long, first long, ids string")
        if run:
            yield _batch([(*key, run[0], ",".join(map(str, run)))], "k0 long, k1 long, depth long, first long, ids string")

    runs = stage(dealt.mapInArrow(join, "k0 long, k1 long, depth long, first long, ids string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*[x.to_pylist() for x in batch.columns]):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, "k0 long, k1 long, depth long, ends_sha256 string")
        if state:
            yield _batch([(*key, state.hexdigest())], "k0 long, k1 long, depth long, ends_sha256 string")

    return runs.repartition(parts, *keys).sortWithinPartitions(*keys, "first").mapInArrow(
        digest, "k0 long, k1 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, rebuilt: bool = True, band: int = BAND, id_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ordered = stage(ordered_turns(turns, id_col, turn_col, role_col, text_col))
    members = stage(prefixes(rebuilt_turns(ordered) if rebuilt else whole_turns(ordered)))
    nodes = stage(trie_nodes(members))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    saved = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0)
    valued = nodes.select(F.col("depth").alias("step"), *NAME, "conv", saved.alias("saved_tokens"),
                          (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"))
    totals = subtree_totals(valued, members.select("conv", F.col("depth").alias("step"), *NAME),
                            ["saved_tokens", "n_leaves"], deepest, band)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"),
                                                F.col("p1").alias("k1")).agg(F.count(F.lit(1)).alias("n_children"))
    every = stage(nodes.select(*NAME, "p0", "p1", "conv", "n_convs").join(totals, NAME).join(children, NAME, "left").join(
        end_hashes(members), NAME, "left"))
    # a node's children may be a third of all nodes
    hot = hot_keys(every.select(*[F.col(n).alias(f"u{i}") for i, n in enumerate(NAME)], F.col("n_children").alias("n")),
                   ["u0", "u1", "u2"], nodes.count())
    up = every.select(*[F.col(n).alias(f"u{i}") for i, n in enumerate(NAME)], F.col("conv").alias("parent_conv_id"))
    lower = every.withColumns({"u0": F.col("depth") - 1, "u1": F.col("p0"), "u2": F.col("p1")})
    out = salted_lookup(lower, up, ["u0", "u1", "u2"], F.col("conv"), "left", hot)
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
                      F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
