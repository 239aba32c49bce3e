"""Chat formatting after collapsing cumulative snapshots.

Logged conversations often repeat: a later log holds an earlier one as its first
turns.  Every turn gets a rolling hash of its conversation's prefix (an XOR of
position-tagged turn hashes, carried from turn to turn, 128 bits in two halves),
so two conversations share a prefix where their hashes agree.  A conversation
whose whole hash is a proper prefix hash of another is dropped by an anti-join;
of equal conversations the smallest ``conv_id`` stays.  What stays is maximal and
is rendered.  All of it is DataFrame work; hashes are made distinct before the
join, so a first turn or a conversation that very many share is one row there.

Turns are ordered by ``turn``, then role and text (ties and repeated rows keep
their own places); a null role or text is the empty string; turns with a null
``conv_id`` form one conversation; an empty table gives no rows; other columns
are ignored whatever their names.

A conversation of more than ``bucket_turns`` turns (a null or common ``conv_id``
may hold a third of all rows) is never one task: equal turns are counted first and
dealt to ranges of (conversation, turn, role, text), so its turns are numbered within
ranges, with offsets from the ranges before; the prefix hashes are carried over
pieces of ``bucket_turns`` positions.  Sizes, offsets and carried hashes are tables
joined on conversation and range or piece; none is collected, and none is broadcast
unless Spark measures it to be small.
``format_chats`` has one row per conversation, which must stay under Spark's row
limit of 2 GB; ``format_chat_parts`` has several ordered rows for long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.session import ensure_checkpoint_dir

TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


BUCKET_TURNS = 4_000
RANGE_TURNS = 50_000  # of long conversations, in one range
PART_CHARS = 50_000_000


def _tagged(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("x1", F.xxhash64(F.lit(1), "pos", "role", "text"))
            .withColumn("x2", F.xxhash64(F.lit(2), "text", "role", "pos")))


def _hash_short(rows: DataFrame) -> DataFrame:
    """Every conversation in one window group."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _tagged(rows.withColumn("pos", F.row_number().over(order)))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("h1", F.bit_xor("x1").over(so_far)).withColumn("h2", F.bit_xor("x2").over(so_far))
            .withColumn("last", F.lead("pos").over(order).isNull()).drop("x1", "x2"))


def _number_long(rows: DataFrame, bucket_turns: int, range_turns: int) -> DataFrame:
    """``rows`` (with the conversation's size ``n``) with ``pos``, by ranges of neighbouring turns."""
    turn = ["conv_id", "turn", "role", "text"]
    equal = rows.groupBy(*turn, "n").agg(F.count("*").alias("times")).checkpoint()
    n_ranges = max(1, -(-equal.count() // range_turns))
    # ranges are read twice: written, they stay the same when a task is run again
    ranged = equal.repartitionByRange(n_ranges, *turn).withColumn("range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv_id", "range").agg(F.sum("times").alias("__in")).select(
        F.col("conv_id").alias("__conv"), F.col("range").alias("__range"),
        F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranged = ranged.withColumn("upto", F.sum("times").over(inside)).join(
        offsets, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("range") == F.col("__range")))
    first = F.col("before") + F.col("upto") - F.col("times") + 1
    end = F.col("before") + F.col("upto")
    # a turn that very many rows repeat is spread in two steps
    some = ranged.withColumn("__end", end).withColumn("__from", F.explode(F.sequence(first, end, F.lit(bucket_turns).cast("long"))))
    some = some.repartition("conv_id", "__from")
    last = F.least(F.col("__end"), F.col("__from") + (bucket_turns - 1))
    each = some.select(*turn, "n", F.explode(F.sequence("__from", last)).alias("pos"))
    return each.withColumn("pos", F.col("pos").cast("int"))


def _hash_long(rows: DataFrame, bucket_turns: int, range_turns: int) -> DataFrame:
    rows = _tagged(_number_long(rows, bucket_turns, range_turns))
    rows = rows.withColumn("piece", F.floor((F.col("pos") - 1) / bucket_turns).cast("int"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2")).select(
        F.col("conv_id").alias("__conv"), F.col("piece").alias("__piece"),
        F.coalesce(F.bit_xor("c1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("c2").over(before), F.lit(0)).alias("b2")))
    inside = (Window.partitionBy("conv_id", "piece").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("h1", F.bit_xor("x1").over(inside)).withColumn("h2", F.bit_xor("x2").over(inside))
    rows = rows.join(carried, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("piece") == F.col("__piece")))
    return rows.select("conv_id", "turn", "role", "text", "pos", F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"),
                       F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"), (F.col("pos") == F.col("n")).alias("last"), "piece")


def with_prefix_hashes(turns: DataFrame, bucket_turns: int = BUCKET_TURNS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """Turns with ``pos`` (from 1), ``last``, the rolling prefix hash (``h1``, ``h2``) and, if any conversation is long, its ``piece``."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    sizes = (rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > bucket_turns)
             .withColumnRenamed("conv_id", "__conv"))
    if sizes.isEmpty():
        return _hash_short(rows)
    ensure_checkpoint_dir(turns.sparkSession)
    sizes = sizes.checkpoint()
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    short = _hash_short(rows.join(sizes, same, "left_anti")).withColumn("piece", F.lit(0))
    return short.unionByName(_hash_long(rows.join(sizes, same).drop("__conv"), bucket_turns, range_turns))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id) of the conversations that stay; ``hashed`` is ``with_prefix_hashes``' table."""
    whole = (hashed.where("last").groupBy(F.col("pos").alias("n"), "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    prefixes = hashed.where(~F.col("last")).select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def _joined(order: str, text) -> Column:
    blocks = F.array_sort(F.collect_list(F.struct(order, text.alias("said"))))
    return F.array_join(F.transform(blocks, lambda b: b["said"]), "").alias("rendered")


def _said():
    return F.concat(F.lit(TURN_OPEN), "role", F.lit(ROLE_CLOSE), "text", F.lit(TURN_CLOSE))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): every turn as an opened, named and closed block, in order."""
    if "piece" not in turns.columns:
        return turns.groupBy("conv_id").agg(_joined("pos", _said()))
    pieces = turns.groupBy("conv_id", "piece").agg(_joined("pos", _said()))
    return pieces.groupBy("conv_id").agg(_joined("piece", F.col("rendered")))


def _kept(turns: DataFrame, bucket_turns: int) -> tuple[DataFrame, DataFrame]:
    hashed = with_prefix_hashes(turns, bucket_turns)
    stay = maximal_conversations(hashed)
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    kept = hashed.join(stay.select(F.col("conv_id").alias("__conv")), same, "left_semi")
    return stay, kept.drop("turn", "h1", "h2", "last")


def format_chats(turns: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """Maximal conversations: ``conv_id``, ``n_turns``, ``n_copies`` (equal logs, itself included), ``rendered``."""
    stay, kept = _kept(turns, bucket_turns)
    texts = render(kept).withColumnRenamed("conv_id", "__conv")
    return stay.join(texts, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "n_turns", "n_copies", "rendered")


def format_chat_parts(turns: DataFrame, bucket_turns: int = BUCKET_TURNS, part_chars: int = PART_CHARS) -> DataFrame:
    """``format_chats`` with rows of at most ``bucket_turns`` turns and about ``part_chars`` characters (one turn at least).

    ``first_turn`` is the position of a part's first turn: in its order the parts
    of a conversation add up to its ``rendered``.
    """
    stay, kept = _kept(turns, bucket_turns)
    said = (kept if "piece" in kept.columns else kept.withColumn("piece", F.lit(0))).withColumn("__said", _said())
    before = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum(F.length("__said")).over(before), F.lit(0)) / part_chars)
    parts = (said.withColumn("__cut", cut).groupBy("conv_id", "piece", "__cut")
             .agg(F.min("pos").alias("first_turn"), _joined("pos", F.col("__said")))
             .withColumnRenamed("conv_id", "__conv"))
    return (stay.join(parts, F.col("conv_id").eqNullSafe(F.col("__conv")))
            .select("conv_id", "n_turns", "n_copies", "first_turn", "rendered"))
