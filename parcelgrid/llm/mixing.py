"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut into blocks of ``block_rows`` in a fixed shuffled
order.  With weights ``w`` that add up to 1, block ``j`` of a source may be placed
from its release time ``floor(j / w)`` and before its deadline
``ceil((j + 1) / w)``.  At every time the released block with the earliest
deadline is placed; on one resource this keeps every source within less than one
block of ``w * t`` at every time ``t``.

The weights are the given ones, as integers over their own sum (a float counts as
the decimal number it prints as), so the bound holds against the target however
many blocks there are.  When a source runs out, a new phase begins: the other
sources' weights are scaled up to 1 and the bound holds again within the phase,
so every row is placed once and none is dropped or repeated.

A plan of up to ``plan_blocks`` blocks is made on the driver.  A longer one is cut
into pieces of a phase which Spark schedules side by side: which blocks earliest
deadline first has placed before a time ``T`` follows from ``T`` alone
(``served_by``), so no piece waits for the one before.

Sources are a bounded list (``max_sources``; more are an error); a null source is
one of its own.  Rows are numbered inside (source, hash bucket) groups with
offsets from bucket counts, so a source with most of the rows is never one task.
Rows equal in source, id and text hash alike; where more than ``bucket_rows`` of them
do, they are dealt to buckets of their own by a written row number.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelgrid.llm.shipping import ship_package

BLOCK_ROWS = 32
PERIOD = 1024  # least number of places in a piece of a phase
MAX_SOURCES = 10_000
BUCKET_ROWS = 4_000
RANGE_BYTES, MANY_RANGES, LARGE_RANGE_BYTES = 16 << 20, 20_000, 512 << 20
BROADCAST_PLACES = 200_000  # blocks; a longer plan is made in Spark and joined by shuffle
ROWS_AT_ONCE = 50_000
SLOTS_AT_ONCE = 1 << 20
PLACES = "phase int, source_no int, block long, rel long, due long, time long"


def exact(weight) -> Fraction:
    """The weight as a fraction; a float is the decimal number it prints as."""
    return Fraction(weight) if isinstance(weight, (int, Fraction, Decimal)) else Fraction(str(float(weight)))


def whole_weights(weights: list[Fraction]) -> list[int]:
    """The same weights as integers without a common divisor."""
    unit = functools.reduce(lcm, (w.denominator for w in weights), 1)
    whole = [int(w * unit) for w in weights]
    common = functools.reduce(gcd, whole)
    return [w // common for w in whole]


def served_by(time: int, shares: list[int]) -> list[int]:
    """Blocks of each source that earliest deadline first has placed before ``time``, without going through it.

    Blocks due by then are all placed.  Each source has at most one more released
    block; of these the earliest deadlines win, as far as the places since their
    releases leave room: from any ``s`` on there are ``time - s`` places, less
    those of due blocks released at ``s`` or later.
    """
    total = sum(shares)
    served = [w * time // total for w in shares]
    spare = time - sum(served)
    open_ = sorted((-(-(served[k] + 1) * total // w), k) for k, w in enumerate(shares) if w * time % total)
    if spare == len(open_):
        return [n + (w * time % total > 0) for n, w in zip(served, shares)]
    release = {k: served[k] * total // shares[k] for _, k in open_}
    levels = sorted(set(release.values()))
    room = _room(time, shares, served, levels)
    at = {s: i for i, s in enumerate(levels)}
    for _, k in open_:
        if not spare:
            break
        upto = at[release[k]] + 1
        if room[:upto].min() > 0:
            room[:upto] -= 1
            served[k] += 1
            spare -= 1
    return served


def _room(time: int, shares: list[int], due: list[int], levels: list[int]) -> np.ndarray:
    """Least room from any ``s`` on, over the times ``s`` after the level before and up to each level."""
    total, after, past = sum(shares), 0, time  # ``after``: due blocks released from ``past`` on
    room = np.full(len(levels), np.iinfo(np.int64).max)
    marks = np.array(levels, np.int64)
    while past > levels[0]:
        low = max(levels[0], past - SLOTS_AT_ONCE)
        released = np.zeros(past - low, np.int64)
        for w, n in zip(shares, due):
            first, last = -(-w * low // total), min(-(-w * past // total), n)
            if first < last:
                kind = np.int64 if last * total < 1 << 62 else object
                released[((np.arange(first, last).astype(kind) * total) // w - low).astype(np.int64)] += 1
        behind = after + released[::-1].cumsum()[::-1]
        times = np.arange(low, past)
        level = np.searchsorted(marks, times)
        known = level < len(levels)
        np.minimum.at(room, level[known], (time - times - behind)[known])
        after, past = int(behind[0]), low
    return room


def schedule(shares: list[int], served: list[int], time: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, time) from ``time`` on without end, after ``served`` blocks of each source."""
    total = sum(shares)
    waiting = [(j * total // w, k, j) for k, (w, j) in enumerate(zip(shares, served))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    while True:
        while waiting and waiting[0][0] <= time:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[k]), k, j, release))
        due, k, j, release = heapq.heappop(ready)
        yield k, j, release, due, time
        heapq.heappush(waiting, ((j + 1) * total // shares[k], k, j + 1))
        time += 1


def piece_places(shares: list[int], period: int) -> int:
    """Places of a piece: its start looks at every source and one block of the rarest back, which its places pay for."""
    return max(period, 4 * len(shares), sum(shares) // min(shares) // 64)


def phase_end(left: list[int], shares: list[int], period: int) -> tuple[int, list[int]]:
    """Length of the phase in which the first source runs out, and the blocks that each source has in it."""
    total, step = sum(shares), piece_places(shares, period)
    low = min((n - 1) * total // w for n, w in zip(left, shares))  # before this no source can be out
    high = min(-(-n * total // w) for n, w in zip(left, shares))
    low = low if low > step else 0
    served = served_by(low, shares) if low else [0] * len(shares)
    while high - low > step:
        middle = (low + high) // 2
        then = served_by(middle, shares)
        if any(a >= b for a, b in zip(then, left)):
            high = middle
        else:
            low, served = middle, then
    for k, _, _, _, time in schedule(shares, served, low):
        served[k] += 1
        if served[k] == left[k]:
            return time + 1, served


def walk_phases(blocks: list[int], weights: list, period: int = PERIOD) -> Iterator[dict]:
    """Phases one by one: ``active`` sources, their integer weights (``shares`` of ``total``), first block and blocks served."""
    target = [exact(w) for w in weights]
    left, done, start = list(blocks), [0] * len(blocks), 0
    while any(left):
        active = [k for k, n in enumerate(left) if n]
        shares = whole_weights([target[k] for k in active])
        length, served = phase_end([left[k] for k in active], shares, period)
        yield {"start": start, "length": length, "total": sum(shares), "active": active, "shares": shares,
               "first": [done[s] for s in active], "served": served}
        for k, source in enumerate(active):
            left[source] -= served[k]
            done[source] += served[k]
        start += length


def phases(blocks: list[int], weights: list, period: int = PERIOD) -> list[dict]:
    """All phases of the mix (see ``walk_phases``)."""
    return list(walk_phases(blocks, weights, period))


def places_of(number: int, start: int, active: list[int], shares: list[int], first: list[int], begin: int,
              end: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(phase, source, block, release, deadline, place) of the places ``begin`` to ``end`` of a phase."""
    dealt = schedule(shares, served_by(begin, shares) if begin else [0] * len(shares), begin)
    for _, (k, j, release, due, time) in zip(range(end - begin), dealt):
        yield number, active[k], first[k] + j, start + release, start + due, start + time


def _place_batches(batches):
    """Pieces of phases (Arrow batches) to their places."""
    names = [part.split()[0] for part in PLACES.split(", ")]
    kinds = [pa.int32() if part.endswith("int") else pa.int64() for part in PLACES.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for p in batch.to_pylist():
            rows = []
            for row in places_of(p["number"], p["start"], p["active"], [int(w) for w in p["shares"]], p["first"],
                                 p["begin"], p["end"]):
                rows.append(row)
                if len(rows) == ROWS_AT_ONCE:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def place_table(spark: SparkSession, blocks: list[int], weights: list, period: int, plan_blocks: int) -> DataFrame:
    """One row per block of every source with its phase, release, deadline and place; made in Spark past ``plan_blocks``."""
    places, whole, here = [], [], sum(blocks) <= plan_blocks
    for number, ph in enumerate(walk_phases(blocks, weights, period)):
        if here:
            places.extend(places_of(number, ph["start"], ph["active"], ph["shares"], ph["first"], 0, ph["length"]))
            continue
        whole.append((number, ph["start"], ph["length"], piece_places(ph["shares"], period), ph["active"],
                      [str(w) for w in ph["shares"]], ph["first"]))
    if here:
        return F.broadcast(spark.createDataFrame(places, PLACES))  # plan_blocks rows at most
    ship_package(spark)
    # a row per phase leaves the driver (at most one phase a source); its pieces are made in Spark
    made = spark.createDataFrame(whole, "number int, start long, length long, step long, active array<int>, "
                                        "shares array<string>, first array<long>")
    begins = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.col("step"))
    pieces = made.withColumn("begin", F.explode(begins)).withColumn("end", F.least(F.col("begin") + F.col("step"), "length"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.select("number", "start", "begin", "end", "active", "shares", "first")
            .repartition(n_parts, "number", "begin").mapInArrow(_place_batches, PLACES))


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS,
        period: int = PERIOD, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        max_sources: int = MAX_SOURCES, carry: tuple[str, ...] = (), plan_blocks: int = BROADCAST_PLACES,
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: id, source, ``block``, ``phase``, ``release``, ``deadline``, ``place`` and ``row_in_block``.

    ``place`` numbers all blocks from 0 without gaps; release and deadline are
    absolute and hold ``release <= place < deadline``.  ``weights`` maps sources
    to positive numbers and must name every source; by default a source weighs
    its block count to the power ``temperature``.  ``period`` is the least number
    of places that Spark schedules as one piece of a plan over ``plan_blocks``.  ``carry`` names further columns
    to take along.  Repeated rows take places of their own; ties in the shuffled
    order (equal id and text) are equal rows; null ids and texts are hashed like
    any other value; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                       F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
                       .alias("__key"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)])
    counts = rows.groupBy("__source").count().limit(max_sources + 1).collect()
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    counts.sort(key=lambda r: (r[0] is None, str(r[0])))
    sources, sizes = [r[0] for r in counts], [r[1] for r in counts]
    blocks = [-(-n // block_rows) for n in sizes]
    given = [weights[s] for s in sources] if weights else [n ** temperature for n in blocks]
    if any(w <= 0 for w in given):
        raise ValueError("weights must be positive")
    places = place_table(spark, blocks, given, period, plan_blocks)
    n_buckets = [max(1, -(-n // bucket_rows)) for n in sizes]
    kind = docs.schema[source_col].dataType.simpleString()
    numbered = spark.createDataFrame([(s, k, b) for k, (s, b) in enumerate(zip(sources, n_buckets))],
                                     f"__s {kind}, source_no int, buckets long")
    rows = rows.join(F.broadcast(numbered), F.col("__source").eqNullSafe(F.col("__s")))  # at most max_sources rows
    rows = _dealt(rows, bucket_rows)
    # equal parts of the hash range: bucket order is hash order
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("__key", 33)) * F.col("buckets") / F.lit(1 << 31)))
    per_bucket = rows.groupBy("source_no", "bucket", "__deal").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("bucket", "__deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source_no", "bucket", "__deal", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # the unsigned order of the hash, as the buckets have it
    inside = Window.partitionBy("source_no", "bucket", "__deal").orderBy(F.shiftrightunsigned("__key", 33), "__key", "__id")
    row_no = (F.col("before") + F.row_number().over(inside) - 1)
    placed = rows.join(offsets, ["source_no", "bucket", "__deal"]).withColumn("__row", row_no)
    placed = placed.withColumn("block", F.floor(F.col("__row") / block_rows))
    here = placed.join(places, ["source_no", "block"])
    return here.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), F.col("block"), F.col("phase"),
                       F.col("rel").alias("release"), F.col("due").alias("deadline"), F.col("time").alias("place"),
                       F.pmod(F.col("__row"), F.lit(block_rows)).cast("int").alias("row_in_block"),
                       *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)])


def _dealt(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` with ``__deal``: 0, or for very many equal rows one of the buckets they fill by themselves."""
    equal = ["source_no", "__key", "__id"]
    many = (rows.groupBy(*equal).agg(F.count("*").alias("__n")).where(F.col("__n") > bucket_rows)
            .select(*[F.col(c).alias(f"{c}_m") for c in equal], F.ceil(F.col("__n") / bucket_rows).alias("__deals")))
    if many.isEmpty():
        return rows.withColumn("__deal", F.lit(0).cast("long"))
    many = many.checkpoint()
    # the row number decides buckets that are counted and filled in two passes: it is written out with the rows
    rows = rows.withColumn("__row_id", F.monotonically_increasing_id()).checkpoint()
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_m")) for c in equal])
    dealt = rows.join(many, same, "left").withColumn(
        "__deal", F.coalesce(F.pmod(F.xxhash64("__row_id"), F.col("__deals")) + 1, F.lit(0)))
    return dealt.drop("__deals", "__row_id", *[f"{c}_m" for c in equal])


def n_ranges(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(partitions for whole rows by the bytes of their texts, rows): ``RANGE_BYTES`` each, larger ones past ``MANY_RANGES``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64
    row = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    n = -(-(row["bytes"] or 0) // RANGE_BYTES)
    if n > MANY_RANGES:
        n = max(MANY_RANGES, -(-row["bytes"] // LARGE_RANGE_BYTES))
    return max(n, docs.sparkSession.sparkContext.defaultParallelism), row["n"]


def mixed_order(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns kept, in mix order: partitions are ranges of places, sorted inside."""
    packed = docs.select("*", F.struct("*").alias("__whole"))
    placed = mix(packed, carry=("__whole",), **settings)
    n_parts, n_rows = n_ranges(docs, settings.get("text_col", "text"))
    n_blocks = F.lit(max(1, n_rows // settings.get("block_rows", BLOCK_ROWS)))
    # places are gapless, so equal ranges of places are equal parts: no sampling pass over whole texts
    part = F.least(F.floor(F.col("place") * n_parts / n_blocks), F.lit(n_parts - 1)).cast("int")
    return (placed.withColumn("__part", part).repartitionById(n_parts, "__part")
            .sortWithinPartitions("place", "row_in_block").select("__whole.*"))


def stored_place(stored: DataFrame) -> tuple[DataFrame, int]:
    """``stored``, a plain Parquet read of written files, with the row's number in file and row order as ``place``; rows.

    A read deals the files to tasks by size, so the order of ``mixed_order``'s
    files is taken from their part numbers and the rows' positions.  Only one
    count per file goes to the driver.
    """
    rows = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = rows.groupBy("__file").agg((F.max("__at") + 1).alias("n")).collect()
    sizes.sort(key=lambda r: [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"([0-9]+)", r[0])])
    offsets, total = [], 0
    for name, n in sizes:
        offsets.append((name, total))
        total += n
    files = stored.sparkSession.createDataFrame(offsets, "__name string, __before long")
    placed = rows.join(F.broadcast(files), F.col("__file") == F.col("__name"))  # a row per file
    return placed.withColumn("place", F.col("__before") + F.col("__at")).drop("__file", "__at", "__name", "__before"), total


def in_place_order(rows: DataFrame, total: int, n_parts: int) -> DataFrame:
    """``rows`` with ``place`` from 0 to ``total`` - 1: ``n_parts`` partitions are ranges of places, sorted inside."""
    part = F.floor(F.col("place") * n_parts / F.lit(max(1, total))).cast("int")
    return (rows.withColumn("__part", part).repartitionById(n_parts, "__part").sortWithinPartitions("place")
            .drop("__part"))
