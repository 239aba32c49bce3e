"""Sharding over fixed virtual slots with a versioned slot-to-shard map.  Law: ``bytes``.

Rows hash into a fixed number of virtual slots.  Bytes are added up per slot
(partial aggregation, one row per slot), and a map assigns slots to shards.
Rebalancing edits the map only: it moves or swaps slots until the shards' bytes
are near equal, and is stored as a new version beside the old ones.  Rows never
change their slot, so a new map moves whole slots.

``assign_shards`` returns one row per input row: the id, ``size`` (UTF-8 bytes of
the text plus 1; null text: 1), ``text_crc32`` (null text: of the empty text),
``law``, ``shard``, ``slot`` (place in the shard, gapless from 0),
``grown_shard`` (null under this law) and ``virtual_slot``.  Rows hash by id, size
and text checksum, so rows without an id spread out too.  Rows equal in all three
share a virtual slot up to ``EQUAL_ROWS`` of them; more are dealt to as many salts as
they fill, so no slot holds a group of any size.  An empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAW = "bytes"
VIRTUAL_SLOTS = 4096
EQUAL_ROWS = 16


def slot_sizes(rows: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each virtual slot; at most ``n_slots`` rows reach the driver."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes = [(0, 0)] * n_slots
    for row in found:
        sizes[row.virtual_slot] = (row.b, row.n)
    return sizes


def first_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: equal ranges of slots."""
    return [slot * n_shards // n_slots for slot in range(n_slots)]


def rebalance(mapping: list[int], sizes: list[int], n_shards: int, tolerance: float = 0.001) -> list[int]:
    """An edited copy of the map whose shard sizes differ by at most ``tolerance`` of the mean, if slots allow.

    Overfull shards give up slots, largest first, until they are within the mean;
    the slots in hand go, largest first, to the emptiest shard.  Then pairs of
    slots are swapped between the fullest and the emptiest shard while that
    brings them closer.  Slots that stay are not touched.
    """
    mean = sum(sizes) / n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in enumerate(mapping):
        held[shard].append(slot)
    load = [sum(sizes[s] for s in slots) for slots in held]
    if max(load) - min(load) <= tolerance * mean:
        return list(mapping)
    loose = []
    for shard in range(n_shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes[s], s)):
            if load[shard] <= mean:
                break
            if sizes[slot] and load[shard] - sizes[slot] >= 0:
                loose.append(slot)
                held[shard].remove(slot)
                load[shard] -= sizes[slot]
    heap = [(load[s], s) for s in range(n_shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
        least, shard = heapq.heappop(heap)
        held[shard].append(slot)
        heapq.heappush(heap, (least + sizes[slot], shard))
    load = [sum(sizes[s] for s in slots) for slots in held]
    for _ in range(64 * n_shards):
        top, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[top] - load[low]
        if gap <= tolerance * mean:
            break
        best = _best_exchange(held[top], held[low], sizes, gap)
        if best is None:
            break
        out, back = best
        held[top].remove(out)
        held[low].append(out)
        if back is not None:
            held[low].remove(back)
            held[top].append(back)
        moved = sizes[out] - (sizes[back] if back is not None else 0)
        load[top] -= moved
        load[low] += moved
    edited = list(mapping)
    for shard, slots in enumerate(held):
        for slot in slots:
            edited[slot] = shard
    return edited


def _best_exchange(full: list[int], empty: list[int], sizes: list[int], gap: int) -> tuple[int, int | None] | None:
    """The move or swap between two shards that comes closest to moving half of the gap."""
    from bisect import bisect_left

    backs = sorted([(0, -1), *((sizes[s], s) for s in empty)])
    best, found = gap, None
    for out in full:
        want = sizes[out] - gap / 2
        at = bisect_left(backs, (want, -1))
        for size, back in backs[max(0, at - 1):at + 1]:
            moved = sizes[out] - size
            left = abs(gap - 2 * moved)
            if 0 < moved < gap and left < best:
                best, found = left, (out, None if back < 0 else back)
    return found


def write_map(spark: SparkSession, folder: str, version: int, mapping: list[int]) -> None:
    """Store one version of the map; earlier versions stay as they are."""
    rows = [(version, slot, shard) for slot, shard in enumerate(mapping)]
    (spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1)
     .write.mode("overwrite").parquet(f"{folder.rstrip('/')}/version={version}"))


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(virtual_slot, shard) of one version: one row per slot."""
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}").select("virtual_slot", "shard")


def last_version(spark: SparkSession, folder: str) -> int | None:
    """The newest stored version of the map; None where there is none."""
    try:
        return spark.read.parquet(folder).select(F.max("version")).first()[0]
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _salted(rows: DataFrame, equal_rows: int) -> DataFrame:
    """``rows`` with ``salt``: 0, or one of as many as a large group of equal rows fills."""
    equal = ["id", "size", "text_crc32"]
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).checkpoint()  # ids and sizes only: texts are read once
    many = (rows.groupBy(*equal).agg(F.count("*").alias("__n")).where(F.col("__n") > equal_rows)
            .select(F.col("id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"),
                    F.ceil(F.col("__n") / equal_rows).alias("__salts")))
    same = (F.col("id").eqNullSafe(F.col("__id")) & (F.col("size") == F.col("__size"))
            & (F.col("text_crc32") == F.col("__crc")))
    salt = F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__salts")), F.lit(0))
    return rows.join(many, same, "left").select(*equal, salt.alias("salt"))


def assign_shards(docs: DataFrame, n_shards: int, map_folder: str, n_slots: int = VIRTUAL_SLOTS,
                  id_col: str = "doc_id", text_col: str = "text", equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """Shard and place of every row (see the module's docstring).

    The newest map in ``map_folder`` is edited to near equal bytes and stored as the
    next version; an empty folder begins with version 0, equal ranges of slots.  Slots
    of shards that no longer exist go to the others first.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = _salted(rows, equal_rows)
    hashed = F.when(F.col("salt") == 0, F.xxhash64("id", "size", "text_crc32")).otherwise(
        F.xxhash64("id", "size", "text_crc32", "salt"))
    rows = rows.withColumn("virtual_slot", F.pmod(hashed, F.lit(n_slots)).cast("int")).drop("salt").checkpoint()
    sizes = slot_sizes(rows, n_slots)
    version = last_version(spark, map_folder)
    if version is None:
        version, start = 0, first_map(n_slots, n_shards)
        write_map(spark, map_folder, version, start)
    else:
        stored = {r["virtual_slot"]: r["shard"] for r in read_map(spark, map_folder, version).collect()}  # n_slots rows
        if sorted(stored) != list(range(n_slots)):
            raise ValueError(f"the stored map has {len(stored)} slots, not {n_slots}")
        start = [stored[slot] if stored[slot] < n_shards else slot % n_shards for slot in range(n_slots)]
    edited = rebalance(start, [b for b, _ in sizes], n_shards)
    write_map(spark, map_folder, version + 1, edited)
    ahead, offsets = [0] * n_shards, []
    for slot, shard in enumerate(edited):
        offsets.append((slot, ahead[shard]))
        ahead[shard] += sizes[slot][1]
    before = spark.createDataFrame(offsets, "virtual_slot int, before long")
    placed = F.broadcast(read_map(spark, map_folder, version + 1).join(before, "virtual_slot"))  # n_slots rows: a parameter
    order = Window.partitionBy("virtual_slot").orderBy("id", "size", "text_crc32")
    return (rows.withColumn("rank", F.row_number().over(order) - 1).join(placed, "virtual_slot")
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("before") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "virtual_slot"))
