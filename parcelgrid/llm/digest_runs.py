"""Exact deduplication by a tree-merge of sorted digest runs.

Texts are equal when they are identical after deleting the ASCII white space
(0x20, 0x09-0x0D).  Of equal texts the row with the most code points in its
original text stays, then the smallest id, then the row read first.

1. Every row becomes a digest row: a 64-bit digest of the normalised text, with
   its SHA-256 and length to verify by.  Digest rows are written once; whole
   texts are never shuffled.
2. Each partition sorts its digest rows to a run and collapses equal ones, so a
   run holds one row per text with its best identifier and its number of copies.
3. Runs are exchanged in binomial rounds: partitions are numbered in ``fan_in``
   (a power of two, so one round is several binomial steps) and in round ``j``
   a partition sends every row to that partner of its group of ``fan_in`` whose
   digit ``j`` is that of the row's digest.  The partner merges the runs it gets
   and collapses rows that are verified equal: digest, SHA-256 and length.
   After the last round a partition holds the merged run of its own part of the
   digests.  A text that fills a third of all rows is one row per run from the
   first level on, and at most ``fan_in`` rows meet per partition and round.
4. The verdicts go back to the rows by digest and lane.  Lanes spread the rows of
   one text, so that a large group is not one join key.

Null texts count as empty.  Texts of white space only equal the empty text.  A
null id is larger than any other: it stays only where all ids of its group with
as many code points are null.  Repeated rows are rows of their own: one stays.
An empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.shipping import ship_package
from parcelgrid.session import ensure_checkpoint_dir

FAN_IN = 8
ROWS_PER_RUN = 500_000
LANES = 64
VERIFIED = ["digest", "sha", "n_chars"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``: its digest, what verifies it, and what ranks it."""
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("points"),
                       normalised(F.col(text_col)).alias("body"))
    return body.select("id", "points", F.monotonically_increasing_id().alias("row"), F.xxhash64("body").alias("digest"),
                       F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"),
                       F.char_length("body").alias("n_chars"))


def _collapse(batches):
    """Of a sorted run: the first row of each verified text, with the copies of all."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        sha = batch.column("sha").cast(pa.binary(32))
        words = np.frombuffer(sha.buffers()[1], np.int64, 4 * len(sha), 32 * sha.offset).reshape(-1, 4)
        keys = np.column_stack([words, batch.column("digest").to_numpy(), batch.column("n_chars").to_numpy()])
        firsts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        copies = np.add.reduceat(batch.column("copies").to_numpy(), firsts)
        run = batch.take(pa.array(firsts))
        run = pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()) if name == "copies" else run.column(name)
                                          for name in batch.schema.names], schema=batch.schema)
        if run.num_rows > 1:
            yield run.slice(0, run.num_rows - 1)
        held = run.slice(run.num_rows - 1)
    if held is not None:
        yield held


def sorted_run(rows: DataFrame) -> DataFrame:
    """Every partition's rows merged to one sorted run of verified texts, best identifier first."""
    order = [*VERIFIED, F.desc("points"), F.asc_nulls_last("id"), "row"]
    return rows.sortWithinPartitions(*order).mapInArrow(_collapse, rows.schema)


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN, rows_per_run: int = ROWS_PER_RUN, n_rows: int | None = None) -> DataFrame:
    """(digest, sha, n_chars, id, row, points, copies): one row per text, after all rounds."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    n_rows = rows.count() if n_rows is None else n_rows
    rounds, width = 1, fan_in
    while width * rows_per_run < n_rows:
        rounds, width = rounds + 1, width * fan_in
    first = rows.withColumn("copies", F.lit(1).cast("long"))
    first = first.withColumn("at", F.pmod(F.spark_partition_id(), F.lit(width)))
    runs = sorted_run(first)
    own = F.pmod(F.col("digest"), F.lit(width)).cast("int")  # the digest's part: the partition that ends with it
    for j in range(rounds):
        step = fan_in ** j
        digit = F.pmod(F.floor(F.col("at") / step), F.lit(fan_in))
        wanted = F.pmod(F.floor(own / step), F.lit(fan_in))
        moved = runs.withColumn("at", (F.col("at") + (wanted - digit) * step).cast("int"))
        runs = sorted_run(moved.repartitionById(width, F.col("at")))
    return runs.drop("at")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN,
                     rows_per_run: int = ROWS_PER_RUN, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id column, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``folder`` (default: a new one under the session's checkpoint folder) holds the
    digest rows and the merged run, so that lost executors cost no earlier round.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-runs-{uuid.uuid4().hex}"
    digest_rows(docs, id_col, text_col).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    merge_runs(rows, fan_in, rows_per_run).write.parquet(f"{folder}/merged")
    groups = (spark.read.parquet(f"{folder}/merged").where("copies > 1")
              .select(*VERIFIED, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "copies"))

    laned = rows.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(LANES)))
    lanes = laned.select(*VERIFIED, "lane").distinct()  # at most LANES rows of one text
    verdicts = lanes.join(groups, VERIFIED)
    found = laned.join(verdicts, [*VERIFIED, "lane"], "left")
    alone = F.col("copies").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
