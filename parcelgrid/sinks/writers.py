"""Writers: keyed tile results, master list, link plan, append-only ledgers.

The crawler rewrote whole JSON files after each tile.  Here every write is a
Spark job with task-level commit: a rerun of a tile replaces only that tile's
partition (dynamic partition overwrite), ledgers only ever get new files
(append), and readers apply set semantics.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.session import ensure_checkpoint_dir

STORE_BUCKETS = 32


def write_tile_results(df: DataFrame, path: str, partition_col: str = "tile_key", keep_empty: bool = True,
                       house_count: str = "house_count") -> None:
    """Tile payloads keyed by ``partition_col``; a rewritten key replaces only
    its own partition (K1).  ``keep_empty=False`` writes only tiles with
    houses.  With many thousands of tiles pass a coarser ``partition_col``
    (for example a region id) and keep the tile key as a column.  A row without
    a key stops the job: unrelated tiles would share one partition and replace
    each other; filter such rows out first."""
    key = F.coalesce(F.col(partition_col), F.raise_error(F.lit("tile result without a key")).cast(
        df.schema[partition_col].dataType))
    df = df.withColumn(partition_col, key)
    out = df if keep_empty else df.filter(F.col(house_count) > 0)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_col).parquet(path))


def write_tile_store(df: DataFrame, path: str, key: str = "tile_key", buckets: int = STORE_BUCKETS) -> None:
    """Tile documents of many tiles in few files (K1): rows are stored by a coarse hash
    bucket of their key, and a write replaces the stored rows of its own keys only.

    ``df`` holds one row per key.  The stored rows of the touched buckets that have
    other keys are carried over, so a bucket is rewritten as a whole; buckets without
    a new key are not read or written.  A row without a key stops the job.  Read it
    back with ``spark.read.parquet(path)``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    number = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    fresh = df.withColumn("bucket", F.when(F.col(key).isNull(), F.raise_error(F.lit("tile document without a key")).cast("int"))
                          .otherwise(number))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        merged = fresh
    else:
        fresh = fresh.checkpoint()  # read twice: its keys decide what is carried over
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        others = stored.filter(F.col("bucket").isin(touched)).join(fresh.select(key), key, "left_anti")
        # a folder cannot be read while it is overwritten: the merged rows are written out first
        merged = fresh.unionByName(others.select(*fresh.columns)).checkpoint()
    (merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path))


def save_tiles(results: DataFrame, store: str, ledger: str, run_id: str, key: str = "tile", payload: str = "payload") -> None:
    """Save a run's tiles with their outcome in one chain (V4 -> K1 -> K4).

    ``results`` has one row per tile with ``outcome``, ``visited`` and the merged
    ``payload``.  All go to the tile store, with a payload where the tile is saved; the
    visited ones are then appended to the ledger from what the store holds, so no tile
    is marked before its document is written, and the tiles are computed once.
    """
    kept = F.when(F.col("outcome") == "saved", F.col(payload))
    write_tile_store(results.select(key, "outcome", "visited", kept.alias(payload), F.lit(run_id).alias("run_id")), store, key)
    stored = results.sparkSession.read.parquet(store)
    append_ledger(stored.filter((F.col("run_id") == run_id) & F.col("visited")).select(key), ledger, run_id)


def write_named_files(df: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> None:
    """One file per row under ``root`` at the row's relative path, written by the tasks
    (K1/S6 layouts that other programs read).  A repeated task writes the same files.
    ``root`` is a shared folder, as a path or URI that ``pyarrow.fs`` knows."""
    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(content)
            yield batch.slice(0, 0)

    rows = df.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()


def write_master_list(df: DataFrame, path: str, json_path: str | None = None) -> None:
    """Master list as Parquet, optionally also as JSON lines (UTF-8, non-ASCII
    kept) (K2)."""
    df.write.mode("overwrite").parquet(path)
    if json_path:
        df.write.mode("overwrite").json(json_path)


def write_links(df: DataFrame, path: str, order_col: str = "idx") -> None:
    """Link plan as Parquet, range-partitioned and sorted by ``order_col`` so
    the files read back in index order (K3)."""
    df.repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col).write.mode("overwrite").parquet(path)


def append_ledger(df: DataFrame, path: str, run_id: str) -> None:
    """Append ledger rows tagged with ``run_id`` (K4, K5, K6).  Readers take
    the distinct keys, so appending the same rows twice changes nothing."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def write_if_absent(statuses: DataFrame, path: str, run_id: str, status_col: str = "status") -> None:
    """Append the rows ``insert_if_absent`` marked ``saved`` (K7)."""
    append_ledger(statuses.filter(F.col(status_col) == "saved").drop(status_col), path, run_id)
