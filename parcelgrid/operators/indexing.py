"""Dense positions in a total order, computed without a single-task window.

``row_number()`` over an unpartitioned window moves every row into one task.
Here the rows are range-partitioned on the order columns, numbered inside each
range, and shifted by the sizes of the ranges before them (one small row per
range, so the offset table is bounded by the partition count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.session import ensure_checkpoint_dir


def dense_index(df: DataFrame, order_cols, name: str = "row_index", num_partitions: int | None = None,
                total: str | None = None) -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order_cols`` order, and
    with ``total`` the number of all rows, which the range sizes give without
    another scan.

    ``order_cols`` must be unique per row (add a tie-breaker).  The range id is
    written out with a reliable checkpoint (to ``spark.checkpoint.dir``) so the
    per-range counts and the per-range numbering see the same ranges, also after
    an executor is lost and tasks rerun.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    ranged = ranged.withColumn("_rng", F.spark_partition_id()).checkpoint(eager=True)
    local = ranged.withColumn("_loc", F.row_number().over(Window.partitionBy("_rng").orderBy(*cols)) - 1)
    sizes = ranged.groupBy("_rng").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1))
    totals = [F.sum("_size").over(Window.partitionBy()).cast("long").alias(total)] if total else []
    offsets = sizes.select("_rng", F.coalesce(before, F.lit(0)).alias("_off"), *totals)
    # offsets has one row per range partition: a proven bound for the broadcast.
    return (local.join(F.broadcast(offsets), "_rng")
            .select(*df.columns, (F.col("_off") + F.col("_loc")).cast("long").alias(name), *([total] if total else [])))


def ranked(df: DataFrame, order_cols, name: str = "rank", total: str = "total") -> DataFrame:
    """An order as data: ``rank`` (from 1) in ``order_cols`` order and ``total``, on
    every row.  A table read back has no row order; the rank is what a sorted
    listing shows."""
    return dense_index(df, order_cols, name, total=total).withColumn(name, F.col(name) + 1)


def positional_folds(df: DataFrame, order_cols, k: int = 5, name: str = "fold") -> DataFrame:
    """``ntile(k)`` over ``order_cols``: contiguous blocks, the first ``n % k``
    blocks one row longer (1-based fold numbers)."""
    indexed = dense_index(df, order_cols, "_i", total="_n")
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    i = F.col("_i")
    big = r * (q + 1)
    fold = F.when(i < big, F.floor(i / (q + 1)) + 1).otherwise(r + F.floor((i - big) / q) + 1)
    return indexed.withColumn(name, fold.cast("long")).drop("_i", "_n")
