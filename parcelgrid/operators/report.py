"""Run reports and table profiles (A9, A10, A12), one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.operators.ledger import insert_if_absent


def run_report(visits: DataFrame, run: str = "run_id", tile: str = "tile", ok: str = "success",
               seconds: str = "seconds", houses: str = "house_count") -> DataFrame:
    """Per run: tiles, pages ok / failed, houses, success %, total and mean
    seconds per tile, tiles per hour (null when nothing was timed)."""
    agg = visits.groupBy(run).agg(
        F.count_distinct(tile).alias("tiles"),
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col(ok), 1)).alias("pages_ok"),
        F.count(F.when(~F.col(ok), 1)).alias("pages_failed"),
        F.sum(houses).cast("long").alias("houses"),
        F.sum(seconds).alias("_secs"))
    return agg.select(
        run, "tiles", "pages", "pages_ok", "pages_failed", "houses",
        F.round(F.try_divide(F.col("pages_ok") * 100.0, F.col("pages")), 2).alias("success_pct"),
        F.round("_secs", 2).alias("total_seconds"),
        F.round(F.try_divide(F.col("_secs"), F.col("tiles")), 4).alias("seconds_per_tile"),
        F.round(F.try_divide(F.col("tiles") * 3600.0, F.col("_secs")), 4).alias("tiles_per_hour"))


def tile_progress(plan: DataFrame, visited: DataFrame, visits: DataFrame, run: str = "run_id", idx: str = "idx",
                  link: str = "link", tile: str = "tile", ok: str = "success", seconds: str = "seconds",
                  houses: str = "house_count") -> DataFrame:
    """Per run, its plan against what was done (A9): ``planned`` tiles, ``skipped``
    (in the ledger already), ``no_link`` (not in it, without a link), ``processed``
    (the others that the visit log has), pages ok / failed, houses, success %, elapsed
    and mean seconds, and the time the ``remaining`` tiles will take at that mean.

    ``plan`` is one row per run and tile, ``visited`` the ledger before the run,
    ``visits`` the page log.  The log is summed per run and tile first, so each of
    the two equi-joins meets one row per key.
    """
    log = visits.groupBy(F.col(run), F.col(tile).alias(idx)).agg(
        F.count(F.when(F.col(ok), 1)).alias("_ok"), F.count(F.when(~F.col(ok), 1)).alias("_failed"),
        F.sum(houses).cast("long").alias("_houses"), F.sum(seconds).alias("_secs"))
    known = visited.select(idx).distinct().withColumn("_known", F.lit(True))
    tiles = plan.select(run, idx, link).join(known, idx, "left").join(log, [run, idx], "left")
    skipped = F.col("_known").isNotNull()
    linked = F.col(link).isNotNull() & (F.col(link) != "")
    did = ~skipped & linked & F.col("_ok").isNotNull()

    def of_done(column):
        return F.sum(F.when(did, F.col(column)).otherwise(0))

    agg = tiles.groupBy(run).agg(
        F.count(F.lit(1)).alias("planned"), F.count(F.when(skipped, 1)).alias("skipped"),
        F.count(F.when(~skipped & ~linked, 1)).alias("no_link"), F.count(F.when(did, 1)).alias("processed"),
        of_done("_ok").alias("pages_ok"), of_done("_failed").alias("pages_failed"), of_done("_houses").alias("houses"),
        of_done("_secs").alias("_elapsed"))
    per_tile = F.try_divide(F.col("_elapsed"), F.col("processed"))
    remaining = F.col("planned") - F.col("skipped") - F.col("no_link") - F.col("processed")
    return agg.select(
        run, "planned", "skipped", "no_link", "processed", "pages_ok", "pages_failed", "houses",
        F.round(F.try_divide(F.col("pages_ok") * 100.0, F.col("pages_ok") + F.col("pages_failed")), 2).alias("success_pct"),
        F.round("_elapsed", 2).alias("elapsed_seconds"), F.round(per_tile, 4).alias("seconds_per_tile"),
        remaining.alias("remaining"), F.round(per_tile * remaining, 2).alias("eta_seconds"))


def house_report(statuses: DataFrame, run: str = "run_id", status: str = "status",
                 seconds: str = "seconds") -> DataFrame:
    """Per run: processed (= saved), saved, failed, skipped, mean seconds, and the
    ``remaining`` houses (no status yet) with the time they will take: the seconds of
    all houses done so far per processed house, as the crawler estimates it."""
    done = F.sum(F.when(F.col(status).isNotNull(), F.col(seconds)))
    agg = statuses.groupBy(run).agg(
        F.count(F.when(F.col(status) == "saved", 1)).alias("processed"),
        F.count(F.when(F.col(status) == "saved", 1)).alias("saved"),
        F.count(F.when(F.col(status) == "failed", 1)).alias("failed"),
        F.count(F.when(F.col(status) == "skipped", 1)).alias("skipped"),
        F.round(F.avg(F.when(F.col(status).isNotNull(), F.col(seconds))), 4).alias("mean_seconds"),
        F.count(F.when(F.col(status).isNull(), 1)).alias("remaining"), done.alias("_done"))
    eta = F.try_divide(F.col("_done"), F.col("processed")) * F.col("remaining")
    return agg.withColumn("eta_seconds", F.round(eta, 2)).drop("_done")


def house_statuses(batch: DataFrame, existing: DataFrame, key: str, order_col: str, url_col: str,
                   reached=None) -> DataFrame:
    """``status`` of a batch of houses (A10): ``skipped`` without a URL, else the status
    of ``insert_if_absent``; null where ``reached`` (a boolean column; default: all) is
    false, the run has not come to it yet."""
    reached = F.lit(True) if reached is None else F.coalesce(reached, F.lit(False))
    has_url = F.col(url_col).isNotNull() & (F.col(url_col) != "")
    marked = batch.withColumn("_reached", reached).withColumn("_url", has_url)
    tried = insert_if_absent(marked.filter("_reached AND _url"), existing, key, order_col)
    rest = marked.filter("NOT (_reached AND _url)").withColumn("status", F.when(F.col("_reached"), F.lit("skipped")))
    return tried.unionByName(rest).drop("_reached", "_url")


def profile(df: DataFrame) -> DataFrame:
    """Shape, types and gaps of a table from one aggregate pass: a row per column with
    its ``position`` (from 1), ``data_type``, ``n_nulls`` and the table's ``n_rows``
    and ``n_columns``."""
    cols = df.dtypes
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_n{i}") for i, (c, _) in enumerate(cols)])
    facts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).cast("long").alias("position"),
                               F.lit(t).alias("data_type"), F.col(f"_n{i}").alias("n_nulls"))
                      for i, (c, t) in enumerate(cols)])
    return one.select(F.col("_rows").alias("n_rows"), F.inline(facts)).select(
        "column_name", "position", "data_type", "n_rows", F.lit(len(cols)).cast("long").alias("n_columns"), "n_nulls")


def head(df: DataFrame, order_cols, n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-n report): a stored table has none of its own."""
    return df.orderBy(*order_cols).limit(n)


def with_eta(report: DataFrame, planned: str = "planned_tiles", done: str = "tiles",
             per_item: str = "seconds_per_tile") -> DataFrame:
    """Add ``remaining`` and ``eta_seconds`` (remaining x mean seconds per
    item; null when nothing was timed) to a run report joined with its plan
    size."""
    remaining = F.greatest(F.col(planned) - F.col(done), F.lit(0))
    return (report.withColumn("remaining", remaining.cast("long"))
            .withColumn("eta_seconds", F.round(F.try_multiply(F.col(per_item), F.col("remaining")), 2)))
