"""Ledgers of done work, as set operations.

The crawler kept JSON sets of visited tiles / houses / empty tiles and tested
membership row by row.  Here each ledger is a keyed table and each membership
test is a join: anti joins for "not yet done", one keyed aggregate where the
batch order matters.  Joins are left to the planner: with AQE a ledger that
turns out small at run time is broadcast, a large one is shuffled, and a
skewed key is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.ids import file_stem, is_all_digits
from parcelgrid.operators.indexing import dense_index

LEDGER_FILE = "visited_houses.json"   # fixed value: the house ledger's own file name
NULL_ID_PREFIX = "nullzpid_"          # fixed value: file-name prefix of houses without id


def unvisited(links: DataFrame, visited: DataFrame, key: str = "idx", link_col: str = "link") -> DataFrame:
    """Links not in the visited ledger, with a non-empty link."""
    todo = links.join(visited.select(key), key, "left_anti")
    return todo.filter(F.col(link_col).isNotNull() & (F.col(link_col) != ""))


def unvisited_houses(master: DataFrame, visited_ids: DataFrame, visited_urls: DataFrame,
                     id_col: str = "zpid", url_col: str = "detailUrl") -> DataFrame:
    """Houses whose id is not visited AND whose URL is not visited.

    Written as two anti joins: a single anti join on ``id = v.id OR url = v.url``
    has no equi-key and plans as a nested-loop join.  A null id never matches,
    so such a row is tested on its URL only.  Rows without a URL are dropped.
    """
    with_url = master.filter(F.col(url_col).isNotNull() & (F.col(url_col) != ""))
    # Rows without an id cannot match the id ledger; they bypass that join, so
    # a large share of null ids does not pile up in one shuffle partition.
    by_id = (with_url.filter(F.col(id_col).isNotNull())
             .join(visited_ids.select(F.col(id_col)), id_col, "left_anti")
             .unionByName(with_url.filter(F.col(id_col).isNull())))
    return by_id.join(visited_urls.select(F.col(url_col)), url_col, "left_anti")


def visited_house_entries(saved: DataFrame, id_col: str = "zpid", url_col: str = "detailUrl"):
    """Rows to append to the two house ledgers after a batch is saved (K5):
    ``(ids, urls)``, each keeping only non-empty values."""
    ids = saved.select(F.col(id_col).cast("string").alias("zpid")).filter(
        F.col("zpid").isNotNull() & (F.col("zpid") != ""))
    urls = saved.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull() & (F.col("url") != ""))
    return ids, urls


def house_ids_from_files(names: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Ids of saved house documents: all-digit stems of ``*.json`` files other
    than the ledger itself and the ``nullzpid_*`` files (S3, U13)."""
    stem = file_stem(F.col(name_col))
    ok = (F.col(name_col).endswith(".json") & (F.col(name_col) != LEDGER_FILE)
          & ~stem.startswith(NULL_ID_PREFIX) & is_all_digits(stem))
    return names.filter(ok).select(stem.alias("zpid"))


def sync_house_ledger(ledger_ids: DataFrame, names: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Ledger ids UNION ids of saved files, distinct."""
    return ledger_ids.select("zpid").unionByName(house_ids_from_files(names, name_col)).distinct()


def insert_if_absent(batch: DataFrame, existing: DataFrame, key: str, order_col: str) -> DataFrame:
    """Status of writing each batch row under ``key`` when a key is never
    overwritten (K7).

    ``saved`` for the first row (smallest ``order_col``) of a key not yet
    stored; ``failed`` for a stored key and for later rows of a batch key.
    Rows with a null or empty key are ``saved`` (they get fresh names).  One aggregate
    per key (existing flag + first order) and one join back to the batch.
    """
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    marks = (batch.select(F.col(key), F.col(order_col).alias("_o"), F.lit(False).alias("_ex"))
             .unionByName(existing.select(F.col(key), F.lit(None).cast(batch.schema[order_col].dataType).alias("_o"),
                                          F.lit(True).alias("_ex")))
             .filter(~missing)
             .groupBy(key).agg(F.min("_o").alias("_first"), F.max("_ex").alias("_exists")))
    keyed = batch.filter(~missing).join(marks, key, "left")
    status = (F.when(F.col("_exists"), "failed")
               .when(F.col(order_col) == F.col("_first"), "saved")
               .otherwise("failed"))
    # null keys never join (and would all hash to one partition): they bypass it
    return (keyed.withColumn("status", status).drop("_first", "_exists")
            .unionByName(batch.filter(missing).withColumn("status", F.lit("saved"))))


def empty_tile_check(tiles: DataFrame, ledger: DataFrame, order_col: str,
                     lat: str = "ne_lat", lon: str = "sw_long", hc: str = "house_count") -> DataFrame:
    """Known-empty pre-check and empty-ledger insert for a batch of tiles.

    Tiles run in ``order_col`` order.  A tile is ``skipped`` when its corner is
    in the ledger or an earlier tile of the batch with the same corner came back
    empty (that one recorded it).  ``empty_recorded`` is true for skipped tiles
    and for tiles that come back with 0 houses (a new ledger entry).  Skipped
    tiles report 0 houses.
    """
    keys = [lat, lon]
    marks = (tiles.filter(F.col(hc) == 0).select(*keys, F.col(order_col).alias("_o"), F.lit(False).alias("_in"))
             .unionByName(ledger.select(*keys, F.lit(None).cast(tiles.schema[order_col].dataType).alias("_o"),
                                        F.lit(True).alias("_in")))
             .groupBy(*keys).agg(F.min("_o").alias("_first_empty"), F.max("_in").alias("_in_ledger")))
    j = tiles.join(marks, keys, "left")
    skipped = F.coalesce(F.col("_in_ledger"), F.lit(False)) | F.coalesce(F.col("_first_empty") < F.col(order_col),
                                                                         F.lit(False))
    return (j.withColumn("skipped", skipped)
             .withColumn("empty_recorded", F.col("skipped") | (F.col(hc) == 0))
             .withColumn(hc, F.when(F.col("skipped"), F.lit(0)).otherwise(F.col(hc)))
             .drop("_first_empty", "_in_ledger"))


def new_empty_entries(checked: DataFrame, lat: str = "ne_lat", lon: str = "sw_long",
                      hc: str = "house_count") -> DataFrame:
    """Ledger rows to append after ``empty_tile_check``."""
    return checked.filter(~F.col("skipped") & (F.col(hc) == 0)).select(lat, lon).distinct()


def next_null_number(names: DataFrame, name_col: str = "file_name"):
    """Scalar column: 1 + the largest N of ``nullzpid_N*`` stems, 1 if none."""
    stem = file_stem(F.col(name_col))
    n = F.regexp_extract(stem, rf"^{NULL_ID_PREFIX}([0-9]+)(_.*)?$", 1)
    best = names.filter(n != "").select(F.coalesce(F.max(n.cast("long")) + 1, F.lit(1)).alias("next"))
    return best.scalar()


def assign_null_ids(batch: DataFrame, id_col: str, order_cols, names: DataFrame,
                    name_col: str = "file_name") -> DataFrame:
    """File stem for each batch row: the id, or ``nullzpid_<n>`` numbered from
    the next free number in batch order for rows without id."""
    nulls = dense_index(batch.filter(F.col(id_col).isNull()), order_cols, "_k")
    start = next_null_number(names, name_col)
    named_nulls = nulls.withColumn("file_stem", F.concat(F.lit(NULL_ID_PREFIX), (start + F.col("_k")).cast("string"))) \
                       .drop("_k")
    return batch.filter(F.col(id_col).isNotNull()).withColumn("file_stem", F.col(id_col)).unionByName(named_nulls)
