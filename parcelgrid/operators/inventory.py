"""Listing numbers and photo-folder inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.ids import year_from_file
from parcelgrid.functions.text import blank_to_null, strip_float_suffix
from parcelgrid.operators.indexing import ranked

# The one stray file the dataset cleanup removes.
QUARANTINE_FILES = [("20851", "test_year.txt")]


def distinct_listing_numbers(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """Distinct non-blank listing numbers (trimmed text).

    ``normalize=True`` folds ``12.0`` into ``12`` (the float form a number
    column takes when it has blanks); ``False`` keeps the text as read.
    """
    v = blank_to_null(F.col(col))
    if normalize:
        v = strip_float_suffix(v)
    return df.select(v.alias("listing_no")).filter(F.col("listing_no").isNotNull()).distinct()


def quarantine(files: DataFrame, rules=QUARANTINE_FILES, folder: str = "folder", name: str = "file_name"):
    """Split ``(kept, rejected)`` by ``(folder, file_name)`` rules; nothing is
    deleted, rejected rows go to their own table."""
    hit = F.lit(False)
    for f, n in rules:
        hit = hit | ((F.col(folder) == f) & (F.col(name) == n))
    return files.filter(~hit), files.filter(hit)


def folder_inventory(files: DataFrame, folder: str = "folder", name: str = "file_name",
                     size: str = "size") -> DataFrame:
    """Per folder: distinct files, ``.png`` files, year files and bytes."""
    distinct_files = files.groupBy(folder, name).agg(F.max(size).alias(size))
    return distinct_files.groupBy(folder).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count(F.when(F.col(name).endswith(".png"), 1)).alias("n_png"),
        F.count(year_from_file(F.col(name))).alias("n_years"),
        F.sum(size).cast("long").alias("total_bytes"))


def year_combos(files: DataFrame, folder: str = "folder", name: str = "file_name") -> DataFrame:
    """How many folders hold each set of years (``<year>.png`` files); folders
    without year files are skipped.  ``rank`` (from 1) is the most common first,
    ties by the years; ``total`` is the number of sets.

    Years are made distinct per folder first, so the per-folder list is bounded
    by the number of distinct years, not by the number of files.
    """
    years = (files.select(folder, year_from_file(F.col(name)).alias("year")).filter(F.col("year").isNotNull())
             .distinct())
    per_folder = years.groupBy(folder).agg(F.array_sort(F.collect_list("year")).alias("years"))
    sets = (per_folder.groupBy("years").agg(F.count(F.lit(1)).alias("n_folders"))
            .select(F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"),
                    "n_folders"))
    return ranked(sets, [F.desc("n_folders"), "years"])


def distinct_file_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Distinct file names across all folders, with their ``rank`` by name and the ``total``."""
    return ranked(files.select(name).distinct(), [name])


def folder_count(files: DataFrame, folder: str = "folder"):
    """Scalar column: number of distinct folders."""
    return files.select(F.count_distinct(folder)).scalar()


def sorted_listing(files: DataFrame, name: str = "file_name", size: str = "size", n: int = 5, ties=()) -> DataFrame:
    """Every file in name order, then by the ``ties`` columns: ``rank`` (from 1), size
    in KB, the ``total`` number of files, and ``n_more``, the files after the first ``n``."""
    listed = ranked(files.select(name, *ties, F.round(F.col(size) / 1024, 1).alias("size_kb")), [name, *ties])
    return listed.withColumn("n_more", F.greatest(F.col("total") - n, F.lit(0)).cast("long"))


def file_listing(files: DataFrame, name: str = "file_name", size: str = "size", n: int = 5, ties=()) -> DataFrame:
    """The first ``n`` files of ``sorted_listing`` (a top-n report)."""
    return sorted_listing(files, name, size, n, ties).filter(F.col("rank") <= n)
