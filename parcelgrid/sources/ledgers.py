"""Ledger scans: a missing ledger reads as empty, corrupt files are skipped on request and counted."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARQUET_END = "PAR1"  # fixed value: the last four bytes of a Parquet file


def _plain(path: Column) -> Column:
    """A file's path in one spelling: sources differ in the slashes after the scheme."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/"), r"\+", "%2B"))


def corrupt_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``(path)`` of the ledger's files that a skipping read leaves out.

    Files from which no row comes are told by their metadata alone; only these are
    opened, and one that ends like a Parquet file is a valid empty one.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .select("path", _plain(F.col("path")).alias("_file")))
    seen = (spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(path)
            .select(_plain(F.col("_metadata.file_path")).alias("_file")).distinct())
    silent = [r["path"] for r in listed.join(seen, "_file", "left_anti").select("path").collect()]
    if not silent:
        return spark.createDataFrame([], "path string")
    return (spark.read.format("binaryFile").load(silent)
            .filter(F.decode(F.right(F.col("content"), F.lit(4)), "ISO-8859-1") != PARQUET_END).select("path"))


def read_ledger(spark: SparkSession, path: str, schema: StructType | str, keys=None,
                skip_corrupt: bool = True) -> DataFrame:
    """Distinct ``keys`` (default: all schema columns) of the ledger at
    ``path``; an absent ledger gives an empty table with the same schema.

    Corrupt files are skipped as the crawler does, which means that their houses
    are fetched again; they are counted, and a warning names their number
    (``corrupt_files`` lists them).  ``skip_corrupt=False`` fails on them instead.
    Any other fault than a missing path (schema, permission) is raised.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    cols = list(keys) if keys else [f.name for f in schema.fields]
    try:
        df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select(*cols)
    if skip_corrupt and (n := corrupt_files(spark, path, schema).count()):
        warnings.warn(f"{n} corrupt files of the ledger {path} were skipped", stacklevel=2)
    return df.select(*cols).distinct()
