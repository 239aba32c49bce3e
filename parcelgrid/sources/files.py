"""File-system sources: CSV tables, offset-header CSV folders, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelgrid.functions.text import py_float_text

# The field texts that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_FIELD_RX = r',("(?:[^"]|"")*+"|[^,]*)'  # one field of a record that was given a leading comma


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header row (S4).  Pass ``schema`` in production; without it
    types are inferred, which costs an extra pass over the data."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def file_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, folder, file_name, size)`` of the files directly inside the
    sub-folders of ``root`` (S6, J9).

    Uses the binary-file source with only path and length selected: the file
    contents are never read.  ``folder`` is the sub-folder name; files lying in
    ``root`` itself or deeper than one level are not part of the folder
    listing.
    """
    import re

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.regexp_extract("path", rf"{base}/(.*)$", 1)
    df = reader.load(root).select("path", "length").withColumn("_rel", rel)
    return (df.filter(F.col("_rel").rlike(r"^[^/]+/[^/]+$"))
              .select("path", F.regexp_extract("_rel", r"^([^/]+)/", 1).alias("folder"),
                      F.regexp_extract("_rel", r"/([^/]+)$", 1).alias("file_name"),
                      F.col("length").alias("size")))


def list_files(spark: SparkSession, folder: str, glob: str | None = "*.json") -> DataFrame:
    """``(path, file_name, size)`` of the files directly in ``folder`` (S3),
    e.g. the saved house documents; contents are never read.  An empty or
    missing folder gives no rows."""
    from pyspark.errors import AnalysisException

    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        df = reader.load(folder).select("path", "length")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, file_name string, size long")
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                     F.col("length").alias("size"))


def csv_lines(spark: SparkSession, folder: str, glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """Lines of the folder's files by a splittable read: ``file_name``, ``path``, the
    ``block`` (first byte of the split) and ``line``, a number that grows within a block;
    (block, line) is the order of a file's lines."""
    return (spark.read.format("text").option("pathGlobFilter", glob).load(folder)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
                    F.col("value").alias("text")))


def csv_records(lines: DataFrame) -> DataFrame:
    """Lines joined to records: a line end inside quotes does not end a record.

    A record is open after a line when the file holds an odd number of quotes up to
    there.  Only files that have a line with an odd number take that way: quotes and
    record starts are counted within each block, and what the blocks before it leave
    open is added (one row per block).  A record has the number of its start within
    the block it starts in.  The lines of all other files are records as they are and
    are not shuffled.
    """
    odd = F.length(F.regexp_replace("text", '[^"]+', "")) % 2
    quoted = lines.filter(odd == 1).select("path").distinct()
    plain = lines.join(quoted, "path", "left_anti")
    counted = lines.join(quoted, "path", "left_semi").withColumn("_odd", odd)
    blocks = counted.groupBy("path", "block").agg(F.sum("_odd").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.join(blocks, ["path", "block"]).withColumn(
        "_open", (F.col("_before") + F.coalesce(F.sum("_odd").over(inside), F.lit(0))) % 2 == 1)
    # a record starts at a line that no quote is open before; 0: it started in an earlier block
    numbered = numbered.withColumn("_nth", F.sum(F.when(F.col("_open"), 0).otherwise(1)).over(
        Window.partitionBy("path", "block").orderBy("line")))
    starts = numbered.groupBy("path", "block").agg(F.max("_nth").alias("_starts"))
    begun = F.last(F.when(F.col("_starts") > 0, F.struct(F.col("block"), F.col("_starts").alias("nth"))), ignorenulls=True)
    starts = starts.select("path", "block", begun.over(earlier).alias("_earlier"))
    own = F.struct(F.col("block"), F.col("_nth").alias("nth"))
    numbered = numbered.join(starts, ["path", "block"]).withColumn(
        "_record", F.when(F.col("_nth") > 0, own).otherwise(F.col("_earlier")))
    joined = numbered.groupBy("file_name", "path", "_record").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("_parts"))
    return plain.unionByName(joined.select(
        "file_name", "path", F.col("_parts")[0]["block"].alias("block"), F.col("_parts")[0]["line"].alias("line"),
        F.array_join(F.col("_parts.text"), "\n").alias("text")))


def _fields(record) -> F.Column:
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD_RX), F.lit(1))
    return F.transform(found, lambda f: F.when(
        f.startswith('"'), F.replace(F.regexp_replace(f, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))


def offset_csv_column(spark: SparkSession, folder: str, column: str, drop_lines=(1, 2)) -> DataFrame:
    """Values of ``column`` from every ``.csv`` file (any case) in ``folder``
    whose header is the first record and whose records ``drop_lines`` (0-based, the
    header is 0) are not data (S5).

    Files are read by lines, so a large file is many tasks and no file is one row.  The
    first records of each file give its header, the column's place and where the data
    begin; they are joined to the records by path.  Empty files and files without the
    column give no rows.  A column of numbers only comes back in one number form per
    file: whole numbers without blanks as such, otherwise as floats (``12.0``); any
    other column as its field texts.  Output ``(file_name, value)``; missing values
    are dropped.
    """
    records = csv_records(csv_lines(spark, folder))
    place = Window.partitionBy("path").orderBy("block", "line")
    heads = (records.withColumn("_at", F.row_number().over(place) - 1).filter(F.col("_at") <= max([0, *drop_lines]))
             .groupBy("path").agg(
                 F.max(F.when(F.col("_at") == 0, F.col("text"))).alias("_header"),
                 F.collect_list(F.when(F.col("_at").isin([0, *drop_lines]), F.struct("block", "line"))).alias("_dropped")))
    heads = heads.select("path", "_dropped", F.array_position(_fields(F.col("_header")), column).alias("_column"))
    rows = records.join(heads.filter("_column > 0"), "path").filter(
        (F.trim("text") != "") & ~F.array_contains("_dropped", F.struct("block", "line")))
    values = rows.select("file_name", "path", F.get(_fields(F.col("text")), (F.col("_column") - 1).cast("int")).alias("_v"))
    values = values.withColumn("_v", F.when(~F.col("_v").isin(MISSING), F.col("_v")))
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    present = F.col("_v").isNotNull()
    forms = values.groupBy("path").agg(
        F.bool_and(present & F.coalesce(F.col("_v").rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.lit(False))).alias("_whole"),
        F.bool_and(F.when(present, F.col("_v").rlike(number))).alias("_numbers"))
    shown = (F.when(F.col("_whole"), F.trim("_v").try_cast("long").cast("string"))
             .when(F.col("_numbers"), py_float_text(F.trim("_v").try_cast("double"))).otherwise(F.col("_v")))
    return values.filter(present).join(forms, "path").select("file_name", shown.alias("value"))
