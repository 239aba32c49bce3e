"""Scans of stored tile result documents and record lists (JSON text)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelgrid.session import check_last_key_wins


def read_text_documents(spark: SparkSession, path_glob: str, name_col: str = "file_name") -> DataFrame:
    """One row per file: ``(file_name, path, text)``.

    ``wholetext`` makes each file one record; each file is one task's worth of
    work, so many small tile files spread over the cluster.  Only the metadata
    columns named here are read.
    """
    return (spark.read.option("wholetext", "true").text(path_glob)
            .select(F.col("_metadata.file_name").alias(name_col),
                    F.col("_metadata.file_path").alias("path"),
                    F.col("value").alias("text")))


def parsed_documents(docs: DataFrame, text_col: str = "text", doc_col: str = "doc") -> DataFrame:
    """Every document parsed once: ``doc`` (VARIANT) or ``reason`` and ``rejected_text``.

    ``reason`` is null for a JSON object, else ``empty document`` (null or blank
    text), ``unparsable JSON`` or ``not an object``; the text is kept for rejected
    documents only, and their ``doc`` is null.  Of a repeated key the last value
    counts (the session's setting is checked).
    """
    check_last_key_wins(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    parsed = docs.select(*others, F.col(text_col).alias("_text"), F.try_parse_json(F.col(text_col)).alias("_doc"))
    blank = F.col("_text").isNull() | ~F.col("_text").rlike(r"\S")
    judged = parsed.withColumn("reason", F.when(blank, "empty document").when(F.col("_doc").isNull(), "unparsable JSON")
                               .when(~F.ltrim("_text").rlike(r"^\s*\{"), "not an object"))
    good = F.col("reason").isNull()
    return judged.select(*others, F.when(good, F.col("_doc")).alias(doc_col), "reason",
                         F.when(~good, F.col("_text")).alias("rejected_text"))


def parse_documents(docs: DataFrame, text_col: str = "text", doc_col: str = "doc"):
    """``(parsed, quarantine)`` of ``parsed_documents``.

    ``parsed`` keeps every row, with a null ``doc`` where the document was rejected
    (such a row explodes to no items); ``quarantine`` holds the rejected rows with
    their text and ``reason``.  Each of the two parses when it is executed; to parse
    once for both use ``split_documents``, to only count the rejects ``observe_rejects``.
    """
    parsed = parsed_documents(docs, text_col, doc_col)
    bad = (parsed.filter(F.col("reason").isNotNull()).drop(doc_col)
           .withColumnRenamed("rejected_text", text_col))
    return parsed.drop("reason", "rejected_text"), bad


def observe_rejects(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """``parsed_documents`` rows with a count of the documents and the rejects that
    Spark takes while the caller's own action runs: no second pass.  Read it after
    that action with ``warn_rejected``."""
    seen = Observation()
    counted = parsed.observe(seen, F.count(F.lit(1)).alias("n_documents"), F.count("reason").alias("n_rejected"))
    return counted, seen


def warn_rejected(seen: Observation) -> int:
    """The rejects that an action has counted; warns when there are any."""
    n = seen.get["n_rejected"]
    if n:
        warnings.warn(f"{n} of {seen.get['n_documents']} documents were rejected and give no items", stacklevel=2)
    return n


def split_documents(parsed: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` from one parse: the parsed rows are written once under
    ``folder``, partitioned by verdict, and each side reads its own files."""
    spark = parsed.sparkSession
    parsed.withColumn("rejected", F.col("reason").isNotNull()).write.mode("overwrite").partitionBy("rejected").parquet(folder)
    both = spark.read.schema(parsed.schema.add("rejected", "boolean")).parquet(folder)
    return (both.filter(~F.col("rejected")).drop("rejected", "reason", "rejected_text"),
            both.filter("rejected").drop("rejected", *[c for c, t in parsed.dtypes if t == "variant"]))


def record_list(docs: DataFrame, key_cols, text_col: str = "text") -> DataFrame:
    """Houses from JSON-array documents (one array per document).

    A document that is not JSON or not an array contributes nothing.  An
    element is kept when it is an object with a truthy ``detailUrl``; its
    ``zpid`` is kept as text when truthy, else null.  Output
    ``key_cols + (pos, zpid, detailUrl)``.
    """
    from parcelgrid.functions.ids import member, truthy_text

    check_last_key_wins(docs.sparkSession)
    arr = F.try_variant_get(F.try_parse_json(F.col(text_col)), "$", "array<variant>")
    items = docs.select(*key_cols, F.posexplode(arr).alias("pos", "item"))
    # member lookups are null on non-objects: the detailUrl test also drops them
    return (items
            .select(*key_cols, F.col("pos").cast("long").alias("pos"),
                    truthy_text(member(F.col("item"), "$.zpid")).alias("zpid"),
                    truthy_text(member(F.col("item"), "$.detailUrl")).alias("detailUrl"))
            .filter(F.col("detailUrl").isNotNull()))


def read_tile_folder(spark: SparkSession, folder: str, key: str = "tile_file") -> DataFrame:
    """Tile documents stored one per directory ``<key>=<name>/`` (as Spark's
    partitioned text writer lays them out): ``(key, text)`` with the whole
    file as ``text``.  The key comes from partition discovery, not from the
    file contents."""
    return (spark.read.option("wholetext", "true").text(folder)
            .select(F.col(key).cast("string").alias(key), F.col("value").alias("text")))
