"""Training-data pipeline over ``documents``: five stages, each one operator of ``parcelgrid.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is all that the stage before kept, and returns a DataFrame.  All but the
last return the columns of ``documents``; the last returns the token ids with
``place``, the row's number in the order of the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.llm.merge_automaton import encode_decode
from parcelgrid.llm.mixing import in_place_order, mixed_order, n_ranges, stored_place
from parcelgrid.llm.quality_rules import keep_good
from parcelgrid.llm.queries import tokenizer_path
from parcelgrid.llm.rule_ensemble import fit_rules, keep_predicted_good, training_rows
from parcelgrid.llm.simhash import keep_one_each
from parcelgrid.session import ensure_checkpoint_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble calls good; it learns from the labelled rows of the whole corpus."""
    rows = training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keep_predicted_good(docs, fit_rules(spark, rows))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    return keep_one_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, so that files read in order hold the target weights."""
    return mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text decoded from them.

    ``docs`` is the mix as read from its files; their order is kept as ``place``
    and by the written files, which are ranges of places.
    """
    placed, total = stored_place(docs)
    coded = encode_decode(placed, tokenizer_path(), carry=("place",))
    return in_place_order(coded.select("place", "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")), total, n_ranges(docs)[0])


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

ORACLE_SQL = None  # lasso weights, components and byte-pair merging are not SQL; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
