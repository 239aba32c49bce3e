"""Properties: idempotence, partition independence, conservation of rows."""

from pyspark.sql import functions as F

from parcelgrid.operators.dedupe import dedupe_arrays, first_wins
from parcelgrid.operators.indexing import dense_index, positional_folds
from parcelgrid.operators.model import assign_splits
from parcelgrid.plans.standins import tile_documents_from_pages
from parcelgrid.session import table
from parcelgrid.sources.tiles import parse_documents

from conftest import SF_SMALL


def _items(spark):
    ev = table(spark, SF_SMALL, "events")
    return ev.select(F.col("user_id").alias("tile"), F.dayofmonth("ts").alias("page"),
                     F.when(F.col("event_type") == "click", "listResults").otherwise("mapResults").alias("result_type"),
                     F.col("event_id").alias("pos"), (F.col("value").cast("int") % 7).cast("string").alias("item_id"))


def test_dedupe_idempotent_and_partition_independent(spark):
    items = _items(spark)
    once = dedupe_arrays(items, "tile", "page")
    twice = dedupe_arrays(once, "tile", "page")
    shuffled = dedupe_arrays(items.repartition(7, "pos"), "tile", "page")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect())) == sorted(map(tuple, shuffled.collect()))


def test_first_wins_independent_of_input_order(spark):
    items = _items(spark).withColumn("v", F.col("pos") * 3)
    a = sorted(map(tuple, first_wins(items, "item_id", ["page", "pos"], ["v"]).collect()))
    b = sorted(map(tuple, first_wins(items.orderBy(F.rand(7)).repartition(5), "item_id", ["page", "pos"], ["v"]).collect()))
    assert a == b


def test_dense_index_is_a_permutation(spark):
    df = table(spark, SF_SMALL, "orders").select("o_orderkey")
    idx = dense_index(df, ["o_orderkey"], num_partitions=5)
    got = [r.row_index for r in idx.orderBy("o_orderkey").collect()]
    assert got == list(range(df.count()))


def test_positional_folds_match_ntile(spark):
    df = table(spark, SF_SMALL, "documents").select("doc_id")
    ours = {r.doc_id: r.fold for r in positional_folds(df, ["doc_id"], 5).collect()}
    ref = {r.doc_id: r.f for r in df.selectExpr("doc_id", "ntile(5) over (order by doc_id) as f").collect()}
    assert ours == ref


def test_split_buckets_cover_all_rows(spark):
    s = assign_splits(table(spark, SF_SMALL, "orders"), "o_orderkey")
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == s.count()
    fit = s.filter(F.col("split") != "test")
    assert fit.filter(F.col("fold").isNull() | F.col("refit_part").isNull()).count() == 0


def test_every_document_is_parsed_or_quarantined(spark):
    docs = tile_documents_from_pages(table(spark, SF_SMALL, "pages"))
    parsed, bad = parse_documents(docs)
    assert parsed.filter(F.col("doc").isNotNull()).count() + bad.count() == docs.count()
