"""The whole pipeline against a plain version, and what each stage returns."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from parcelgrid.llm.quality_rules import judge
from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept[name]) == len(set(kept[name])) and set(kept[name]) <= set(before)
        if name == "near_duplicates":
            ids = sorted(before)
            roots = plain_components(ids, [plain_fingerprint(before[i]) for i in ids])
            assert sorted(kept[name]) == sorted(set(roots))
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(kept["quality_rules"]) == sorted(r.doc_id for r in judge(whole).where("kept").collect())
    good = {r.doc_id for r in labels.where(F.col("quality") == 1).collect()}
    assert not good & (set(kept["quality_rules"]) - set(kept["quality_classifier"]))
    assert sorted(kept["source_mix"]) == sorted(kept["near_duplicates"])
    last = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in last.select("doc_id").collect()) == sorted(kept["source_mix"])
    assert sorted(r.place for r in last.select("place").collect()) == list(range(len(kept["source_mix"])))


def test_tokens_keep_the_order_of_the_mix(spark, docs_of, scratch):
    docs = docs_of([(k, f"w{k} " * (1 + k % 3), "ab"[k % 5 == 0]) for k in range(300)])
    mixed = corpus_pipeline.source_mix(spark, docs, SF)
    order = [r.doc_id for r in mixed.select("doc_id").collect()]
    spot = {doc: n for n, doc in enumerate(order)}
    files = 12  # later files are larger, so a plain read deals the last one first
    for n in range(files):
        ids = [doc for doc in order if spot[doc] * files // len(order) == n]
        part = docs.where(F.col("doc_id").isin(ids)).rdd.map(lambda r: (spot[r.doc_id], r)).sortByKey(numPartitions=1).values()
        rows = spark.createDataFrame(part, docs.schema).withColumn("text", F.repeat("text", F.lit(1 + 40 * n)))
        rows.coalesce(1).write.parquet(f"{scratch}/one/{n}")
        name = [f for f in os.listdir(f"{scratch}/one/{n}") if f.endswith(".parquet")][0]
        os.makedirs(f"{scratch}/mix", exist_ok=True)
        os.link(f"{scratch}/one/{n}/{name}", f"{scratch}/mix/part-{n:05d}-x-c000.snappy.parquet")
    read = spark.read.parquet(f"{scratch}/mix")
    assert [r.doc_id for r in read.select("doc_id").collect()] != order
    corpus_pipeline.tokens(spark, read, SF).write.parquet(f"{scratch}/out")
    out = spark.read.parquet(f"{scratch}/out")
    assert [r.doc_id for r in out.orderBy("place").collect()] == order
    names = sorted(f for f in os.listdir(f"{scratch}/out") if f.endswith(".parquet"))
    in_files = [r.place for f in names for r in spark.read.parquet(f"{scratch}/out/{f}").collect()]
    assert len(names) > 1 and in_files == list(range(300))
