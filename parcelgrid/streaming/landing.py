"""Incremental master list over a landing folder of tile documents.

New tile files arriving in a folder are read as a stream; each micro-batch is
exploded and deduplicated first-wins by (file, array, position) and only ids
not already in the master table are appended.  Across batches the first
*arrival* wins (a later file never replaces an id), which is what the crawl's
save-after-each-tile loop gives; within one batch the file order decides.

Each batch writes into its own ``batch_id`` partition with dynamic overwrite,
and the "already stored" check reads only earlier batches, so a batch that is
retried after a failure rewrites the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.operators.dedupe import explode_results, master_list
from parcelgrid.sources.ledgers import read_ledger
from parcelgrid.sources.tiles import observe_rejects, parsed_documents, warn_rejected

MASTER_SCHEMA = ("zpid string, detailUrl string, tile_file string, type_rank int, result_type string, "
                 "pos long, batch_id long")


def _batch_writer(master_path: str, site: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed, seen = observe_rejects(parsed_documents(batch))
        fresh = master_list(explode_results(parsed, "doc", ["tile_file"]), file_col="tile_file", site=site)
        # a corrupt file stops the batch: skipped, its ids would be appended a second time
        earlier = (read_ledger(spark, master_path, MASTER_SCHEMA, skip_corrupt=False)
                   .filter(F.col("batch_id") < batch_id).select("zpid"))
        new = fresh.join(earlier, "zpid", "left_anti").withColumn("batch_id", F.lit(batch_id).cast("long"))
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(master_path))
        warn_rejected(seen)
    return write


def start_master_list_stream(spark: SparkSession, landing_dir: str, master_path: str, checkpoint_dir: str,
                             site: str = "https://www.zillow.com", available_now: bool = False,
                             max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "tile_*.json")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    docs = reader.load(landing_dir).select(F.col("_metadata.file_name").alias("tile_file"),
                                           F.col("value").alias("text"))
    writer = docs.writeStream.foreachBatch(_batch_writer(master_path, site)).option("checkpointLocation",
                                                                                     checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
