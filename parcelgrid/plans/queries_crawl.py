"""Bindings: master list, records, ids (tile documents and record lists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.operators.dedupe import explode_results, master_list
from parcelgrid.plans.registry import query
from parcelgrid.plans.standins import scratch_folder, tile_documents_from_pages
from parcelgrid.session import table
from parcelgrid.sinks.writers import write_master_list, write_tile_store
from parcelgrid.sources.tiles import observe_rejects, parsed_documents, split_documents

FIRST_WINS_SQL = r"""
WITH h AS (
  SELECT page_id,
         unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, 'href="(/[^"]*)"', 1), 1) - 1 AS p
  FROM pages WHERE page_id % 50 <> 7
), i AS (
  SELECT href AS zpid,
         'tile_' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.json' AS tile_file,
         CAST(CASE p % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS type_rank,
         CASE p % 3 WHEN 2 THEN 'relaxedResults' WHEN 0 THEN 'listResults' ELSE 'mapResults' END AS result_type,
         CAST(p // 3 AS BIGINT) AS pos,
         'https://www.zillow.com' || href AS detailUrl
  FROM h
)
SELECT zpid, detailUrl, tile_file, type_rank, result_type, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY tile_file, type_rank, pos) AS rn FROM i
) WHERE rn = 1
"""


def _master(parsed):
    out = master_list(explode_results(parsed, "doc", ["tile_file"]), file_col="tile_file")
    return out.select("zpid", "detailUrl", "tile_file", F.col("type_rank").cast("long").alias("type_rank"),
                      "result_type", "pos")


@query("q_first_wins", FIRST_WINS_SQL)
def q_first_wins(spark, sf_dir):
    """S1 -> V2 -> U10 -> U8 -> A2: first-wins master list over tile documents.  The
    rejected documents are counted by the pass that reads them (``observe``)."""
    docs = tile_documents_from_pages(table(spark, sf_dir, "pages"))
    counted, _seen = observe_rejects(parsed_documents(docs))
    return _master(counted)


@query("q_quarantine", r"""
WITH t AS (SELECT page_id, 'tile_' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.json' AS tile_file FROM pages)
SELECT tile_file, CASE page_id % 50 WHEN 7 THEN 'unparsable JSON' WHEN 8 THEN 'empty document'
                       WHEN 9 THEN 'empty document' ELSE 'not an object' END AS reason,
       CAST(CASE page_id % 50 WHEN 7 THEN 40 WHEN 8 THEN NULL WHEN 9 THEN 3 WHEN 10 THEN 4 ELSE 7 END AS BIGINT) AS n_chars,
       (SELECT count(*) FROM t WHERE page_id % 50 NOT BETWEEN 7 AND 11) AS n_accepted
FROM t WHERE page_id % 50 BETWEEN 7 AND 11""")
def q_quarantine(spark, sf_dir):
    """V2/K8: rejected tile documents with their reasons, and the number accepted, from one
    parse written once for both sides.  Besides the truncated documents some are
    missing, blank, null, or an array."""
    docs = tile_documents_from_pages(table(spark, sf_dir, "pages"))
    number = F.substring("tile_file", 6, 8).cast("long") % 50
    docs = docs.withColumn("text", F.when(number == 8, F.lit(None)).when(number == 9, F.lit(" \t\n"))
                           .when(number == 10, F.lit("null")).when(number == 11, F.lit('[{}, 1]'))
                           .otherwise(F.col("text")))
    accepted, rejected = split_documents(parsed_documents(docs), scratch_folder(spark, sf_dir, "quarantine"))
    return rejected.select("tile_file", "reason", F.char_length("rejected_text").cast("long").alias("n_chars"),
                           accepted.select(F.count(F.lit(1))).scalar().alias("n_accepted"))


@query("q_written_master", FIRST_WINS_SQL)
def q_written_master(spark, sf_dir):
    """A2 -> K2: the master list is written as a table and as JSON lines, and read back from the lines."""
    folder = scratch_folder(spark, sf_dir, "master")
    docs = tile_documents_from_pages(table(spark, sf_dir, "pages"))
    master = _master(parsed_documents(docs))
    write_master_list(master, f"{folder}/table", f"{folder}/lines")
    return spark.read.schema(master.schema).json(f"{folder}/lines")


@query("q_tile_files", FIRST_WINS_SQL)
def q_tile_files(spark, sf_dir):
    """S1/K1 on real files: the tile documents go to a store that keeps many documents a
    file, by a coarse bucket of their key; a second write replaces every other one by
    its own key; what is read back is parsed and deduped.  Same result as ``q_first_wins``."""
    folder = scratch_folder(spark, sf_dir, "tiles")
    docs = tile_documents_from_pages(table(spark, sf_dir, "pages"))
    odd = F.substring("tile_file", 6, 8).cast("long") % 2 == 1
    stale = docs.withColumn("text", F.when(odd, F.lit("{}")).otherwise(F.col("text")))
    write_tile_store(stale, folder, "tile_file")
    write_tile_store(docs.filter(odd), folder, "tile_file")
    counted, _seen = observe_rejects(parsed_documents(spark.read.parquet(folder).select("tile_file", "text")))
    return _master(counted)
