"""Bindings: paging, merge, per-array dedupe, tile totals (events stand-in)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.functions.payload import RESULT_ARRAYS, result_array
from parcelgrid.operators.dedupe import dedupe_arrays, merge_pages
from parcelgrid.operators.paging import (integrity_violations, stop_prefix, tile_outcome, tile_payloads,
                                         tile_totals)
from parcelgrid.plans import events_standin as ev
from parcelgrid.plans.registry import query
from parcelgrid.plans.standins import scratch_folder
from parcelgrid.session import table
from parcelgrid.sinks.writers import save_tiles
from parcelgrid.sources.ledgers import read_ledger
from parcelgrid.sources.tiles import parsed_documents

_BASE = (ev.ITEMS_SQL, ev.VISITS_SQL, ev.MARKED_SQL)


def _marked(spark, sf_dir):
    return stop_prefix(ev.visits(table(spark, sf_dir, "events")))


def _merged_items(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    marked = stop_prefix(ev.visits(events))
    merged_pages = marked.filter("merged").select("tile", "page")
    return marked, merge_pages(ev.items(events), "tile", "page", merged_pages)


def _totals(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return tile_totals(stop_prefix(ev.visits(events)), ev.items(events))


@query("q_pagination_stop", ev.with_sql(*_BASE) + """
SELECT tile, page, page_count, house_count, CAST(acc_page_count AS BIGINT) AS acc_page_count,
       CAST(target_house_count AS BIGINT) AS target_house_count, stop, kept, merged, over_cap FROM marked_m""")
def q_pagination_stop(spark, sf_dir):
    """Running page count, first-page target, stop prefix; one row per visit, over the cap or not."""
    return _marked(spark, sf_dir).select("tile", "page", "page_count", "house_count", "acc_page_count",
                                         "target_house_count", "stop", "kept", "merged", "over_cap")


@query("q_merge_pages", ev.with_sql(*_BASE, ev.MERGED_SQL) + """
SELECT tile, result_type, page, pos, item_id FROM merged_items""")
def q_merge_pages(spark, sf_dir):
    """List items of every merged page, other arrays of the first page."""
    _, merged = _merged_items(spark, sf_dir)
    return merged.select("tile", "result_type", "page", "pos", "item_id")


@query("q_dedupe_arrays", ev.with_sql(*_BASE, ev.MERGED_SQL) + """
SELECT tile, result_type, item_id, page, pos FROM deduped""")
def q_dedupe_arrays(spark, sf_dir):
    """Per-array first-wins dedupe of the merged payload."""
    _, merged = _merged_items(spark, sf_dir)
    return dedupe_arrays(merged, "tile", "page").select("tile", "result_type", "item_id", "page", "pos")


@query("q_tile_counts", ev.with_sql(*_BASE, ev.MERGED_SQL) + """
SELECT tile, pages_read, pages_merged, accumulated_page_count, CAST(house_count_target AS BIGINT) AS house_count_target,
       page_count, house_count FROM totals""")
def q_tile_counts(spark, sf_dir):
    """A3/U16: pages read and merged, accumulated count, deduped sizes."""
    return _totals(spark, sf_dir).select("tile", "pages_read", "pages_merged", "accumulated_page_count",
                                         "house_count_target", "page_count", "house_count")


@query("q_integrity", ev.with_sql(*_BASE, ev.MERGED_SQL) + """
SELECT tile, page_count, house_count FROM totals WHERE page_count < house_count""")
def q_integrity(spark, sf_dir):
    """V1: tiles whose deduped list is shorter than the map list (quarantine)."""
    return integrity_violations(_totals(spark, sf_dir)).select("tile", "page_count", "house_count")


@query("q_tile_outcome", ev.with_sql(*_BASE, ev.MERGED_SQL) + """
SELECT tile, house_count,
       CASE WHEN house_count > 0 AND tile % 7 <> 0 THEN 'saved' WHEN house_count > 0 THEN 'not saved'
            WHEN failed THEN 'failed' ELSE 'empty' END AS outcome,
       CASE WHEN house_count > 0 THEN tile % 7 <> 0 ELSE NOT failed END AS visited,
       house_count = 0 OR tile % 7 <> 0 AS visited_parity FROM totals""")
def q_tile_outcome(spark, sf_dir):
    """V4: saved / not saved / empty / failed and the visited marks; every seventh tile stands for one without coordinates."""
    return tile_outcome(_totals(spark, sf_dir), F.col("tile") % 7 != 0).select("tile", "house_count", "outcome", "visited",
                                                       "visited_parity")


@query("q_library_paging", ev.with_sql(ev.ITEMS_SQL, ev.VISITS_SQL) + """,
a AS (SELECT *, success AND has_listings AS ok,
        sum(CASE WHEN success AND has_listings THEN page_count ELSE 0 END)
          OVER (PARTITION BY tile ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM visits),
b AS (SELECT *, (NOT ok) OR acc >= house_count OR page_count = 0 AS stop FROM a),
c AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY tile ORDER BY page
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kept FROM b)
SELECT tile, page, CAST(acc AS BIGINT) AS acc_page_count, CAST(house_count AS BIGINT) AS target_house_count, stop, kept,
       kept AND ok AS merged FROM c""")
def q_library_paging(spark, sf_dir):
    """W2, library mode: the target is each page's own house count, without a cap."""
    marked = stop_prefix(ev.visits(table(spark, sf_dir, "events")), mode="library")
    return marked.select("tile", "page", "acc_page_count", "target_house_count", "stop", "kept", "merged")


@query("q_saved_tiles", ev.with_sql(*_BASE, ev.MERGED_SQL) + """,
o AS (SELECT tile, CASE WHEN house_count > 0 AND tile % 7 <> 0 THEN 'saved' WHEN house_count > 0 THEN 'not saved'
                        WHEN failed THEN 'failed' ELSE 'empty' END AS outcome,
             CASE WHEN house_count > 0 THEN tile % 7 <> 0 ELSE NOT failed END AS visited FROM totals),
p AS (SELECT tile, count(*) FILTER (WHERE result_type = 'relaxedResults' AND item_id IS NOT NULL) AS n_relaxed,
             count(*) FILTER (WHERE result_type = 'listResults') AS n_list,
             count(*) FILTER (WHERE result_type = 'mapResults') AS n_map,
             arg_min(item_id, {'a': page, 'b': pos}) FILTER (WHERE result_type = 'listResults') AS first_item
      FROM deduped GROUP BY tile)
SELECT tile, outcome, visited AS in_ledger, CASE WHEN outcome = 'saved' THEN n_relaxed END AS n_relaxed,
       CASE WHEN outcome = 'saved' THEN n_list END AS n_list, CASE WHEN outcome = 'saved' THEN n_map END AS n_map,
       CASE WHEN outcome = 'saved' THEN first_item END AS first_item
FROM o LEFT JOIN p USING (tile)""")
def q_saved_tiles(spark, sf_dir):
    """J7 -> A1 -> V4 -> K1 -> K4: the merged document of every tile is saved with its
    outcome, visited tiles go to the ledger, and both are read back."""
    base = scratch_folder(spark, sf_dir, "saved-tiles")
    marked, merged = _merged_items(spark, sf_dir)
    outcome = tile_outcome(tile_totals(marked, ev.items(table(spark, sf_dir, "events"))), F.col("tile") % 7 != 0)
    payloads = tile_payloads(dedupe_arrays(merged, "tile", "page"))
    save_tiles(outcome.select("tile", "outcome", "visited").join(payloads, "tile", "left"), f"{base}/store",
               f"{base}/ledger", "run-1")
    stored = spark.read.parquet(f"{base}/store").filter("run_id = 'run-1'").select("tile", "outcome", "payload")
    ledger = read_ledger(spark, f"{base}/ledger", "tile long, run_id string", ["tile"]).withColumn("in_ledger", F.lit(True))
    docs = parsed_documents(stored, "payload").select("tile", "outcome", *[
        F.when(F.col("outcome") == "saved", result_array("doc", name)).alias(name) for name in RESULT_ARRAYS])
    relaxed, listed, mapped = (F.when(F.col(name).isNotNull(), F.size(name)).cast("long") for name in RESULT_ARRAYS)
    return docs.join(ledger, "tile", "left").select(
        "tile", "outcome", F.coalesce("in_ledger", F.lit(False)).alias("in_ledger"), relaxed.alias("n_relaxed"),
        listed.alias("n_list"), mapped.alias("n_map"),
        F.try_variant_get(F.get("listResults", F.lit(0)), "$", "string").alias("first_item"))
