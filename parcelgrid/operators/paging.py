"""Page-visit rules per tile: running counts, stop prefix, totals, outcome.

Input is a page-visit log, one row per ``(tile, page)``; ``one_visit_per_page``
makes it so where pages were tried again.  Windows are partitioned by tile and
ordered by page.  Pages above the cap never enter them: they are marked and
passed along beside the windows, so no row is lost and a window partition holds
at most ``max_pages`` rows of a tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.functions.payload import RESULT_ARRAYS

MAX_PAGES = 50  # fixed value: the crawler's page cap per tile
MODE_CAP = "mode"  # the cap that belongs to the mode: MAX_PAGES in browser mode, none in library mode


def one_visit_per_page(visits: DataFrame, tile: str = "tile", page: str = "page", success: str = "success",
                       listings: str = "has_listings") -> DataFrame:
    """One row per ``(tile, page)`` of a log with repeated visits: a usable visit
    goes before a failed one, then the one with the greatest other columns."""
    rest = [c for c in visits.columns if c not in (tile, page)]
    ok = F.coalesce(F.col(success) & F.col(listings), F.lit(False))
    best = visits.groupBy(tile, page).agg(F.max(F.struct(ok.alias("_ok"), *rest)).alias("_v"))
    return best.select(tile, page, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*visits.columns)


def stop_prefix(visits: DataFrame, tile: str = "tile", page: str = "page", pc: str = "page_count",
                hc: str = "house_count", success: str = "success", listings: str = "has_listings",
                mode: str = "browser", max_pages: int | None | str = MODE_CAP) -> DataFrame:
    """Mark the pages a crawl of each tile reads before it stops; every input row comes back.

    Adds ``acc_page_count`` (running sum of ``pc`` over usable pages),
    ``target_house_count``, ``stop`` (this page ends the crawl), ``kept`` (page
    read), ``merged`` (page read and its payload merged) and ``over_cap`` (page
    above ``max_pages``).  A page over the cap, or without a page number, is not
    kept and has no running count or target.

    ``mode='browser'``: the target is the house count of page 1; the crawl
    stops at the first page that failed or shows no listings (read, not
    merged), or when ``acc >= target``, or ``target == 0 and pc == 0``, or
    ``page > 1 and pc == 0``; pages up to ``max_pages`` (default 50).
    ``mode='library'``: the target is the current page's house count and the
    crawl stops when ``acc >= target``; an empty page (``pc == 0``) or failed
    page also stops it, so a tile cannot page for ever; no cap by default.
    """
    if max_pages == MODE_CAP:
        max_pages = MAX_PAGES if mode == "browser" else None
    within = F.col(page).isNotNull() if max_pages is None else F.coalesce(F.col(page) <= max_pages, F.lit(False))
    v = visits.filter(within)
    ok = F.coalesce(F.col(success), F.lit(False)) & F.coalesce(F.col(listings), F.lit(False))
    w_run = Window.partitionBy(tile).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_before = Window.partitionBy(tile).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(tile)
    pcc, hcc = F.coalesce(F.col(pc), F.lit(0)), F.coalesce(F.col(hc), F.lit(0))
    acc = F.sum(F.when(ok, pcc).otherwise(F.lit(0))).over(w_run)
    if mode == "browser":
        target = F.coalesce(F.max(F.when((F.col(page) == 1) & ok, hcc)).over(w_all), F.lit(0))
        stop = (~ok | (F.col("acc_page_count") >= F.col("target_house_count"))
                | ((F.col("target_house_count") == 0) & (pcc == 0)) | ((F.col(page) > 1) & (pcc == 0)))
    elif mode == "library":
        target = hcc
        stop = ~ok | (F.col("acc_page_count") >= F.col("target_house_count")) | (pcc == 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = (v.withColumn("_ok", ok)
            .withColumn("acc_page_count", acc.cast("long"))
            .withColumn("target_house_count", target.cast("long"))
            .withColumn("stop", stop)
            .withColumn("kept", F.coalesce(F.sum(F.col("stop").cast("int")).over(w_before), F.lit(0)) == 0)
            .withColumn("merged", F.col("kept") & F.col("_ok")))
    out = out.withColumn("over_cap", F.lit(False)).drop("_ok")
    beside = (visits.filter(~within)
              .withColumn("acc_page_count", F.lit(None).cast("long"))
              .withColumn("target_house_count", F.lit(None).cast("long"))
              .withColumn("stop", F.lit(False)).withColumn("kept", F.lit(False)).withColumn("merged", F.lit(False))
              .withColumn("over_cap", F.col(page).isNotNull()))
    return out.unionByName(beside)


def capped_tiles(marked: DataFrame, tile: str = "tile", page: str = "page", max_pages: int = MAX_PAGES) -> DataFrame:
    """Tiles whose crawl read its last allowed page without a reason to stop, with
    the number of stored pages beyond it."""
    last = F.max(F.when((F.col(page) == max_pages) & F.col("kept") & ~F.col("stop"), 1))
    return (marked.groupBy(tile).agg(last.alias("_hit"), F.count(F.when(F.col("over_cap"), 1)).alias("pages_beyond"))
            .filter(F.col("_hit") == 1).drop("_hit"))


def tile_totals(marked: DataFrame, items: DataFrame, tile: str = "tile", page: str = "page",
                pc: str = "page_count", id_col: str = "item_id") -> DataFrame:
    """Per-tile totals in one pass over the marked page log (A3, U16).

    Pages read, pages merged, accumulated page count, target house count and
    whether a page failed, plus ``page_count`` / ``house_count`` of the merged,
    deduped payload: distinct non-empty ids of ``listResults`` / ``mapResults``
    (list items from every merged page, map items from the first one).

    The page-level figures are windows over the tile partitioning the stop rule
    already produced (no extra shuffle, at most the page cap per tile); one
    left join brings in the items, so every tile keeps a row even without
    items.  Distinct ids are counted by two plain aggregates, first per (tile,
    array, id) and then per tile, so no row is multiplied for the two counts.
    The page log is consumed once.
    """
    w = Window.partitionBy(tile)
    merged = F.col("merged")
    pages = (marked.filter("kept").select(
        F.col(tile), F.col(page), merged,
        F.min(F.when(merged, F.col(page))).over(w).alias("_first"),
        F.count(F.lit(1)).over(w).alias("pages_read"),
        F.count(F.when(merged, 1)).over(w).alias("pages_merged"),
        F.sum(F.when(merged, F.col(pc)).otherwise(0)).over(w).cast("long").alias("accumulated_page_count"),
        F.max("target_house_count").over(w).alias("house_count_target"),
        F.max((~merged).cast("int")).over(w).cast("boolean").alias("failed")))
    it = items.select(F.col(tile).alias("_it"), F.col(page).alias("_ip"), "result_type", F.col(id_col).alias("_id"))
    cond = ((pages[tile] == it["_it"]) & (pages[page] == it["_ip"]) & pages["merged"]
            & ((it["result_type"] == "listResults") | (pages[page] == pages["_first"])))
    j = pages.join(it, cond, "left")
    figures = [F.max(c).alias(c) for c in ("pages_read", "pages_merged", "accumulated_page_count",
                                           "house_count_target", "failed")]
    ids = j.groupBy(tile, "result_type", "_id").agg(*figures)
    return ids.groupBy(tile).agg(
        *figures, F.count(F.when(F.col("result_type") == "listResults", F.col("_id"))).alias("page_count"),
        F.count(F.when(F.col("result_type") == "mapResults", F.col("_id"))).alias("house_count"))


def deduped_counts(deduped_items: DataFrame, tile: str = "tile") -> DataFrame:
    """``page_count`` / ``house_count`` of already deduped items per tile."""
    return deduped_items.groupBy(tile).agg(
        F.count(F.when(F.col("result_type") == "listResults", 1)).alias("page_count"),
        F.count(F.when(F.col("result_type") == "mapResults", 1)).alias("house_count"))


def integrity_violations(totals: DataFrame, tile: str = "tile", mode: str = "quarantine") -> DataFrame:
    """Tiles whose deduped list is shorter than the deduped map list.

    ``mode='quarantine'`` returns them; ``mode='raise'`` makes the job fail on
    the first one.  The error is part of the filter, so it is raised whatever
    columns are read, and by ``count()`` too.
    """
    violated = F.col("page_count") < F.col("house_count")
    if mode == "raise":
        return totals.filter(F.when(violated, F.raise_error(F.concat(
            F.lit("Data integrity error: page_count < house_count for tile "),
            F.coalesce(F.col(tile).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(False)))
    return totals.filter(violated)


def tile_outcome(totals: DataFrame, has_coordinates=None) -> DataFrame:
    """``saved`` (houses found), ``not saved`` (houses found, but the tile has no
    coordinates to save them under), ``failed`` (a page failed, none found) or
    ``empty``.  ``visited`` marks what is not crawled again: saved and empty
    tiles.  ``visited_parity`` is the crawler's rule: a tile with 0 houses counts
    as visited, failed or not; a tile that was not saved does not.
    ``has_coordinates`` is a boolean column (null: none; left out: all tiles have them)."""
    placed = F.lit(True) if has_coordinates is None else F.coalesce(has_coordinates, F.lit(False))
    found = F.col("house_count") > 0
    outcome = (F.when(found & placed, "saved").when(found, "not saved")
                .when(F.col("failed"), "failed").otherwise("empty"))
    return (totals.withColumn("outcome", outcome)
            .withColumn("visited", F.col("outcome").isin("saved", "empty"))
            .withColumn("visited_parity", F.col("outcome") != "not saved"))


def tile_payloads(deduped: DataFrame, tile: str = "tile", page: str = "page", id_col: str = "item_id",
                  arrays=RESULT_ARRAYS) -> DataFrame:
    """``(tile, payload)``: the merged result document of each tile as JSON text, every
    array's items in (page, position) order.  An array holds what the merged pages of
    one tile hold, which the page cap bounds."""
    def array(name):
        own = F.collect_list(F.when((F.col("result_type") == name) & F.col(id_col).isNotNull(), F.struct(page, "pos", id_col)))
        return F.transform(F.array_sort(own), lambda item: item[id_col]).alias(name)

    return deduped.groupBy(tile).agg(*[array(name) for name in arrays]).select(
        tile, F.to_json(F.struct(*arrays)).alias("payload"))
