"""Result-item explode, page merge and first-wins dedupe.

Ordering is always explicit (file / page, array rank, position).  Nothing
relies on partition order, and every dedupe is an aggregate with partial
(map-side) aggregation, so a hot key is cut down before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.functions.ids import absolute_url, coalesce_id, truthy_text
from parcelgrid.functions.payload import RESULT_ARRAYS, result_array
from parcelgrid.functions.urls import DEFAULT_SITE


def explode_results(df: DataFrame, payload_col: str, keep_cols, arrays=RESULT_ARRAYS) -> DataFrame:
    """One row per item: ``keep_cols + (type_rank, result_type, pos, item)``.

    ``type_rank`` is the index of the array in ``arrays`` (default order
    relaxedResults < listResults < mapResults); ``pos`` is the 0-based index in
    that array.  The three arrays come from one pass over the input.
    """
    groups = F.array(*[F.struct(F.lit(r).alias("type_rank"), F.lit(n).alias("result_type"),
                                result_array(F.col(payload_col), n).alias("items"))
                       for r, n in enumerate(arrays)])
    return (df.select(*keep_cols, F.explode(groups).alias("_g"))
              .select(*keep_cols, F.col("_g.type_rank").cast("int").alias("type_rank"),
                      F.col("_g.result_type").alias("result_type"),
                      F.posexplode(F.col("_g.items")).alias("pos", "item"))
              .withColumn("pos", F.col("pos").cast("long")))


def first_wins(df: DataFrame, key_col: str, order_cols, value_cols) -> DataFrame:
    """Keep, per key, the values of the row with the smallest order tuple.

    ``min`` over a struct led by the order columns is an ordinary aggregate, so
    Spark combines per map task before the shuffle: a key that holds a third of
    all rows still sends at most one row per task.
    """
    packed = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in value_cols])
    best = df.groupBy(key_col).agg(F.min(packed).alias("_w"))
    return best.select(key_col, *[F.col(f"_w.{c}").alias(c) for c in list(order_cols) + list(value_cols)])


def master_list(items: DataFrame, file_col: str = "tile_file", site: str = DEFAULT_SITE,
                strict_presence: bool = False) -> DataFrame:
    """Global first-wins list of houses over exploded tile items.

    Order: file name, then relaxed < list < map results, then position.  An
    item needs a non-empty id and a non-empty ``detailUrl``; root-relative URLs
    get ``site`` in front.  Output ``(zpid, detailUrl, <file_col>, type_rank,
    result_type, pos)``.
    """
    ided = (items
            .withColumn("zpid", coalesce_id(F.col("item"), strict_presence=strict_presence))
            .withColumn("detailUrl", absolute_url(truthy_text(F.try_variant_get("item", "$.detailUrl", "variant")), site))
            .filter((F.col("zpid").isNotNull()) & (F.col("zpid") != "") & F.col("detailUrl").isNotNull()))
    return first_wins(ided, "zpid", [file_col, "type_rank", "pos"], ["result_type", "detailUrl"])


def merge_pages(items: DataFrame, tile_col: str, page_col: str, nonempty_pages: DataFrame) -> DataFrame:
    """Concatenate the merged pages of each tile.

    ``nonempty_pages`` holds one row per merged, non-empty ``(tile, page)``.
    ``listResults`` of every such page are kept in (page, pos) order; the other
    arrays only from the tile's first one.  The first page is a window over the
    page table (at most the page cap per tile), and one inner join on
    ``(tile, page)`` both restricts the items to merged pages and brings the
    first page along.
    """
    w = Window.partitionBy(tile_col)
    pages = (nonempty_pages.select(tile_col, page_col)
             .withColumn("_first_page", F.min(page_col).over(w)))
    joined = items.join(pages, [tile_col, page_col], "inner")
    keep = (F.col("result_type") == "listResults") | (F.col(page_col) == F.col("_first_page"))
    return joined.filter(keep).drop("_first_page")


POS_BITS = 47            # packed order key: page in the high 16 bits, position in the low 47
PAGE_LIMIT = 1 << 16


def _packed_order(page: F.Column, pos: F.Column) -> F.Column:
    """``(page, pos)`` as one long that sorts the same way, so the first item is
    a plain ``min`` (hash aggregation).  Values outside the packable range stop
    the job instead of ordering wrongly."""
    ok = (page >= 0) & (page < PAGE_LIMIT) & (pos >= 0) & (pos < (1 << POS_BITS))
    packed = page.cast("long") * (1 << POS_BITS) + pos.cast("long")
    return F.when(ok, packed).otherwise(F.raise_error(F.concat(
        F.lit("page/position out of the packable range: "), page.cast("string"), F.lit("/"),
        pos.cast("string"))).cast("long"))


def dedupe_arrays(items: DataFrame, tile_col: str, page_col: str, id_col: str = "item_id",
                  deduped=("listResults", "mapResults"), value_cols=()) -> DataFrame:
    """Per tile, drop repeated ids within each array, first (page, pos) kept.

    Items with a null id are dropped from the deduped arrays; other arrays
    (``relaxedResults``) pass through untouched.  Output keeps
    ``(tile, result_type, id, page, pos)`` and ``value_cols`` (the payload of the
    kept item); order within an array is the ``(page, pos)`` of the kept item.

    Deduped arrays are one aggregate per id that keeps the smallest packed
    ``(page, pos)``: a hash aggregate without values, and with them a sort-based
    one that still combines before the shuffle.  The other arrays are joined on
    by a union, so their rows are not shuffled.
    """
    values = list(value_cols)
    in_scope = F.coalesce(F.col("result_type").isin(list(deduped)), F.lit(False))
    order = _packed_order(F.col(page_col), F.col("pos"))
    keys = [F.col(tile_col), F.col("result_type"), F.col(id_col)]
    scoped = items.filter(in_scope & F.col(id_col).isNotNull())
    best = [F.min(order).alias("_k")]
    if values:
        best.append(F.min_by(F.struct(*values), order).alias("_v"))
    types = dict(items.dtypes)
    firsts = scoped.groupBy(*keys).agg(*best).select(
        tile_col, "result_type", id_col,
        F.shiftright(F.col("_k"), POS_BITS).cast(types[page_col]).alias(page_col),
        F.col("_k").bitwiseAND((1 << POS_BITS) - 1).cast(types["pos"]).alias("pos"),
        *[F.col(f"_v.{c}").alias(c) for c in values])
    return firsts.unionByName(items.filter(~in_scope).select(tile_col, "result_type", id_col, page_col, "pos", *values))
