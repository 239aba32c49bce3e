"""Crawl stand-in over ``events``: tile = five users, page = half day, item = event.

* tile   = user_id div 5, so that most tiles have items on most pages;
* page   = half days since 2024-01-01, plus 1 (some lie above the page cap);
* array  = listResults (click, view), mapResults (purchase, signup),
           relaxedResults (error);
* pos    = event_id (order inside a page);
* item   = ``props`` JSON; its id is ``k`` (0 counts as missing).
Page visit: ``page_count`` = list items, ``house_count`` = 25 x map items (a
target that takes several pages to reach),
``success`` = fewer than four error events, ``has_listings`` = any list or map
item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.ids import member, truthy_text

TILE = "user_id div 5"
PAGE = "2 * datediff(to_date(ts), DATE'2024-01-01') + if(hour(ts) >= 12, 1, 0) + 1"


def items(events: DataFrame) -> DataFrame:
    rtype = (F.when(F.col("event_type").isin("click", "view"), "listResults")
              .when(F.col("event_type").isin("purchase", "signup"), "mapResults")
              .otherwise("relaxedResults"))
    item = F.try_parse_json("props")
    return events.select(
        F.expr(TILE).alias("tile"), F.expr(PAGE).cast("long").alias("page"),
        rtype.alias("result_type"), F.col("event_id").alias("pos"),
        truthy_text(member(item, "$.k")).alias("item_id"))


def visits(events: DataFrame) -> DataFrame:
    lst = F.col("event_type").isin("click", "view")
    mp = F.col("event_type").isin("purchase", "signup")
    return (events.groupBy(F.expr(TILE).alias("tile"), F.expr(PAGE).cast("long").alias("page"))
            .agg(F.count(F.when(lst, 1)).alias("page_count"),
                 (25 * F.count(F.when(mp, 1))).alias("house_count"),
                 F.count(F.when(F.col("event_type") == "error", 1)).alias("n_error"))
            .withColumn("success", F.col("n_error") < 4)
            .withColumn("has_listings", (F.col("page_count") + F.col("house_count")) > 0)
            .drop("n_error"))


# The same stand-in in SQL, for the oracles.
ITEMS_SQL = """
items AS (
  SELECT CAST(user_id // 5 AS BIGINT) AS tile,
         CAST(2 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))
              + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END + 1 AS BIGINT) AS page,
         CASE WHEN event_type IN ('click','view') THEN 'listResults'
              WHEN event_type IN ('purchase','signup') THEN 'mapResults' ELSE 'relaxedResults' END AS result_type,
         event_id AS pos,
         CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 0 THEN NULL
              ELSE CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS item_id
  FROM events
)"""

VISITS_SQL = """
visits AS (
  SELECT tile, page, page_count, house_count, n_error < 4 AS success,
         page_count + house_count > 0 AS has_listings
  FROM (SELECT tile, page,
               count(*) FILTER (WHERE result_type = 'listResults') AS page_count,
               25 * count(*) FILTER (WHERE result_type = 'mapResults') AS house_count,
               count(*) FILTER (WHERE result_type = 'relaxedResults') AS n_error
        FROM items GROUP BY tile, page)
)"""

MARKED_SQL = """
marked0 AS (
  SELECT *, success AND has_listings AS ok,
         sum(CASE WHEN success AND has_listings THEN page_count ELSE 0 END)
           OVER (PARTITION BY tile ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc_page_count,
         coalesce(max(CASE WHEN page = 1 AND success AND has_listings THEN house_count END)
           OVER (PARTITION BY tile), 0) AS target_house_count
  FROM visits WHERE page <= 50
), marked1 AS (
  SELECT *, (NOT ok) OR acc_page_count >= target_house_count OR (target_house_count = 0 AND page_count = 0)
            OR (page > 1 AND page_count = 0) AS stop
  FROM marked0
), marked AS (
  SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY tile ORDER BY page
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kept
  FROM marked1
), marked_m AS (SELECT *, kept AND ok AS merged, FALSE AS over_cap FROM marked
  UNION ALL BY NAME
  SELECT *, FALSE AS stop, FALSE AS kept, FALSE AS merged, TRUE AS over_cap FROM visits WHERE page > 50)"""

MERGED_SQL = """
firstp AS (SELECT tile, min(page) AS first_page FROM marked_m WHERE merged GROUP BY tile),
merged_items AS (
  SELECT i.* FROM items i JOIN marked_m m ON i.tile = m.tile AND i.page = m.page AND m.merged
  JOIN firstp f ON i.tile = f.tile
  WHERE i.result_type = 'listResults' OR i.page = f.first_page
),
deduped AS (
  SELECT tile, result_type, item_id, page, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY tile, result_type, item_id ORDER BY page, pos) AS rn
    FROM merged_items WHERE result_type <> 'relaxedResults' AND item_id IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT tile, result_type, item_id, page, pos FROM merged_items WHERE result_type = 'relaxedResults'
),
dcounts AS (
  SELECT tile, count(*) FILTER (WHERE result_type = 'listResults') AS page_count,
         count(*) FILTER (WHERE result_type = 'mapResults') AS house_count
  FROM deduped GROUP BY tile
),
totals AS (
  SELECT p.tile, p.pages_read, p.pages_merged, p.accumulated_page_count, p.house_count_target, p.failed,
         coalesce(d.page_count, 0) AS page_count, coalesce(d.house_count, 0) AS house_count
  FROM (SELECT tile, count(*) AS pages_read, count(*) FILTER (WHERE merged) AS pages_merged,
               CAST(sum(CASE WHEN merged THEN page_count ELSE 0 END) AS BIGINT) AS accumulated_page_count,
               max(target_house_count) AS house_count_target,
               bool_or(NOT merged) AS failed
        FROM marked_m WHERE kept GROUP BY tile) p
  LEFT JOIN dcounts d ON p.tile = d.tile
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
