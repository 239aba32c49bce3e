"""Bindings: query parameters, search state, pagination rewrite, request body,
tile grid, tile links and tile keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.functions.geo import tile_key
from parcelgrid.functions.urls import first_param, quote, request_body, search_state, search_state_text, url_parameters
from parcelgrid.operators.grid import BASE_PATH, BASE_STATE, REFERENCE_TILE, page_plan, tile_grid, tile_links
from parcelgrid.plans import url_standin as us
from parcelgrid.plans.registry import query
from parcelgrid.session import table


@query("q_query_params", "WITH " + us.URLS_SQL + r""",
q AS (SELECT page_id, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS qs FROM u),
p AS (SELECT page_id, unnest(string_split(qs, '&')) AS part, generate_subscripts(string_split(qs, '&'), 1) - 1 AS pos
      FROM q),
kv AS (SELECT page_id, CAST(pos AS BIGINT) AS pos,
              url_decode(replace(regexp_extract(part, '^([^=]*)', 1), '+', ' ')) AS key,
              url_decode(replace(regexp_extract(part, '^[^=]*=(.*)$', 1), '+', ' ')) AS value
       FROM p WHERE contains(part, '='))
SELECT page_id, pos, key, value,
       CASE WHEN regexp_matches(value, '%7B.*%7D')
            THEN CASE WHEN json_valid(url_decode(value)) THEN 'json' ELSE 'raw' END
            ELSE 'plain' END AS status,
       coalesce(json_valid(url_decode(value)), FALSE) AS json_ok,
       row_number() OVER (PARTITION BY page_id, key ORDER BY pos) = 1 AS is_first,
       CASE WHEN regexp_matches(value, '%7B.*%7D') THEN url_decode(value) END AS decoded
FROM kv WHERE value <> ''""")
def q_query_params(spark, sf_dir):
    """Every query pair decoded, with the JSON sniff of each value."""
    return url_parameters(us.search_urls(table(spark, sf_dir, "pages")), "url", ["page_id"])


@query("q_url_state", "WITH " + us.URLS_SQL + """
SELECT page_id, state AS state_json, CAST(page_id % 20 AS BIGINT) AS map_zoom,
       round(CAST(page_id AS DOUBLE) / 8, 9) AS north,
       prefix || '?category=RECENT_SEARCH&searchQueryState=' || replace(url_encode(state), '%2F', '/') AS rebuilt_url,
       (page_id % 4 <> 0 AND page_id % 5 <> 0 AND page_id % 6 <> 0) AS round_trip
FROM u""")
def q_url_state(spark, sf_dir):
    """Extract and parse the state, rebuild the URL, check round trip."""
    urls = us.search_urls(table(spark, sf_dir, "pages"))
    st = search_state(F.col("url"))
    rebuilt = F.concat(F.col("prefix"), F.lit("?category="), first_param(F.col("url"), "category"),
                       F.lit("&searchQueryState="), quote(search_state_text(F.col("url")), safe="/"))
    return urls.select(
        "page_id", search_state_text(F.col("url")).alias("state_json"),
        F.variant_get(st, "$.mapZoom", "long").alias("map_zoom"),
        F.round(F.variant_get(st, "$.mapBounds.north", "double"), 9).alias("north"),
        rebuilt.alias("rebuilt_url"), (rebuilt == F.col("url")).alias("round_trip"))


@query("q_paginate_urls", "WITH " + us.URLS_SQL + """,
pg AS (SELECT page_id, prefix, base, CAST(n AS BIGINT) AS page_number
       FROM u, range(1, 2 + page_id % 3) t(n))
SELECT page_id, page_number,
       prefix || '?category=RECENT_SEARCH&searchQueryState='
       || replace(url_encode(base || ',"pagination":{"currentPage":' || CAST(page_number AS VARCHAR) || '}}'), '%', '%25')
       || CASE WHEN page_id % 4 = 0 THEN '&ref=x&ref=y&zed=1&junk=%257Bnot+json%257D' ELSE '' END
       || CASE WHEN page_id % 5 = 0 THEN '#top' ELSE '' END AS page_url
FROM pg""")
def q_paginate_urls(spark, sf_dir):
    """Pages 1..n of each search URL with the page number written in."""
    urls = us.search_urls(table(spark, sf_dir, "pages")).withColumn("n_pages", 1 + F.col("page_id") % 3)
    return page_plan(urls, "url", pages="n_pages").select(
        "page_id", F.col("page_number").cast("long").alias("page_number"), "page_url")


@query("q_request_body", "WITH " + us.URLS_SQL + """
SELECT page_id, '{"searchQueryState": ' || state || ', "wants": {"cat1": ["listResults", "mapResults"], '
       || '"cat2": ["total"]}, "requestId": 10, "isDebugRequest": false}' AS body FROM u""")
def q_request_body(spark, sf_dir):
    """H8: the search request body for each URL's state."""
    urls = us.search_urls(table(spark, sf_dir, "pages"))
    return urls.select("page_id", request_body(search_state_text(F.col("url"))).alias("body"))


# ----------------------------------------------------------------------------- grid
def _regions(spark, sf_dir):
    """One small search box per embedding: corner from dims 1-2, size from
    dims 3-4 (signed, so some boxes come with east < west)."""
    e = F.col("embedding")
    west = e[0].cast("double") * 2 - 122.5
    south = e[1].cast("double") + 37.7
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("region_id"), west.alias("west"), (west + e[2].cast("double") * 0.2).alias("east"),
        south.alias("south"), (south + F.abs(e[3].cast("double")) * 0.1).alias("north"))


_R = REFERENCE_TILE
GRID_SQL = f"""
r AS (
  SELECT vec_id AS region_id, CAST(embedding[1] AS DOUBLE) * 2 - 122.5 AS w0,
         CAST(embedding[2] AS DOUBLE) + 37.7 AS s0, CAST(embedding[3] AS DOUBLE) AS e2, CAST(embedding[4] AS DOUBLE) AS e3
  FROM embeddings
), b AS (
  SELECT region_id, w0 AS W, w0 + e2 * 0.2 AS E, s0 AS S, s0 + abs(e3) * 0.1 AS N FROM r
), ref AS (
  SELECT abs({_R['east']} - ({_R['west']})) * (111.320 * cos(radians(({_R['south']} + {_R['north']}) * 0.5))) AS rw,
         abs({_R['north']} - {_R['south']}) * 110.574 AS rh
), g AS (
  SELECT b.*, CAST(greatest(1, ceil(abs(E - W) * (111.320 * cos(radians((S + N) * 0.5))) / ref.rw)) AS BIGINT) AS cols,
         CAST(greatest(1, ceil(abs(N - S) * 110.574 / ref.rh)) AS BIGINT) AS rows
  FROM b, ref
), t AS (
  SELECT region_id, i AS "row", j AS col, cols, rows,
         W + j * ((E - W) / cols) AS x0, W + (j + 1) * ((E - W) / cols) AS x1,
         S + i * ((N - S) / rows) AS y0, S + (i + 1) * ((N - S) / rows) AS y1
  FROM g, range(0, rows) ti(i), range(0, cols) tj(j)
), tiles AS (
  SELECT region_id, "row" * cols + col AS idx, "row", col, least(x0, x1) AS west, greatest(x0, x1) AS east,
         least(y0, y1) AS south, greatest(y0, y1) AS north FROM t
)"""


@query("q_tile_grid", "WITH " + GRID_SQL + """
SELECT region_id, idx, "row", col, round(west, 9) AS west, round(east, 9) AS east,
       round(south, 9) AS south, round(north, 9) AS north FROM tiles""")
def q_tile_grid(spark, sf_dir):
    """Tiles no larger than the reference tile, row-major from SW."""
    g = tile_grid(_regions(spark, sf_dir))
    return g.select("region_id", "idx", "row", "col", *[F.round(c, 9).alias(c) for c in
                                                          ("west", "east", "south", "north")])


_STATE_SQL = (BASE_STATE.replace('"mapZoom":13', '"mapZoom":17')
              .replace('"north":37.81609909306968', '"north":\' || CAST(north AS VARCHAR) || \'')
              .replace('"south":37.703729038459144', '"south":\' || CAST(south AS VARCHAR) || \'')
              .replace('"east":-122.34046069506836', '"east":\' || CAST(east AS VARCHAR) || \'')
              .replace('"west":-122.54817096118164', '"west":\' || CAST(west AS VARCHAR) || \''))


@query("q_tile_links", "WITH " + GRID_SQL + f"""
SELECT region_id, idx, 'https://www.zillow.com{BASE_PATH}?category=RECENT_SEARCH&searchQueryState='
       || replace(url_encode('{_STATE_SQL}'), '%2F', '/') AS link FROM tiles""")
def q_tile_links(spark, sf_dir):
    """One search URL per tile (bounds and zoom overridden)."""
    return tile_links(tile_grid(_regions(spark, sf_dir))).select("region_id", "idx", "link")


@query("q_tile_key", "WITH " + GRID_SQL + """
SELECT region_id, idx, 'tile_' || replace(CAST(north AS VARCHAR), '.', '_') || '_long_'
       || replace(CAST(west AS VARCHAR), '.', '_') || '.json' AS tile_key FROM tiles""")
def q_tile_key(spark, sf_dir):
    """File key of each tile from its north-west corner."""
    g = tile_grid(_regions(spark, sf_dir))
    return g.select("region_id", "idx", tile_key(F.col("north"), F.col("west")).alias("tile_key"))
