"""Search-URL stand-in over ``pages``.

Each page gets a search state built from ``page_id`` and a URL on the page's
host and path: ``?category=RECENT_SEARCH&searchQueryState=<state>``, the state
quoted once, or twice when ``page_id % 6 == 0``; ``page_id % 4 == 0`` adds
``&ref=x&empty=&zed=1&ref=y&junk=%257Bnot%20json%257D`` (braces that are not
JSON) and ``page_id % 5 == 0`` a ``#top`` fragment.
State variants by ``page_id % 3``: no pagination, ``currentPage`` 7, empty
pagination object.  Every state holds a nested ``pagination`` inside ``saved`` and
the text ``c$1``; ``page_id % 7 == 0`` turns an empty object into null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.text import py_float_text
from parcelgrid.functions.urls import quote, url_prefix

EXTRA = "&ref=x&empty=&zed=1&ref=y&junk=%257Bnot%20json%257D"


def state_base(pid):
    return F.concat(
        F.lit('{"saved":{"pagination":{"currentPage":2},"x":"c$1"},"isMapVisible":true,"mapBounds":{"north":'), py_float_text(pid.cast("double") / 8),
        F.lit(',"south":'), py_float_text(-(pid.cast("double") / 16)),
        F.lit(',"east":'), (pid % 50).cast("string"), F.lit(',"west":-3.5},"filterState":{"sort":{"value":'
                                                            '"globalrelevanceex"}},"mapZoom":'),
        (pid % 20).cast("string"), F.lit(',"usersSearchTerm":"City '), pid.cast("string"), F.lit(', ST+x/y"'))


def state_suffix(pid):
    return (F.when(pid % 3 == 0, F.lit("}"))
             .when(pid % 3 == 1, F.lit(',"pagination":{"currentPage":7}}'))
             .when(pid % 7 == 0, F.lit(',"pagination":null}'))
             .otherwise(F.lit(',"pagination":{}}')))


def search_urls(pages: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    staged = (pages.select("page_id", url_prefix(F.col("url")).alias("prefix"),
                           F.concat(state_base(pid), state_suffix(pid)).alias("_st"))
              .withColumn("_enc", quote(F.col("_st"), safe="/"))
              .withColumn("_enc", F.when(pid % 6 == 0, quote(F.col("_enc"), safe="/")).otherwise(F.col("_enc"))))
    url = F.concat(F.col("prefix"), F.lit("?category=RECENT_SEARCH&searchQueryState="), F.col("_enc"),
                   F.when(pid % 4 == 0, F.lit(EXTRA)).otherwise(F.lit("")),
                   F.when(pid % 5 == 0, F.lit("#top")).otherwise(F.lit("")))
    return staged.select("page_id", url.alias("url"), "prefix")


STATE_SQL = """
CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',"pagination":{"currentPage":7}' ELSE CASE WHEN page_id % 7 = 0 THEN ',"pagination":null' ELSE ',"pagination":{}' END END"""

BASE_SQL = """
'{"saved":{"pagination":{"currentPage":2},"x":"c$1"},"isMapVisible":true,"mapBounds":{"north":' || CAST(CAST(page_id AS DOUBLE) / 8 AS VARCHAR)
 || ',"south":' || CAST(-(CAST(page_id AS DOUBLE) / 16) AS VARCHAR)
 || ',"east":' || CAST(page_id % 50 AS VARCHAR)
 || ',"west":-3.5},"filterState":{"sort":{"value":"globalrelevanceex"}},"mapZoom":' || CAST(page_id % 20 AS VARCHAR)
 || ',"usersSearchTerm":"City ' || CAST(page_id AS VARCHAR) || ', ST+x/y"'"""

URLS_SQL = f"""
u0 AS (
  SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS prefix, {BASE_SQL} AS base,
         {BASE_SQL} || {STATE_SQL} || '}}' AS state
  FROM pages
), u AS (
  SELECT *, prefix || '?category=RECENT_SEARCH&searchQueryState='
            || CASE WHEN page_id % 6 = 0 THEN replace(url_encode(replace(url_encode(state), '%2F', '/')), '%2F', '/')
                    ELSE replace(url_encode(state), '%2F', '/') END
            || CASE WHEN page_id % 4 = 0 THEN '{EXTRA}' ELSE '' END
            || CASE WHEN page_id % 5 = 0 THEN '#top' ELSE '' END AS url
  FROM u0
)"""
