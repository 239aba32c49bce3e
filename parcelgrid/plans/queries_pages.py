"""Bindings: record lists, id coalesce, page health, embedded JSON, response
unwrap, score texts, flatten, filter state, listing filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.functions.ids import coalesce_id
from parcelgrid.functions.pages import detail_gate, next_data_text, page_health
from parcelgrid.functions.payload import array_count, result_array, unwrap_response
from parcelgrid.operators.reshape import filter_state_entries, flatten_sections, listing_filter_sets, summary_columns
from parcelgrid.operators.scores import score_texts
from parcelgrid.plans.registry import query
from parcelgrid.session import table
from parcelgrid.sources.tiles import record_list

HREF_RX = r'href="(/[^"]*)"'


@query("q_valid_records", f"""
SELECT page_id, CAST(0 AS BIGINT) AS pos, CASE WHEN page_id = 0 THEN NULL ELSE CAST(page_id AS VARCHAR) END AS zpid,
       url AS detailUrl
FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 <> 0 AND url IS NOT NULL AND url <> ''
UNION ALL
SELECT page_id, CAST(1 AS BIGINT), NULL, h FROM (
  SELECT page_id, regexp_extract(html, '{HREF_RX}', 1) AS h FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 <> 0)
WHERE h <> ''""")
def q_valid_records(spark, sf_dir):
    """JSON-array record lists; non-lists, bad JSON and bad entries skipped."""
    pages = table(spark, sf_dir, "pages")
    href = F.regexp_extract(F.col("html"), HREF_RX, 1)
    good = F.concat(F.lit("["), F.to_json(F.struct(F.col("page_id").alias("zpid"), F.col("url").alias("detailUrl"))),
                    F.lit(',{"zpid":null,'), F.substring(F.to_json(F.struct(href.alias("detailUrl"))), 2, 1 << 30),
                    F.lit(',{"zpid":"","detailUrl":""},5]'))
    text = (F.when(F.col("page_id") % 17 == 0, F.lit('{"a":1}'))
             .when(F.col("page_id") % 19 == 0, F.lit('[{"zpid":1,')).otherwise(good))
    return record_list(pages.select("page_id", text.alias("text")), ["page_id"])


def _id_json():
    ok, ck = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    k = F.col("o_orderkey") % 8
    return (F.when(k == 0, F.concat(F.lit('{"zpid":'), ok, F.lit(',"id":'), ck, F.lit("}")))
             .when(k == 1, F.concat(F.lit('{"id":'), ck, F.lit(',"hdpData":{"homeInfo":{"zpid":'), ok, F.lit("}}}")))
             .when(k == 2, F.concat(F.lit('{"hdpData":{"homeInfo":{"zpid":'), ok, F.lit("}}}")))
             .when(k == 3, F.concat(F.lit('{"zpid":null,"id":'), ck, F.lit("}")))
             .when(k == 4, F.lit('{"hdpData":{"homeInfo":{}}}'))
             .when(k == 5, F.concat(F.lit('{"zpid":"Z'), ok, F.lit('"}')))
             .when(k == 6, F.lit('{"id":null,"hdpData":{"homeInfo":{"zpid":null}}}'))
             .otherwise(F.lit("{}")))


@query("q_id_coalesce", """
SELECT o_orderkey,
       CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR)
            WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN CAST(o_custkey AS VARCHAR)
            WHEN 5 THEN 'Z' || CAST(o_orderkey AS VARCHAR) END AS zpid,
       CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR)
            WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'None' WHEN 4 THEN ''
            WHEN 5 THEN 'Z' || CAST(o_orderkey AS VARCHAR) WHEN 6 THEN 'None' END AS zpid_strict
FROM orders""")
def q_id_coalesce(spark, sf_dir):
    """Id by zpid / id / hdpData.homeInfo.zpid; default and key-presence modes."""
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(_id_json()).alias("item"))
    return items.select("o_orderkey", coalesce_id(F.col("item")).alias("zpid"),
                        coalesce_id(F.col("item"), strict_presence=True).alias("zpid_strict"))


def _health_body():
    pid = F.col("page_id")

    def part(cond, text):
        return F.when(cond, F.lit(text)).otherwise(F.lit(""))
    return F.concat(part(pid % 13 == 4, "<h1 class=x>Server Error</h1>"),
                    part(pid % 11 == 3, "<title>Page Not Found</title>"), F.col("html"),
                    part(pid % 7 == 1, '<div id="px-captcha"></div>'),
                    part(pid % 5 == 2, '<div class="property-card"></div>'),
                    part(pid % 9 == 5, "<p>you are blocked</p>"), part(pid % 17 == 6, "<p>error 404</p>"))


_ERR = "'404','page not found','access denied','blocked','forbidden','server error','something went wrong'"


def _any(expr, words):
    return "(" + " OR ".join(f"contains({expr}, {w})" for w in words.split(",")) + ")"


@query("q_page_health", f"""
WITH b AS (
  SELECT page_id, page_id % 4 AS pc, page_id % 3 AS hc,
         CASE WHEN page_id % 13 = 4 THEN '<h1 class=x>Server Error</h1>' ELSE '' END
         || CASE WHEN page_id % 11 = 3 THEN '<title>Page Not Found</title>' ELSE '' END || html
         || CASE WHEN page_id % 7 = 1 THEN '<div id="px-captcha"></div>' ELSE '' END
         || CASE WHEN page_id % 5 = 2 THEN '<div class="property-card"></div>' ELSE '' END
         || CASE WHEN page_id % 9 = 5 THEN '<p>you are blocked</p>' ELSE '' END
         || CASE WHEN page_id % 17 = 6 THEN '<p>error 404</p>' ELSE '' END AS body
  FROM pages
), l AS (SELECT *, lower(body) AS low FROM b),
f AS (
  SELECT page_id, pc, hc, length(body) AS content_length,
         {_any('low', "'press and hold','px-captcha','access denied'")} AS cap,
         {_any('low', "'listresults','mapresults','property-card','zestimate'")} AS lst,
         {_any('low', _ERR)} AS anyerr,
         regexp_matches(low, '(?s)<title[^>]*>(.*?)</title>')
           AND {_any("regexp_extract(low, '(?s)<title[^>]*>(.*?)</title>', 1)", _ERR)} AS t_err,
         regexp_matches(low, '(?s)<h1[^>]*>(.*?)</h1>')
           AND {_any("regexp_extract(low, '(?s)<h1[^>]*>(.*?)</h1>', 1)", _ERR)} AS h_err,
         contains(low, '404') AS has404
  FROM l
), g AS (
  SELECT *, (NOT lst) AND anyerr AND (t_err OR h_err OR has404) AS err0 FROM f
), h AS (
  SELECT *, (NOT cap) AND (NOT err0) AND lst AS succ0, lst AND (pc > 0 OR hc > 0) AS got FROM g
)
SELECT page_id, cap AS has_captcha, lst AS has_listings, err0 AND NOT got AS has_error, succ0 OR got AS success,
       CAST(content_length AS BIGINT) AS content_length
FROM h""")
def q_page_health(spark, sf_dir):
    """H1-H4: challenge / listings / error flags and the success verdict."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", _health_body().alias("body"), (F.col("page_id") % 4).alias("pc"), (F.col("page_id") % 3).alias("hc"))
    return pages.select("page_id", page_health(F.col("body"), F.col("pc"), F.col("hc")).alias("h")) \
        .select("page_id", "h.has_captcha", "h.has_listings", "h.has_error", "h.success", "h.content_length")


@query("q_embedded_json", """
SELECT event_id,
       CASE WHEN event_id % 11 = 4 THEN 'error' WHEN event_id % 5 = 0 THEN 'no_next_data'
            WHEN event_id % 7 = 3 THEN 'bad_json' ELSE 'ok' END AS status,
       CASE WHEN event_id % 11 <> 4 AND event_id % 5 <> 0 AND event_id % 7 <> 3
            THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 4 END AS BIGINT) AS n_scores
FROM events""")
def q_embedded_json(spark, sf_dir):
    """__NEXT_DATA__ text in any quoting, gate (error, missing or bad JSON fail), optional score texts."""
    ev = table(spark, sf_dir, "events")
    eid, props = F.col("event_id"), F.col("props")
    html = (F.when(eid % 5 == 0, F.lit("<html><body>no data</body></html>"))
             .when(eid % 7 == 3, F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'),
                                         F.expr("substring(props, 1, length(props) - 1)"), F.lit("</script></html>")))
             .when(eid % 3 == 0, F.concat(F.lit("<html><script id='__NEXT_DATA__'>"), props, F.lit("</script></html>")))
             .when(eid % 3 == 1, F.concat(F.lit("<html><script id=__NEXT_DATA__ async>"), props, F.lit("</script></html>")))
             .otherwise(F.concat(F.lit('<html><head><script id="__NEXT_DATA__" type="application/json">'), props,
                                 F.lit("</script></head></html>"))))
    raw = ev.select("event_id", next_data_text(html).alias("next_text"),
                    F.when(eid % 11 == 4, F.lit("timeout")).alias("error"),
                    F.when(eid % 2 == 1, F.array_repeat(F.lit("Walk Score"), (eid % 4).cast("int"))).alias("texts"))
    gated = raw.select("event_id", detail_gate("next_text", "error", "texts").alias("g"))
    return gated.select("event_id", "g.status", F.try_variant_get("g.next_data", "$.k", "long").alias("k"),
                        F.size("g.scores").cast("long").alias("n_scores"))


@query("q_unwrap_response", """
SELECT event_id,
       CAST(CASE event_id % 6 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS list_count,
       CAST(CASE event_id % 6 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) AS map_count,
       CASE WHEN event_id % 6 IN (1, 2, 3) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS first_k
FROM events""")
def q_unwrap_response(spark, sf_dir):
    """H7/U16: payload of stored responses of every shape; array sizes."""
    ev = table(spark, sf_dir, "events")
    eid, p = F.col("event_id") % 6, F.col("props")
    shape3 = F.concat(F.lit('{"cat1":{"searchResults":{"listResults":['), p, F.lit('],"mapResults":[]}}}'))
    text = (F.when(eid == 0, F.lit('{"error":"timeout"}'))
             .when(eid == 1, F.concat(F.lit('[{"a":1},{"cat1":{"searchResults":{"listResults":['), p, F.lit("]}}}]")))
             .when(eid == 2, F.concat(F.lit('[{"k":{"cat1":{"searchResults":{"mapResults":['), p, F.lit(","), p,
                                      F.lit("]}}}}]")))
             .when(eid == 3, shape3).when(eid == 4, F.lit('{"cat1":{}}'))
             .otherwise(F.substring(shape3, 1, 20)))
    pay = ev.select("event_id", unwrap_response(text).alias("payload"))
    first = F.coalesce(F.try_variant_get(F.try_element_at(result_array("payload", "listResults"), F.lit(1)), "$.k", "long"),
                       F.try_variant_get(F.try_element_at(result_array("payload", "mapResults"), F.lit(1)), "$.k", "long"))
    return pay.select("event_id", array_count("payload", "listResults").alias("list_count"),
                      array_count("payload", "mapResults").alias("map_count"), first.alias("first_k"))


@query("q_score_texts", """
SELECT page_id, CAST(0 AS BIGINT) AS pos, 'Walk Score: ' || CAST(page_id % 100 AS VARCHAR) AS text
FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, CAST(1 AS BIGINT), 'Walk Score: ' || CAST(page_id % 100 AS VARCHAR) FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, CAST(0 AS BIGINT), 'Transit Score ' || CAST(page_id % 100 AS VARCHAR) FROM pages WHERE page_id % 3 = 1""")
def q_score_texts(spark, sf_dir):
    """H6: score texts by the three selectors (mapInPandas, stdlib parser)."""
    pages = table(spark, sf_dir, "pages")
    n = (F.col("page_id") % 100).cast("string")
    extra = (F.when(F.col("page_id") % 3 == 0, F.concat(
                F.lit('<ul><li class="score-box"><span data-testid="walk-score">Walk Score: '), n,
                F.lit("</span><li>not of the item before</ul>")))
             .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<div class="TransitScore">Transit Score '), n,
                                                       F.lit("</div>")))
             .otherwise(F.lit("")))
    html = F.concat(F.col("html"), extra)
    return score_texts(pages.select("page_id", html.alias("html")))


def _houses(spark, sf_dir):
    """Nested house documents from customer + nation + region + order totals."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    sold = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")) \
        .agg(F.sum("o_totalprice").alias("sold"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey) \
         .join(sold, "c_custkey", "left")
    k = F.col("c_custkey")
    return j.select(
        F.struct(F.col("c_name").alias("address"), F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                 F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zipcode"),
                 (k % 5).alias("bedrooms"), ((k % 3).cast("double") + 0.5).alias("bathrooms"),
                 (k % 1000 + 400).alias("livingArea"), k.cast("string").alias("zpid"),
                 F.col("c_mktsegment").alias("description")).alias("basic_info"),
        F.struct(F.round("c_acctbal", 2).alias("price"), F.round("sold", 2).alias("lastSoldPrice")).alias("financial"),
        F.struct(F.when(k % 4 != 0, k % 100).alias("walkScore"), F.col("c_nationkey").cast("long").alias("transitScore"),
                 F.when(k % 5 != 0, k % 7).alias("bikeScore")).alias("scores"),
        F.array_repeat(F.struct(F.col("n_name").alias("name")), (k % 4).cast("int")).alias("schools"),
        F.struct(k.cast("string").alias("zpid")).alias("metadata"))


@query("q_flatten", """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS sold FROM orders GROUP BY o_custkey)
SELECT c_name AS basic_info_address, n_name AS basic_info_city, r_name AS basic_info_state,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS basic_info_zipcode, c_custkey % 5 AS basic_info_bedrooms,
       CAST(c_custkey % 3 AS DOUBLE) + 0.5 AS basic_info_bathrooms, c_custkey % 1000 + 400 AS basic_info_livingArea,
       CAST(c_custkey AS VARCHAR) AS basic_info_zpid, c_mktsegment AS basic_info_description,
       round(c_acctbal, 2) AS financial_price, round(s.sold, 2) AS financial_lastSoldPrice,
       CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 100 END AS scores_walkScore,
       CAST(c_nationkey AS BIGINT) AS scores_transitScore,
       CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 END AS scores_bikeScore,
       CAST(c_custkey AS VARCHAR) AS metadata_zpid,
       coalesce(CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 100 END AS VARCHAR), 'N/A') AS walkScore,
       CAST(c_nationkey AS VARCHAR) AS transitScore,
       coalesce(CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 7 END AS VARCHAR), 'N/A') AS bikeScore,
       c_custkey % 4 AS school_count
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN s ON s.o_custkey = c_custkey""")
def q_flatten(spark, sf_dir):
    """section_field columns of the house documents plus the summary."""
    houses = _houses(spark, sf_dir)
    out = flatten_sections(houses.select("basic_info", "financial", "scores", "metadata",
                                         *summary_columns(detail=False)))
    return out


@query("q_filter_state", """
SELECT n_nationkey, 'filter' AS kind, 'sort' AS name, '"' || r_name || '"' AS value_json
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_nationkey, 'filter', 'fsba', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END FROM nation
UNION ALL SELECT n_nationkey, 'filter', 'price', '{"min":' || CAST(n_nationkey * 1000 AS VARCHAR) || '}' FROM nation
UNION ALL SELECT n_nationkey, 'region', CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT n_nationkey, 'region', CAST(n_nationkey + 100 AS VARCHAR), '6' FROM nation""")
def q_filter_state(spark, sf_dir):
    """One row per filterState entry and per regionSelection entry."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey").cast("string")
    state = F.concat(
        F.lit('{"filterState":{"sort":{"value":"'), F.col("r_name"), F.lit('"},"fsba":{"value":'),
        F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"),
        F.lit('},"price":{"value":{"min":'), (F.col("n_nationkey") * 1000).cast("string"),
        F.lit('}}},"regionSelection":[{"regionId":'), k, F.lit(',"regionType":'), F.col("n_regionkey").cast("string"),
        F.lit('},{"regionId":'), (F.col("n_nationkey") + 100).cast("string"), F.lit(',"regionType":6}]}'))
    states = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.parse_json(state).alias("state"))
    return states.select("n_nationkey", F.inline(filter_state_entries(F.col("state"))))


RANGE_SETS = [
    (1, {"min_size": 10, "max_price": 1000.0}),
    (2, {}),
    (3, {"min_size": 5, "max_size": 20, "min_price": 900.0, "max_price": 950.0}),
]


@query("q_range_filter", """
SELECT CAST(1 AS BIGINT) AS set_id, p_partkey FROM part WHERE p_size >= 10 AND p_retailprice <= 1000.0
UNION ALL SELECT 2, p_partkey FROM part
UNION ALL SELECT 3, p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice BETWEEN 900.0 AND 950.0""")
def q_range_filter(spark, sf_dir):
    """Listing predicate with open (None) bounds; all bound sets in one scan."""
    part = table(spark, sf_dir, "part")
    cols = {"size": "p_size", "price": "p_retailprice"}
    return listing_filter_sets(part, RANGE_SETS, cols).select("set_id", "p_partkey")
