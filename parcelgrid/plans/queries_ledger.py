"""Bindings: ledgers, anti joins, insert-if-absent, empty tiles, null ids.

Stand-ins (SURVEY 7.4): links and ledgers from ``customer`` / ``orders`` /
``lineitem`` keys, tile corners from ``supplier`` / ``nation``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelgrid.functions.ids import first_id
from parcelgrid.operators.ledger import (assign_null_ids, empty_tile_check, insert_if_absent, sync_house_ledger,
                                         unvisited, unvisited_houses, visited_house_entries)
from parcelgrid.plans.registry import query
from parcelgrid.session import ensure_checkpoint_dir, table
from parcelgrid.sinks.writers import append_ledger
from parcelgrid.sources.ledgers import corrupt_files, read_ledger

URL_BASE = "https://h.example/c/"


def _house_url(col):
    return F.concat(F.lit(URL_BASE), F.col(col).cast("string"))


@query("q_unvisited_tiles", """
SELECT c_custkey AS idx, c_name AS link FROM customer c
WHERE c_custkey % 13 <> 0 AND c_name IS NOT NULL AND c_name <> ''
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_custkey = c.c_custkey)""")
def q_unvisited_tiles(spark, sf_dir):
    """Links minus the visited-tile ledger, missing links dropped."""
    links = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(F.col("c_name")).alias("link"))
    visited = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F") \
        .select(F.col("o_custkey").alias("idx"))
    return unvisited(links, visited)


@query("q_unvisited_houses", f"""
WITH m AS (
  SELECT o_orderkey AS list_pos,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS zpid,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '{URL_BASE}' || CAST(o_custkey AS VARCHAR) END AS detailUrl
  FROM orders)
SELECT list_pos, zpid, detailUrl FROM m
WHERE detailUrl IS NOT NULL AND detailUrl <> ''
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_linenumber = 1 AND l.l_returnflag = 'R'
                  AND CAST(l.l_orderkey AS VARCHAR) = m.zpid)
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment = 'BUILDING'
                  AND '{URL_BASE}' || CAST(c.c_custkey AS VARCHAR) = m.detailUrl)""")
def q_unvisited_houses(spark, sf_dir):
    """Drop a house if its id OR its URL was visited (two anti joins)."""
    master = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("list_pos"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderkey").cast("string")).alias("zpid"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(_house_url("o_custkey")).alias("detailUrl"))
    ids = table(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")) \
        .select(F.col("l_orderkey").cast("string").alias("zpid"))
    urls = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(_house_url("c_custkey").alias("detailUrl"))
    return unvisited_houses(master, ids, urls).select("list_pos", "zpid", "detailUrl")


@query("q_insert_if_absent", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN ''
                                   ELSE CAST(o_custkey AS VARCHAR) END AS zpid
           FROM orders),
     e AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS zpid FROM customer WHERE c_acctbal > 5000),
     f AS (SELECT zpid, min(o_orderkey) AS first_key FROM b WHERE zpid IS NOT NULL GROUP BY zpid)
SELECT b.o_orderkey, b.zpid,
       CASE WHEN b.zpid IS NULL OR b.zpid = '' THEN 'saved' WHEN e.zpid IS NOT NULL THEN 'failed'
            WHEN b.o_orderkey = f.first_key THEN 'saved' ELSE 'failed' END AS status
FROM b LEFT JOIN e ON b.zpid = e.zpid LEFT JOIN f ON b.zpid = f.zpid""")
def q_insert_if_absent(spark, sf_dir):
    """K7: a stored id is never overwritten; first batch row per id wins."""
    batch = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).when(F.col("o_orderkey") % 9 == 1, F.lit(""))
         .otherwise(F.col("o_custkey").cast("string")).alias("zpid"))
    existing = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 5000) \
        .select(F.col("c_custkey").cast("string").alias("zpid"))
    return insert_if_absent(batch, existing, "zpid", "o_orderkey").select("o_orderkey", "zpid", "status")


def _saved_file_names(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    name = (F.when(k == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".json")))
             .when(k == 1, F.concat(F.lit("nullzpid_"), F.col("o_orderkey").cast("string"), F.lit(".json")))
             .when(k == 2, F.concat(F.lit("x"), F.col("o_custkey").cast("string"), F.lit(".json")))
             .when(k == 3, F.lit("visited_houses.json"))
             .when(k == 4, F.concat(F.col("o_custkey").cast("string"), F.lit(".txt")))
             .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".json"))))
    return table(spark, sf_dir, "orders").select(name.alias("file_name"))


@query("q_ledger_sync", """
SELECT CAST(c_custkey AS VARCHAR) AS zpid FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 6 = 0
UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 6 = 5""")
def q_ledger_sync(spark, sf_dir):
    """Ledger ids union all-digit stems of saved house files."""
    ledger = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "HOUSEHOLD") \
        .select(F.col("c_custkey").cast("string").alias("zpid"))
    return sync_house_ledger(ledger, _saved_file_names(spark, sf_dir))


@query("q_ledger_totals", f"""
SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS tiles_visited,
       (SELECT count(DISTINCT CAST(l_orderkey AS VARCHAR)) FROM lineitem WHERE l_returnflag = 'R') AS houses_visited,
       (SELECT count(DISTINCT '{URL_BASE}' || CAST(c_custkey AS VARCHAR)) FROM customer
         WHERE c_mktsegment = 'BUILDING') AS urls_visited""")
def q_ledger_totals(spark, sf_dir):
    """K4/K5/A4: append-only ledgers read with set semantics; totals count ids.

    The tile ledger is appended twice here; the total must not change."""
    tiles = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("idx"))
    tiles = tiles.unionByName(tiles)
    ids = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R") \
        .select(F.col("l_orderkey").cast("string").alias("zpid"))
    urls = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING") \
        .select(_house_url("c_custkey").alias("url"))
    return spark.range(1).select(
        tiles.select(F.count_distinct("idx")).scalar().alias("tiles_visited"),
        ids.select(F.count_distinct("zpid")).scalar().alias("houses_visited"),
        urls.select(F.count_distinct("url")).scalar().alias("urls_visited"))


@query("q_ledger_append", f"""
SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS tiles_visited,
       (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R') AS houses_visited,
       (SELECT count(DISTINCT '{URL_BASE}' || CAST(l_partkey AS VARCHAR)) FROM lineitem
         WHERE l_returnflag = 'R' AND l_partkey % 5 <> 0) AS urls_visited,
       CAST(1 AS BIGINT) AS corrupt_files, CAST(0 AS BIGINT) AS absent_ledger""")
def q_ledger_append(spark, sf_dir):
    """K4/K5/S8 through real files: the tile ledger is appended twice by two runs, with a
    corrupt file among its files; the house ledgers get the entries of a saved batch;
    all are read back as sets, and a ledger nobody wrote as empty."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgers-{uuid.uuid4().hex}"
    tiles = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("idx"))
    for run in ("run-1", "run-2"):
        append_ledger(tiles, f"{base}/tiles", run)
    spark.range(1).select(F.lit("this is no ledger").alias("value")).write.mode("append").text(f"{base}/tiles")
    saved = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("zpid"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit("")).otherwise(_house_url("l_partkey")).alias("detailUrl"))
    for name, rows in zip(("ids", "urls"), visited_house_entries(saved)):
        append_ledger(rows, f"{base}/{name}", "run-1")
    known = {"tiles": ("idx long, run_id string", "idx"), "ids": ("zpid string, run_id string", "zpid"),
             "urls": ("url string, run_id string", "url"), "never_written": ("idx long, run_id string", "idx")}
    n = {name: read_ledger(spark, f"{base}/{name}", schema, [key]).select(F.count(key)).scalar()
         for name, (schema, key) in known.items()}
    corrupt = corrupt_files(spark, f"{base}/tiles", known["tiles"][0]).select(F.count("path")).scalar()
    return spark.range(1).select(n["tiles"].alias("tiles_visited"), n["ids"].alias("houses_visited"),
                                 n["urls"].alias("urls_visited"), corrupt.alias("corrupt_files"),
                                 n["never_written"].alias("absent_ledger"))


@query("q_empty_tiles", """
WITH t AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) + 0.5 AS ne_lat,
                  -CAST(s_suppkey % 7 AS DOUBLE) - 0.25 AS sw_long, s_suppkey % 4 AS hc FROM supplier),
     l AS (SELECT DISTINCT CAST(n_nationkey AS DOUBLE) + 0.5 AS ne_lat, -CAST(n_regionkey AS DOUBLE) - 0.25 AS sw_long
           FROM nation WHERE n_regionkey <= 2),
     f AS (SELECT ne_lat, sw_long, min(s_suppkey) AS fe FROM t WHERE hc = 0 GROUP BY ne_lat, sw_long),
     j AS (SELECT t.*, (l.ne_lat IS NOT NULL) OR coalesce(f.fe < t.s_suppkey, FALSE) AS skipped
           FROM t LEFT JOIN l ON t.ne_lat = l.ne_lat AND t.sw_long = l.sw_long
                  LEFT JOIN f ON t.ne_lat = f.ne_lat AND t.sw_long = f.sw_long)
SELECT s_suppkey, ne_lat, sw_long, CASE WHEN skipped THEN 0 ELSE hc END AS house_count, skipped,
       skipped OR hc = 0 AS empty_recorded FROM j""")
def q_empty_tiles(spark, sf_dir):
    """Skip tiles known empty; record newly empty tiles once."""
    tiles = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_nationkey").cast("double") + 0.5).alias("ne_lat"),
        (-(F.col("s_suppkey") % 7).cast("double") - 0.25).alias("sw_long"),
        (F.col("s_suppkey") % 4).alias("house_count"))
    ledger = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") <= 2).select(
        (F.col("n_nationkey").cast("double") + 0.5).alias("ne_lat"),
        (-F.col("n_regionkey").cast("double") - 0.25).alias("sw_long"))
    return empty_tile_check(tiles, ledger, "s_suppkey").select(
        "s_suppkey", "ne_lat", "sw_long", "house_count", "skipped", "empty_recorded")


@query("q_null_id_assign", """
WITH b AS (
  SELECT c_custkey,
         coalesce(nullif(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END, ''),
                  nullif(CASE WHEN c_custkey % 20 = 10 THEN 'm' || CAST(c_custkey AS VARCHAR)
                              WHEN c_custkey % 20 = 0 THEN '' END, ''),
                  nullif(CASE WHEN c_custkey % 40 = 0 THEN 'b' || CAST(c_custkey AS VARCHAR) ELSE '' END, '')) AS zpid
  FROM customer),
names AS (
  SELECT 'nullzpid_' || CAST(n_nationkey AS VARCHAR) || '.json' AS f FROM nation WHERE n_regionkey >= 3
  UNION ALL SELECT 'nullzpid_x.json' UNION ALL SELECT n_name || '.json' FROM nation),
nx AS (SELECT coalesce(max(CAST(regexp_extract(f, '^nullzpid_([0-9]+)', 1) AS BIGINT)) + 1, 1) AS n
       FROM names WHERE regexp_matches(f, '^nullzpid_[0-9]+(_.*)?[.]json$'))
SELECT c_custkey, zpid,
       CASE WHEN zpid IS NOT NULL THEN zpid
            ELSE 'nullzpid_' || CAST((SELECT n FROM nx) + row_number() OVER (PARTITION BY zpid IS NULL
                                     ORDER BY c_custkey) - 1 AS VARCHAR) END AS file_stem
FROM b""")
def q_null_id_assign(spark, sf_dir):
    """Id fallback chain; houses without id get nullzpid_<next>."""
    k = F.col("c_custkey")
    given = F.when(k % 10 == 0, F.lit(None)).otherwise(k.cast("string"))
    meta = F.when(k % 20 == 10, F.concat(F.lit("m"), k.cast("string"))).when(k % 20 == 0, F.lit(""))
    basic = F.when(k % 40 == 0, F.concat(F.lit("b"), k.cast("string"))).otherwise(F.lit(""))
    batch = table(spark, sf_dir, "customer").select("c_custkey", first_id(given, meta, basic).alias("zpid"))
    nation = table(spark, sf_dir, "nation")
    names = (nation.filter(F.col("n_regionkey") >= 3)
             .select(F.concat(F.lit("nullzpid_"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("file_name"))
             .unionByName(nation.select(F.concat(F.col("n_name"), F.lit(".json")).alias("file_name")))
             .unionByName(spark.range(1).select(F.lit("nullzpid_x.json").alias("file_name"))))
    return assign_null_ids(batch, "zpid", ["c_custkey"], names).select("c_custkey", "zpid", "file_stem")
