"""Bindings: listing numbers, photo inventories, run reports, profile."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelgrid.operators.grid import pick_links
from parcelgrid.operators.inventory import (distinct_listing_numbers, folder_count, folder_inventory, quarantine,
                                            sorted_listing, year_combos)
from parcelgrid.operators.ledger import LEDGER_FILE, next_null_number, sync_house_ledger
from parcelgrid.operators.model import features_and_target
from parcelgrid.operators.report import house_report, house_statuses, profile, run_report, tile_progress
from parcelgrid.plans.registry import query
from parcelgrid.plans.standins import scratch_folder
from parcelgrid.session import table
from parcelgrid.sinks.writers import write_links, write_named_files
from parcelgrid.sources.files import file_inventory, list_files, offset_csv_column, read_csv_table


@query("q_distinct_listing_no", """
WITH v AS (
  SELECT CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '  ' || source || ' ' WHEN 2 THEN '' WHEN 3 THEN NULL
              ELSE CAST(n_chars % 97 AS VARCHAR) || '.0' END AS raw FROM documents)
SELECT DISTINCT regexp_replace(trim(raw), '^(-?[0-9]+)[.]0$', '\\1') AS listing_no FROM v
WHERE raw IS NOT NULL AND trim(raw) <> ''""")
def q_distinct_listing_no(spark, sf_dir):
    """Distinct trimmed listing numbers, blanks dropped, 12.0 = 12."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    raw = (F.when(k == 0, F.col("source")).when(k == 1, F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
            .when(k == 2, F.lit("")).when(k == 3, F.lit(None))
            .otherwise(F.concat((F.col("n_chars") % 97).cast("string"), F.lit(".0"))))
    return distinct_listing_numbers(d.select(raw.alias("raw")), "raw")


def _photo_files(spark, sf_dir):
    """Photo tree stand-in: folder = 20800 + user, file = <2000 + day>.png,
    with stray ``test_year.txt`` and ``x.png`` files; size from value."""
    e = table(spark, sf_dir, "events")
    name = (F.when((F.col("event_type") == "error") & (F.col("value") < 5), F.lit("test_year.txt"))
             .when((F.col("event_type") == "signup") & (F.col("value") > 45), F.lit("x.png"))
             .otherwise(F.concat((2000 + F.dayofmonth("ts")).cast("string"), F.lit(".png"))))
    return e.select((20800 + F.col("user_id")).cast("string").alias("folder"), name.alias("file_name"),
                    (F.col("value") * 100).cast("long").alias("size"))


_FILES_SQL = """
f0 AS (
  SELECT CAST(20800 + user_id AS VARCHAR) AS folder,
         CASE WHEN event_type = 'error' AND value < 5 THEN 'test_year.txt'
              WHEN event_type = 'signup' AND value > 45 THEN 'x.png'
              ELSE CAST(2000 + day(ts) AS VARCHAR) || '.png' END AS file_name,
         CAST(trunc(value * 100) AS BIGINT) AS size
  FROM events
), f AS (SELECT * FROM f0 WHERE NOT (folder = '20851' AND file_name = 'test_year.txt'))"""


@query("q_file_inventory", "WITH " + _FILES_SQL + """,
d AS (SELECT folder, file_name, max(size) AS size FROM f GROUP BY folder, file_name)
SELECT folder, count(*) AS n_files, count(*) FILTER (WHERE ends_with(file_name, '.png')) AS n_png,
       count(*) FILTER (WHERE regexp_matches(file_name, '^[0-9]+[.]png$')) AS n_years,
       CAST(sum(size) AS BIGINT) AS total_bytes
FROM d GROUP BY folder""")
def q_file_inventory(spark, sf_dir):
    """Per-folder inventory after quarantining the stray file."""
    kept, _rejected = quarantine(_photo_files(spark, sf_dir))
    return folder_inventory(kept)


@query("q_year_combos", "WITH " + _FILES_SQL + r""",
y AS (SELECT DISTINCT folder, CAST(regexp_extract(file_name, '^([0-9]+)[.]png$', 1) AS INT) AS year
      FROM f WHERE regexp_matches(file_name, '^[0-9]+[.]png$')),
c AS (SELECT folder, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM y GROUP BY folder),
n AS (SELECT years, count(*) AS n_folders FROM c GROUP BY years)
SELECT years, n_folders, row_number() OVER (ORDER BY n_folders DESC, years) AS rank, count(*) OVER () AS total FROM n""")
def q_year_combos(spark, sf_dir):
    """Folders per set of photo years, ranked most common first."""
    kept, _ = quarantine(_photo_files(spark, sf_dir))
    return year_combos(kept)


@query("q_listing_files", """
WITH v AS (SELECT DISTINCT c_nationkey AS f, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_custkey % 50 END AS no FROM customer
           WHERE c_nationkey % 5 <> 4),
b AS (SELECT f, bool_or(no IS NULL) AS blanks FROM v GROUP BY f)
SELECT DISTINCT CAST(no AS VARCHAR) || CASE WHEN f % 5 = 2 THEN 'a' WHEN blanks THEN '.0' ELSE '' END AS listing_no
FROM v JOIN b USING (f) WHERE no IS NOT NULL""")
def q_listing_files(spark, sf_dir):
    """S5/J8/A5 on written CSV files, one per nation: header, two lines that are no data
    (one with a line end inside quotes), then the listings; some files have no such
    column, some have texts, blanks make a column of numbers floats."""
    c = table(spark, sf_dir, "customer")
    kind, key = F.col("c_nationkey") % 5, F.col("c_custkey")
    number = F.when(key % 10 == 3, F.lit("")).otherwise(
        F.concat((key % 50).cast("string"), F.when(kind == 2, F.lit("a")).otherwise(F.lit(""))))
    line = F.concat(F.lit('"'), F.col("c_name"), F.when(kind == 1, F.lit('\nand ""co""')).otherwise(F.lit("")),
                    F.lit('",'), number, F.lit(",z"))
    head = F.concat(F.lit("Owner,"), F.when(kind == 4, F.lit("Other")).otherwise(F.lit("MLS#")), F.lit(",Last"))
    files = (c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct(key, line.alias("l"))))["l"], "\n")
                                          .alias("body"))
             .select(F.concat(F.lit("listings_"), F.col("c_nationkey").cast("string"),
                              F.when(kind % 2 == 0, F.lit(".csv")).otherwise(F.lit(".CSV"))).alias("path"),
                     F.concat(head, F.lit('\n"no\ndata",1,2\nnone,7777,\n'), F.col("body"), F.lit("\n")).alias("content")))
    folder = scratch_folder(spark, sf_dir, "listings")
    write_named_files(files, folder)
    return distinct_listing_numbers(offset_csv_column(spark, folder, "MLS#"), "value", normalize=False)


@query("q_file_listing", "WITH " + _FILES_SQL + """,
d AS (SELECT folder, file_name, max(size) AS size FROM f GROUP BY folder, file_name)
SELECT file_name, folder, round(size / 1024, 1) AS size_kb, row_number() OVER (ORDER BY file_name, folder) AS rank,
       count(*) OVER () AS total, greatest(count(*) OVER () - 5, 0) AS n_more
FROM d""")
def q_file_listing(spark, sf_dir):
    """Every file by name with its rank, the total, and how many follow the first five."""
    kept, _ = quarantine(_photo_files(spark, sf_dir))
    files = kept.groupBy("folder", "file_name").agg(F.max("size").alias("size"))
    return sorted_listing(files, ties=["folder"])


TREE_FOLDERS, TREE_BYTES = 60, 4096


@query("q_photo_tree", f"""
WITH f AS (
  SELECT CAST(20800 + user_id % {TREE_FOLDERS} AS VARCHAR) AS folder,
         CASE WHEN event_type = 'error' AND value < 5 THEN 'test_year.txt'
              WHEN event_type = 'signup' AND value > 45 THEN 'x.png'
              ELSE CAST(2000 + day(ts) AS VARCHAR) || '.png' END AS file_name,
         CAST(trunc(value * 100) AS BIGINT) % {TREE_BYTES} AS size FROM events),
d AS (SELECT folder, file_name, max(size) AS size FROM f
      WHERE NOT (folder = '20851' AND file_name = 'test_year.txt') GROUP BY folder, file_name)
SELECT folder, count(*) AS n_files, count(*) FILTER (WHERE ends_with(file_name, '.png')) AS n_png,
       count(*) FILTER (WHERE regexp_matches(file_name, '^[0-9]+[.]png$')) AS n_years,
       CAST(sum(size) AS BIGINT) AS total_bytes, (SELECT count(DISTINCT folder) FROM d) AS n_folders
FROM d GROUP BY folder""")
def q_photo_tree(spark, sf_dir):
    """S6/J9/A6/K8 on a written tree: the photo files are stored as ``<folder>/<file>``,
    listed by metadata only, the stray file is quarantined, and folders are counted.
    A file in the root and one too deep are no part of the folder listing."""
    folder = (F.col("folder").cast("long") - 20800) % TREE_FOLDERS + 20800
    files = (_photo_files(spark, sf_dir).groupBy(folder.cast("string").alias("folder"), "file_name")
             .agg(F.max(F.col("size") % TREE_BYTES).cast("int").alias("size")))
    rows = files.select(F.concat_ws("/", "folder", "file_name").alias("path"),
                        F.repeat(F.lit("p"), F.col("size")).alias("content"))
    odd = spark.range(1).select(F.explode(F.array(F.lit("readme.txt"), F.lit("20800/old/1999.png"))).alias("path"),
                                F.lit("not part of it").alias("content"))
    root = scratch_folder(spark, sf_dir, "photos")
    write_named_files(rows.unionByName(odd), root)
    kept, _rejected = quarantine(file_inventory(spark, root))
    return folder_inventory(kept).withColumn("n_folders", folder_count(kept))


@query("q_run_eta", """
WITH p AS (SELECT c_nationkey AS run_id, c_custkey AS idx, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS link
           FROM customer),
k AS (SELECT DISTINCT o_custkey AS idx FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0),
l AS (SELECT o_custkey AS idx, o_orderpriority NOT LIKE '1%' AS ok, CAST(floor(o_totalprice) AS BIGINT) % 60 AS seconds,
             o_orderkey % 4 AS houses FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 = 0),
s AS (SELECT p.run_id, p.idx, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed,
             sum(houses) AS houses, sum(seconds) AS secs FROM l JOIN p USING (idx) GROUP BY ALL),
t AS (SELECT p.run_id, k.idx IS NOT NULL AS skipped, p.link <> '' AS linked, s.* EXCLUDE (run_id, idx),
             k.idx IS NULL AND p.link <> '' AND s.idx IS NOT NULL AS did
      FROM p LEFT JOIN k USING (idx) LEFT JOIN s ON s.run_id = p.run_id AND s.idx = p.idx),
a AS (SELECT run_id, count(*) AS planned, count(*) FILTER (WHERE skipped) AS skipped,
             count(*) FILTER (WHERE NOT skipped AND NOT linked) AS no_link, count(*) FILTER (WHERE did) AS processed,
             coalesce(sum(ok) FILTER (WHERE did), 0) AS pages_ok, coalesce(sum(failed) FILTER (WHERE did), 0) AS pages_failed,
             coalesce(sum(houses) FILTER (WHERE did), 0) AS houses, coalesce(sum(secs) FILTER (WHERE did), 0) AS secs
      FROM t GROUP BY run_id),
r AS (SELECT *, planned - skipped - no_link - processed AS remaining, secs / nullif(processed, 0) AS per FROM a)
SELECT CAST(run_id AS BIGINT) AS run_id, planned, skipped, no_link, processed, CAST(pages_ok AS BIGINT) AS pages_ok,
       CAST(pages_failed AS BIGINT) AS pages_failed, CAST(houses AS BIGINT) AS houses,
       round(pages_ok * 100.0::DOUBLE / nullif(pages_ok + pages_failed, 0), 2) AS success_pct,
       CAST(secs AS BIGINT) AS elapsed_seconds, round(per, 4) AS seconds_per_tile, remaining,
       round(per * remaining, 2) AS eta_seconds FROM r""")
def q_run_eta(spark, sf_dir):
    """The plan of each run (nation) joined with the ledger and the page log:
    planned, skipped, processed, elapsed, and the time the remaining tiles take."""
    plan = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("run_id"), F.col("c_custkey").alias("idx"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(F.col("c_name")).alias("link"))
    orders = table(spark, sf_dir, "orders")
    known = orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)).select(
        F.col("o_custkey").alias("idx"))
    log = orders.filter((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 5 == 0)).select(
        F.col("o_custkey").alias("idx"), (~F.col("o_orderpriority").startswith("1")).alias("success"),
        (F.floor("o_totalprice") % 60).alias("seconds"), (F.col("o_orderkey") % 4).alias("house_count"))
    visits = log.join(plan.select("idx", "run_id"), "idx")
    return tile_progress(plan, known, visits.withColumnRenamed("idx", "tile"))


@query("q_link_lookup", """
SELECT c_custkey AS idx, c_name AS link, c_mktsegment AS segment
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""")
def q_link_lookup(spark, sf_dir):
    """The link row of every wanted index, one row per request, by an equi-join."""
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("link"),
                                                    F.col("c_mktsegment").alias("segment"))
    wanted = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("idx"))
    return pick_links(links, wanted)


@query("q_house_folder", """
WITH n AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'nullzpid_' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'x' || CAST(s_suppkey AS VARCHAR)
                  ELSE CAST(s_suppkey AS VARCHAR) END AS stem, s_suppkey % 7 = 0 AS is_text FROM supplier)
SELECT stem AS zpid, (SELECT max(s_suppkey) + 1 FROM n WHERE s_suppkey % 5 = 0 AND NOT is_text) AS next_number
FROM n WHERE s_suppkey % 5 > 1 AND NOT is_text
UNION SELECT CAST(n_nationkey + 100000 AS VARCHAR), (SELECT max(s_suppkey) + 1 FROM n WHERE s_suppkey % 5 = 0 AND NOT is_text) FROM nation""")
def q_house_folder(spark, sf_dir):
    """S3/J6/U13/A8 on written files: house documents named by supplier are listed by
    metadata; their all-digit stems join the ledger, and the next null number follows."""
    k = F.col("s_suppkey")
    stem = (F.when(k % 5 == 0, F.concat(F.lit("nullzpid_"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("x"), k.cast("string")))
            .otherwise(k.cast("string")))
    name = F.concat(stem, F.when(k % 7 == 0, F.lit(".txt")).otherwise(F.lit(".json")))
    files = table(spark, sf_dir, "supplier").select(name.alias("path"), F.lit("{}").alias("content"))
    files = files.unionByName(spark.range(1).select(F.lit(LEDGER_FILE).alias("path"), F.lit("[]").alias("content")))
    folder = scratch_folder(spark, sf_dir, "houses")
    write_named_files(files, folder)
    names = list_files(spark, folder)
    ledger = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100_000).cast("string").alias("zpid"))
    return sync_house_ledger(ledger, names).withColumn("next_number", next_null_number(names))


@query("q_csv_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_csv_table(spark, sf_dir):
    """A CSV table with a header, written and read back by schema."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    folder = scratch_folder(spark, sf_dir, "csv")
    suppliers.write.mode("overwrite").option("header", "true").csv(folder)
    return read_csv_table(spark, folder, suppliers.schema)


@query("q_written_links", """
SELECT c_custkey AS idx, c_name AS link, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer""")
def q_written_links(spark, sf_dir):
    """The link plan is written in index order; ``place`` is a row's position in
    the files as they lie, file by file."""
    folder = scratch_folder(spark, sf_dir, "links")
    write_links(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("link")), folder)
    rows = spark.read.parquet(folder).select("idx", "link", F.col("_metadata.file_name").alias("file"),
                                             F.col("_metadata.row_index").alias("at"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(files, "file").select("idx", "link", (F.col("before") + F.col("at")).alias("place"))


@query("q_features", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders""")
def q_features(spark, sf_dir):
    """The feature table, without the target and the text column."""
    return features_and_target(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])


@query("q_run_report", """
WITH v AS (
  SELECT day(ts) AS run_id, user_id AS tile, event_type <> 'error' AS success, value AS seconds,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS house_count FROM events),
a AS (SELECT run_id, count(DISTINCT tile) AS tiles, count(*) AS pages, count(*) FILTER (WHERE success) AS pages_ok,
             count(*) FILTER (WHERE NOT success) AS pages_failed, CAST(sum(house_count) AS BIGINT) AS houses,
             sum(seconds) AS secs FROM v GROUP BY run_id)
SELECT CAST(run_id AS BIGINT) AS run_id, tiles, pages, pages_ok, pages_failed, houses,
       round(pages_ok * 100.0 / pages, 2) AS success_pct, round(secs, 2) AS total_seconds,
       round(secs / tiles, 4) AS seconds_per_tile, round(tiles * 3600.0 / secs, 4) AS tiles_per_hour
FROM a""")
def q_run_report(spark, sf_dir):
    """Per-run crawl report (events as the visit log: run = day)."""
    e = table(spark, sf_dir, "events")
    visits = e.select(F.dayofmonth("ts").cast("long").alias("run_id"), F.col("user_id").alias("tile"),
                      (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"),
                      F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("house_count"))
    return run_report(visits)


@query("q_house_report", """
WITH b AS (SELECT o_orderkey, o_orderpriority, o_totalprice,
                  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS zpid,
                  o_orderkey % 8 <> 3 AS reached, o_orderkey % 10 <> 7 AS has_url FROM orders),
     e AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS zpid FROM customer WHERE c_acctbal > 5000),
     f AS (SELECT zpid, min(o_orderkey) AS first_key FROM b WHERE zpid IS NOT NULL AND reached AND has_url GROUP BY zpid),
     s AS (SELECT b.o_orderpriority AS run_id, CAST(floor(b.o_totalprice) AS BIGINT) % 60 AS seconds,
                  CASE WHEN NOT reached THEN NULL WHEN NOT has_url THEN 'skipped' WHEN b.zpid IS NULL THEN 'saved' WHEN e.zpid IS NOT NULL THEN 'failed'
                       WHEN b.o_orderkey = f.first_key THEN 'saved' ELSE 'failed' END AS status
           FROM b LEFT JOIN e ON b.zpid = e.zpid LEFT JOIN f ON b.zpid = f.zpid)
SELECT run_id, count(*) FILTER (WHERE status = 'saved') AS processed, count(*) FILTER (WHERE status = 'saved') AS saved,
       count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
       round(avg(seconds) FILTER (WHERE status IS NOT NULL), 4) AS mean_seconds,
       count(*) FILTER (WHERE status IS NULL) AS remaining,
       round(sum(seconds) FILTER (WHERE status IS NOT NULL) / nullif(count(*) FILTER (WHERE status = 'saved'), 0)
             * count(*) FILTER (WHERE status IS NULL), 2) AS eta_seconds
FROM s GROUP BY run_id""")
def q_house_report(spark, sf_dir):
    """A10: per-run house report (run = priority): houses without a URL are skipped, the
    others saved or failed by insert-if-absent, and some are still to come."""
    o = table(spark, sf_dir, "orders")
    batch = o.select("o_orderkey", F.col("o_orderpriority").alias("run_id"),
                     (F.floor("o_totalprice") % 60).alias("seconds"),
                     F.when(F.col("o_orderkey") % 10 == 7, F.lit("")).otherwise(F.lit("https://h.example/x")).alias("url"),
                     F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string"))
                     .alias("zpid"))
    existing = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 5000) \
        .select(F.col("c_custkey").cast("string").alias("zpid"))
    return house_report(house_statuses(batch, existing, "zpid", "o_orderkey", "url", F.col("o_orderkey") % 8 != 3))


_LINEITEM_COLS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                  "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                  "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("q_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({k} AS BIGINT) AS position, '{t}' AS data_type, count(*) AS n_rows, "
    f"CAST({len(_LINEITEM_COLS)} AS BIGINT) AS n_columns, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM lineitem"
    for k, (c, t) in enumerate(_LINEITEM_COLS.items(), 1)))
def q_profile(spark, sf_dir):
    """Shape, types and null count per column, one pass."""
    return profile(table(spark, sf_dir, "lineitem"))
