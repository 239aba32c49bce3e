"""Tile store, quarantine, ledgers, ranks, bound sets and run reports against plain Python."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.operators.grid import pick_links
from parcelgrid.operators.indexing import dense_index, positional_folds, ranked
from parcelgrid.operators.inventory import distinct_file_names, file_listing, sorted_listing, year_combos
from parcelgrid.operators.report import head, house_report, house_statuses, tile_progress
from parcelgrid.operators.reshape import listing_filter, listing_filter_sets
from parcelgrid.operators.paging import tile_payloads
from parcelgrid.sinks.writers import append_ledger, save_tiles, write_named_files, write_tile_store
from parcelgrid.sources.ledgers import corrupt_files, read_ledger
from parcelgrid.sources.tiles import parsed_documents, split_documents


def test_store_replaces_its_own_keys_only(spark, scratch):
    path, rng, want = f"{scratch}/store", random.Random(2), {}
    for run in range(4):
        batch = {f"t{rng.randrange(300)}": f"run {run}" for _ in range(rng.choice([1, 60, 250]))}
        rows = spark.createDataFrame([(k, v, len(k)) for k, v in batch.items()], "tile_key string, text string, n int")
        write_tile_store(rows, path, buckets=8)
        want |= batch
        assert {r.tile_key: r.text for r in spark.read.parquet(path).collect()} == want
        assert spark.read.parquet(path).count() == len(want)
    assert 1 < len([d for d in os.listdir(path) if d.startswith("bucket=")]) <= 8
    assert len(glob.glob(f"{path}/*/*.parquet")) < 40  # many documents a file


def test_store_touches_only_the_buckets_of_its_keys(spark, scratch):
    path = f"{scratch}/store"
    rows = spark.range(200).select(F.concat(F.lit("t"), "id").alias("tile_key"), F.lit("old").alias("text"))
    write_tile_store(rows, path, buckets=16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    write_tile_store(spark.createDataFrame([("t7", "new")], "tile_key string, text string"), path, buckets=16)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    changed = {os.path.dirname(f) for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert len(changed) == 1 and len(after) > 8
    with pytest.raises(Exception, match="without a key"):
        write_tile_store(spark.createDataFrame([(None, "x")], "tile_key string, text string"), path)
    assert spark.read.parquet(path).count() == 200


def test_split_documents_gives_every_document_one_verdict(spark, scratch):
    docs = [("a", '{"listResults": [1]}'), ("b", None), ("c", " \n"), ("d", "{broken"), ("e", "[1]"), ("f", "null"),
            ("g", "  {}"), ("h", "5"), ("i", '"{}"'), ("j", '{"a": 1, "a": 2}')]
    parsed = parsed_documents(spark.createDataFrame(docs, "tile_file string, text string"))
    accepted, rejected = split_documents(parsed, f"{scratch}/split")
    assert sorted((r.tile_file, r.j) for r in accepted.select("tile_file", F.to_json("doc").alias("j")).collect()) == [
        ("a", '{"listResults":[1]}'), ("g", "{}"), ("j", '{"a":2}')]
    reasons = {r.tile_file: (r.reason, r.rejected_text) for r in rejected.collect()}
    text = dict(docs)
    assert reasons == {"b": ("empty document", None), "c": ("empty document", " \n"),
                       **{k: ("unparsable JSON", text[k]) for k in "d"}, **{k: ("not an object", text[k]) for k in "efhi"}}
    empty = split_documents(parsed.limit(0), f"{scratch}/none")
    assert empty[0].count() == empty[1].count() == 0


def test_corrupt_ledger_files_are_counted_and_empty_ones_are_not(spark, scratch):
    path, schema = f"{scratch}/my ledger+1", "idx long, run_id string"
    assert read_ledger(spark, path, schema).count() == 0
    append_ledger(spark.createDataFrame([(1,), (2,)], "idx long"), path, "r1")
    append_ledger(spark.createDataFrame([], "idx long"), path, "r2")  # a valid file without rows
    assert corrupt_files(spark, path, schema).count() == 0
    for name in ("part-bad.parquet", "part-half.parquet"):
        with open(f"{path}/{name}", "wb") as fh:
            fh.write(b"PAR1 and no end")
    with pytest.warns(UserWarning, match="2 corrupt files"):
        ledger = read_ledger(spark, path, schema, ["idx"])
    assert sorted(r.idx for r in ledger.collect()) == [1, 2]
    with pytest.raises(Exception):
        read_ledger(spark, path, schema, skip_corrupt=False).count()


def test_ranks_and_totals_are_those_of_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), k) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = sorted((r["rank"], r.a, r.b, r.total) for r in ranked(df, [F.desc("a"), "b"]).collect())
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == [(k + 1, a, b, 500) for k, (a, b) in enumerate(want)]
    assert ranked(df.limit(0), ["a"]).count() == 0 and dense_index(df, ["b"]).columns == ["a", "b", "row_index"]
    folds = positional_folds(df.select("b"), ["b"], 7).orderBy("b").collect()
    assert [r.fold for r in folds] == [f + 1 for f in range(7) for _ in range(72 if f < 3 else 71)]


def test_listings_say_how_many_follow(spark):
    files = spark.createDataFrame([("z1", "b.png", 2048), ("z2", "b.png", 100), ("z1", "a.png", 1), ("z3", "d.png", 51)],
                                  "folder string, file_name string, size long")
    got = [(r["rank"], r.file_name, r.folder, r.size_kb, r.total, r.n_more)
           for r in sorted_listing(files, n=3, ties=["folder"]).orderBy("rank").collect()]
    assert got == [(1, "a.png", "z1", 0.0, 4, 1), (2, "b.png", "z1", 2.0, 4, 1), (3, "b.png", "z2", 0.1, 4, 1),
                   (4, "d.png", "z3", 0.0, 4, 1)]
    assert [r["rank"] for r in file_listing(files, n=2, ties=["folder"]).orderBy("rank").collect()] == [1, 2]
    assert file_listing(files, n=9, ties=["folder"]).first().n_more == 0
    assert [(r.file_name, r["rank"], r.total) for r in distinct_file_names(files).orderBy("rank").collect()] == [
        ("a.png", 1, 3), ("b.png", 2, 3), ("d.png", 3, 3)]


def test_most_common_year_sets_come_first(spark):
    sets = {"A": [2012, 2013], "B": [2013, 2012], "C": [2012], "D": [2011], "E": [], "F": [2012]}
    files = spark.createDataFrame([(z, f"{y}.png") for z, ys in sets.items() for y in ys] + [("E", "99999999999999999999.png")],
                                  "folder string, file_name string")
    got = [(r["rank"], r.years, r.n_folders, r.total) for r in year_combos(files).orderBy("rank").collect()]
    assert got == [(1, "2012", 2, 3), (2, "2012,2013", 2, 3), (3, "2011", 1, 3)]


def test_bound_sets_equal_one_filter_each(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, *range(20)]), rng.choice([None, rng.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, size int, price double")
    cols = {"size": "size", "price": "price"}
    sets = [(1, {"min_size": 5}), (2, {}), (3, {"min_size": 3, "max_size": 3, "max_price": 0.5}), (9, {"min_price": 2.0}),
            (4, {"max_price": 0.9, "min_price": None})]
    want = sorted((i, r.id) for i, b in sets for r in listing_filter(df, b, cols).collect())
    assert sorted((r.set_id, r.id) for r in listing_filter_sets(df, sets, cols).collect()) == want
    assert listing_filter_sets(df, [], cols).count() == 0


def test_links_are_looked_up_by_request(spark):
    links = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "idx long, link string")
    wanted = spark.createDataFrame([(3,), (3,), (8,), (77,), (None,)], "idx long")
    assert sorted(tuple(r) for r in pick_links(links, wanted).collect()) == [(3, "l3"), (3, "l3"), (8, "l8")]


def test_progress_by_hand(spark):
    plan = spark.createDataFrame([("r1", i, "" if i == 4 else f"l{i}") for i in range(8)] + [("r2", 1, "l1")],
                                 "run_id string, idx long, link string")
    visited = spark.createDataFrame([(0,), (0,), (4,)], "idx long")
    visits = spark.createDataFrame([("r1", 1, True, 10, 3), ("r1", 1, False, 5, 0), ("r1", 2, True, 15, 2),
                                    ("r1", 0, True, 99, 9), ("r1", 50, True, 99, 9)],
                                   "run_id string, tile long, success boolean, seconds int, house_count int")
    got = {r.run_id: r.asDict() for r in tile_progress(plan, visited, visits).collect()}
    assert got["r1"] == {"run_id": "r1", "planned": 8, "skipped": 2, "no_link": 0, "processed": 2, "pages_ok": 2,
                         "pages_failed": 1, "houses": 5, "success_pct": 66.67, "elapsed_seconds": 30, "seconds_per_tile": 15.0,
                         "remaining": 4, "eta_seconds": 60.0}
    assert got["r2"]["processed"] == 0 and got["r2"]["eta_seconds"] is None and got["r2"]["remaining"] == 1


def test_house_statuses_and_eta_by_hand(spark):
    batch = spark.createDataFrame([(1, "a", "u", 4), (2, "b", "", 1), (3, "c", None, 1), (4, "a", "u", 2), (5, "d", "u", 3),
                                   (6, "e", "u", 9), (7, None, "u", 6)], "k int, zpid string, url string, seconds int")
    existing = spark.createDataFrame([("d",)], "zpid string")
    got = house_statuses(batch.withColumn("run_id", F.lit("r")), existing, "zpid", "k", "url", F.col("k") != 6)
    assert {r.k: r.status for r in got.collect()} == {1: "saved", 2: "skipped", 3: "skipped", 4: "failed", 5: "failed",
                                                      6: None, 7: "saved"}
    row = house_report(got).first()
    assert (row.processed, row.saved, row.failed, row.skipped, row.remaining) == (2, 2, 2, 2, 1)
    assert row.eta_seconds == round(17 / 2, 2) and row.mean_seconds == round(17 / 6, 4)
    assert [r.k for r in head(batch, ["seconds", "k"], 3).collect()] == [2, 3, 4]


def test_named_files_land_where_their_rows_say(spark, scratch):
    rows = spark.createDataFrame([("z1/a.json", json.dumps({"é": 1})), ("z2/deep/b.txt", ""), ("c", "x" * 100_000)],
                                 "path string, content string").repartition(3)
    for _ in range(2):  # a repeated task writes the same files
        write_named_files(rows, f"{scratch}/tree")
    found = {os.path.relpath(f, f"{scratch}/tree"): open(f).read() for f in glob.glob(f"{scratch}/tree/**", recursive=True)
             if os.path.isfile(f)}
    assert found == {r.path: r.content for r in rows.collect()}


def test_payloads_keep_the_order_of_pages(spark):
    items = spark.createDataFrame([(1, "listResults", "b", 2, 0), (1, "listResults", "a", 1, 7), (1, "listResults", "c", 2, 1),
                                   (1, "mapResults", "m", 1, 0), (1, "relaxedResults", None, 1, 0), (2, "mapResults", "z", 3, 3)],
                                  "tile long, result_type string, item_id string, page long, pos long")
    got = {r.tile: json.loads(r.payload) for r in tile_payloads(items).collect()}
    assert got == {1: {"relaxedResults": [], "listResults": ["a", "b", "c"], "mapResults": ["m"]},
                   2: {"relaxedResults": [], "listResults": [], "mapResults": ["z"]}}


def test_saved_tiles_and_their_ledger_agree_after_a_second_run(spark, scratch):
    store, ledger = f"{scratch}/store", f"{scratch}/ledger"
    rows = [(1, "saved", True, "{1}"), (2, "not saved", False, "{2}"), (3, "failed", False, None), (4, "empty", True, None)]
    schema = "tile long, outcome string, visited boolean, payload string"
    for _ in range(2):  # the same run again changes nothing
        save_tiles(spark.createDataFrame(rows, schema), store, ledger, "run-1")
    again = [(3, "saved", True, "{3}"), (2, "saved", True, "{2b}")]
    save_tiles(spark.createDataFrame(again, schema), store, ledger, "run-2")
    stored = {r.tile: (r.outcome, r.payload, r.run_id) for r in spark.read.parquet(store).collect()}
    assert stored == {1: ("saved", "{1}", "run-1"), 2: ("saved", "{2b}", "run-2"), 3: ("saved", "{3}", "run-2"),
                      4: ("empty", None, "run-1")}
    assert sorted(r.tile for r in read_ledger(spark, ledger, "tile long, run_id string", ["tile"]).collect()) == [1, 2, 3, 4]
