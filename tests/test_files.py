"""File sources: offset-header CSV folders, inventories, ledgers, sinks, stream."""

import os

import pytest
from pyspark.sql import functions as F

from parcelgrid.operators.inventory import distinct_listing_numbers, quarantine
from parcelgrid.sinks.writers import append_ledger, write_tile_results
from parcelgrid.sources.files import file_inventory, offset_csv_column, read_csv_table
from parcelgrid.sources.ledgers import read_ledger


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_listing_numbers_parity_and_normalised(spark, scratch):
    _write(f"{scratch}/a.CSV", 'Addr,MLS#\nx,y\nz,w\n1," 11 "\n2,\n3,12\n')
    _write(f"{scratch}/b.csv", "Addr,MLS#\nx,y\nz,w\n1,11\n2,13\n")
    _write(f"{scratch}/c.csv", "")
    _write(f"{scratch}/d.csv", "Addr,Other\nx,y\nz,w\n1,5\n")
    _write(f"{scratch}/e.txt", "MLS#\n\n\n99\n")
    vals = offset_csv_column(spark, scratch, "MLS#")
    parity = {r.listing_no for r in distinct_listing_numbers(vals, "value", normalize=False).collect()}
    norm = {r.listing_no for r in distinct_listing_numbers(vals, "value", normalize=True).collect()}
    assert parity == {"11.0", "12.0", "11", "13"}
    assert norm == {"11", "12", "13"}


def test_file_inventory_and_quarantine(spark, scratch):
    for z, names in {"20851": ["2012.png", "test_year.txt"], "20852": ["2013.png"]}.items():
        for n in names:
            _write(f"{scratch}/DMV/{z}/{n}", "x" * 10)
    _write(f"{scratch}/DMV/readme.txt", "root-level file, not a folder")
    _write(f"{scratch}/DMV/20852/deeper/2014.png", "nested too deep")
    inv = file_inventory(spark, f"{scratch}/DMV")
    assert "content" not in inv.columns
    kept, rejected = quarantine(inv)
    assert sorted((r.folder, r.file_name) for r in kept.collect()) == [("20851", "2012.png"), ("20852", "2013.png")]
    assert [(r.folder, r.file_name) for r in rejected.collect()] == [("20851", "test_year.txt")]
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_csv_table(spark, scratch):
    _write(f"{scratch}/h.csv", "a,b\n1,x\n2,y\n")
    df = read_csv_table(spark, f"{scratch}/h.csv")
    assert df.count() == 2 and dict(df.dtypes)["a"] == "int"


def test_ledger_append_is_set(spark, scratch):
    path = f"{scratch}/visited"
    assert read_ledger(spark, path, "idx long").count() == 0
    rows = spark.createDataFrame([(1,), (2,), (2,)], "idx long")
    append_ledger(rows, path, "r1")
    once = read_ledger(spark, path, "idx long, run_id string", keys=["idx"]).count()
    append_ledger(rows, path, "r2")
    twice = read_ledger(spark, path, "idx long, run_id string", keys=["idx"]).count()
    assert once == twice == 2


def test_tile_sink_overwrites_only_its_key(spark, scratch):
    path = f"{scratch}/tiles"
    first = spark.createDataFrame([("t1", 1), ("t2", 0)], "tile_key string, house_count int")
    write_tile_results(first, path)
    write_tile_results(spark.createDataFrame([("t1", 5)], "tile_key string, house_count int"), path)
    got = sorted((r.tile_key, r.house_count) for r in spark.read.parquet(path).collect())
    assert got == [("t1", 5), ("t2", 0)]


def test_stream_master_list_matches_batch(spark, scratch):
    import json

    from parcelgrid.operators.dedupe import explode_results, master_list
    from parcelgrid.sources.tiles import parse_documents, read_text_documents
    from parcelgrid.streaming.landing import start_master_list_stream

    land = f"{scratch}/landing"
    docs = {"tile_1.json": {"listResults": [{"zpid": 1, "detailUrl": "/a"}, {"zpid": 2, "detailUrl": "/b"}]},
            "tile_2.json": {"mapResults": [{"zpid": 2, "detailUrl": "/b2"}, {"zpid": 3, "detailUrl": "/c"}]},
            "tile_3.json": "{broken"}
    for name, d in docs.items():
        _write(f"{land}/{name}", d if isinstance(d, str) else json.dumps(d))
    q = start_master_list_stream(spark, land, f"{scratch}/master", f"{scratch}/ckpt", available_now=True)
    q.awaitTermination(120)
    streamed = {(r.zpid, r.detailUrl) for r in spark.read.parquet(f"{scratch}/master").collect()}
    parsed, _ = parse_documents(read_text_documents(spark, f"{land}/tile_*.json", "tile_file").drop("path"))
    batch = {(r.zpid, r.detailUrl) for r in master_list(explode_results(parsed, "doc", ["tile_file"])).collect()}
    assert streamed == batch == {("1", "https://www.zillow.com/a"), ("2", "https://www.zillow.com/b"),
                                 ("3", "https://www.zillow.com/c")}
    # a later file never replaces an id already stored
    _write(f"{land}/tile_0.json", json.dumps({"listResults": [{"zpid": 1, "detailUrl": "/late"}]}))
    q = start_master_list_stream(spark, land, f"{scratch}/master", f"{scratch}/ckpt", available_now=True)
    q.awaitTermination(120)
    again = spark.read.parquet(f"{scratch}/master").filter(F.col("zpid") == "1").collect()
    assert [r.detailUrl for r in again] == ["https://www.zillow.com/a"]


def test_house_folder_sync_from_real_files(spark, scratch):
    from parcelgrid.operators.ledger import next_null_number, sync_house_ledger
    from parcelgrid.sources.files import list_files

    for name in ("2.json", "nullzpid_1.json", "nullzpid_4.json", "abc.json", "visited_houses.json", "7.txt"):
        _write(f"{scratch}/houses/{name}", "{}")
    names = list_files(spark, f"{scratch}/houses")
    ledger = spark.createDataFrame([("1",)], "zpid string")
    assert sorted(r.zpid for r in sync_house_ledger(ledger, names).collect()) == ["1", "2"]
    assert spark.range(1).select(next_null_number(names)).first()[0] == 5
    assert list_files(spark, f"{scratch}/missing").count() == 0


def test_repeated_json_keys_keep_the_last_value(spark, scratch):
    from parcelgrid.functions.payload import array_count, unwrap_response
    from parcelgrid.operators.dedupe import explode_results, master_list
    from parcelgrid.session import prepare_session
    from parcelgrid.sources.tiles import observe_rejects, parse_documents, parsed_documents, warn_rejected

    other = spark.newSession()  # a session without this library's settings
    other.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    with pytest.raises(RuntimeError, match="prepare_session"):
        parse_documents(other.createDataFrame([("{}",)], "text string"))
    assert other.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"  # a helper changes no setting
    docs = prepare_session(other).createDataFrame([("a", '{"listResults": [], "listResults": [{"zpid": 1, "zpid": 2, "detailUrl": "/x"}]}'),
                                  ("b", '{"listResults": [')], "tile_file string, text string")
    parsed, bad = parse_documents(docs)
    items = master_list(explode_results(parsed, "doc", ["tile_file"])).collect()
    assert [(r.tile_file, r.zpid, r.detailUrl) for r in items] == [("a", "2", "https://www.zillow.com/x")]
    assert [r.tile_file for r in bad.collect()] == ["b"]
    counted, seen = observe_rejects(parsed_documents(docs))
    assert counted.count() == 2
    with pytest.warns(UserWarning, match="1 of 2 documents"):
        assert warn_rejected(seen) == 1
    prepare_session(spark)
    text = '{"cat1": {}, "cat1": {"searchResults": {"mapResults": [], "mapResults": [1, 2]}}}'
    found = spark.createDataFrame([(text,)], "t string").select(unwrap_response("t").alias("p"))
    assert found.select(array_count("p", "mapResults")).first()[0] == 2
