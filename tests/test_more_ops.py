"""Remaining operators: sinks K2/K3, T3 picks, A6/A11 listings, V1 raise,
general bounds override against a dict update."""

import json

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions.urls import with_bounds_override
from parcelgrid.operators.grid import pick_links, sample_link
from parcelgrid.operators.inventory import distinct_file_names, file_listing, folder_count
from parcelgrid.operators.paging import integrity_violations, tile_outcome
from parcelgrid.sinks.writers import write_links, write_master_list


def test_master_list_and_link_sinks(spark, scratch):
    master = spark.createDataFrame([("1", "https://x/ä"), ("2", "https://x/b")], "zpid string, detailUrl string")
    write_master_list(master, f"{scratch}/m", json_path=f"{scratch}/mj")
    assert sorted(map(tuple, spark.read.parquet(f"{scratch}/m").collect())) == [("1", "https://x/ä"), ("2", "https://x/b")]
    import glob

    text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{scratch}/mj/part-*"))
    assert "https://x/ä" in text  # UTF-8 kept, not escaped
    links = spark.range(50).select(F.col("id").alias("idx"), F.concat(F.lit("u"), F.col("id")).alias("link"))
    write_links(links.orderBy(F.rand(3)), f"{scratch}/l")
    assert [r.idx for r in spark.read.parquet(f"{scratch}/l").collect()] == list(range(50))


def test_pick_and_sample(spark):
    links = spark.range(100).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("link"))
    assert sorted(r.idx for r in pick_links(links, [80, 1]).collect()) == [1, 80]
    one = sample_link(links, seed=42).collect()
    assert len(one) == 1 and one == sample_link(links, seed=42).collect()


def test_file_listing_and_names(spark):
    files = spark.createDataFrame([("a", "b.png", 2048), ("a", "a.png", 1024), ("b", "a.png", 10), ("c", "z.txt", 0),
                                   ("c", "c.png", 1), ("c", "d.png", 1), ("c", "e.png", 1)],
                                  "folder string, file_name string, size long")
    top = file_listing(files).collect()
    assert [r.file_name for r in top] == ["a.png", "a.png", "b.png", "c.png", "d.png"]
    assert sorted(r.file_name for r in distinct_file_names(files).collect()) == ["a.png", "b.png", "c.png", "d.png",
                                                                                 "e.png", "z.txt"]
    assert spark.range(1).select(folder_count(files)).first()[0] == 3


def test_integrity_raise_mode(spark):
    totals = spark.createDataFrame([(1, 5, 3), (2, 1, 4)], "tile int, page_count int, house_count int")
    assert [r.tile for r in integrity_violations(totals).collect()] == [2]
    with pytest.raises(Exception, match="Data integrity error"):
        integrity_violations(totals, mode="raise").collect()
    with pytest.raises(Exception, match="Data integrity error"):
        integrity_violations(totals, mode="raise").count()
    with pytest.raises(Exception, match="Data integrity error"):
        integrity_violations(totals, mode="raise").select("tile").collect()
    assert integrity_violations(totals.filter("tile = 1"), mode="raise").count() == 0


def test_tile_outcome_not_saved(spark):
    rows = [(1, 3, False, True), (2, 3, False, False), (3, 0, True, True), (4, 0, False, None), (5, 1, True, None)]
    totals = spark.createDataFrame(rows, "tile int, house_count int, failed boolean, placed boolean")
    got = {r.tile: (r.outcome, r.visited, r.visited_parity) for r in tile_outcome(totals, F.col("placed")).collect()}
    assert got == {1: ("saved", True, True), 2: ("not saved", False, False), 3: ("failed", False, True),
                   4: ("empty", True, True), 5: ("not saved", False, False)}


# state, sides (north, south, east, west), and the state that must come out
OVERRIDES = [
    ('{"a":1,"mapBounds":{"north":1.0,"south":0.5,"east":2.0,"west":-1.0},"z":[1]}', (37.5, None, -122.25, 1e-05),
     '{"a":1,"mapBounds":{"north":37.5,"south":0.5,"east":-122.25,"west":1e-05},"z":[1]}'),
    ('{"mapBounds":{"west":3.25,"x":7},"q":"t"}', (0.1, 0.2, 0.3, 0.4),
     '{"mapBounds":{"west":0.4,"x":7,"north":0.1,"south":0.2,"east":0.3},"q":"t"}'),
    ('{"a":"b"}', (0.1, 0.2, None, 0.4), '{"a":"b","mapBounds":{"north":0.1,"south":0.2,"west":0.4}}'),
    ('{"mapBounds":{}}', (None, 0.2, None, None), '{"mapBounds":{"south":0.2}}'),
    ('{"a":"b"}', (None, None, None, None), '{"a":"b"}'),
    ('{"mapBounds":{"north":1.0}}', (None, None, None, None), '{"mapBounds":{"north":1.0}}'),
]


def test_bounds_override_gives_the_stated_states(spark):
    df = spark.createDataFrame([(state, *sides, want) for state, sides, want in OVERRIDES],
                               "state string, n double, s double, e double, w double, want string")
    out = with_bounds_override(df, "state", "out", north=F.col("n"), south=F.col("s"), east=F.col("e"),
                               west=F.col("w")).collect()
    assert [r.out for r in out] == [r.want for r in out]


def test_zoom_override_on_state_column(spark):
    from parcelgrid.functions.urls import set_member_value

    states = ['{"a":1,"mapZoom":13,"b":[2]}', '{"a":1}', '{}']
    df = spark.createDataFrame([(s,) for s in states], "s string")
    got = [r[0] for r in df.select(set_member_value("s", "mapZoom", F.lit("17"))).collect()]
    want = []
    for s in states:
        d = json.loads(s)
        d["mapZoom"] = 17
        want.append(json.dumps(d, separators=(",", ":")))
    assert got == want


def test_house_summary(spark):
    from parcelgrid.operators.reshape import house_summary

    houses = spark.createDataFrame(
        [(("1 Main St", 3, 2.5, 1200), (900000.0,), (88, None, 70), [("A",), ("B",)])],
        "basic_info struct<address:string,bedrooms:int,bathrooms:double,livingArea:int>, "
        "financial struct<price:double>, scores struct<walkScore:int,transitScore:int,bikeScore:int>, "
        "schools array<struct<name:string>>")
    r = house_summary(houses).first()
    assert (r.address, r.bedrooms, r.price, r.walkScore, r.transitScore, r.bikeScore, r.school_count) == \
        ("1 Main St", 3, 900000.0, "88", "N/A", "70", 2)


def test_empty_ledger_entries_and_insert_sink(spark, scratch):
    from parcelgrid.operators.ledger import empty_tile_check, insert_if_absent, new_empty_entries
    from parcelgrid.sinks.writers import write_if_absent

    tiles = spark.createDataFrame([(1, 1.5, -2.5, 0), (2, 1.5, -2.5, 0), (3, 2.5, -2.5, 4), (4, 9.5, -9.5, 0)],
                                  "k long, ne_lat double, sw_long double, house_count long")
    ledger = spark.createDataFrame([(9.5, -9.5)], "ne_lat double, sw_long double")
    checked = empty_tile_check(tiles, ledger, "k")
    assert {(r.k, r.skipped) for r in checked.collect()} == {(1, False), (2, True), (3, False), (4, True)}
    assert [tuple(r) for r in new_empty_entries(checked).collect()] == [(1.5, -2.5)]
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "o long, zpid string")
    existing = spark.createDataFrame([("b",)], "zpid string")
    write_if_absent(insert_if_absent(batch, existing, "zpid", "o"), f"{scratch}/houses", "run1")
    assert [(r.o, r.zpid) for r in spark.read.parquet(f"{scratch}/houses").collect()] == [(1, "a")]


def test_feature_split_and_deduped_counts(spark):
    from parcelgrid.operators.model import features_and_target
    from parcelgrid.operators.paging import deduped_counts

    df = spark.createDataFrame([(1.0, "d", 3, 4)], "financial_lastSoldPrice double, basic_info_description string, "
                                                   "a int, b int")
    assert features_and_target(df, "financial_lastSoldPrice", ["basic_info_description"]).columns == ["a", "b"]
    items = spark.createDataFrame([(1, "listResults"), (1, "listResults"), (1, "mapResults"), (2, "relaxedResults")],
                                  "tile int, result_type string")
    got = {r.tile: (r.page_count, r.house_count) for r in deduped_counts(items).collect()}
    assert got == {1: (2, 1), 2: (0, 0)}


def test_house_ledger_entries_and_corrupt_ledger(spark, scratch):
    from parcelgrid.operators.ledger import visited_house_entries
    from parcelgrid.sinks.writers import append_ledger
    from parcelgrid.sources.ledgers import read_ledger

    saved = spark.createDataFrame([("1", "u1"), (None, "u2"), ("", None), ("3", "")], "zpid string, detailUrl string")
    ids, urls = visited_house_entries(saved)
    assert sorted(r.zpid for r in ids.collect()) == ["1", "3"]
    assert sorted(r.url for r in urls.collect()) == ["u1", "u2"]
    append_ledger(ids, f"{scratch}/ids", "r1")
    with open(f"{scratch}/ids/part-corrupt.parquet", "wb") as fh:
        fh.write(b"not parquet at all")
    assert sorted(r.zpid for r in read_ledger(spark, f"{scratch}/ids", "zpid string").collect()) == ["1", "3"]


def test_strict_state_raises(spark):
    from parcelgrid.functions.urls import search_state_text

    df = spark.createDataFrame([("https://h.example/p?x=1",)], "url string")
    assert df.select(search_state_text("url")).first()[0] is None
    with pytest.raises(Exception, match="searchQueryState not found"):
        df.select(search_state_text("url", strict=True)).collect()


def test_page_plan_uses_a_given_count(spark):
    from parcelgrid.operators.grid import page_plan

    links = spark.createDataFrame([("https://x.example/a", 60), ("https://x.example/b", None)], "link string, n int")
    got = {r.link: r["count"] for r in page_plan(links, max_pages=50, pages="n").groupBy("link").count().collect()}
    assert got == {"https://x.example/a": 60, "https://x.example/b": 50}
    assert page_plan(links, pages=3).count() == 6


def test_score_texts_end_where_a_browser_ends_them():
    from parcelgrid.operators.scores import score_texts_of

    html = ('<ul><li class="score">Walk Score 5<li class="score">Bike Score 7</ul>'
            '<p class="score">Transit Score 2<div>other</div><table><tr><td class="Score">A Score<td>b</table>')
    assert score_texts_of(html) == ["Walk Score 5", "Bike Score 7", "Transit Score 2", "A Score"]
    assert score_texts_of('<i data-testid="score">&#83;core 1</i>') == ["Score 1"]
    assert score_texts_of(None) == score_texts_of("") == []


def test_script_text_by_id_in_any_quoting(spark):
    from parcelgrid.functions.pages import next_data_text

    tags = ['<script id="__NEXT_DATA__">1</script>', "<script a=b id='__NEXT_DATA__' c>1</script>",
            "<script id=__NEXT_DATA__>1</script>", '<script id="__NEXT_DATA__2">1</script>', '<script data-id="x">1</script>']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, h string")
    got = {r.i: r.x for r in df.select("i", next_data_text("h").alias("x")).collect()}
    assert got == {0: "1", 1: "1", 2: "1", 3: None, 4: None}


def test_empty_key_is_saved_under_a_fresh_name(spark):
    from parcelgrid.operators.ledger import insert_if_absent

    batch = spark.createDataFrame([(1, ""), (2, ""), (3, None), (4, "b")], "o long, zpid string")
    existing = spark.createDataFrame([("b",), ("",)], "zpid string")
    got = {r.o: r.status for r in insert_if_absent(batch, existing, "zpid", "o").collect()}
    assert got == {1: "saved", 2: "saved", 3: "saved", 4: "failed"}


def test_dedupe_keeps_the_payload_of_the_first_item(spark):
    from parcelgrid.operators.dedupe import dedupe_arrays

    rows = [(1, "listResults", 2, 0, "a", "late"), (1, "listResults", 1, 5, "a", "first"),
            (1, "relaxedResults", 1, 0, None, "x"), (1, "relaxedResults", 1, 0, None, "x"), (1, "mapResults", 1, 0, None, "y")]
    items = spark.createDataFrame(rows, "tile int, result_type string, page int, pos long, item_id string, body string")
    got = sorted((r.result_type, r.page, r.pos, r.body) for r in dedupe_arrays(items, "tile", "page", value_cols=["body"]).collect())
    assert got == [("listResults", 1, 5, "first"), ("relaxedResults", 1, 0, "x"), ("relaxedResults", 1, 0, "x")]
