"""Worked examples from FIXTURES.md section 2."""

import json
import math

from pyspark.sql import functions as F

from parcelgrid.functions.geo import tile_key
from parcelgrid.functions.ids import coalesce_id
from parcelgrid.functions.pages import page_health
from parcelgrid.functions.payload import array_count, unwrap_response
from parcelgrid.operators.dedupe import dedupe_arrays, explode_results, master_list
from parcelgrid.operators.grid import REFERENCE_TILE, tile_grid
from parcelgrid.operators.inventory import year_combos
from parcelgrid.operators.ledger import next_null_number, sync_house_ledger, unvisited_houses
from parcelgrid.operators.model import early_stop_index, param_grid_rows, regression_metrics
from parcelgrid.operators.paging import capped_tiles, one_visit_per_page, stop_prefix
from parcelgrid.sources.tiles import parse_documents, read_text_documents

SEARCH = {"north": 37.81609909306968, "south": 37.703729038459144, "east": -122.34046069506836,
          "west": -122.54817096118164}


def test_tile_grid_golden(spark):
    regions = spark.createDataFrame([(1, SEARCH["north"], SEARCH["south"], SEARCH["east"], SEARCH["west"])],
                                    "region_id int, north double, south double, east double, west double")
    rows = {r["idx"]: r for r in tile_grid(regions, REFERENCE_TILE).collect()}
    assert len(rows) == 289
    assert rows[0]["rows"] == 17 and rows[0]["cols"] == 17
    expect = {0: (0, 0, -122.54817096118164, -122.5359527102338, 37.703729038459144, 37.71033904167153),
              44: (2, 10, -122.42598845170323, -122.4137702007554, 37.71694904488391, 37.7235590480963),
              80: (4, 12, -122.40155194980755, -122.38933369885972, 37.730169051308685, 37.736779054521065)}
    for idx, (r, c, w, e, s, n) in expect.items():
        got = rows[idx]
        assert (got["row"], got["col"]) == (r, c)
        for k, v in zip(("west", "east", "south", "north"), (w, e, s, n)):
            assert round(got[k], 9) == round(v, 9)


def test_grid_covers_bounds_and_respects_reference(spark):
    regions = spark.createDataFrame([(1, 37.9, 37.6, -122.2, -122.6), (2, 37.6, 37.9, -122.6, -122.2)],
                                    "region_id int, north double, south double, east double, west double")
    g = tile_grid(regions).toPandas()
    ref_w = abs(REFERENCE_TILE["east"] - REFERENCE_TILE["west"]) * 111.320 * math.cos(
        math.radians((REFERENCE_TILE["north"] + REFERENCE_TILE["south"]) / 2))
    for _, t in g.iterrows():
        w = abs(t.east - t.west) * 111.320 * math.cos(math.radians((t.north + t.south) / 2))
        assert w <= ref_w * 1.01
    for rid in (1, 2):
        part = g[g.region_id == rid]
        assert math.isclose(part.west.min(), -122.6) and math.isclose(part.east.max(), -122.2)
        assert math.isclose(part.south.min(), 37.6) and math.isclose(part.north.max(), 37.9)


def test_tile_key_golden(spark):
    df = spark.createDataFrame([(37.730169051308685, -122.38933369885972)], "lat double, lon double")
    assert df.select(tile_key("lat", "lon")).first()[0] == "tile_37_730169051308685_long_-122_38933369885972.json"
    tiny = spark.createDataFrame([(1e-05, 1.0)], "lat double, lon double")
    assert tiny.select(tile_key("lat", "lon")).first()[0] is None


def _visits(spark, rows):
    return spark.createDataFrame(rows, "tile int, page int, page_count int, house_count int, success boolean, "
                                       "has_listings boolean")


def test_pagination_stop_golden(spark):
    rows = [(1, 1, 40, 100, True, True), (1, 2, 40, 100, True, True), (1, 3, 41, 100, True, True),
            (1, 4, 40, 100, True, True), (2, 1, 0, 0, True, True), (3, 1, 10, 50, True, True),
            (3, 2, 0, 50, True, True), (3, 3, 9, 50, True, True)]
    out = stop_prefix(_visits(spark, rows)).filter("kept").groupBy("tile").agg(
        F.max("page").alias("last"), F.max("acc_page_count").alias("acc")).orderBy("tile").collect()
    assert [(r.tile, r["last"], r.acc) for r in out] == [(1, 3, 121), (2, 1, 0), (3, 2, 10)]


def test_pagination_failure_and_cap(spark):
    rows = [(1, 1, 5, 100, True, True), (1, 2, 5, 100, False, True), (1, 3, 5, 100, True, True)]
    m = {r.page: r for r in stop_prefix(_visits(spark, rows)).collect()}
    assert m[2].kept and not m[2].merged and not m[3].kept
    many = [(1, p, 1, 10_000, True, True) for p in range(1, 61)]
    marked = stop_prefix(_visits(spark, many))
    assert marked.filter("kept").count() == 50 and marked.filter("over_cap").count() == 10 and marked.count() == 60
    assert [(r.tile, r.pages_beyond) for r in capped_tiles(marked).collect()] == [(1, 10)]
    library = stop_prefix(_visits(spark, many), mode="library")
    assert library.filter("kept").count() == 60 and not library.filter("over_cap").count()
    twice = _visits(spark, [(1, 1, 0, 9, False, False), (1, 1, 5, 9, True, True), (1, 2, 5, 9, True, True)])
    assert stop_prefix(one_visit_per_page(twice)).filter("merged").count() == 2
    lib = stop_prefix(_visits(spark, [(1, 1, 3, 10, True, True), (1, 2, 0, 10, True, True),
                                      (1, 3, 3, 10, True, True)]), mode="library")
    assert sorted(r.page for r in lib.filter("kept").collect()) == [1, 2]


def test_per_array_dedupe_golden(spark):
    items = spark.createDataFrame(
        [(1, "listResults", 1, 0, "a"), (1, "listResults", 1, 1, "b"), (1, "listResults", 1, 2, "a"),
         (1, "listResults", 1, 3, None), (1, "mapResults", 1, 0, "a"), (1, "mapResults", 1, 1, "a"),
         (1, "mapResults", 1, 2, "c"), (1, "relaxedResults", 1, 0, "a"), (1, "relaxedResults", 1, 1, "a")],
        "tile int, result_type string, page int, pos int, item_id string")
    out = dedupe_arrays(items, "tile", "page").orderBy("result_type", "page", "pos").collect()
    by = {}
    for r in out:
        by.setdefault(r.result_type, []).append(r.item_id)
    assert by == {"listResults": ["a", "b"], "mapResults": ["a", "c"], "relaxedResults": ["a", "a"]}


def test_first_wins_golden(spark, scratch):
    files = {
        "tile_1.json": {"listResults": [{"zpid": "1", "detailUrl": "/a"}],
                        "mapResults": [{"zpid": 1, "detailUrl": "/other"}, {"zpid": 9}]},
        "tile_2.json": {"relaxedResults": [{"id": 9, "detailUrl": "https://x/b"}],
                        "listResults": [{"hdpData": {"homeInfo": {"zpid": 7}}, "detailUrl": "/c"}]},
    }
    for name, doc in files.items():
        with open(f"{scratch}/{name}", "w") as fh:
            json.dump(doc, fh)
    with open(f"{scratch}/tile_3.json", "w") as fh:
        fh.write('{"listResults": [{"zpid": "5", "detailUrl": "/t"')
    docs = read_text_documents(spark, f"{scratch}/tile_*.json", "tile_file").drop("path")
    parsed, bad = parse_documents(docs)
    out = {r.zpid: r.detailUrl for r in master_list(explode_results(parsed, "doc", ["tile_file"])).collect()}
    assert out == {"1": "https://www.zillow.com/a", "9": "https://x/b", "7": "https://www.zillow.com/c"}
    assert [r.tile_file for r in bad.collect()] == ["tile_3.json"]


def test_id_coalesce_presence(spark):
    df = spark.createDataFrame([('{"zpid":null,"id":5}',), ('{"hdpData":{"homeInfo":{}}}',), ('{"zpid":7}',)], "t string")
    v = F.parse_json("t")
    got = df.select(coalesce_id(v).alias("a"), coalesce_id(v, strict_presence=True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("5", "None"), (None, ""), ("7", "7")]


def test_unvisited_houses_golden(spark):
    master = spark.createDataFrame([("1", "u9"), ("2", "u2"), (None, "u2"), (None, "u3"), ("4", "u4"), ("5", None)],
                                   "zpid string, detailUrl string")
    ids = spark.createDataFrame([("1",)], "zpid string")
    urls = spark.createDataFrame([("u2",)], "detailUrl string")
    out = sorted((r.zpid or "-", r.detailUrl) for r in unvisited_houses(master, ids, urls).collect())
    assert out == [("-", "u3"), ("4", "u4")]


def test_ledger_sync_and_null_number(spark):
    ledger = spark.createDataFrame([("1",)], "zpid string")
    names = spark.createDataFrame([("2.json",), ("nullzpid_1.json",), ("abc.json",), ("visited_houses.json",)],
                                  "file_name string")
    assert sorted(r.zpid for r in sync_house_ledger(ledger, names).collect()) == ["1", "2"]
    nn = spark.createDataFrame([("nullzpid_1.json",), ("nullzpid_4.json",), ("nullzpid_x.json",)], "file_name string")
    assert spark.range(1).select(next_null_number(nn)).first()[0] == 5
    none = spark.createDataFrame([("a.json",)], "file_name string")
    assert spark.range(1).select(next_null_number(none)).first()[0] == 1


HEALTH = [
    ("property-card", 0, 0, (False, True, False, True)),
    ("px-captcha", None, None, (True, False, False, False)),
    ("px-captcha property-card", 3, 3, (True, True, False, True)),
    ("<title>Forbidden</title>", None, None, (False, False, True, False)),
    ("<p>forbidden</p>", None, None, (False, False, False, False)),
    ("<p>call 404 now</p>", None, None, (False, False, True, False)),
    ("property-card 404", 0, 0, (False, True, False, True)),
    ("hello", None, None, (False, False, False, False)),
    ("<h1 class=a>Server error</h1>", None, None, (False, False, True, False)),
    ("<title>ok</title><title>blocked</title>", None, None, (False, False, False, False)),
]


def test_page_health_table(spark):
    df = spark.createDataFrame([(b, pc, hc) for b, pc, hc, _ in HEALTH], "body string, pc int, hc int")
    got = df.select(page_health("body", "pc", "hc").alias("h")).select("h.*").collect()
    for (body, _, _, want), r in zip(HEALTH, got):
        assert (r.has_captcha, r.has_listings, r.has_error, r.success) == want, body


def test_response_unwrap_shapes(spark):
    cases = [('{"error":"x"}', 0), ('[{"a":1},{"cat1":{"searchResults":{"listResults":[1]}}}]', 1),
             ('[{"k":{"cat1":{"searchResults":{"listResults":[2]}}}}]', 1), ('{"cat1":{}}', 0),
             ('{"k":{"cat1":{"searchResults":{"listResults":[1]}}}}', 0), ("5", 0), ("[]", 0), ("null", 0),
             ("{bad", 0), ('{"error":"x","cat1":{"searchResults":{"listResults":[1]}}}', 0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string")
    got = [r[0] for r in df.select(array_count(unwrap_response("t"), "listResults")).collect()]
    assert got == [n for _, n in cases]
    empty = spark.createDataFrame([('{"cat1":{}}',)], "t string").select(F.to_json(unwrap_response("t"))).first()[0]
    assert empty == "{}"


def test_year_sets_golden(spark):
    files = spark.createDataFrame([("A", "2012.png"), ("A", "2013.png"), ("B", "2013.png"), ("B", "2012.png"),
                                   ("C", "2012.png"), ("D", "x.png"), ("D", "test_year.txt")],
                                  "folder string, file_name string")
    got = {r.years: r.n_folders for r in year_combos(files).collect()}
    assert got == {"2012,2013": 2, "2012": 1}


def test_param_grid_size(spark):
    g = param_grid_rows(spark.range(1))
    assert g.count() == 2916 and g.dropDuplicates().count() == 2916


def test_metrics_golden(spark):
    df = spark.createDataFrame([(math.log1p(1.0), math.log1p(1.0)), (math.log1p(3.0), math.log1p(1.0))],
                               "y_log double, pred_log double")
    r = regression_metrics(df).first()
    assert math.isclose(r.mae, 1.0) and math.isclose(r.rmse, math.sqrt(2))
    assert math.isclose(r.rmsle, 0.490129, rel_tol=1e-5) and math.isclose(r.r2, -1.0)


def test_early_stop_golden():
    assert early_stop_index([5, 4, 3, 3.5, 3.2, 2], patience=2) == (2, 4)


def test_dedupe_arrays_packing_edges(spark):
    import pytest

    items = spark.createDataFrame(
        [(1, "relaxedResults", 2, 5, "a:b:c"), (1, "relaxedResults", 2, 6, None), (1, "relaxedResults", 2, 7, "n"),
         (1, "listResults", 3, 1, "x:y"), (1, "listResults", 2, 9, "x:y"), (1, "mapResults", 1, (1 << 40), "z")],
        "tile int, result_type string, page long, pos long, item_id string")
    got = sorted((r.result_type, r.item_id or "-", r.page, r.pos) for r in dedupe_arrays(items, "tile", "page").collect())
    assert got == [("listResults", "x:y", 2, 9), ("mapResults", "z", 1, 1 << 40), ("relaxedResults", "-", 2, 6),
                   ("relaxedResults", "a:b:c", 2, 5), ("relaxedResults", "n", 2, 7)]
    bad = spark.createDataFrame([(1, "listResults", 70000, 1, "q")], "tile int, result_type string, page long, pos long, "
                                                                     "item_id string")
    with pytest.raises(Exception, match="packable range"):
        dedupe_arrays(bad, "tile", "page").collect()
