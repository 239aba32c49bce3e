"""Stop prefix (W1-W3) on drawn visit logs: facts that hold for whatever is kept."""

from hypothesis import given, settings
from hypothesis import strategies as st

from parcelgrid.operators.paging import stop_prefix

PAGE = st.tuples(st.integers(0, 6), st.integers(0, 12), st.booleans(), st.booleans())
SCHEMA = "tile int, page int, page_count int, house_count int, success boolean, has_listings boolean"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.dictionaries(st.integers(1, 8), PAGE, min_size=1, max_size=8), min_size=1, max_size=6),
       st.integers(2, 8))
def test_kept_pages_form_a_prefix_that_ends_at_the_first_stop(spark, tiles, cap):
    rows = [(t, p, *visit) for t, pages in enumerate(tiles) for p, visit in pages.items()]
    marked = stop_prefix(spark.createDataFrame(rows, SCHEMA), max_pages=cap).collect()
    assert sorted((r.tile, r.page) for r in marked) == sorted(r[:2] for r in rows)
    assert all(r.over_cap == (r.page > cap) for r in marked)
    for t in range(len(tiles)):
        log = sorted((r for r in marked if r.tile == t and not r.over_cap), key=lambda r: r.page)
        flags = [r.kept for r in log]
        assert flags == sorted(flags, reverse=True)
        stops = [k for k, r in enumerate(log) if r.stop]
        assert sum(flags) == (stops[0] + 1 if stops else len(log))
        usable = [r.page_count if r.success and r.has_listings else 0 for r in log]
        assert [r.acc_page_count for r in log] == [sum(usable[:k + 1]) for k in range(len(log))]
        assert all(r.merged == (r.kept and r.success and r.has_listings) for r in log)
        for r in log:  # an unusable page and a reached target always stop, an unreached one with items never does
            reached = r.acc_page_count >= r.target_house_count
            assert r.stop or not (reached or not (r.success and r.has_listings))
            assert not r.stop or reached or r.page_count == 0 or not (r.success and r.has_listings)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=7), st.integers(0, 4))
def test_crawl_built_to_end_at_a_known_page(spark, counts, more):
    """The target is the sum of the first pages, so the crawl ends right there."""
    rows = [(1, p, c, sum(counts), True, True) for p, c in enumerate(counts + [1] * more, 1)]
    kept = stop_prefix(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()
    assert sorted(r.page for r in kept) == list(range(1, len(counts) + 1))
