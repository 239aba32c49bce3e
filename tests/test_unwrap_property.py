"""Response unwrap (H7): each case is built around a chosen payload, so its answer is known."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelgrid.functions.payload import array_count, unwrap_response

NOISE = st.one_of(st.integers(0, 3), st.none(), st.just("x"), st.fixed_dictionaries({"a": st.integers(0, 3)}))


@st.composite
def response(draw):
    """(stored response, sizes of its two arrays)."""
    sizes = draw(st.tuples(st.integers(0, 4), st.integers(0, 4)))
    payload = {"listResults": [0] * sizes[0], "mapResults": [0] * sizes[1], "total": 9}
    holder = {"cat1": {"searchResults": payload}, "b": draw(NOISE)}
    shape = draw(st.sampled_from(["plain", "in a list", "one level down in a list", "error", "none"]))
    if shape == "plain":
        return holder, sizes
    if shape == "error":
        return holder | {"error": 1}, (0, 0)
    if shape == "none":
        return draw(st.one_of(NOISE, st.lists(NOISE, max_size=3))), (0, 0)
    before, after = draw(st.lists(NOISE, max_size=2)), draw(st.lists(NOISE, max_size=2))
    return before + [holder if shape == "in a list" else {"k": draw(NOISE), "m": holder}] + after, sizes


@settings(max_examples=30, deadline=None)
@given(st.lists(response(), min_size=1, max_size=8))
def test_unwrap_finds_the_payload_it_was_built_around(spark, cases):
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)], "i int, t string")
    got = {r.i: (r.l, r.m) for r in df.select(
        "i", array_count(unwrap_response(F.col("t")), "listResults").alias("l"),
        array_count(unwrap_response(F.col("t")), "mapResults").alias("m")).collect()}
    assert got == {i: sizes for i, (_, sizes) in enumerate(cases)}
