"""Search-response expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelgrid.functions.ids import member
from parcelgrid.session import check_last_key_wins

RESULT_ARRAYS = ["relaxedResults", "listResults", "mapResults"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return v.isNotNull() & _kind(v).startswith("OBJECT")


def _search_results(holder: Column) -> Column:
    """``holder.cat1.searchResults`` with ``{}`` for a missing member; null when
    ``cat1`` is not an object (the crawler's lookup fails there)."""
    sr = member(holder, "$.cat1.searchResults")
    # a path lookup only succeeds inside objects, so the (whole-value) object
    # test is needed only when searchResults is absent
    return F.when(sr.isNotNull(), sr).when(_is_object(member(holder, "$.cat1")), F.parse_json(F.lit("{}")))


def unwrap_response(text) -> Column:
    """Payload (VARIANT) of a stored search response, null for "no results".

    * unparsable text, or an object with an ``error`` key -> null;
    * a list -> the first element that has ``cat1``, or whose member value has
      ``cat1``; its ``cat1.searchResults``;
    * an object with ``cat1`` -> its ``cat1.searchResults`` (``{}`` if missing);
    * anything else -> null.
    VARIANT keeps object members sorted by key, so among several members of one
    element that carry ``cat1`` the first by key name is taken.  Of a repeated key
    the last value counts.
    """
    check_last_key_wins()
    v = F.try_parse_json(_c(text))
    arr = F.try_variant_get(v, "$", "array<variant>")
    # member lookups return null on non-objects, so they double as type tests
    per_item = F.transform(arr, lambda x: F.when(
        member(x, "$.cat1").isNotNull(), F.struct(_search_results(x).alias("p")))
        .otherwise(F.try_element_at(F.filter(
            F.transform(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")),
                        lambda y: F.when(member(y, "$.cat1").isNotNull(),
                                         F.struct(_search_results(y).alias("p")))),
            lambda s: s.isNotNull()), F.lit(1))))
    from_list = F.try_element_at(F.filter(per_item, lambda s: s.isNotNull()), F.lit(1))["p"]
    from_obj = F.when(member(v, "$.cat1").isNotNull(), _search_results(v))
    has_error = member(v, "$.error").isNotNull()
    return F.when(has_error, F.lit(None)).when(arr.isNotNull(), from_list).otherwise(from_obj)


def result_array(payload, name: str) -> Column:
    """``array<variant>`` of a result array; missing -> empty array."""
    arr = F.try_variant_get(_c(payload), f"$.{name}", "array<variant>")
    return F.coalesce(arr, F.array().cast("array<variant>"))


def array_count(payload, name: str) -> Column:
    """Length of a result array, 0 when missing (``page_count`` = listResults,
    ``house_count`` = mapResults)."""
    return F.size(result_array(payload, name)).cast("long")
