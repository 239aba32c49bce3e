"""Nested house documents: flatten and summary (U19, H9); listing filter."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten_sections(df: DataFrame, sep: str = "_") -> DataFrame:
    """``section.field`` -> ``section_field`` for every struct column; other
    columns (arrays, scalars) are kept as they are."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, StructType):
            cols += [F.col(f"`{field.name}`.`{sub.name}`").alias(f"{field.name}{sep}{sub.name}")
                     for sub in field.dataType.fields]
        else:
            cols.append(F.col(f"`{field.name}`"))
    return df.select(*cols)


def summary_columns(detail: bool = True):
    """Summary of a parsed house: (address, beds / baths / area, price when
    ``detail``), the three scores as text (``N/A`` when missing) and the
    number of schools."""
    def score(name):
        return F.coalesce(F.col(f"scores.{name}").cast("string"), F.lit("N/A")).alias(name)
    head = [F.col("basic_info.address").alias("address"), F.col("basic_info.bedrooms").alias("bedrooms"),
            F.col("basic_info.bathrooms").alias("bathrooms"), F.col("basic_info.livingArea").alias("livingArea"),
            F.col("financial.price").alias("price")] if detail else []
    return head + [score("walkScore"), score("transitScore"), score("bikeScore"),
                   F.coalesce(F.size("schools"), F.lit(0)).cast("long").alias("school_count")]


def house_summary(houses: DataFrame) -> DataFrame:
    """One summary row per parsed house (H9)."""
    return houses.select(*summary_columns())


def listing_filter(df: DataFrame, bounds: dict, columns: dict) -> DataFrame:
    """Keep rows inside every given bound; a missing or None bound is open.

    ``bounds`` holds ``min_<name>`` / ``max_<name>`` values and ``columns``
    maps ``<name>`` to a column.  Bounds are literals, so the predicate reaches
    the Parquet scan as pushed filters.
    """
    return df.filter(_within(bounds, columns))


def _within(bounds: dict, columns: dict) -> F.Column:
    tests = [F.col(col) >= F.lit(bounds[f"min_{name}"]) for name, col in columns.items()
             if bounds.get(f"min_{name}") is not None]
    tests += [F.col(col) <= F.lit(bounds[f"max_{name}"]) for name, col in columns.items()
              if bounds.get(f"max_{name}") is not None]
    return functools.reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def listing_filter_sets(df: DataFrame, sets, columns: dict, set_col: str = "set_id") -> DataFrame:
    """``listing_filter`` for several bound sets, ``(set_id, bounds)`` pairs, in one
    scan: a row comes back once for each set it lies in, with the set's id first.

    The sets are parameters, a few written by hand: they become one array per row
    that is exploded.  What lies in no set is filtered first, by a predicate over
    the columns that reaches the scan unless a set is open on all sides.
    """
    inside = [F.coalesce(_within(bounds, columns), F.lit(False)) for _, bounds in sets]
    if not inside:
        return df.select(F.lit(None).cast("long").alias(set_col), "*").limit(0)
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(set_id).cast("long")) for hit, (set_id, _) in zip(inside, sets)]))
    any_set = functools.reduce(lambda a, b: a | b, [_within(bounds, columns) for _, bounds in sets])
    return df.filter(any_set).select(F.explode(hits).alias(set_col), "*")


def filter_state_entries(state: F.Column) -> F.Column:
    """``array<struct<kind,name,value_json>>`` of a search state's filters
    (``filterState`` entries with their ``value``) and ``regionSelection``
    entries (id, type)."""
    filters = F.try_variant_get(state, "$.filterState", "map<string,variant>")
    regions = F.try_variant_get(state, "$.regionSelection", "array<variant>")
    f_rows = F.transform(F.map_entries(F.coalesce(filters, F.create_map().cast("map<string,variant>"))),
                         lambda e: F.struct(F.lit("filter").alias("kind"), e["key"].alias("name"),
                                            F.to_json(F.try_variant_get(e["value"], "$.value", "variant"))
                                            .alias("value_json")))
    r_rows = F.transform(F.coalesce(regions, F.array().cast("array<variant>")),
                         lambda r: F.struct(F.lit("region").alias("kind"),
                                            F.try_variant_get(r, "$.regionId", "string").alias("name"),
                                            F.to_json(F.try_variant_get(r, "$.regionType", "variant"))
                                            .alias("value_json")))
    return F.concat(f_rows, r_rows)
