"""Listing-id expressions over parsed JSON (VARIANT) items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def member(v, path: str) -> Column:
    """Member at ``path`` as VARIANT: SQL null when absent, VARIANT null when
    present with a JSON null."""
    return F.try_variant_get(_c(v), path, "variant")


def is_present(v, path: str) -> Column:
    return member(v, path).isNotNull()


def _json_of(x: Column) -> Column:
    """JSON text of a VARIANT value; its first character tells the JSON type.
    Used in the first condition of each CASE, so Spark evaluates it once per
    row and reuses it in the branches."""
    return F.to_json(x)


def py_text(v) -> Column:
    """Text of a JSON scalar the way Python's ``str`` prints the decoded value.

    Strings as they are, integers as digits, booleans ``True``/``False``,
    JSON null ``None``.  Objects and arrays come back as JSON text.
    """
    x = _c(v)
    j = _json_of(x)
    return (F.when(j.startswith('"'), F.variant_get(x, "$", "string"))
             .when(j == "true", F.lit("True"))
             .when(j == "false", F.lit("False"))
             .when(j == "null", F.lit("None"))
             .otherwise(j))


def truthy_text(v) -> Column:
    """``str(x) if x else None``: falsy values (null, '', 0, false, empty
    container) give null."""
    x = _c(v)
    j = _json_of(x)
    numeric = j.rlike("^-?[0-9]")
    falsy = (j.isin("null", '""', "false", "{}", "[]")
             | (numeric & (F.try_variant_get(x, "$", "double") == 0)))
    return F.when(~falsy, py_text(x))


def coalesce_id(item, strict_presence: bool = False) -> Column:
    """Listing id of an item: ``zpid``, else ``id``, else ``hdpData.homeInfo.zpid``.

    Default: the first of the three that is present and not null.
    ``strict_presence=True`` follows key presence instead, as the crawler did:
    a present null ``zpid`` gives the text ``None`` and blocks the fallback, and
    a ``homeInfo`` without ``zpid`` gives ``''``.
    """
    v = _c(item)
    zpid, ident = member(v, "$.zpid"), member(v, "$.id")
    nested = member(v, "$.hdpData.homeInfo.zpid")
    if not strict_presence:
        def val(m):
            return F.when(_json_of(m) != "null", py_text(m))
        return F.coalesce(val(zpid), val(ident), val(nested))
    return (F.when(zpid.isNotNull(), py_text(zpid))
             .when(ident.isNotNull(), py_text(ident))
             .when(is_present(v, "$.hdpData.homeInfo"), F.coalesce(py_text(nested), F.lit(""))))


def first_id(*cols) -> Column:
    """First non-empty id among the given text columns (falsy = missing)."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


def is_all_digits(col) -> Column:
    return _c(col).rlike(r"^[0-9]+$")


def absolute_url(col, site: str) -> Column:
    """Prefix ``site`` to a root-relative URL; other URLs are kept."""
    u = _c(col)
    return F.when(u.startswith("/"), F.concat(F.lit(site), u)).otherwise(u)


def file_stem(name_col) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(_c(name_col), r"^(.*?)(\.[^.]*)?$", 1)


def year_from_file(name_col) -> Column:
    """Year from ``<digits>.png`` file names, else null (also for digits past an int)."""
    y = F.regexp_extract(_c(name_col), r"^([0-9]+)\.png$", 1)
    return F.when(y != "", y.try_cast("int"))
