"""Stand-in inputs derived from the driver's tables.

The test tables hold no listings, so each crawl input is derived from a table
with the same structure (SURVEY 7.4).  Every derivation here is a projection or
an aggregate of the given tables; the same derivation is restated in each
oracle SQL string.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.session import ensure_checkpoint_dir

HREF_RX = r'href="(/[^"]*)"'
ARRAY_OF_POS = {0: "listResults", 1: "mapResults", 2: "relaxedResults"}


def scratch_folder(spark, sf_dir: str, name: str) -> str:
    """A folder on the session's shared storage for the files a query writes and reads
    back, one per query and source tables: a repeated run replaces its files."""
    key = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/parcelgrid-{name}/{key}"


def tile_documents_from_pages(pages: DataFrame) -> DataFrame:
    """One tile result document per page: ``(tile_file, text)``.

    The page's root-relative links become items (id = link text); link ``p``
    goes to ``listResults`` / ``mapResults`` / ``relaxedResults`` by ``p % 3``
    and carries its id in one of four shapes by ``p % 4``.  Pages with
    ``page_id % 50 == 7`` are stored truncated (malformed).
    """
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(HREF_RX), 1)

    def item(h, i):
        shape = i % 4
        return (F.when(shape == 0, F.to_json(F.struct(h.alias("zpid"), h.alias("detailUrl"))))
                 .when(shape == 1, F.to_json(F.struct(h.alias("id"), h.alias("detailUrl"))))
                 .when(shape == 2, F.to_json(F.struct(
                     F.struct(F.struct(h.alias("zpid")).alias("homeInfo")).alias("hdpData"), h.alias("detailUrl"))))
                 .otherwise(F.to_json(F.struct(h.alias("zpid"), F.lit("other").alias("id"), h.alias("detailUrl")))))

    tagged = F.transform(hrefs, lambda h, i: F.struct(i.alias("p"), item(h, i).alias("j")))

    def arr(mod):
        picked = F.filter(tagged, lambda s: s["p"] % 3 == mod)
        return F.concat(F.lit("["), F.array_join(F.transform(picked, lambda s: s["j"]), ","), F.lit("]"))

    text = F.concat(F.lit('{"listResults":'), arr(0), F.lit(',"mapResults":'), arr(1),
                    F.lit(',"relaxedResults":'), arr(2), F.lit("}"))
    text = F.when(F.col("page_id") % 50 == 7, F.substring(text, 1, 40)).otherwise(text)
    return pages.select(
        F.concat(F.lit("tile_"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".json")).alias("tile_file"),
        text.alias("text"))
