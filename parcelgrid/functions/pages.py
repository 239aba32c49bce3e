"""Stored-page expressions: health flags and the embedded page JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker phrases the crawler tests a lower-cased page for.
CHALLENGE_MARKERS = ["press and hold", "px-captcha", "access denied"]
LISTING_MARKERS = ["listresults", "mapresults", "property-card", "zestimate"]
ERROR_MARKERS = ["404", "page not found", "access denied", "blocked", "forbidden",
                 "server error", "something went wrong"]

# The elements whose text the crawler looks at.
TITLE_RX = r"(?s)<title[^>]*>(.*?)</title>"
H1_RX = r"(?s)<h1[^>]*>(.*?)</h1>"
NEXT_DATA_RX = r"""(?s)<script\b[^>]*?\sid\s*=\s*(["']?)__NEXT_DATA__\1(?=[\s/>])[^>]*>(.*?)</script>"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_any(text, markers) -> Column:
    t = _c(text)
    out = F.lit(False)
    for m in markers:
        out = out | t.contains(m)
    return out


def _first_match_has(lower_body: Column, rx: str) -> Column:
    found = lower_body.rlike(rx)
    return found & contains_any(F.regexp_extract(lower_body, rx, 1), ERROR_MARKERS)


def page_health(body, page_count=None, house_count=None) -> Column:
    """Struct ``(has_captcha, has_listings, has_error, success, content_length)``.

    * challenge: any challenge marker in the lower-cased body;
    * listings: any listing marker;
    * error (only when no listings): an error phrase somewhere, and it is in the
      first ``<title>`` or the first ``<h1>``, or ``404`` occurs anywhere;
    * success: no challenge, no error, listings; a page with listings whose
      extracted counts are positive is a success with the error cleared.
    """
    b = _c(body)
    low = F.lower(b)
    captcha = contains_any(low, CHALLENGE_MARKERS)
    listings = contains_any(low, LISTING_MARKERS)
    error = (~listings & contains_any(low, ERROR_MARKERS)
             & (_first_match_has(low, TITLE_RX) | _first_match_has(low, H1_RX) | low.contains("404")))
    success = ~captcha & ~error & listings
    if page_count is not None and house_count is not None:
        pc, hc = F.coalesce(_c(page_count), F.lit(0)), F.coalesce(_c(house_count), F.lit(0))
        got = (success | listings) & ((pc > 0) | (hc > 0))
        success = success | got
        error = error & ~got
    return F.struct(captcha.alias("has_captcha"), listings.alias("has_listings"),
                    error.alias("has_error"), success.alias("success"),
                    F.length(b).cast("long").alias("content_length"))


def next_data_text(html) -> Column:
    """Text of the ``__NEXT_DATA__`` script element, null when there is none."""
    h = _c(html)
    return F.when(h.rlike(NEXT_DATA_RX), F.regexp_extract(h, NEXT_DATA_RX, 2))


def detail_gate(next_text, error=None, score_texts=None) -> Column:
    """``struct<status, next_data, scores>`` of a fetched detail page.

    ``status``: ``error`` (the fetch reported one), ``no_next_data`` (script text
    missing or empty), ``bad_json`` or ``ok``; ``next_data`` (VARIANT) is set on
    ``ok`` only.  Score texts are optional: null becomes an empty array.
    """
    text = _c(next_text)
    data = F.try_parse_json(text)
    failed = F.lit(False) if error is None else _c(error).isNotNull()
    status = (F.when(failed, "error").when(text.isNull() | (text == ""), "no_next_data")
               .when(data.isNull(), "bad_json").otherwise("ok"))
    none = F.array().cast("array<string>")
    scores = none if score_texts is None else F.coalesce(_c(score_texts), none)
    return F.struct(status.alias("status"), F.when(status == "ok", data).alias("next_data"), scores.alias("scores"))
