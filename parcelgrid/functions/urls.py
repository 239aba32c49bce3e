"""URL codec and search-state expressions (all JVM-side column expressions).

The crawl keeps its search request inside one query parameter,
``searchQueryState``, as percent-encoded compact JSON.  These helpers read and
write that form with built-in functions only:

* ``quote`` / ``quote_plus`` / ``unquote`` / ``unquote_plus`` reproduce the
  four standard-library URL codecs on top of ``url_encode`` / ``url_decode``.
* ``query_pairs`` turns a URL into the ordered, decoded ``(pos, key, value)``
  pairs a standard query-string parser returns (blank values dropped).
* ``search_state_text`` pulls the first ``searchQueryState`` and decodes it.
* ``with_bounds_override`` / ``with_current_page`` edit the raw JSON text, so key order
  and number text survive (a VARIANT round trip would sort keys).
* ``build_search_url`` / ``with_page_url`` rebuild URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.text import py_float_text

# Fixed values that must equal the crawler's for identical URLs.
DEFAULT_SITE = "https://www.zillow.com"
DEFAULT_CATEGORY = "RECENT_SEARCH"
STATE_PARAM = "searchQueryState"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- codecs
def quote(col, safe: str = "/") -> Column:
    """Percent-encode like the standard ``quote`` (space -> %20, ``~`` kept).

    ``url_encode`` is form encoding: it writes ``+`` for space, keeps ``*`` and
    escapes ``~``; three replacements turn it into RFC 3986 quoting.  ``safe``
    may contain ``/`` (the default) or be empty.
    """
    out = F.url_encode(_c(col))
    out = F.replace(out, F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    out = F.replace(out, F.lit("%7E"), F.lit("~"))
    if "/" in safe:
        out = F.replace(out, F.lit("%2F"), F.lit("/"))
    return out


def quote_plus(col) -> Column:
    """Form-encode like ``quote_plus`` (space -> ``+``, ``~`` kept, ``*`` escaped)."""
    out = F.url_encode(_c(col))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def unquote_plus(col) -> Column:
    """Decode form encoding (``+`` -> space); malformed escapes give null."""
    return F.try_url_decode(_c(col))


def unquote(col) -> Column:
    """Decode percent escapes only; a literal ``+`` stays ``+``."""
    return F.try_url_decode(F.replace(_c(col), F.lit("+"), F.lit("%2B")))


# --------------------------------------------------------------------------- URL parts
def url_prefix(url) -> Column:
    """Everything before the query and fragment (scheme, host, path, params)."""
    return F.regexp_extract(_c(url), r"^([^?#]*)", 1)


def url_query(url) -> Column:
    """Raw query text: after the first ``?`` and before the first ``#``."""
    return F.regexp_extract(_c(url), r"^[^#?]*\?([^#]*)", 1)


def url_fragment(url) -> Column:
    return F.regexp_extract(_c(url), r"(?s)#(.*)$", 1)


def query_pairs(url) -> Column:
    """``array<struct<pos,key,value>>`` of decoded query pairs in order.

    Same rules as the standard parser: split on ``&``; a pair needs ``=``;
    pairs with an empty value are dropped; key and value are form-decoded.
    ``pos`` is the 0-based position of the pair in the raw query string.
    """
    parts = F.split(url_query(url), "&")
    tagged = F.transform(
        parts,
        lambda p, i: F.struct(
            i.cast("long").alias("pos"),
            unquote_plus(F.regexp_extract(p, r"^([^=]*)", 1)).alias("key"),
            unquote_plus(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
            p.contains("=").alias("has_eq"),
        ),
    )
    kept = F.filter(tagged, lambda s: s["has_eq"] & (F.length(s["value"]) > 0)
                    & s["key"].isNotNull() & s["value"].isNotNull())
    return F.transform(kept, lambda s: F.struct(s["pos"].alias("pos"), s["key"].alias("key"),
                                                s["value"].alias("value")))


# Fixed value: what a parameter value that may hold JSON looks like after one decoding.
JSON_MARK = "%7B.*%7D"


def sniff_json(value) -> Column:
    """``struct<status,decoded,json_ok>`` of a decoded parameter value.

    A value with encoded braces is decoded once more: ``json`` when that parses,
    else ``raw``; any other value is ``plain``.  ``decoded`` is the text decoded once
    more (null for plain values), and ``json_ok`` whether it parses, asked of plain
    values too.
    """
    again = unquote(_c(value))
    ok = F.coalesce(F.try_parse_json(again).isNotNull(), F.lit(False))
    marked = _c(value).rlike(JSON_MARK)
    status = F.when(marked, F.when(ok, "json").otherwise("raw")).otherwise("plain")
    return F.struct(status.alias("status"), F.when(marked, again).alias("decoded"), ok.alias("json_ok"))


def url_parameters(df: DataFrame, url_col: str, keep_cols) -> DataFrame:
    """Every query parameter of a table of URLs: ``keep_cols``, ``pos``, ``key``, ``value``,
    ``is_first`` (the first value of its key in the URL), ``status``, ``decoded``, ``json_ok``."""
    pairs = df.select(*keep_cols, query_pairs(url_col).alias("_pairs"))
    keyed = pairs.withColumn("_keys", F.transform("_pairs", lambda s: s["key"]))
    marked = F.transform("_pairs", lambda s, i: F.struct(
        s["pos"].alias("pos"), s["key"].alias("key"), s["value"].alias("value"),
        (F.array_position("_keys", s["key"]) == i + 1).alias("is_first")))
    rows = keyed.select(*keep_cols, F.inline(marked))
    return rows.withColumn("_s", sniff_json("value")).select(
        *keep_cols, "pos", "key", "value", "is_first", "_s.status", "_s.decoded", "_s.json_ok")


def first_param(url, key: str) -> Column:
    """First decoded value of ``key`` (null when absent)."""
    hits = F.filter(query_pairs(url), lambda s: s["key"] == F.lit(key))
    return F.try_element_at(hits, F.lit(1))["value"]


def search_state_text(url, strict: bool = False) -> Column:
    """Decoded JSON text of the first ``searchQueryState`` parameter.

    The parser already decoded the value once; it is decoded once more, so both
    single- and double-encoded states come out as JSON.  Lenient form returns
    null when absent; ``strict=True`` raises instead.
    """
    text = F.nullif(unquote(first_param(url, STATE_PARAM)), F.lit(""))
    if strict:
        return F.coalesce(text, F.raise_error(F.lit("searchQueryState not found in URL")).cast("string"))
    return text


def search_state(url) -> Column:
    """Parsed search state as VARIANT (null when absent or not JSON)."""
    return F.try_parse_json(search_state_text(url))


# --------------------------------------------------------------------------- JSON edits
_BOUNDS_OBJ = r'"mapBounds"\s*:\s*\{([^{}]*)\}'


def _set_member(obj_inner: Column, name: str, value_text: Column) -> Column:
    """Set ``"name":value`` inside the text of a flat JSON object body."""
    pattern = rf'"{name}"\s*:\s*[^,}}]*'
    has = obj_inner.rlike(rf'"{name}"\s*:')
    replaced = F.regexp_replace(obj_inner, F.lit(pattern), F.concat(F.lit(f'"{name}":'), value_text))
    appended = F.when(F.trim(obj_inner) == "", F.concat(F.lit(f'"{name}":'), value_text)) \
                .otherwise(F.concat(obj_inner, F.lit(f',"{name}":'), value_text))
    return F.when(has, replaced).otherwise(appended)


def _append_member(obj_text: Column, member: Column) -> Column:
    """Append ``member`` (``"k":v``) at the end of a top-level JSON object text."""
    empty = F.regexp_replace(obj_text, r"\s", "") == "{}"
    return F.when(empty, F.concat(F.lit("{"), member, F.lit("}"))).when(
        obj_text.rlike(r"\}\s*$"),
        F.concat(F.regexp_replace(obj_text, r"\}\s*$", ""), F.lit(","), member, F.lit("}"))).otherwise(obj_text)


def with_bounds_override(df: DataFrame, state_col: str, out_col: str, north=None, south=None, east=None,
                         west=None) -> DataFrame:
    """Add ``out_col``: the state text with the given ``mapBounds`` sides replaced.

    A null override leaves that side as it is; a missing side is appended and a
    missing ``mapBounds`` object is added at the end, as a dict update would.
    Numbers are written the way ``json.dumps`` writes a float.  Each step is its
    own projection (Spark does not inline an expensive column that is used
    several times), so the work per row stays linear in the number of sides.
    """
    st = F.col(state_col)
    given = [(name, _c(v) if not isinstance(v, (int, float)) else F.lit(float(v)))
             for name, v in (("north", north), ("south", south), ("east", east), ("west", west)) if v is not None]
    if not given:
        return df.withColumn(out_col, st)
    # number texts for all sides in one array transform (small generated code)
    df = df.withColumn("_bnum", F.transform(F.array(*[v.cast("double") for _, v in given]), py_float_text))
    df = df.withColumn("_bnd", F.regexp_extract(st, _BOUNDS_OBJ, 1))
    for i, (name, v) in enumerate(given):
        txt = F.col("_bnum")[i]
        df = df.withColumn("_bnd", F.when(txt.isNull(), F.col("_bnd"))
                           .otherwise(_set_member(F.col("_bnd"), name, txt)))
    obj = F.concat(F.lit('"mapBounds":{'), F.col("_bnd"), F.lit("}"))
    out = F.when(st.rlike(_BOUNDS_OBJ),
                 F.regexp_replace(st, F.lit(_BOUNDS_OBJ), F.replace(obj, F.lit("$"), F.lit("\\$")))) \
           .otherwise(_append_member(st, obj))
    # all overrides null: the state is left as it is (no bounds object added)
    any_set = F.exists(F.col("_bnum"), lambda x: x.isNotNull())
    return df.withColumn(out_col, F.when(any_set, out).otherwise(st)).drop("_bnum", "_bnd")


def set_member_value(state_text, name: str, value_text: Column) -> Column:
    """Set a top-level scalar member (e.g. ``mapZoom``) on raw JSON text."""
    st = _c(state_text)
    pattern = rf'("{name}"\s*:\s*)(-?[0-9.eE+-]+|true|false|null|"[^"]*")'
    has = st.rlike(rf'"{name}"\s*:')
    return F.when(has, F.regexp_replace(st, F.lit(pattern), F.concat(F.lit(f'"{name}":'), value_text))) \
            .otherwise(_append_member(st, F.concat(F.lit(f'"{name}":'), value_text)))


_TEXT_RX = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _object_rx(depth: int) -> str:
    """Pattern of a JSON object that nests at most ``depth`` levels of objects."""
    rx = ""
    for _ in range(depth):
        rx = r'\{(?:[^{}"]++|' + _TEXT_RX + (f"|{rx}" if rx else "") + r")*+\}"
    return rx


_MEMBER_VALUE_RX = rf'(?s)^(\s*:\s*)({_object_rx(4)}|\[(?:[^\[\]"]++|{_TEXT_RX})*+\]|{_TEXT_RX}|[^,{{}}\s]+)(.*)$'


def _with_member(df: DataFrame, text_col: str, name: str, out_col: str) -> DataFrame:
    """Add ``out_col``: ``struct<head, value, tail>`` of the text around the value of
    the top-level member ``name`` of the JSON object in ``text_col``.

    ``head + value + tail`` is the whole text; all three are null when the object
    has no such member (of repeated members the last counts).  An occurrence of
    the quoted name is a top-level key when a colon follows it and the text before
    it, strings left out, opens exactly one more bracket than it closes.
    """
    key = f'"{name}"'
    df = df.withColumn("_parts", F.split(F.col(text_col), key))

    def key_end(n):  # the text up to the n-th occurrence, and whether that is a top-level key
        before = F.array_join(F.slice("_parts", 1, n), key)
        bare = F.regexp_replace(before, _TEXT_RX, "")
        opened = F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))
        return F.struct(F.length(before).alias("at"), (
            (opened == 1) & ~bare.contains('"') & F.get("_parts", n).rlike(r"^\s*:")).alias("top"))

    df = df.withColumn("_ends", F.when(F.size("_parts") > 1, F.transform(
        F.sequence(F.lit(1), F.size("_parts") - 1), key_end)))
    df = df.withColumn("_at", F.array_max(F.transform(F.filter("_ends", lambda e: e["top"]), lambda e: e["at"])))
    after = F.substring(F.col(text_col), F.col("_at") + 1 + len(key), F.length(text_col))
    df = df.withColumn("_after", after)
    found = F.col("_at").isNotNull() & F.col("_after").rlike(_MEMBER_VALUE_RX)
    part = {k: F.regexp_extract("_after", _MEMBER_VALUE_RX, k) for k in (1, 2, 3)}
    return df.withColumn(out_col, F.struct(
        F.when(found, F.concat(F.substring(F.col(text_col), F.lit(1), F.col("_at")), F.lit(key), part[1])).alias("head"),
        F.when(found, part[2]).alias("value"), F.when(found, part[3]).alias("tail"),
    )).drop("_parts", "_ends", "_at", "_after")


def with_current_page(df: DataFrame, state_col: str, page, out_col: str) -> DataFrame:
    """Add ``out_col``: the state text with top-level ``pagination.currentPage`` set.

    Only the top-level member is edited; a missing one is appended, and one that
    is not an object (null, a number) is replaced.  The text is cut and joined,
    never used as a replacement pattern, so ``$`` and ``\\`` in it stay.
    """
    pg = (_c(page) if not isinstance(page, int) else F.lit(page)).cast("long").cast("string")
    df = _with_member(df, state_col, "pagination", "_pm")
    df = df.withColumn("_inner", F.when(F.col("_pm.value").startswith("{"), F.col("_pm.value")).otherwise("{}"))
    df = _with_member(df, "_inner", "currentPage", "_cm")
    inner = F.when(F.col("_cm.value").isNull(), _append_member(
        F.col("_inner"), F.concat(F.lit('"currentPage":'), pg))).otherwise(F.concat("_cm.head", pg, "_cm.tail"))
    df = df.withColumn("_new", inner)
    out = F.when(F.col("_pm.value").isNull(), _append_member(
        F.col(state_col), F.concat(F.lit('"pagination":'), F.col("_new")))).otherwise(
        F.concat("_pm.head", "_new", "_pm.tail"))
    return df.withColumn(out_col, out).drop("_pm", "_inner", "_cm", "_new")


# --------------------------------------------------------------------------- URL builders
def build_search_url(base_path, state_text, category=DEFAULT_CATEGORY, site: str = DEFAULT_SITE) -> Column:
    """``site + path + ?category=..&searchQueryState=<quoted compact JSON>``."""
    cat = F.lit(category) if isinstance(category, str) else category
    path = F.lit(base_path) if isinstance(base_path, str) and not base_path.startswith("`") else _c(base_path)
    return F.concat(F.lit(site), path, F.lit("?category="), cat,
                    F.lit(f"&{STATE_PARAM}="), quote(_c(state_text), safe="/"))


def with_page_url(df: DataFrame, url_col: str, page, out_col: str = "page_url",
                  encode_once: bool = False) -> DataFrame:
    """Add ``out_col``: the URL rewritten to ask for ``page``.

    Parity with the crawler: the query is rebuilt from the parsed pairs, grouped
    by key in order of first appearance (blank values are gone), every value is
    form-encoded, and the new state is percent-encoded first, so it ends up
    encoded twice.  ``encode_once=True`` writes it encoded once.  A URL with no
    state comes back unchanged.  Parsed pairs and state are staged columns, so
    each is computed once per row.
    """
    u = F.col(url_col)
    df = df.withColumn("_qp", query_pairs(u))
    df = df.withColumn("_st", F.nullif(unquote(F.try_element_at(
        F.filter("_qp", lambda s: s["key"] == F.lit(STATE_PARAM)), F.lit(1))["value"]), F.lit("")))
    df = with_current_page(df, "_st", page, "_new_st")
    df = df.withColumn("_enc", quote(F.col("_new_st"), safe=""))
    state_value = F.col("_enc") if encode_once else quote_plus(F.col("_enc"))
    df = df.withColumn("_keys", F.transform("_qp", lambda s: s["key"]))
    ordered = F.sort_array(F.transform("_qp", lambda s: F.struct(
        F.array_position(F.col("_keys"), s["key"]).alias("grp"), s["pos"].alias("pos"),
        s["key"].alias("key"), s["value"].alias("value"))))
    df = df.withColumn("_ord", ordered)
    # only the first searchQueryState survives (its list is replaced by one value)
    first_state_pos = F.try_element_at(F.filter("_ord", lambda s: s["key"] == STATE_PARAM), F.lit(1))["pos"]
    kept = F.filter("_ord", lambda s: (s["key"] != STATE_PARAM) | (s["pos"] == first_state_pos))
    df = df.withColumn("_sv", state_value)
    encoded = F.transform(kept, lambda s: F.concat(
        quote_plus(s["key"]), F.lit("="),
        F.when(s["key"] == STATE_PARAM, F.col("_sv")).otherwise(quote_plus(s["value"]))))
    df = df.withColumn("_q", F.array_join(encoded, "&")).withColumn("_fr", url_fragment(u))
    rebuilt = F.concat(url_prefix(u), F.when(F.col("_q") != "", F.concat(F.lit("?"), F.col("_q"))).otherwise(F.lit("")),
                       F.when(F.col("_fr") != "", F.concat(F.lit("#"), F.col("_fr"))).otherwise(F.lit("")))
    return (df.withColumn(out_col, F.when(F.col("_st").isNull(), u).otherwise(rebuilt))
              .drop("_qp", "_st", "_new_st", "_enc", "_keys", "_ord", "_sv", "_q", "_fr"))


# The texts before and after the state in a search request.
BODY_HEAD = '{"searchQueryState": '
BODY_TAIL = (', "wants": {"cat1": ["listResults", "mapResults"], "cat2": ["total"]}, '
             '"requestId": 10, "isDebugRequest": false}')


def request_body(state_text) -> Column:
    """Search request body for a state: the state as stored (compact) between the fixed texts."""
    return F.concat(F.lit(BODY_HEAD), _c(state_text), F.lit(BODY_TAIL))
