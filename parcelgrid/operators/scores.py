"""Score texts of stored detail pages (the one DOM query SQL cannot state).

For each page, the trimmed text content of every element matched by
``[class*="score"]``, then ``[class*="Score"]``, then ``[data-testid*="score"]``
(document order within a selector), kept when it contains ``Score`` or
``score``.  An element matched by two selectors appears twice.  Runs as
``mapInPandas`` with the standard-library HTML parser: each batch of pages is
parsed inside its task; no page leaves its partition.
"""

from __future__ import annotations

import sys

from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Python code of this module runs inside tasks: ship it by value, so the
# workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The three selectors, as (attribute, substring), in order.
SCORE_SELECTORS = [("class", "score"), ("class", "Score"), ("data-testid", "score")]
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr"}


# Start tags that end an open element of the same kind (nearest first, not past the second set).
_BLOCKS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
           "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
           "table", "ul"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody"}, {"table"}),
         "tfoot": ({"thead", "tbody"}, {"table"})}
_CELLS = {"td", "th", "caption", "button", "object"}


def _matches(attrs: dict) -> bool:
    return any(needle in (attrs.get(attr) or "") for attr, needle in SCORE_SELECTORS)


class _Collector(HTMLParser):
    """Matched elements with their attributes and text content (descendant text).

    ``stack`` holds the open elements as (tag, text parts, or None where the
    element is not matched), so text is kept for matched elements only.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = []  # (attrs, text parts)
        self.stack = []

    def _close_implied(self, tag):
        for wanted, bounds in ([({"p"}, _CELLS)] if tag in _BLOCKS else []) + ([_ENDS[tag]] if tag in _ENDS else []):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in wanted:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in bounds:
                    break

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        named, parts = dict(reversed(attrs)), None  # of repeated attributes the first counts
        if _matches(named):
            parts = []
            self.elements.append((named, parts))
        if tag not in _VOID:
            self.stack.append((tag, parts))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash ends void elements only

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        for _, parts in self.stack:
            if parts is not None:
                parts.append(data)


def score_texts_of(html: str | None) -> list[str]:
    if not html:
        return []
    try:
        parser = _Collector()
        parser.feed(html)
        parser.close()
    except Exception:  # a page that cannot be parsed has no score texts
        return []
    out = []
    for attr, needle in SCORE_SELECTORS:
        for attrs, parts in parser.elements:
            value = attrs.get(attr)
            if value is not None and needle in value:
                text = "".join(parts).strip()
                if text and ("Score" in text or "score" in text):
                    out.append(text)
    return out


def score_texts(pages: DataFrame, key_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(key, pos, text)`` rows, one per score text.

    Pages reach Python in Arrow batches of ``spark.sql.execution.arrow.
    maxRecordsPerBatch`` rows (default 10,000); with large pages set it lower
    (a few hundred) so a batch of HTML fits comfortably in worker memory.
    """
    import pandas as pd

    key_type = pages.schema[key_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            keys, poss, texts = [], [], []
            for key, html in zip(pdf[key_col], pdf[html_col]):
                for i, t in enumerate(score_texts_of(html)):
                    keys.append(key)
                    poss.append(i)
                    texts.append(t)
            yield pd.DataFrame({key_col: keys, "pos": pd.Series(poss, dtype="int64"), "text": texts})

    html = F.col(html_col)  # a page without these strings has no score text (character references may spell them)
    maybe = pages.filter(html.contains("score") | html.contains("Score") | html.contains("&#"))
    return maybe.select(key_col, html_col).mapInPandas(run, f"{key_col} {key_type}, pos long, text string")
