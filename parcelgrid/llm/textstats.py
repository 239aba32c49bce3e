"""Statistics of whole texts as Spark column expressions (no user functions).

Words are runs of characters other than the ASCII white space (0x20, 0x09-0x0D).
``with_counts`` gives, for each row, long columns named by ``COUNTS``; a null text
counts like an empty one.  The text is split once; every count is taken from the
word and line arrays inside the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words, by language.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une".split(),
    "de": "auf das dem den der des die ein eine für im ist mit nicht sich und von zu".split(),
    "es": "al como con del de el en es la las lo los no para por que se su sus un una y".split(),
}
ALL_STOP_WORDS = sorted(set().union(*STOP_WORDS.values()))

_REPEATED = """
aggregate(
  array_sort(transform(
    filter(
      transform(sorted, (s, k) -> struct(s.i AS i,
        (k > 0 AND get(sorted, k - 1).h = s.h) OR (k + 1 < size(sorted) AND get(sorted, k + 1).h = s.h) AS twice)),
      s -> s.twice),
    s -> s.i)),
  struct(0 AS n, 0 AS next),
  (acc, i) -> struct(acc.n + i + 3 - greatest(i, acc.next) AS n, i + 3 AS next),
  acc -> acc.n)
"""


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def _window_hashes(words: str) -> str:
    """Hash of each 3-word window, in order; no window: an empty array."""
    return (f"CASE WHEN size({words}) < 3 THEN array() ELSE transform(slice({words}, 1, size({words}) - 2), "
            f"(w, i) -> xxhash64(w, get({words}, i + 1), get({words}, i + 2))) END")


def with_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts.

    ``n_repeat_words`` are the words in 3-word windows that occur twice or more in
    the text; ``n_stop_words`` counts the words that are a stop word of any listed
    language, in any letter case.  Most texts repeat none: the windows' 64-bit hashes are counted
    apart first, and only a text that repeats one has them sorted and its covered
    word places summed.
    """
    base = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    split = base.select(*keep, "__text", words_of(F.col("__text")).alias("__words"),
                        F.filter(F.split("__text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("__lines"))
    counted = split.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", f"[{SYMBOLS}]+", ""))).cast("long")
        .alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(ALL_STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.expr(_window_hashes("__words")).alias("__windows"))
    repeats = counted.withColumn("__repeats", F.expr("size(array_distinct(__windows)) < size(__windows)"))
    # windows are sorted only in texts where one repeats
    ordered = repeats.withColumn("__sorted", F.expr(
        "CASE WHEN __repeats THEN array_sort(transform(__windows, (h, i) -> struct(h AS h, i AS i))) END"))
    repeated = f"CASE WHEN __repeats THEN {_REPEATED.replace('sorted', '__sorted')} ELSE 0 END"
    counts = (ordered.withColumn("n_repeat_words", F.expr(repeated).cast("long"))
              .drop("__windows", "__repeats", "__sorted"))
    # A caller's filter on a count would be moved below the projections, with the
    # count's whole expression copied into it at every use.  No filter passes a
    # projection that makes the partition number; the one below holds for every row.
    return counts.withColumn("__partition", F.spark_partition_id()).where("__partition >= 0").drop("__partition")
