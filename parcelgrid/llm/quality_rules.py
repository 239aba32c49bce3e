"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds one ratio of a text; the table below is data, and ``compile_rules``
turns it into a column expression over the counts of ``textstats``.  Nothing runs
outside the JVM.

The stop-word ratio counts words, in any letter case, that are function words of a
listed language.  Running prose has one in every two to four words; the lower bound
of one in thirty leaves room for headings and names, the upper one takes a text that
is four fifths function words for filler.  A text without function words is only
suspicious where its language has a list: the lower bound holds for rows whose
language column names a listed language (``en``, also ``EN`` and ``en-GB``).  Rows of
other languages, or of none, are not rejected by it.

A row's ``kept`` is false when ``base_failed`` (fewer than 50 words, or more than
half of the words in repeated 3-word windows) or when any rule fails.  Null and
empty texts have no words and fail the base.  Repeated rows get repeated results;
an empty table gives no rows; null ids stay; other columns are ignored or, in
``keep_good``, carried along whatever their names.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.textstats import STOP_WORDS, with_counts


class Rule(NamedTuple):
    """``numerator / denominator`` must lie in [least, most]; None is no bound; ``only_listed``: the lower bound holds for
    languages with a stop-word list only."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None
    only_listed: bool = False


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 1 / 32, 0.8, only_listed=True),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 2.0, None),
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def listed_language(lang: Column) -> Column:
    """True where the language has a stop-word list; null: false."""
    return F.coalesce(F.lower(F.regexp_extract(lang.cast("string"), "^[A-Za-z]*", 0)).isin(list(STOP_WORDS)), F.lit(False))


def compile_rules(rules: tuple[Rule, ...] = RULES, listed: str = "__listed") -> Column:
    """True where every rule holds; bounds are compared as products, so an empty denominator needs no division."""
    holds = []
    for rule in rules:
        value, per = F.col(rule.numerator), F.col(rule.denominator)
        if rule.least is not None:
            enough = value >= per * F.lit(rule.least)
            holds.append(~F.col(listed) | enough if rule.only_listed else enough)
        if rule.most is not None:
            holds.append(value <= per * F.lit(rule.most))
    return functools.reduce(lambda a, b: a & b, holds, F.lit(True))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: tuple[Rule, ...] = RULES, lang_col: str = "lang") -> DataFrame:
    """One row per input row: the id, the counts, ``base_failed`` and ``kept``.  A table without ``lang_col`` names no languages."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    listed = listed_language(F.col(lang_col)) if lang_col in docs.columns else F.lit(False)
    counted = with_counts(docs.select(F.col(id_col), F.col(text_col), listed.alias("__listed")), text_col, (id_col, "__listed"))
    return (counted.withColumn("base_failed", base_failed)
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop("__listed"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a join."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    whole = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__body"), lang.alias("__lang"))
    verdict = judge(whole, "__row", "__body", rules, "__lang")
    return verdict.where("kept").select("__row.*")
