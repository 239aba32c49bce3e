"""Text forms that must match what the crawler wrote (Python ``str`` / ``repr``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_float_text(col) -> Column:
    """Double -> text in Python ``repr`` form (what ``json.dumps`` writes).

    Spark prints doubles the Java way, which switches to exponent form below
    1e-3 and from 1e7 on; Python switches below 1e-4 and from 1e16 on and writes
    ``1e-05`` rather than ``1.0E-5``.  Both use the plain form in between, so
    only exponent-form text is rewritten.
    """
    s = _c(col).cast("double").cast("string")
    parts = F.split(s, "E")
    mant, exp = parts[0], F.try_element_at(parts, F.lit(2)).cast("int")
    sign = F.when(mant.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mant, r"[-.]", ""), "(?<=.)0+$", "")
    ndig = F.length(digits)
    rest = F.substr(digits, F.lit(2))
    sci = F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")),
                   F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.lpad(F.abs(exp).cast("string"), 2, "0"))
    big = F.when(ndig - 1 <= exp, F.concat(sign, digits, F.repeat(F.lit("0"), exp - ndig + 1), F.lit(".0"))) \
           .otherwise(F.concat(sign, F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2)))
    return (F.when(exp.isNull(), s)
             .when(exp == -4, F.concat(sign, F.lit("0.000"), digits))
             .when((exp >= 7) & (exp <= 15), big)
             .otherwise(sci))


def blank_to_null(col) -> Column:
    """Trimmed text, or null when null / empty after trimming."""
    t = F.trim(_c(col).cast("string"))
    return F.when(t != "", t)


def strip_float_suffix(col) -> Column:
    """``'12.0'`` -> ``'12'``: undo the float form a number column picks up when
    it has blanks, so ``11`` and ``11.0`` count once."""
    return F.regexp_replace(_c(col), r"^(-?[0-9]+)\.0$", "$1")
