"""Formats of dates and numbers: parsing by label, and detection over a whole column.

Detection is one aggregate of conditional counts a column; what can be read in two ways
is reported as ``AMBIGUOUS``, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date formats by label, in order of preference, as (pattern, shape).
DATE_FORMATS = {
    "ISO_YMD": ("yyyy-M-d", r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"),
    "YMD_SLASH": ("yyyy/M/d", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
    "YMD_COMPACT": ("yyyyMMdd", r"[0-9]{8}"),
    "DMY_MONTHNAME": ("d-MMM-yyyy", r"[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}"),
    "DMY_MONTHNAME_SPACE": ("d MMM yyyy", r"[0-9]{1,2} [A-Za-z]{3} [0-9]{4}"),
    "MDY_MONTHNAME": ("MMM d, yyyy", r"[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}"),
    "DMY_DOT": ("d.M.yyyy", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"),
}
# The two readings of numeric dates, which need evidence.
NUMERIC_FORMATS = {"DMY_NUMERIC": "d/M/yyyy", "MDY_NUMERIC": "M/d/yyyy"}
#: Labels that may be read without being told.
SAFE_FORMATS = ("ISO_YMD", "YMD_SLASH", "YMD_COMPACT")
_NUMERIC = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"


def date_by_label(raw: Column, label: str) -> Column:
    """The date written in a format; null for anything else.  An unknown label is an error."""
    text = F.trim(raw)
    if label in NUMERIC_FORMATS:
        return F.when(text.rlike(_NUMERIC), F.try_to_timestamp(F.translate(text, "-", "/"), F.lit(NUMERIC_FORMATS[label])).cast("date"))
    if label not in DATE_FORMATS:
        raise ValueError(f"unknown date format: {label}")
    pattern, shape = DATE_FORMATS[label]
    if "MMM" in pattern:
        text = F.initcap(text)
    return F.when(text.rlike(rf"\A{shape}\z"), F.try_to_timestamp(text, F.lit(pattern)).cast("date"))


def safe_date(raw: Column) -> Column:
    """A date in one of the formats that can't be misread, else null."""
    return F.coalesce(*[date_by_label(raw, label) for label in SAFE_FORMATS])


def date_format(column: Column) -> Column:
    """Aggregate: the label of the format all filled values of a column have.

    ``AMBIGUOUS`` if they are numeric and every part could be day or month,
    ``CONTRADICTORY`` if both readings are ruled out, ``UNKNOWN`` otherwise; null if there
    is no filled value.
    """
    text = F.nullif(F.trim(column), F.lit(""))
    filled = F.count(text)
    day, month = (F.regexp_extract(text, _NUMERIC, k).try_cast("int") for k in (1, 2))
    numeric = F.count_if(text.rlike(_NUMERIC)) == filled
    late = [F.coalesce(F.max(part), F.lit(0)) > 12 for part in (day, month)]
    label = F.when(filled == 0, F.lit(None).cast("string"))
    for name in DATE_FORMATS:
        label = label.when(F.count(date_by_label(text, name)) == filled, name)
    return label.when(numeric & late[0] & late[1], "CONTRADICTORY").when(numeric & late[0], "DMY_NUMERIC").when(numeric & late[1], "MDY_NUMERIC").when(numeric, "AMBIGUOUS").otherwise("UNKNOWN")


_CODE = r"(?:[A-Za-z]{3}|[$€£¥])"


def amount_body(raw: Column) -> Column:
    """What is left of a written amount without a currency sign or code at one of its ends."""
    return F.trim(F.regexp_replace(F.trim(raw), rf"(?U)\A{_CODE}\s*|\s*{_CODE}\z", ""))


def _grammar(group: str, point: str) -> str:
    whole = rf"(?:[0-9]{{1,3}}(?:[{group}'  ][0-9]{{3}})+|[0-9]+)"
    return rf"(?:{whole}(?:{point}[0-9]*)?|{point}[0-9]+)"


def parsed_amount(raw: Column, decimal_comma: bool = False) -> Column:
    """decimal(24,8) of a written amount; null if it is none.

    A currency sign or code may stand at one end; a negative has a sign at one end or
    brackets around; digits are bare or grouped in threes.  Anything else, an open
    bracket, a sign inside or odd grouping, is not read.
    """
    body = amount_body(raw)
    number = _grammar(r"\.", ",") if decimal_comma else _grammar(",", r"\.")
    valid = body.rlike(rf"\A(?:[+-]?{number}|{number}[+-]|\({number}\))\z")
    negative = body.rlike(r"\A[-(]|-\z")
    digits = F.regexp_replace(body, r"[^0-9,.]", "")
    digits = F.translate(F.translate(digits, ".", ""), ",", ".") if decimal_comma else F.translate(digits, ",", "")
    value = F.when(valid, digits.try_cast("decimal(24,8)"))
    return F.when(negative, -value).otherwise(value).cast("decimal(24,8)")


def number_format(column: Column) -> Column:
    """Aggregate: COMMA_DECIMAL, DOT_DECIMAL or PLAIN, as the rightmost mark of the values
    says; ``AMBIGUOUS`` if values disagree, ``UNKNOWN`` if one holds letters, null if there is
    no filled value.

    A mark with one or two digits behind is decimal, with any other number a grouping mark
    (so ``1.084`` counts as grouped: three decimals can't be told from a thousand).
    """
    body = F.nullif(F.regexp_replace(amount_body(column), r"[()\s+-]", ""), F.lit(""))
    tail = F.length(F.regexp_extract(body, r"[.,]([^.,]*)\z", 1))
    last = F.regexp_extract(body, r"([.,])[^.,]*\z", 1)
    short = tail.between(1, 2)
    comma = F.count_if(((last == ",") & short) | ((last == ".") & ~short))
    dot = F.count_if(((last == ".") & short) | ((last == ",") & ~short))
    letters = F.count_if(body.rlike("[A-Za-z]"))
    return F.when(F.count(body) == 0, F.lit(None).cast("string")).when(letters > 0, "UNKNOWN").when((comma > 0) & (dot > 0), "AMBIGUOUS").when(comma > 0, "COMMA_DECIMAL").when(dot > 0, "DOT_DECIMAL").otherwise("PLAIN")


def column_formats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by ..., date_format, number_format) of a text column for each group, in one aggregate."""
    return df.groupBy(*by).agg(date_format(F.col(column)).alias("date_format"), number_format(F.col(column)).alias("number_format"))
