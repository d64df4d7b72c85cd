"""The three readings of a number in text, kept apart because they disagree on purpose.

table_number reads cells for exact arithmetic, profile_number reads cells for column profiles, and evidence_number
reads numbers in prose, where a group of three digits is a thousand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,8)"
_NBSP = " "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: a Column that is named twice in an expression is otherwise computed twice."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _bare(text: Column, *signs: str) -> Column:
    out = F.trim(F.coalesce(text, F.lit("")))
    for sign in ("R$", _NBSP, " ", *signs):
        out = F.replace(out, F.lit(sign), F.lit(""))
    return out


def table_text(text: Column) -> Column:
    return let(_bare(text), lambda b: F.when(F.contains(b, F.lit(",")), F.replace(F.replace(b, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(b))


def table_number(text: Column) -> Column:
    """Exact decimal of a table cell. Text that is no finite number stops the query."""
    clean = table_text(text)
    found = clean.try_cast(MONEY)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("Non-numeric table value: "), F.coalesce(text, F.lit("")))).cast(MONEY))


def _last(text: Column, sign: str) -> Column:
    return F.length(text) - F.locate(sign, F.reverse(text))


def _both(text: Column) -> Column:
    """Where comma and dot both occur, the last one is the decimal mark."""
    comma_last = _last(text, ",") > _last(text, ".")
    as_comma = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(comma_last, as_comma).otherwise(F.replace(text, F.lit(","), F.lit("")))


def profile_number(text: Column) -> Column:
    """Double of a cell, or null. Percent signs go; a comma alone is a decimal mark."""

    def read(bare: Column) -> Column:
        comma, dot = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
        clean = F.when(comma & dot, _both(bare)).when(comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(bare)
        return F.when(bare != "", clean).try_cast("double")

    return let(_bare(text, "%"), read)


def _evidence_digits(digits: Column) -> Column:
    comma, dot = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    head, tail = F.regexp_extract(digits, "^(.*),", 1), F.regexp_extract(digits, ",([^,]*)$", 1)
    thousands = (F.length(tail) == 3) & (F.length(F.replace(head, F.lit(","), F.lit(""))) <= 3)
    by_comma = F.when(thousands, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    groups = digits.rlike(r"^[^.]*(\.[^.]{3}){2,}$") | digits.rlike(r"^[^.]{0,3}\.[^.]{3}$")
    by_dot = F.when(groups, F.replace(digits, F.lit("."), F.lit(""))).otherwise(digits)
    return F.when(comma & dot, _both(digits)).when(comma, by_comma).when(dot, by_dot).otherwise(digits)


def _signs_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9,.\-]", "")


def _signed(bare: Column) -> Column:
    sign = F.when(F.startswith(bare, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, let(F.regexp_replace(bare, "^-+", ""), _evidence_digits))


def evidence_text(text: Column) -> Column:
    """The digits of a number in prose, with a dot as decimal mark."""
    return let(_signs_and_digits(text), _signed)


def evidence_number(text: Column) -> Column:
    """A number in prose as plain text without trailing zeros, or null. Digits alone, which most are, need no marks read and no decimals cut."""

    def read(bare: Column) -> Column:
        found = _signed(bare).try_cast("decimal(38,12)").cast("string")
        plain = F.regexp_replace(F.regexp_replace(found, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(bare.rlike("^[0-9]{1,18}$"), bare.cast("long").cast("string")).otherwise(let(plain, lambda p: F.when(p.isin("-0", ""), F.lit("0")).otherwise(p)))

    return let(_signs_and_digits(text), read)


def _values(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, evidence_number), lambda v: v.isNotNull())))


def numbers_in(text: Column) -> Column:
    return _values(text, r"(?U)(?<!\w)-?\d+(?:[.,]\d+)*(?!\w)")


def percentages_in(text: Column) -> Column:
    return _values(text, r"-?[0-9]+(?:[.,][0-9]+)*\s*%")


def currencies_in(text: Column) -> Column:
    return _values(text, r"(?i)(?:R\$\s*|RS\s*)-?[0-9]+(?:[.,][0-9]+)*")


def dates_in(text: Column) -> Column:
    """Dates as year-month-day. Day first unless the year leads; two-digit years are of this century; months are not checked."""
    clean = F.coalesce(text, F.lit(""))
    part = lambda x, p, k: F.regexp_extract(x, p, k)
    first = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"
    leading = r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b"

    def day_first(x: Column) -> Column:
        year = part(x, first, 3).cast("int")
        year = F.when(year < 100, year + 2000).otherwise(year)
        return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(x, first, 2), 2, "0"), F.lpad(part(x, first, 1), 2, "0"))

    def year_first(x: Column) -> Column:
        return F.concat_ws("-", part(x, leading, 1), F.lpad(part(x, leading, 2), 2, "0"), F.lpad(part(x, leading, 3), 2, "0"))

    both = F.concat(F.transform(F.regexp_extract_all(clean, F.lit(first), 0), day_first), F.transform(F.regexp_extract_all(clean, F.lit(leading), 0), year_first))
    return F.sort_array(F.array_distinct(both))


def format_number(value: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.2f", value))
