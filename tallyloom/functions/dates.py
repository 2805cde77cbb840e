"""Loose dates with their precision, years, months and the comparison of field values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, money_scale, same_number
from .text import part_of_list, same_answer

# Formats in the order in which they are tried: pattern of the text, Spark format, precision.
FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy", "day"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy", "day"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y", "day"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM y", "day"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y", "day"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, y", "day"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y", "day"),
    (r"^[A-Za-z]{3}-\d{2}$", "MMM-yy", "month"),
    (r"^[A-Za-z]{4,} \d{4}$", "MMMM y", "month"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM y", "month"),
    (r"^\d{1,2}/\d{4}$", "M/y", "month"),
    (r"^\d{1,2}/\d{2}$", "M/yy", "month"),
    (r"^\d{4}$", "y", "year"),
)
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LONG_MONTHS = "january february march april may june july august september october november december".split()


def loose_date(c: Column) -> Column:
    """struct(d, precision) by the first format that fits; null where none does. Two-digit years from 69 on are 19xx."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), r"\s+", " "))
    # month names in one case, May told apart from its own abbreviation by length only
    return let(F.initcap(F.lower(t)), _first_fit)


def _first_fit(t: Column) -> Column:
    tries = []
    for pattern, form, precision in FORMATS:
        d = F.try_to_date(t, form)
        if form.endswith("yy"):
            d = F.when(F.year(d) >= 2069, F.add_months(d, F.lit(-1200))).otherwise(d)
        tries.append(F.when(t.rlike(pattern) & d.isNotNull(), F.struct(d.alias("d"), F.lit(precision).alias("precision"))))
        if pattern.startswith(r"^\d{1,2} [A-Za-z]{4,}") or pattern.startswith("^[A-Za-z]{4,}"):
            short = pattern.replace("[A-Za-z]{4,}", "May")  # May is its own full name
            tries[-1] = F.coalesce(tries[-1], F.when(t.rlike(short) & d.isNotNull(), F.struct(d.alias("d"), F.lit(precision).alias("precision"))))
    return F.coalesce(*tries)


def coarser_date(a: Column, b: Column) -> Column:
    """Whether two loose dates differ only in that one was recorded with less precision."""
    return let(F.struct(loose_date(a).alias("x"), loose_date(b).alias("y")), lambda p: _coarser(p.x, p.y))


def _coarser(x: Column, y: Column) -> Column:
    rank = lambda p: F.when(p == "day", 2).when(p == "month", 1).otherwise(0)
    coarse = F.when(rank(x.precision) < rank(y.precision), x.precision).otherwise(y.precision)
    same = F.when(coarse == "year", F.year(x.d) == F.year(y.d)).otherwise(F.trunc(x.d, "MONTH") == F.trunc(y.d, "MONTH"))
    return F.coalesce((x.d != y.d) & (x.precision != y.precision) & same, F.lit(False))


def whole_year(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{2}$"), F.concat(F.lit("20"), t)).when(t.rlike("^[0-9]{4}$"), t)


def month_number(c: Column) -> Column:
    """Two digits of a month given by name, abbreviation or number; else null."""
    pairs = {}
    for i, (short, long) in enumerate(zip(MONTH_NAMES, LONG_MONTHS, strict=True), 1):
        pairs |= {str(i): f"{i:02}", f"{i:02}": f"{i:02}", short: f"{i:02}", long: f"{i:02}"}
    pairs["sept"] = "09"
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.lower(F.trim(c)))


def year_gap(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b), F.lit(0))


def values_match(kind: Column, a: Column, b: Column) -> Column:
    """match, mismatch, scale_mismatch, granularity_mismatch or unparseable, by the field's kind."""
    number = F.when(same_number(a, b), "match").when((kind == "monetary") & money_scale(a, b), "scale_mismatch").otherwise("mismatch")
    verdict = lambda p: F.when(p.x.isNull() | p.y.isNull(), "unparseable").when(p.x.d == p.y.d, "match").when(_coarser(p.x, p.y), "granularity_mismatch").otherwise("mismatch")
    date = let(F.struct(loose_date(a).alias("x"), loose_date(b).alias("y")), verdict)
    text = F.when(same_answer(a, b), "match").when(part_of_list(a, b), "granularity_mismatch").otherwise("mismatch")
    return F.when(kind.isin("monetary", "numerical"), number).when(kind == "date", date).otherwise(text)


def any_of(conditions) -> Column:
    return reduce(lambda p, q: p | q, conditions)
