"""Text expressions: normal forms, tokens, periods, labels, identifiers and tagged targets. All are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOPWORDS = "a an and are as at be by company companies did does during ended ending fiscal for from how in is it of on period reported shown that the their this to was were what which year years".split()
JACCARD_STOPWORDS = "of the and in for to a an".split()
QUALIFIERS = "adjusted reported actual budget gaap non-gaap underlying core normalized normalised".split()
CONFUSABLE = (("revenue", "sales", "turnover"), ("profit", "income", "earnings"), ("debt", "borrowings", "liabilities"), ("ebitda",), ("margin",), ("cash", "liquidity"), ("expense", "expenses", "cost", "costs"))
YEAR = r"\b(?:19|20)\d{2}\b"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
MONTH_DATE = rf"(?i)\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b"
LOOSE_DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s*(?:19|20)\d{2}\b"
QUARTER = r"(?i)\b(?:Q[1-4]|first|second|third|fourth)\s+quarter\b"
TOKEN = r"[A-Za-z][A-Za-z&'-]*|\d{4}"
UNIT_WORD = r"(?i)[$£€%]|\b(?:usd|eur|gbp|mn|bn|000|million|millions|thousand|thousands|billion|billions)\b"
UNIT_SUBSTRINGS = ("$", "£", "€", "%", "usd", "eur", "gbp", "million", "millions", "mn", "m", "000", "thousand", "thousands")
VARIANT_ALIASES = {
    "clean": "clean",
    "target_value": "target_value",
    "target_value_replacement": "target_value",
    "target-value replacement": "target_value",
    "header_swap": "header_address_swap",
    "header_address_swap": "header_address_swap",
    "header/address swap": "header_address_swap",
    "column-header swap": "header_address_swap",
    "irrelevant_cell": "irrelevant_value",
    "irrelevant_value": "irrelevant_value",
    "irrelevant_value_replacement": "irrelevant_value",
    "irrelevant-cell replacement": "irrelevant_value",
    "irrelevant-value replacement": "irrelevant_value",
}
SCENARIO_LABELS = ("A", "F", "E", "B", "Budget", "Forecast", "Actual", "Estimate", "LTM A", "GAAP", "Reported", "Pro-Forma", "ProForma", "Pro Forma", "Landing", "Target", "Reforecast")
RELATIVE_LABELS = ("Prior Qtr", "Curr Qtr", "At Close", "Investment", "Acquisition", "Entry", "Current", "Close")
TEMPORAL_LABELS = ("LTM", "Q1", "Q2", "Q3", "Q4", "YTD", "Quarter Ended", "1Q", "2Q", "3Q", "4Q", "Year-to-Date", "12M Audited", "H1", "H2", "FY")
ACTUAL_LABELS, FORECAST_LABELS = ("a", "actual"), ("f", "e", "forecast", "estimate")


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact(c: Column) -> Column:
    """Trimmed, inner white space as one blank; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normal(c: Column) -> Column:
    """compact() in lower case: metric, header and OCR texts."""
    return F.lower(compact(c))


def slug(c: Column, limit: int = 120) -> Column:
    cleaned = F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", ""), 1, limit)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def number_text(c: Column) -> Column:
    """Comparable text of a number: quotes, separators and symbols dropped, (x) as -x. Text, not a number."""
    t = F.regexp_replace(normal(c), "^[\"'`]+|[\"'`]+$", "")
    t = F.trim(F.regexp_replace(t, "[,$£€%]", ""))
    return F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), F.trim(F.regexp_extract(t, r"(?s)^\((.*)\)$", 1)))).otherwise(t)


def scalar_answer(c: Column) -> Column:
    """The one element of an array answer; null for none, several or a blank one."""
    return F.nullif(F.when(F.size(c) == 1, compact(F.get(c, F.lit(0)))), F.lit(""))


def without_periods(c: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), (MONTH_DATE, YEAR, QUARTER), c)


def tokens(c: Column) -> Column:
    """Ordered distinct content words: no stop words, no plain digits."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^['_-]+|['_-]+$", "")))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~F.array_contains(strings(STOPWORDS), t) & ~t.rlike("^[0-9]+$")))


def metric_tokens(c: Column) -> Column:
    return tokens(without_periods(c))


def periods(c: Column) -> Column:
    """Ordered distinct dates, years and quarters; a quarter takes a year that starts within the next 24 characters."""
    dates = F.transform(F.regexp_extract_all(c, F.lit(MONTH_DATE), F.lit(0)), compact)
    years = F.regexp_extract_all(c, F.lit(YEAR), F.lit(0))
    quarter = F.regexp_extract_all(c, F.lit(QUARTER + r"(?:.{0,20}?\b(?:19|20)\d{2}\b)?"), F.lit(0))
    named = F.transform(quarter, lambda q: F.concat(compact(F.regexp_extract(q, QUARTER, 0)), F.when(q.rlike(YEAR), F.concat(F.lit(" "), F.regexp_extract(q, YEAR, 0))).otherwise(F.lit(""))))
    both = lambda every: F.struct(every.alias("every"), F.transform(every, F.lower).alias("lowered"))
    distinct = lambda b: F.filter(b.every, lambda x, i: F.array_position(b.lowered, F.lower(x)) == i + 1)
    return once(once(F.concat(dates, years, named), both), distinct)


def period_in(period: Column, context: Column) -> Column:
    """Whether the context holds the period, or else all of its years."""
    p = compact(period)
    years = F.regexp_extract_all(p, F.lit(YEAR), F.lit(0))
    return (p != "") & (F.contains(F.lower(context), F.lower(p)) | ((F.size(years) > 0) & F.forall(years, lambda y: F.contains(context, y))))


def content_words(c: Column) -> Column:
    """Distinct words of a label without stop words and single characters."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: (F.length(t) > 1) & ~F.array_contains(strings(JACCARD_STOPWORDS), t)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the word sets without stop words and single characters; 0 if either is empty."""
    x, y = content_words(a), content_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def without_qualifiers(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~F.array_contains(strings(QUALIFIERS), t)), " ")


def has_qualifier(c: Column) -> Column:
    return F.exists(F.split(c, " "), lambda t: F.array_contains(strings(QUALIFIERS), t))


def confusable(a: Column, b: Column) -> Column:
    x, y = F.split(normal(a), " "), F.split(normal(b), " ")
    return reduce(lambda p, q: p | q, (F.arrays_overlap(x, strings(g)) & F.arrays_overlap(y, strings(g)) for g in CONFUSABLE))


def temporal_remainder(c: Column) -> Column:
    """What is left of a period label without dates, years and separators."""
    return normal(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, LOOSE_DATE, ""), YEAR, ""), "[,:;]+", " "))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, YEAR, 0), F.lit("")).cast("int")


def period_key(c: Column) -> Column:
    """What periods are sorted by: the first year in the label, 0 without one, then the label."""
    return F.struct(F.coalesce(first_year(c), F.lit(0)).alias("year"), c.alias("label"))


def unit_class(value: Column, metric: Column, tag: Column) -> Column:
    return F.when(F.coalesce(metric, F.lit("")).rlike(r"(?i)\bper[\s-]+(?:share|unit)\b"), "per_share").when(F.trim(value).rlike(r"%\s*\)?$"), "percent").otherwise(F.coalesce(F.nullif(tag, F.lit("")), F.lit("unscaled")))


def is_numeric(c: Column) -> Column:
    return compact(c).rlike(r"^\(?-?[$£€]?\s*\d[\d,]*(?:\.\d+)?%?\)?$")


def is_unit_by_word(c: Column) -> Column:
    return c.rlike(UNIT_WORD)


def is_unit_by_substring(c: Column) -> Column:
    """The labelled tables' test: any unit string anywhere, a bare m included."""
    return F.exists(strings(UNIT_SUBSTRINGS), lambda t: F.contains(F.lower(c), t))


def is_degenerate(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^(?U)[\W_]*$"), F.lit(True))


def is_numeric_label(c: Column) -> Column:
    return F.coalesce((F.trim(c) != "") & F.trim(c).rlike(r"^[\s$£€()%.,0-9-]+$"), F.lit(False))


def is_bare_total(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("total", "totals"), F.lit(False))


def is_footnote_copy(a: Column, b: Column) -> Column:
    base = lambda c: F.trim(F.regexp_replace(c, r"\s*\(?\d\)?$", ""))
    return (base(a) != "") & (base(a) == base(b)) & (a != b)


def has_arithmetic(c: Column) -> Column:
    t = F.trim(c)
    return t.rlike(r"[+*/=]") | t.rlike(r"\d\s*-\s*\d")


def answer_text(c: Column) -> Column:
    """An answer without its prefix, quotes and extra white space."""
    t = F.trim(F.regexp_replace(F.trim(c), r"(?i)^\s*(?:answer|value)\s*[:：]\s*", ""))
    return F.regexp_replace(F.regexp_replace(t, "^[\"'`]+|[\"'`]+$", ""), r"(?U)\s+", " ")


def same_answer(a: Column, b: Column) -> Column:
    return F.lower(answer_text(a)) == F.lower(answer_text(b))


def canonical_variant(c: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for pair in VARIANT_ALIASES.items() for x in pair))
    lowered = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(aliases, F.regexp_replace(lowered, " ", "_")), F.try_element_at(aliases, lowered), c)


def label_class(c: Column) -> Column:
    """missing, scenario_basis, ambiguous_relative, actual_temporal or unknown_other, by whole words in that order."""
    t = F.lower(F.trim(c))
    has = lambda labels: t.rlike(r"\b(?:" + "|".join(x.lower().replace("-", r"\-") for x in labels) + r")\b")
    return F.when(c.isNull(), "missing").when(has(SCENARIO_LABELS), "scenario_basis").when(has(RELATIVE_LABELS), "ambiguous_relative").when(has(TEMPORAL_LABELS), "actual_temporal").otherwise("unknown_other")


def substitute(question: Column, old: Column, new: Column) -> Column:
    """First occurrence replaced; null where there is none."""
    return F.when(F.contains(question, old), F.overlay(question, new, F.instr(question, old), F.length(old)))


def stable_seed(seed: int | Column, key: Column) -> Column:
    """First 16 hex digits of sha256("seed:key") as an unsigned number."""
    text = F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), key)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def question_key(document: Column, question: Column, cell: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u001f", document, question, F.coalesce(cell, F.lit("")))), 1, 20)


def grounding_target(answer: Column, row: Column, column: Column, box: Column) -> Column:
    numbers = F.array_join(F.transform(box, lambda x: x.cast("string")), " ")
    return F.format_string("<answer>%s</answer>\n<row>%s</row>\n<column>%s</column>\n<bbox>%s</bbox>", answer, row, column, numbers)


def evidence_first_target(box: Column, answer: Column) -> Column:
    return F.format_string("<bbox>%s</bbox>\n<answer>%s</answer>", F.array_join(F.transform(box, lambda x: x.cast("string")), " "), answer)


def tag(c: Column, name: str) -> Column:
    """The trimmed content of the first <name>…</name>; null where there is none."""
    pattern = rf"(?s)<{name}>(.*?)</{name}>"
    return F.when(c.rlike(pattern), F.trim(F.regexp_extract(c, pattern, 1)))


def tag_box(c: Column) -> Column:
    """The four whole numbers of the first <bbox>; null if missing, out of 0 to 1000, or not ordered."""
    pattern = r"<bbox>\s*(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s*</bbox>"
    box = F.array(*(F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2, 3, 4)))
    fine = F.forall(box, lambda x: x.between(0, 1000)) & (box[2] > box[0]) & (box[3] > box[1])
    return F.when(c.rlike(pattern) & fine, box)


def box_before_answer(c: Column) -> Column:
    """Whether <bbox> opens before <answer>; null if either is missing."""
    a, b = F.instr(c, F.lit("<answer>")), F.instr(c, F.lit("<bbox>"))
    return F.when((a > 0) & (b > 0), b < a)


def part_of_list(a: Column, b: Column) -> Column:
    """Whether the shorter text is a comma-separated part of the longer one, without being equal to it."""
    x, y = F.trim(a), F.trim(b)
    shorter = F.lower(F.when(F.length(x) <= F.length(y), x).otherwise(y))
    longer = F.lower(F.when(F.length(x) <= F.length(y), y).otherwise(x))
    return (shorter != longer) & F.array_contains(F.transform(F.split(longer, ","), lambda t: F.trim(t)), shorter)


def mean_text(mean: Column, sd: Column, percent: bool = False) -> Column:
    k, unit = (100, "%%") if percent else (1, "")
    return F.when(mean.isNull(), "n/a").otherwise(F.format_string(f"%.{1 if percent else 3}f{unit} ± %.{1 if percent else 3}f{unit}", mean * k, F.coalesce(sd, F.lit(0.0)) * k))
