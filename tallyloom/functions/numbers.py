"""Number expressions: canonical texts, strict and OCR readings, scale and sign variants, rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, factors and tolerances that results depend on.
NUMBER = r"\(?-?[$£€]?\s*\d(?:[\d,.\s]*\d)?%?\)?"
STRICT = r"^\(?-?[$£€]?\s*\d[\d,]*(?:\.\d+)?%?\)?$"
SHIFTS = (10.0, 100.0, 1000.0, 0.1, 0.01, 0.001)
MONEY_FACTORS, MONEY_TOLERANCE = (1e3, 1e6, 1e9), 0.02
OCR_FACTORS = ((10.0, 0.0005), (100.0, 0.0005), (1000.0, 0.02), (1e6, 0.02))


def let(c: Column, body) -> Column:
    """body(c) with c computed once; keeps deep expressions from being copied into every use."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strict_value(c: Column) -> Column:
    """A double if the whole trimmed text is one number; parentheses negate; else null."""
    t = F.trim(c)
    bare = F.trim(F.regexp_replace(t, r"[,$£€%()]", ""))
    value = bare.try_cast("double")
    return F.when(t.rlike(STRICT), F.when(t.startswith("(") & t.endswith(")"), -value).otherwise(value))


def plain_separators(body: Column) -> Column:
    """Thousands separators dropped and the decimal one as a dot; body has no sign."""
    drop = F.regexp_replace(body, "[.,]", "")
    tail = F.length(F.regexp_extract(body, r"[.,](\d*)$", 1))
    last = F.regexp_extract(body, r"([.,])\d*$", 1)
    both = F.when(tail == 3, drop).when(last == ".", F.regexp_replace(body, ",", "")).otherwise(F.regexp_replace(F.regexp_replace(body, r"\.", ""), ",", "."))
    has = lambda s: F.contains(body, F.lit(s))
    return F.when(body.rlike(r"^\d{1,3}(?:,\d{3})+$|^\d{1,3}(?:\.\d{3})+$"), drop).when(has(",") & has("."), both).when(has(","), F.regexp_replace(body, ",", "")).otherwise(body)


def canonical(c: Column) -> Column:
    """The first number of a text in one canonical spelling, else null. Dot thousands read as thousands (0.125 is 125).

    Equality of canonical texts is equality of numbers; texts keep all digits, without a limit on their number.
    """
    bare = lambda found: F.regexp_replace(found, r"(?U)[()$£€%\s]", "")
    body = lambda b: let(F.regexp_replace(b, "^-", ""), plain_separators)
    return let(F.regexp_extract(c, "(?U)" + NUMBER, 0), lambda found: let(bare(found), lambda b: let(body(b), lambda text: _spelled(found, b, text))))


def _spelled(found: Column, bare: Column, body: Column) -> Column:
    """The canonical text from what was found, the same without decoration, and its digits with a plain decimal dot."""
    in_brackets = F.trim(found).startswith("(") & F.trim(found).endswith(")")
    minus = bare.startswith("-")
    whole = F.regexp_replace(F.regexp_extract(body, r"^(\d+)", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(body, r"\.(\d+)$", 1), "0+$", "")
    text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    zero = text == "0"
    negative = F.when(zero, minus & ~in_brackets).otherwise(minus != in_brackets)
    return F.when(body.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.concat(F.when(negative, "-").otherwise(""), text))


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def ocr_value(c: Column) -> Column:
    """An OCR reading: symbols dropped, ( as a minus, a magnitude suffix dropped, two digits."""
    t = F.trim(F.regexp_replace(c, "[$€¥£,%]", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\(", "-"), r"\)", "")
    t = F.trim(F.regexp_replace(t, r"(?i)\s*(?:bn|mn|tn|mm|kn|[bmktx])\s*$", ""))
    return F.bround(t.try_cast("double"), 2)


def close(a: Column, b: Column | float, tolerance: float) -> Column:
    b = F.lit(b) if isinstance(b, float) else b
    return F.when(b == 0, a == 0).otherwise(F.abs(a - b) <= F.abs(b) * tolerance)


def money_scale(a: Column, b: Column) -> Column:
    """Whether two texts agree up to a factor of a thousand, a million or a billion."""
    x, y = canonical(a).try_cast("double"), canonical(b).try_cast("double")
    near = lambda ratio: reduce(lambda p, q: p | q, (close(ratio, f, MONEY_TOLERANCE) | close(ratio, 1 / f, MONEY_TOLERANCE) for f in MONEY_FACTORS))
    return F.coalesce(let(x / F.nullif(y, F.lit(0.0)), near), F.lit(False))


def scale_or_sign(target: Column, number: Column) -> Column:
    near = lambda a, b, t: F.abs(a - b) <= F.greatest(F.abs(b), F.lit(1e-9)) * t
    ratio = target / F.nullif(number, F.lit(0.0))
    shifted = reduce(lambda p, q: p | q, (near(ratio, F.lit(f), t) | near(ratio, F.lit(1 / f), t) for f, t in OCR_FACTORS))
    return F.coalesce((number != 0) & (near(target, -number, 0.02) | shifted), F.lit(False))


def scale_shift(prediction: Column, target: Column) -> Column:
    """Whether the canonical numbers' ratio is within 0.001 of a power of ten from 0.001 to 1000 (1 excepted)."""
    x, y = canonical(prediction).try_cast("double"), canonical(target).try_cast("double")
    near = lambda ratio: (ratio != 0) & reduce(lambda p, q: p | q, (F.abs(ratio - k) < 0.001 for k in SHIFTS))
    return F.coalesce(let(x / F.nullif(y, F.lit(0.0)), near), F.lit(False))


def rate(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den)


def geometric_mean(*rates: Column) -> Column:
    return F.pow(reduce(lambda a, b: a * b, rates), F.lit(1.0 / len(rates)))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a digest of the key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def counterfactual(c: Column, key: Column) -> Column:
    """Another number in the text's own format: the magnitude moved by 5 to 35 percent, up or down by the key's digest.

    A zero becomes one of 1, 3, 5, 7; a move that would reach zero goes up; a text without a number gives null.
    """
    digits = F.regexp_extract(c, r"\d[\d,]*(?:\.\d+)?", 0)
    places = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
    value = F.regexp_replace(digits, ",", "").try_cast("double")
    unit = F.pow(F.lit(10.0), -places)
    delta = F.greatest(F.round(value * (0.05 + 0.3 * uniform(F.concat(key, F.lit(":size")))) / unit) * unit, unit)
    up = (uniform(F.concat(key, F.lit(":sign"))) < 0.5) | (value <= delta)
    small = F.get(F.array(*map(F.lit, (1.0, 3.0, 5.0, 7.0))), F.floor(uniform(F.concat(key, F.lit(":zero"))) * 4).cast("int"))
    moved = F.when(value == 0, small).when(up, value + delta).otherwise(value - delta)
    text = F.format_number(moved, 0)
    for p in (1, 2, 3, 4):
        text = F.when(places >= p, F.format_number(moved, p)).otherwise(text)
    text = F.when(F.contains(digits, F.lit(",")) | (value < 1000), text).otherwise(F.regexp_replace(text, ",", ""))
    return F.when(value.isNotNull(), F.overlay(c, text, F.instr(c, digits), F.length(digits)))
