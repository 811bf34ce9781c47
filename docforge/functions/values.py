"""Money, rates and numbers as Column expressions. Amounts are DECIMAL(18,6); what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"
#: Tolerances of money, percentages and quantities.
MONEY_TOLERANCE, PERCENT_TOLERANCE, QUANTITY_TOLERANCE = "0.01", "0.01", "0.001"


def dec(x: str | int) -> Column:
    return F.lit(str(x)).cast(MONEY)


def to_decimal(text: Column) -> Column:
    """Blanks trimmed, thousands separators dropped; null for anything that is no plain decimal number (NaN, too)."""
    clean = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    return F.when(clean.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), clean.try_cast(MONEY))


def money_eq(a: Column, b: Column, tolerance: str = MONEY_TOLERANCE) -> Column:
    return F.abs(a - b) <= dec(tolerance)


def money_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), dec(0)).cast(MONEY)


def quantize(x: Column) -> Column:
    return F.round(x.cast(MONEY), 2)


def numeric_value(amount: Column, pct: Column, qty: Column) -> Column:
    return F.coalesce(amount, pct, qty)


def rate_multiplier(value: Column, kind: Column) -> Column:
    """11 % as 0.11; a bare number is taken for a percentage if it exceeds 1."""
    return F.when((kind == "PERCENT") | (value > 1), (value / 100).cast(MONEY)).otherwise(value.cast(MONEY))


def nearer_rate(value: Column, known: Column) -> Column:
    """value or value / 100, whichever is nearer the known rate; a tie is a percentage."""
    percent = (value / 100).cast(MONEY)
    return F.when(F.abs(percent - known) <= F.abs(value - known), percent).otherwise(value.cast(MONEY))


def normal_number(text: Column) -> Column:
    """(100) as -100; everything but digits, point and sign dropped."""
    t = F.trim(text)
    sign = F.when(t.rlike(r"^\(.*\)$"), F.lit("-")).otherwise(F.lit(""))
    return to_decimal(F.concat(sign, F.regexp_replace(t, r"[^0-9.\-]", "")))


def numeric_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)"), F.lit(1))
    return F.filter(F.transform(found, normal_number), lambda x: x.isNotNull())


def is_numeric_cell(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[0-9]")) >= 4) & (F.regexp_count(text, F.lit(r"\p{L}")) <= 2)


def first_digit(text: Column) -> Column:
    """The first significant digit, past zeros, separators and signs; null after any other character."""
    d = F.regexp_extract(F.trim(text.cast("string")), r"^[0.,\-+ ]*([1-9])", 1)
    return F.when(d != "", d.cast("int"))


def luhn_applies(text: Column) -> Column:
    return text.rlike("^[0-9]{13,19}$")


def luhn_ok(name: str) -> Column:
    return F.expr(f"luhn_check({name})")


def jpeg_quality(table: Column) -> Column:
    """Estimated from the mean of the first eight quantisation values. The ladder."""
    mean = F.aggregate(F.slice(table, 1, 8), F.lit(0.0), lambda a, x: a + x) / 8
    ladder = F.when(mean < 5, 95).when(mean < 10, 85).when(mean < 20, 70).when(mean < 35, 55).when(mean < 50, 40).otherwise(25)
    return F.when(F.size(table) >= 8, ladder)


def dpi(px_w: Column, px_h: Column, pt_w: Column, pt_h: Column) -> Column:
    return F.round((px_w / (pt_w / 72) + px_h / (pt_h / 72)) / 2).cast("int")


def channel_difference(a: Column, b: Column) -> Column:
    part = lambda c, s: F.shiftright(c, s).bitwiseAND(255)
    return F.greatest(*(F.abs(part(a, s) - part(b, s)) for s in (16, 8, 0)))


def is_near_white(color: Column, least: int = 0xEF) -> Column:
    """By channel, so that a saturated colour is not taken for white."""
    part = lambda s: F.shiftright(color, s).bitwiseAND(255)
    return F.least(part(16), part(8), part(0)) >= least


def style_bits(flags: Column) -> Column:
    """Italic, serif and bold bits of a font's flags."""
    return flags.bitwiseAND(26)


def page_of(observation_id: Column) -> Column:
    return F.floor(observation_id / 1000).cast("int")


def observation_id(page: Column, index: Column) -> Column:
    return (page * 1000 + index).cast("int")
