"""Money as whole minor units: rates by floor, formatting, strict parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.types import FEE_BPS, TAX_BPS


def pct_of(amount: Column, bps: int) -> Column:
    """amount * bps / 10000, rounded toward minus infinity in whole numbers."""
    product = amount * F.lit(bps).cast("long")
    return F.call_function("div", product - F.pmod(product, F.lit(10_000).cast("long")), F.lit(10_000).cast("long"))


def expected_fee_and_tax(gross: Column) -> tuple[Column, Column]:
    fee = pct_of(gross, FEE_BPS)
    return fee, pct_of(fee, TAX_BPS)


def rupees(paise: Column) -> Column:
    """A decimal with two places as text."""
    size = F.abs(paise)
    text = F.concat(F.floor(size / 100).cast("long").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.when(paise < 0, F.concat(F.lit("-"), text)).otherwise(text)


def fmt_inr(paise: Column) -> Column:
    """₹1,234.56, the sign first."""
    size = F.abs(paise)
    text = F.concat(F.lit("₹"), F.format_number(F.floor(size / 100).cast("long"), 0), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.when(paise < 0, F.concat(F.lit("-"), text)).otherwise(text)


#: An optional sign and currency mark, grouped or plain digits, at most two decimals.
AMOUNT = r"^([+-]?)\s*(?:₹|Rs\.?|INR)?\s*([+-]?)([0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]+)(?:\.([0-9]{1,2}))?$"


def parse_paise(text: Column) -> Column:
    """Paise of a rupee amount; null where it isn't one. Fractions of a paisa are refused, never rounded, and so are amounts beyond a long."""
    bare = F.trim(text)
    sign = F.when((F.regexp_extract(bare, AMOUNT, 1) == "-") | (F.regexp_extract(bare, AMOUNT, 2) == "-"), -1).otherwise(1)
    whole = F.regexp_replace(F.regexp_extract(bare, AMOUNT, 3), ",", "")
    cents = F.rpad(F.regexp_extract(bare, AMOUNT, 4), 2, "0")
    return F.when(bare.rlike(AMOUNT), sign.cast("long") * F.expr("1L") * F.concat(whole, cents).try_cast("long"))


def parse_comma_amount(text: Column) -> Column:
    """Paise of an amount of up to 15 whole digits, with at most one decimal comma and two decimals; null where it isn't one."""
    shape = r"^([0-9]{1,15})(?:,([0-9]{0,2}))?$"
    return F.when(text.rlike(shape), F.concat(F.regexp_extract(text, shape, 1), F.rpad(F.regexp_extract(text, shape, 2), 2, "0")).try_cast("long"))


def strict_long(text: Column) -> Column:
    """A canonical file's amount: a sign and digits, nothing else; null where it isn't one."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))


def parse_date(text: Column, *formats: str) -> Column:
    """The date by the first format that fits; null otherwise."""
    return F.coalesce(*(F.try_to_date(F.trim(text), f) for f in formats))
