"""Functions from columns to columns: masks, standard forms, dates, bands, digests, amounts.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGACY_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm")


def email_token(c: Column) -> Column:
    """SHA-256 of the trimmed, lower-case address: it can be counted and joined on, not read.  Null stays null."""
    return F.sha2(F.lower(F.trim(c)), 256)


def phone_digits(c: Column) -> Column:
    """The last ten digits; null if there are fewer."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def phone_hint(c: Column) -> Column:
    """XXXXXX and the last four digits of a valid number."""
    return F.concat(F.lit("XXXXXX"), F.right(phone_digits(c), F.lit(4)))


def city_name(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(c)))


def legacy_timestamp(c: Column, formats: tuple[str, ...] = LEGACY_FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def band(c: Column, edges: dict[str, float], above: str) -> Column:
    """The first name whose edge lies above the value; null is `above`, as a comparison with it is not true."""
    out = None
    for name, edge in edges.items():
        out = F.when(c < edge, name) if out is None else out.when(c < edge, name)
    return out.otherwise(above)


def fiscal_year(c: Column, first_month: int = 4) -> Column:
    return F.concat(F.lit("FY"), (F.year(c) + (F.month(c) >= first_month).cast("int")).cast("string"))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns as text, each after its length, and a dash for null: no two different rows are written alike."""
    said = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(said(F.col(c).cast("string")) for c in columns)), 256)


def digest_number(digest: Column) -> Column:
    """The first 15 hex digits of a digest as a decimal that can be summed up."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def amounts(quantity: Column, price: Column, percent: Column) -> dict[str, Column]:
    """Gross, discount (rounded half up to cents) and net amount of an order line, each decimal(14,2)."""
    gross = quantity * price
    discount = F.round(gross * percent * F.lit("0.01").cast("decimal(3,2)"), 2)
    return {
        "gross_amount": gross.cast("decimal(14,2)"), "discount_amount": discount.cast("decimal(14,2)"),
        "net_amount": (gross - discount).cast("decimal(14,2)")
    }


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole, one decimal place; null where whole is zero or null."""
    return F.round(F.try_divide(100 * part.cast("double"), whole.cast("double")), 1)
