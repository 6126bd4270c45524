"""Amounts, dates and identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.formats import parsed_amount
from tallyloom.functions.formats import safe_date as parsed_date

__all__ = ["parsed_amount", "parsed_date"]

# Currencies whose minor unit is not a hundredth.
MINOR_DIGITS = {"BHD": 3, "BIF": 0, "CLP": 0, "DJF": 0, "GNF": 0, "IQD": 3, "ISK": 0, "JOD": 3, "JPY": 0, "KMF": 0, "KRW": 0, "KWD": 3, "LYD": 3, "OMR": 3, "PYG": 0, "RWF": 0, "TND": 3, "UGX": 0, "VND": 0, "VUV": 0, "XAF": 0, "XOF": 0, "XPF": 0}
# Words of a direction column.
DEBIT_WORDS, CREDIT_WORDS = ("D", "DR", "DEBIT", "DB"), ("C", "CR", "CREDIT")

def minor_digits(currency: Column) -> Column:
    odd = F.create_map(*[F.lit(x) for pair in MINOR_DIGITS.items() for x in pair])
    return F.coalesce(odd[currency], F.lit(2))


def minor_units(amount: Column, currency: Column) -> Column:
    """The amount as a whole number of minor units, halves away from zero."""
    digits = minor_digits(currency)
    scaled = F.when(digits == 0, F.round(amount, 0)).when(digits == 3, F.round(amount * 1000, 0)).otherwise(F.round(amount * 100, 0))
    return scaled.cast("long")


def quantized(amount: Column, currency: Column) -> Column:
    """The amount rounded to its currency's minor unit, halves away from zero."""
    digits = minor_digits(currency)
    return F.when(digits == 0, F.round(amount, 0)).when(digits == 3, F.round(amount, 3)).otherwise(F.round(amount, 2)).cast("decimal(24,8)")


def direction(word: Column, amount: Column) -> Column:
    """debit, credit or unknown, from a direction word, else from the sign."""
    w = F.upper(F.trim(word))
    return F.when(w.isin(*DEBIT_WORDS), "debit").when(w.isin(*CREDIT_WORDS), "credit").when(amount > 0, "debit").when(amount < 0, "credit").otherwise("unknown")


def folded_amount(debit: Column, credit: Column) -> Column:
    """One signed amount from two columns; null unless exactly one of them is set."""
    return F.when(debit.isNotNull() & credit.isNull(), F.abs(debit)).when(credit.isNotNull() & debit.isNull(), -F.abs(credit))


def best_date(*dates: Column) -> Column:
    """The first of transaction, posting and value date that is known."""
    return F.coalesce(*dates)


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """Version 5 uuid of a name, without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def row_checksum(*columns: Column) -> Column:
    """SHA-256 over the values in order, null and empty kept apart."""
    cells = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *cells), 256)


def date_distance(x: Column, y: Column) -> Column:
    """Days between two dates, null if one is missing."""
    return F.abs(F.datediff(x, y))


def _same_currency(x_ccy: Column, y_ccy: Column, value: Column) -> Column:
    known = x_ccy.isNotNull() & y_ccy.isNotNull()
    return F.when(known & (x_ccy != y_ccy), F.raise_error(F.lit("amounts of different currencies")).cast("decimal(24,8)")).otherwise(value)


def money_sum(x: Column, x_ccy: Column, y: Column, y_ccy: Column) -> Column:
    """x + y; amounts of different currencies are an error."""
    return _same_currency(x_ccy, y_ccy, (x + y).cast("decimal(24,8)"))


def money_difference(x: Column, x_ccy: Column, y: Column, y_ccy: Column) -> Column:
    """x - y; negative if x is less; amounts of different currencies are an error."""
    return _same_currency(x_ccy, y_ccy, (x - y).cast("decimal(24,8)"))


def within_absolute(x: Column, y: Column, limit: str) -> Column:
    """Whether two amounts differ by at most ``limit``; false if one is missing."""
    return F.coalesce(F.abs(x - y) <= F.lit(limit).cast("decimal(24,8)"), F.lit(False))


def within_share(x: Column, y: Column, share: str) -> Column:
    """Whether x differs from y by at most this share of y; of zero only zero does."""
    near = F.abs(x - y) / F.nullif(F.abs(y), F.lit(0).cast("decimal(24,8)")) <= F.lit(share).cast("decimal(24,8)")
    return F.coalesce(F.when(y == 0, x == 0).otherwise(near), F.lit(False))


def fee_explains(gross: Column, fee: Column, net: Column, limit: str = "0") -> Column:
    """Whether a gross amount less its fee, whatever the sign of the fee, is the net amount."""
    return within_absolute(gross - F.abs(fee), net, limit)


def fx_explains(amount: Column, rate: Column, other: Column, share: str = "0.01") -> Column:
    """Whether an amount at a rate gives the other amount, within a share of it."""
    return within_share((amount * rate).cast("decimal(24,8)"), other, share)
