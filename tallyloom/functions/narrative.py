"""Identifiers and masks in free text: a small grammar of key words and tokens."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is letters and digits, its parts joined by dashes.
_PART = "[A-Z0-9]"
TOKEN = f"{_PART}[A-Z0-9-]"


@dataclass(frozen=True)
class Shape:
    """An identifier: one of some key words, perhaps fillers, a joint, then a token.

    ``kept`` tells that the key word belongs to the identifier.  ``provider`` names who
    issues it.
    """

    kind: str
    name: str
    words: tuple[str, ...]
    token: str
    joint: str = r"[-\s#]?"
    fillers: tuple[str, ...] = ()
    kept: bool = False
    provider: str = ""
    cased: bool = False

    @property
    def pattern(self) -> str:
        """The regular expression; its first group is the identifier."""
        head = "(?:" + "|".join(self.words) + ")" if self.words else ""
        between = rf"(?:\s*\b(?:{'|'.join(self.fillers)})\b)*" if self.fillers else ""
        inner = f"({head}{between}{self.joint}{self.token})" if self.kept else f"{head}{between}{self.joint}({self.token})"
        return ("" if self.cased else "(?i)") + rf"\b{inner}\b"


#: A token of three signs or more, one of them a digit.
_NUMBERED = rf"(?=[A-Z-]*[0-9])(?={TOKEN}{{2}}){_PART}+(?:-{_PART}+)*"
_PAYOUT_WORDS = ("PAYOUTS?", "SETTLEMENT", "BATCH", "TRANSFER", "DEPOSIT")


def _brand(provider: str) -> Shape:
    return Shape("settlement_id", f"{provider}_payout", (provider.upper(),), _NUMBERED, r"[\s:/-]*", _PAYOUT_WORDS, provider=provider)


# Key words of narratives in order of precedence.
SHAPES = (
    _brand("stripe"),
    Shape("settlement_id", "stripe_short", ("STRP",), f"{_PART}{{4,}}", "-?", kept=True, provider="stripe"),
    Shape("settlement_id", "payout_key", ("po_",), "[A-Za-z0-9]{8,}", "", kept=True, provider="stripe", cased=True),
    _brand("paypal"),
    _brand("adyen"),
    Shape("invoice_number", "invoice", ("INV", "INVOICE", "RECHNUNG", "FACTUUR"), "[A-Z]?[0-9][A-Z0-9-]*", kept=True),
    Shape("purchase_order", "order", ("PO", r"P\.O\.", "ORDER"), f"{TOKEN}{{2,}}"),
    Shape("check_number", "check", ("CHK", "CHECK", "CHEQUE"), "[0-9]{3,}"),
    Shape("counterparty_account", "iban", (), "[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", "", cased=True),
    Shape("reference", "end_to_end", ("EREF",), "[A-Z0-9-]{4,}", r"[-:\s]?"),
)


def _normalized(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(value), "[^A-Z0-9]+", ""), F.lit(""))


def extract_references(text: Column) -> Column:
    """array<struct<kind, value, normalized, provider, shape>> of the identifiers in a narrative,
    without repeats of (kind, normalised); empty for null."""

    def matches(shape: Shape) -> Column:
        values = F.coalesce(F.regexp_extract_all(text, F.lit(shape.pattern), 1), F.array().cast("array<string>"))
        provider = F.lit(shape.provider or None).cast("string").alias("provider")
        return F.transform(values, lambda v: F.struct(F.lit(shape.kind).alias("kind"), v.alias("value"), _normalized(v).alias("normalized"), provider, F.lit(shape.name).alias("shape")))

    found = F.flatten(F.array(*[matches(s) for s in SHAPES]))
    label = lambda x: F.concat(x["kind"], F.lit("|"), F.coalesce(x["normalized"], F.lit("")))
    labels = F.transform(found, label)
    return F.filter(found, lambda x, k: F.array_position(labels, label(x)) == k + 1)


def first_of(found: Column, *kinds: str) -> Column:
    """The first value of ``extract_references`` of one of the kinds, in the order of kinds."""
    at = lambda kind: F.get(F.filter(found, lambda x: x["kind"] == kind), F.lit(0))["value"]
    return F.coalesce(*[at(k) for k in kinds])


def trailing_entity(text: Column) -> Column:
    """The name in the last part of a narrative that slashes or bars divide; null without such
    a mark, or if that part is no name of three letters and more."""
    parts = F.split(text, "[/|]")
    last = F.trim(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & last.rlike(r"\A[A-Za-z][A-Za-z0-9 .&'-]{2,}\z"), last)


# What masks stand for, in the order they are set.
MASKS = (
    (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "[IBAN]"),
    (r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "[CARD]"),
    (r"\b[A-Za-z0-9_.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"\b[0-9]{9,}\b", "[ACCOUNT]"),
)


def masked(text: Column) -> Column:
    """Free text with account numbers, cards and addresses masked."""
    return reduce(lambda column, mask: F.regexp_replace(column, mask[0], mask[1]), MASKS, text)


def mask_count(text: Column) -> Column:
    """How many masks ``masked`` sets; null for null."""
    total, column = F.lit(0), text
    for pattern, word in MASKS:
        total = total + F.regexp_count(column, F.lit(pattern))
        column = F.regexp_replace(column, pattern, word)
    return total


# Parts of key names whose values are never shown.
SECRET_KEYS = ("access_token", "account_number", "api_key", "api_secret", "authorization", "bank_account", "client_secret", "credential", "iban", "password", "private_key", "refresh_token", "secret", "token")


def redacted_map(entries: Column) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("|".join(SECRET_KEYS)), F.lit("[REDACTED]")).otherwise(v))


def redacted_json(text: Column) -> Column:
    """JSON text with the scalar values of secret keys replaced, at any depth: a key is followed
    by its value wherever it stands, so no tree is built."""
    key = rf'("[^"]*(?:{"|".join(SECRET_KEYS)})[^"]*"\s*:\s*)'
    return F.regexp_replace(text, rf'(?i){key}(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)', '$1"[REDACTED]"')
