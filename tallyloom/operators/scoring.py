"""Evidence of a pair of records: features, score, reasons and warnings, as Columns.

The pair table has the fields of both records as ``a_<field>`` and ``b_<field>``; fields that
a source does not have are taken as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.functions.text import description_contains

# What each kind of evidence weighs.
WEIGHTS = {"external_id": 45.0, "settlement": 40.0, "reference": 35.0, "invoice": 35.0, "amount": 25.0, "narrative": 15.0, "counterparty": 10.0, "date": 10.0, "currency": 5.0, "description": 5.0}
#: Similarity that counts at least, and what the lack of any equal identifier adds to the whole.
FLOOR, NO_IDENTIFIER = 0.85, 45.0
# Types of the fields that the features read.
_TYPES = {"amount": "decimal(24,8)", "net_amount": "decimal(24,8)", "best_date": "date", "value_date": "date"}
_TEXTS = ("currency", "reference", "normalized_reference", "invoice_number", "normalized_invoice_number", "normalized_counterparty", "normalized_description", "description", "external_transaction_id", "settlement_id", "payout_id", "batch_id")


def _completed(pairs: DataFrame) -> DataFrame:
    types = {**_TYPES, **dict.fromkeys(_TEXTS, "string")}
    missing = {f"{side}_{f}": F.lit(None).cast(t) for side in "ab" for f, t in types.items() if f"{side}_{f}" not in pairs.columns}
    return pairs.withColumns(missing) if missing else pairs


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, [_true(t) for t in tests])


def features(pairs: DataFrame) -> DataFrame:
    """The pairs with 16 features as ``f_*``; a missing value is no evidence, never agreement."""
    pairs = _completed(pairs)
    ids = ("settlement_id", "payout_id", "batch_id")
    same_set = _any([F.upper(_a(x)) == F.upper(_b(y)) for x in ids for y in ids])
    needles = ("settlement_id", "payout_id", "external_transaction_id", "invoice_number", "reference")
    told = _any([description_contains(F.col(f"{theirs}_{n}"), F.col(f"{mine}_description")) for mine, theirs in ("ab", "ba") for n in needles])
    difference = F.abs(_a("amount") - _b("amount"))
    party = F.greatest(sim.jaro_winkler_similarity(_a("normalized_counterparty"), _b("normalized_counterparty")), sim.trigram_similarity(_a("normalized_counterparty"), _b("normalized_counterparty")))
    inv, ref = "normalized_invoice_number", "normalized_reference"
    return pairs.withColumns(
        {
            "f_amount_exact": _true(_a("amount") == _b("amount")),
            "f_amount_difference": difference,
            "f_amount_share": difference / F.nullif(F.abs(_b("amount")), F.lit(0).cast("decimal(24,8)")),
            "f_net_exact": _any([_a("amount") == _b("net_amount"), _b("amount") == _a("net_amount")]),
            "f_currency_exact": _true(_a("currency") == _b("currency")),
            "f_reference_exact": _true(_a(ref) == _b(ref)),
            "f_reference_similarity": F.coalesce(sim.jaro_winkler_similarity(_a(ref), _b(ref)), F.lit(0.0)),
            "f_invoice_exact": _any([_a(inv) == _b(inv), _a(inv) == _b(ref), _b(inv) == _a(ref)]),
            "f_counterparty_exact": _true(_a("normalized_counterparty") == _b("normalized_counterparty")),
            "f_counterparty_similarity": F.coalesce(party, F.lit(0.0)),
            "f_days": F.abs(F.datediff(_a("best_date"), _b("best_date"))),
            "f_value_days": F.abs(F.datediff(_a("value_date"), _b("value_date"))),
            "f_settlement_exact": same_set,
            "f_external_exact": _true(F.upper(_a("external_transaction_id")) == F.upper(_b("external_transaction_id"))),
            "f_description_similarity": F.coalesce(sim.token_set_ratio(_a("normalized_description"), _b("normalized_description")), F.lit(0.0)),
            "f_narrative": told,
        }
    )


def strong_identifier() -> Column:
    return F.col("f_external_exact") | F.col("f_settlement_exact") | F.col("f_reference_exact") | F.col("f_invoice_exact")


def score(tolerance: float = 0.01, window_days: int = 3) -> Column:
    """Evidence that agrees over evidence that could be compared, 6 places.

    A kind of evidence enters only if both records carry the field; an identifier told in
    a description counts only for, never against; without any equal identifier the whole
    is greater by ``NO_IDENTIFIER``.
    """
    both = lambda *names: reduce(lambda x, y: x | y, [_a(n).isNotNull() for n in names]) & reduce(lambda x, y: x | y, [_b(n).isNotNull() for n in names])
    graded = lambda exact, alike: F.when(F.col(exact), 1.0).when(F.col(alike) >= FLOOR, F.col(alike)).otherwise(0.0)
    flag = lambda name: F.col(name).cast("double")
    limit = F.lit(tolerance).cast("decimal(24,8)")
    near = F.when(F.col("f_amount_difference") <= limit, 1.0 - F.col("f_amount_difference").cast("double") / tolerance) if tolerance > 0 else F.lit(0.0)
    amount = F.when(F.col("f_amount_exact") | F.col("f_net_exact"), 1.0).otherwise(F.coalesce(near, F.lit(0.0)))
    alike = F.when(F.col("f_description_similarity") >= FLOOR, F.col("f_description_similarity")).otherwise(0.0)
    signals = (
        ("external_id", both("external_transaction_id"), flag("f_external_exact")),
        ("settlement", both("settlement_id", "payout_id", "batch_id"), flag("f_settlement_exact")),
        ("reference", both("normalized_reference"), graded("f_reference_exact", "f_reference_similarity")),
        ("invoice", both("normalized_invoice_number"), flag("f_invoice_exact")),
        ("amount", F.lit(True), amount),
        ("currency", F.lit(True), flag("f_currency_exact")),
        ("counterparty", both("normalized_counterparty"), graded("f_counterparty_exact", "f_counterparty_similarity")),
        ("description", both("normalized_description"), alike),
        ("date", F.col("f_days").isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.col("f_days") / F.lit(max(window_days, 1) + 1))),
        ("narrative", F.col("f_narrative"), F.lit(1.0)),
    )
    earned = reduce(lambda x, y: x + y, [F.when(known, WEIGHTS[n] * part).otherwise(0.0) for n, known, part in signals])
    whole = reduce(lambda x, y: x + y, [F.when(known, WEIGHTS[n]).otherwise(0.0) for n, known, _ in signals])
    whole = whole + F.when(strong_identifier(), 0.0).otherwise(NO_IDENTIFIER)
    return F.round(F.least(earned / whole, F.lit(1.0)), 6)


def confidence(scored: Column) -> Column:
    """The score as it stands, at most 1; it is not calibrated."""
    return F.round(F.least(scored, F.lit(1.0)), 6)


def reasons() -> Column:
    """array<struct<code, text>>: what speaks for a pair, identifiers first, then amount, currency,
    date and likeness."""
    say = lambda test, code, words, *values: F.when(test, F.struct(F.lit(code).alias("code"), F.format_string(words, *[F.coalesce(v.cast("string"), F.lit("-")) for v in values]).alias("text")))
    f = F.col
    share = lambda name: F.round(100 * f(name), 0).cast("int")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    listed = [
        say(f("f_external_exact"), "EXTERNAL_ID_EXACT", "Both name external id %s.", _a("external_transaction_id")),
        say(f("f_settlement_exact"), "SETTLEMENT_REFERENCE_EXACT", "Both name settlement %s.", F.coalesce(_a("settlement_id"), _a("payout_id"), _a("batch_id"))),
        say(f("f_reference_exact"), "REFERENCE_EXACT", "Both carry reference %s.", _a("normalized_reference")),
        say(f("f_invoice_exact"), "INVOICE_EXACT", "Both name invoice %s.", F.coalesce(_a("normalized_invoice_number"), _b("normalized_invoice_number"))),
        say(f("f_amount_exact"), "AMOUNT_EXACT", "The amounts are equal: %s %s.", _a("currency"), _a("amount").cast("decimal(24,2)")),
        say(~f("f_amount_exact") & f("f_net_exact"), "NET_AMOUNT_EXACT", "One amount is the other's net amount: %s %s.", _a("currency"), _a("amount").cast("decimal(24,2)")),
        say(~f("f_amount_exact") & ~f("f_net_exact") & (f("f_amount_difference") > 0), "AMOUNT_WITHIN_TOLERANCE", "The amounts differ by %s %s.", _a("currency"), f("f_amount_difference").cast("decimal(24,2)")),
        say(f("f_currency_exact"), "CURRENCY_EXACT", "Both are in %s.", _a("currency")),
        say(f("f_days") == 0, "DATE_SAME_DAY", "Both are of %s.", day(_a("best_date"))),
        say(f("f_days") == 1, "DATE_WITHIN_1_DAY", "A day lies between %s and %s.", day(_a("best_date")), day(_b("best_date"))),
        say(f("f_days") > 1, "DATE_WITHIN_WINDOW", "%s days lie between them.", f("f_days")),
        say(f("f_narrative"), "DESCRIPTION_CONTAINS_REFERENCE", "A description names the other's identifier."),
        say(~f("f_reference_exact") & (f("f_reference_similarity") >= FLOOR), "REFERENCE_SIMILAR", "The references are %s%% alike.", share("f_reference_similarity")),
        say(f("f_counterparty_exact"), "COUNTERPARTY_EXACT", "Both name %s.", _a("normalized_counterparty")),
        say(~f("f_counterparty_exact") & (f("f_counterparty_similarity") >= FLOOR), "COUNTERPARTY_SIMILAR", "The names are %s%% alike.", share("f_counterparty_similarity")),
        say(f("f_description_similarity") >= FLOOR, "DESCRIPTION_SIMILAR", "The descriptions share %s%% of their words.", share("f_description_similarity")),
    ]
    return F.filter(F.array(*listed), lambda x: x.isNotNull())


def warnings(tolerance: float = 0.01, window_days: int = 3, material: float = 50_000.0) -> Column:
    """array<string>: codes of what speaks against a pair; those that begin with CONFLICT are hard.

    Two identifiers disagree only if both hold a digit; a differing reference is no hard
    conflict where invoice, settlement or external id agree.
    """
    digit = lambda c: c.rlike("[0-9]")
    differ = lambda name, same: digit(_a(name)) & digit(_b(name)) & (_a(name) != _b(name)) & ~F.col(same)
    backed = F.col("f_invoice_exact") | F.col("f_external_exact") | F.col("f_settlement_exact")
    references = differ("normalized_reference", "f_reference_exact")
    gap = F.col("f_amount_difference") > F.lit(tolerance).cast("decimal(24,8)")
    listed = [
        F.when(_a("currency") != _b("currency"), "CONFLICT_CURRENCY_MISMATCH"),
        F.when(references & backed, "REFERENCE_DIFFERS").when(references, "CONFLICT_REFERENCE_DISAGREES"),
        F.when(differ("normalized_invoice_number", "f_invoice_exact"), "CONFLICT_INVOICE_DISAGREES"),
        F.when(_a("external_transaction_id").isNotNull() & _b("external_transaction_id").isNotNull() & ~F.col("f_external_exact"), "CONFLICT_EXTERNAL_ID_DISAGREES"),
        F.when(F.col("f_days").isNull(), "NO_COMPARABLE_DATE").when(F.col("f_days") > window_days, "DATE_OUTSIDE_WINDOW"),
        F.when(~F.col("f_amount_exact") & ~F.col("f_net_exact") & gap, "AMOUNT_OUTSIDE_TOLERANCE"),
        F.when(F.abs(_a("amount")) >= F.lit(material).cast("decimal(24,8)"), "ABOVE_MATERIALITY"),
    ]
    return F.filter(F.array(*listed), lambda x: x.isNotNull())


def hard_conflicts(codes: Column) -> Column:
    return F.size(F.filter(codes, lambda c: c.startswith("CONFLICT_")))


def eligible(tolerance: float = 0.01, share: float | None = None, window_days: int = 5, fx: bool = False, opposite: bool = False, same_account: bool = False) -> Column:
    """Whether two records could be related at all: currency, status, account, amount by
    difference or share, direction, and days where both are dated."""
    off = lambda c: F.coalesce(F.upper(c).isin("VOID", "CANCELLED", "FAILED"), F.lit(False))
    difference = F.abs(_a("amount") - _b("amount"))
    near = difference <= F.lit(tolerance).cast("decimal(24,8)")
    if share is not None:
        near = near | _true(difference / F.nullif(F.abs(_b("amount")), F.lit(0).cast("decimal(24,8)")) <= F.lit(share).cast("decimal(24,8)"))
    test = near & ~off(_a("status")) & ~off(_b("status")) & F.coalesce(F.abs(F.datediff(_a("best_date"), _b("best_date"))) <= window_days, F.lit(True))
    if not fx:
        test = test & (_a("currency") == _b("currency"))
    if opposite:
        test = test & ((_a("amount") > 0) != (_b("amount") > 0))
    if same_account:
        test = test & _a("source_account_id").eqNullSafe(_b("source_account_id"))
    return _true(test)
