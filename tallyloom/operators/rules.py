"""Matching rules as data, compiled to Columns over a table of pairs.

A pair table has the fields of both records as ``a_<field>`` and ``b_<field>``.  Each
condition becomes two Columns, whether it holds and how strongly, so a whole rule set is
a projection that the engine compiles; nothing is looked up row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.functions.text import description_contains

# The fields that rules may name, and the column that stands for each.
RULE_FIELDS = {
    **{f: f for f in ("amount", "gross_amount", "fee_amount", "net_amount", "tax_amount", "currency", "external_transaction_id", "bank_reference", "settlement_id", "payout_id", "batch_id", "counterparty_account", "check_number", "purchase_order", "customer_id", "vendor_id", "source_account_id", "transaction_date", "posting_date", "value_date", "settlement_date")},
    "reference": "normalized_reference", "raw_reference": "reference", "invoice_number": "normalized_invoice_number", "counterparty": "normalized_counterparty",
    "description": "normalized_description", "raw_description": "description", "date": "best_date",
}


@dataclass(frozen=True)
class Condition:
    """``field`` of one record against ``other`` (by default the same) of the other one."""

    field: str
    operator: str
    value: float | None = None
    other: str | None = None
    weight: float = 1.0
    hard: bool = True
    code: str = ""


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: tuple[Condition, ...]
    deterministic: bool = False
    same_currency: bool = True
    opposite: bool = False
    most_difference: float | None = None
    most_days: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.conditions)


def ordered(rules: list[Rule]) -> list[Rule]:
    """Deterministic rules first, then by falling weight, then by name."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("a rule is listed twice")
    return sorted(rules, key=lambda r: (not r.deterministic, -r.weight, r.name))


def _sides(c: Condition) -> tuple[Column, Column]:
    return F.col(f"a_{RULE_FIELDS[c.field]}"), F.col(f"b_{RULE_FIELDS[c.other or c.field]}")


def _days(x: Column, y: Column) -> Column:
    return F.abs(F.datediff(x, y))


def _within(distance: Column, limit: float) -> tuple[Column, Column]:
    strength = F.lit(1.0) if limit == 0 else 1.0 - distance.cast("double") / limit
    return distance <= F.lit(limit).cast("decimal(24,8)"), strength


_ALIKE = {"similarity_at_least": sim.jaro_winkler_similarity, "trigram_at_least": sim.trigram_similarity, "token_set_at_least": sim.token_set_ratio}


def compiled(c: Condition) -> tuple[Column, Column]:
    """(holds, strength); a missing value never holds, and then the strength is 0.

    Exact ones compare as stored, ``normalized_exact`` trimmed and in capitals.  Within a
    number of days, an amount or a share of the other amount, the strength falls with the
    distance; similarities are their own strength; others count 1.  ``contains`` asks
    whether the field of the first record holds the identifier of the second.
    """
    x, y = _sides(c)
    one = F.lit(1.0)
    if c.operator == "both_present":
        holds, strength = x.isNotNull() & y.isNotNull(), one
    elif c.operator == "sign_opposite":
        holds, strength = x * y < 0, one
    elif c.operator == "contains":
        holds, strength = description_contains(y, x), one
    elif c.operator in ("exact", "net_equals"):
        holds, strength = x == y, one
    elif c.operator == "normalized_exact":
        holds, strength = F.upper(F.trim(x)) == F.upper(F.trim(y)), one
    elif c.operator == "within_days":
        distance = _days(x, y)
        holds, strength = distance <= int(c.value), 1.0 - distance / F.lit(int(c.value) + 1)
    elif c.operator == "within_absolute":
        holds, strength = _within(F.abs(x - y), c.value)
    elif c.operator == "within_percentage":
        near, graded = _within(F.abs(x - y) / F.nullif(F.abs(y), F.lit(0).cast("decimal(24,8)")), c.value)
        holds, strength = F.when(y == 0, x == 0).otherwise(near), F.when(y == 0, one).otherwise(graded)
    elif c.operator in _ALIKE:
        strength = _ALIKE[c.operator](x, y)
        holds = strength >= c.value
    else:
        raise ValueError(f"unknown operator: {c.operator}")
    holds = F.coalesce(holds, F.lit(False))
    return holds, F.when(holds, strength).otherwise(0.0)


def rule_filter(rule: Rule) -> Column:
    """The tests before the conditions; an unknown date fails a window."""
    tests = [F.lit(True)]
    if rule.same_currency:
        tests.append(F.col("a_currency") == F.col("b_currency"))
    if rule.opposite:
        tests.append((F.col("a_amount") > 0) != (F.col("b_amount") > 0))
    if rule.most_difference is not None:
        tests.append(F.abs(F.col("a_amount") - F.col("b_amount")) <= F.lit(rule.most_difference).cast("decimal(24,8)"))
    if rule.most_days is not None:
        tests.append(_days(F.col("a_best_date"), F.col("b_best_date")) <= rule.most_days)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return F.coalesce(out, F.lit(False))


def applied(rule: Rule) -> tuple[Column, Column, Column]:
    """(applies, score, codes): whether the filters and hard conditions hold; the weighted
    strength over the whole weight, at most 1, 6 places; the codes of what held."""
    applies, earned, codes = rule_filter(rule), F.lit(0.0), []
    for c in rule.conditions:
        holds, strength = compiled(c)
        if c.hard:
            applies = applies & holds
        earned = earned + c.weight * strength
        codes.append(F.when(holds, F.lit(c.code or f"{c.field}_{c.operator}".upper())))
    score = F.round(F.least(earned / rule.weight, F.lit(1.0)), 6) if rule.weight else F.lit(0.0)
    return applies, score, F.filter(F.array(*codes), lambda x: x.isNotNull())


def rule_scores(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(a_id, b_id, rule, score, codes) for every rule that applies to a pair; one projection."""
    cells = []
    for rule in ordered(rules):
        applies, score, codes = applied(rule)
        cells.append(F.when(applies, F.struct(F.lit(rule.name).alias("rule"), score.alias("score"), codes.alias("codes"))))
    return pairs.select("a_id", "b_id", F.explode(F.array(*cells)).alias("x")).where("x is not null").select("a_id", "b_id", "x.*")


# Rules for bank and ledger rows and for payouts of a processor.
BANK_RULES = (
    Rule("exact_reference", (Condition("amount", "exact", weight=50, code="AMOUNT_EXACT"), Condition("reference", "normalized_exact", weight=50, code="REFERENCE_EXACT")), deterministic=True),
    Rule("exact_external_id", (Condition("external_transaction_id", "normalized_exact", weight=60, code="EXTERNAL_ID_EXACT"), Condition("amount", "exact", weight=40, code="AMOUNT_EXACT")), deterministic=True),
    Rule("invoice_amount_date", (Condition("amount", "exact", weight=45, code="AMOUNT_EXACT"), Condition("invoice_number", "normalized_exact", weight=45, code="INVOICE_EXACT"), Condition("date", "within_days", 3, weight=10, code="DATE_WITHIN_WINDOW")), deterministic=True, most_days=3),
    Rule("amount_date_counterparty", (Condition("amount", "within_absolute", 0.5, weight=40, code="AMOUNT_WITHIN_TOLERANCE"), Condition("date", "within_days", 3, weight=20, code="DATE_WITHIN_WINDOW"), Condition("counterparty", "similarity_at_least", 0.9, weight=40, code="COUNTERPARTY_SIMILAR")), most_days=5),
)
PAYOUT_RULES = (
    Rule("payout_net_and_reference", (Condition("amount", "net_equals", other="net_amount", weight=50, code="NET_AMOUNT_EXACT"), Condition("raw_description", "contains", other="settlement_id", weight=50, code="SETTLEMENT_REFERENCE_EXACT")), deterministic=True, most_days=5),
    Rule("payout_settlement_id", (Condition("settlement_id", "normalized_exact", weight=60, code="SETTLEMENT_REFERENCE_EXACT"), Condition("amount", "within_absolute", 0.0, weight=40, code="AMOUNT_EXACT")), deterministic=True, most_days=7),
)
