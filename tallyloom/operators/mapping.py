"""Mapping the columns of a delivery to fields: suggestion, validation, application.

A mapping is data.  Applied to a table of text columns it is one projection: typed fields
and an ``_errors`` array; rows are never dropped and never repaired.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import narrative as nv
from tallyloom.functions import text as tx
from tallyloom.functions.formats import date_by_label, parsed_amount, safe_date
from tallyloom.functions.values import CREDIT_WORDS, DEBIT_WORDS

# Fields with the kind of their values and the words of headers that name them, in order of precedence.
FIELDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "settlement_id": ("text", ("SETTLEMENTID", "SETTLEMENT")),
    "payout_id": ("text", ("PAYOUTID", "PAYOUT")),
    "external_transaction_id": ("text", ("TRANSACTIONID", "TXNID", "CHARGEID", "EXTERNALID", "PAYMENTID", "SOURCEID")),
    "invoice_number": ("text", ("INVOICENUMBER", "INVOICENO", "INVOICE", "INVNO", "BILLNO")),
    "purchase_order": ("text", ("PURCHASEORDER", "PONUMBER", "PONO")),
    "check_number": ("text", ("CHECKNUMBER", "CHEQUENUMBER", "CHECKNO", "CHKNO")),
    "bank_reference": ("text", ("BANKREFERENCE", "BANKREF", "ENDTOEND", "EREF")),
    "reference": ("text", ("REFERENCE", "PAYMENTREFERENCE", "REF", "MEMO", "REMITTANCE")),
    "counterparty_account": ("text", ("IBAN", "COUNTERPARTYACCOUNT", "BENEFICIARYACCOUNT", "ACCOUNTNUMBER")),
    "counterparty_name": ("text", ("COUNTERPARTY", "PAYEE", "PAYER", "BENEFICIARY", "CUSTOMERNAME", "VENDORNAME", "NAME")),
    "description": ("text", ("DESCRIPTION", "NARRATIVE", "DETAILS", "PARTICULARS", "TRANSACTIONDETAILS", "TEXT")),
    "gross_amount": ("amount", ("GROSSAMOUNT", "GROSS")),
    "fee_amount": ("amount", ("FEEAMOUNT", "FEE", "FEES", "CHARGE", "COMMISSION")),
    "tax_amount": ("amount", ("TAXAMOUNT", "TAX", "VAT")),
    "net_amount": ("amount", ("NETAMOUNT", "NET", "NETSETTLEMENT")),
    "original_amount": ("amount", ("ORIGINALAMOUNT", "FOREIGNAMOUNT")),
    "original_currency": ("currency", ("ORIGINALCURRENCY", "FOREIGNCURRENCY")),
    "fx_rate": ("amount", ("FXRATE", "EXCHANGERATE", "RATE")),
    "currency": ("currency", ("CURRENCY", "CCY", "CUR")),
    "amount": ("amount", ("AMOUNT", "VALUE", "SUM", "BETRAG", "MONTANT")),
    "settlement_date": ("date", ("SETTLEMENTDATE", "SETTLEDAT")),
    "value_date": ("date", ("VALUEDATE", "VALUTA")),
    "posting_date": ("date", ("POSTINGDATE", "POSTEDDATE", "BOOKINGDATE", "BOOKDATE")),
    "transaction_date": ("date", ("TRANSACTIONDATE", "DATE", "TXNDATE", "CREATEDAT", "DATUM", "OPERATIONDATE")),
    "status": ("text", ("STATUS", "STATE")),
    "transaction_type": ("text", ("TYPE", "TRANSACTIONTYPE", "ENTRYTYPE")),
    "debit_credit": ("text", ("DEBITCREDIT", "DRCR", "DC", "SIGN")),
    "customer_id": ("text", ("CUSTOMERID", "CUSTOMERNO", "CLIENTID")),
    "vendor_id": ("text", ("VENDORID", "SUPPLIERID")),
    "batch_id": ("text", ("BATCHID", "BATCH")),
    "source_account_id": ("text", ("ACCOUNT", "ACCOUNTID", "GLACCOUNT", "LEDGERACCOUNT")),
    "source_record_id": ("text", ("ID", "ROWID", "RECORDID", "LINEID", "ENTRYID")),
}
#: Kinds of columns (as ``checks.column_kinds`` names them) that may hold a kind of field.
FITTING = {"date": {"date"}, "amount": {"amount", "integer"}, "currency": {"currency", "text"}}


@dataclass(frozen=True)
class Bound:
    """A column bound to a field; ``form`` is a date label or, for amounts, ``COMMA_DECIMAL``."""

    column: str
    form: str | None = None
    negate: bool = False
    confidence: float = 1.0


@dataclass(frozen=True)
class Mapping:
    """field -> column, constants, and the two columns of a signless amount."""

    columns: dict[str, Bound] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    debit: str | None = None
    credit: str | None = None
    comma: bool = False

    def faults(self) -> list[str]:
        """Why it can't give a valid row; empty if it can."""
        out = [f"unknown field {f}" for f in [*self.columns, *self.constants] if f not in FIELDS]
        used = [b.column for b in self.columns.values()]
        out += [f"column {c} is bound twice" for c in sorted({c for c in used if used.count(c) > 1})]
        if "amount" not in self.columns and not (self.debit and self.credit):
            out.append("an amount, or a debit and a credit column, is needed")
        if "currency" not in self.columns and "currency" not in self.constants:
            out.append("a currency is needed")
        return out


def suggested(profile: Iterable[tuple[str, str]]) -> Mapping:
    """A mapping for columns (name, kind) in the order of the file: the words of the header say
    what a column is, its kind whether it can be.  Equal words weigh 0.95, contained ones
    0.7; the first column that has one of either takes the field."""
    left, bound = list(profile), {}
    for name, (kind, words) in FIELDS.items():
        for column, actual in left:
            header = re.sub("[^A-Z0-9]+", "", column.upper())
            if any(w in header for w in words) and (kind == "text" or actual in FITTING[kind]) and actual != "empty":
                bound[name] = Bound(column, confidence=0.95 if header in words else 0.7)
                left.remove((column, actual))
                break
    return Mapping(bound)


def _typed(raw: Column, kind: str, b: Bound) -> Column:
    if kind == "date":
        return date_by_label(raw, b.form) if b.form else safe_date(raw)
    if kind == "amount":
        value = parsed_amount(raw, b.form == "COMMA_DECIMAL")
        return -value if b.negate else value
    return F.upper(raw) if kind == "currency" else raw


def apply_mapping(rows: DataFrame, mapping: Mapping, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, one typed column a field, and ``_errors`` (array of text, empty for
    good rows).

    A filled value that can't be read is an error; a null or blank one is just missing,
    save amount and currency, which every row needs.  Of a debit and a credit column exactly
    one may be filled with a value other than zero.  Empty fields reference, invoice
    number, settlement id and counterparty are filled from the description.  A mapping
    with faults is refused; an empty table gives an empty one.
    """
    if faults := mapping.faults():
        raise ValueError("; ".join(faults))
    keep = keep or []
    cell = lambda name: F.nullif(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))
    fields: dict[str, Column] = {}
    errors: list[Column] = []
    for name, b in mapping.columns.items():
        kind = FIELDS[name][0]
        fields[name] = _typed(cell(b.column), kind, b)
        if kind in ("date", "amount"):
            errors.append(F.when(cell(b.column).isNotNull() & fields[name].isNull(), F.lit(f"{name} can't be read")))
    for name, value in mapping.constants.items():
        constant = F.lit(value.upper() if FIELDS[name][0] == "currency" else value)
        fields[name] = F.coalesce(fields[name], constant) if name in fields else constant
    word = fields.pop("debit_credit", F.lit(None).cast("string"))
    direction = F.when(F.upper(word).isin(*DEBIT_WORDS), "debit").when(F.upper(word).isin(*CREDIT_WORDS), "credit")
    if mapping.debit and mapping.credit:
        sides = {}
        for side, column in (("debit", mapping.debit), ("credit", mapping.credit)):
            sides[side] = parsed_amount(cell(column), mapping.comma)
            errors.append(F.when(cell(column).isNotNull() & sides[side].isNull(), F.lit(f"{side} can't be read")))
        debit, credit = (F.nullif(sides[s], F.lit(0).cast("decimal(24,8)")) for s in ("debit", "credit"))
        errors.append(F.when(debit.isNotNull() & credit.isNotNull(), F.lit("both a debit and a credit")).when(debit.isNull() & credit.isNull(), F.lit("neither a debit nor a credit")))
        fields["amount"] = F.when(debit.isNotNull() & credit.isNull(), F.abs(debit)).when(credit.isNotNull() & debit.isNull(), -F.abs(credit))
        direction = F.when(debit.isNotNull(), "debit").when(credit.isNotNull(), "credit")
    fields["debit_credit"] = F.coalesce(direction, F.when(fields["amount"] > 0, "debit").when(fields["amount"] < 0, "credit").otherwise("unknown"))
    errors.append(F.when(fields["amount"].isNull(), F.lit("amount is missing")))
    errors.append(F.when(F.coalesce(fields["currency"], F.lit("")) == "", F.lit("currency is missing")))
    typed = rows.select(*[F.col(f"`{k}`") for k in keep], *[c.alias(n) for n, c in fields.items()], F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("_errors"))
    return promoted(typed)


def promoted(df: DataFrame) -> DataFrame:
    """Fields that are empty filled from identifiers in the description, and the fields that
    are compared in normal form."""
    none = F.lit(None).cast("string")
    have = lambda name: F.col(name) if name in df.columns else none
    found = df.withColumn("_found", nv.extract_references(have("description")))
    ids = F.col("_found")
    filled = {
        "reference": F.coalesce(have("reference"), nv.first_of(ids, "reference", "settlement_id")),
        "invoice_number": F.coalesce(have("invoice_number"), nv.first_of(ids, "invoice_number")),
        "settlement_id": F.coalesce(have("settlement_id"), nv.first_of(ids, "settlement_id")),
        "counterparty_name": F.coalesce(have("counterparty_name"), nv.trailing_entity(have("description"))),
        "description": have("description"),
    }
    out = found.withColumns(filled).drop("_found")
    return out.withColumns(
        {
            "normalized_description": tx.normalize_bank_description(F.col("description")),
            "normalized_reference": tx.normalize_reference(F.col("reference")),
            "normalized_invoice_number": tx.normalize_invoice_number(F.col("invoice_number")),
            "normalized_counterparty": tx.normalize_name(F.col("counterparty_name")),
        }
    )
