"""The quality gate of a delivery: findings with a level, and the worst of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Findings and their levels.
FINDINGS = {
    "FILE_EMPTY": "FAIL", "MALFORMED_ROWS": "FAIL", "AMBIGUOUS_DATE_FORMAT": "WARN", "COLUMN_WARNING": "WARN", "ROW_MAPPING_FAILED": "FAIL", "NO_TRANSACTIONS": "FAIL",
    "INVALID_CURRENCY": "FAIL", "MISSING_DATE": "WARN", "DUPLICATE_SOURCE_ROW": "WARN", "DUPLICATE_SOURCE_RECORD_ID": "FAIL", "DUPLICATE_TRANSACTION_ID": "FAIL",
    "HIGH_BLANK_REFERENCE_RATE": "WARN", "INCONSISTENT_SIGNS": "WARN", "MIXED_CURRENCIES": "WARN", "TOTAL_IMBALANCE": "FAIL", "ROW_COUNT_CHANGE": "WARN",
}
#: Share of rows without any identifier, and of change against the delivery before, that are reported.
BLANK_SHARE, CHANGED_SHARE = 0.2, 0.5


def _repeated(rows: DataFrame, key: str, extra: bool) -> DataFrame:
    """One row: the keys that repeat, or the rows beyond the first of each."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n") if extra else F.count("*").alias("n"))


def quality_findings(
    rows: DataFrame,
    errors: int = 0,
    malformed: int = 0,
    read: int | None = None,
    ambiguous: tuple[str, ...] = (),
    warned: tuple[str, ...] = (),
    expected_total: float | None = None,
    rows_before: int | None = None,
) -> DataFrame:
    """(code, level, affected) of what is wrong with mapped rows; no row if nothing is.

    ``rows`` has record_id, external_id, checksum, kind (of transaction), amount, currency, date,
    reference and invoice.  ``errors`` and ``malformed`` count rows that could not be
    mapped or read, ``read`` the rows of the file; ``ambiguous`` and ``warned`` name columns
    with such formats; ``expected_total`` and ``rows_before`` are what the delivery is held
    against.  Three aggregates by key and one over everything, however large the table.
    """
    blank = F.col("reference").isNull() & F.col("invoice").isNull() & F.col("external_id").isNull()
    whole = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(F.length("currency") != 3, F.lit(True))).alias("currency"),
        F.count_if(F.col("date").isNull()).alias("dates"),
        F.count_if(blank).alias("blank"),
        F.sum("amount").alias("total"),
    )
    signs = rows.where("kind is not null").groupBy("kind").agg(F.count_if(F.col("amount") >= 0).alias("p"), F.count_if(F.col("amount") < 0).alias("m")).where("p > 0 and m > 0").agg(F.count("*").alias("signs"))
    currencies = rows.select("currency").distinct().agg(F.count("*").alias("currencies"))
    repeats = {"same_rows": _repeated(rows, "checksum", True), "same_ids": _repeated(rows, "record_id", False), "same_external": _repeated(rows, "external_id", False)}
    one = whole.crossJoin(F.broadcast(signs)).crossJoin(F.broadcast(currencies))  # one row each
    for name, counted in repeats.items():
        one = one.crossJoin(F.broadcast(counted.select(F.col("n").alias(name))))
    some = F.col("rows") > 0
    number = lambda n: F.lit(n).cast("long")
    off = F.lit(False) if expected_total is None else F.coalesce(F.col("total"), F.lit(0)) != F.lit(str(expected_total)).cast("decimal(24,8)")
    moved = F.lit(False) if not rows_before else F.abs(F.col("rows") - rows_before) / rows_before >= CHANGED_SHARE
    found = {
        "FILE_EMPTY": (F.lit(read == 0), number(0)),
        "MALFORMED_ROWS": (F.lit(malformed > 0), number(malformed)),
        "AMBIGUOUS_DATE_FORMAT": (F.lit(bool(ambiguous)), number(len(ambiguous))),
        "COLUMN_WARNING": (F.lit(bool(warned)), number(len(warned))),
        "ROW_MAPPING_FAILED": (F.lit(errors > 0), number(errors)),
        "NO_TRANSACTIONS": (~some & F.lit(read != 0), number(0)),
        "INVALID_CURRENCY": (F.col("currency") > 0, F.col("currency")),
        "MISSING_DATE": (F.col("dates") > 0, F.col("dates")),
        "DUPLICATE_SOURCE_ROW": (F.col("same_rows") > 0, F.col("same_rows")),
        "DUPLICATE_SOURCE_RECORD_ID": (F.col("same_ids") > 0, F.col("same_ids")),
        "DUPLICATE_TRANSACTION_ID": (F.col("same_external") > 0, F.col("same_external")),
        "HIGH_BLANK_REFERENCE_RATE": (some & (F.col("blank") >= BLANK_SHARE * F.col("rows")), F.col("blank")),
        "INCONSISTENT_SIGNS": (F.col("signs") > 0, F.col("signs")),
        "MIXED_CURRENCIES": (F.col("currencies") > 1, F.col("currencies")),
        "TOTAL_IMBALANCE": (some & off, number(1)),
        "ROW_COUNT_CHANGE": (some & moved, F.col("rows")),
    }
    cells = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(FINDINGS[code]).alias("level"), n.cast("long").alias("affected"))) for code, (test, n) in found.items()]
    return one.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")


def gate_level(findings: DataFrame) -> DataFrame:
    """(level): FAIL, WARN or PASS, the worst of the findings."""
    return findings.agg(F.when(F.count_if(F.col("level") == "FAIL") > 0, "FAIL").when(F.count("*") > 0, "WARN").otherwise("PASS").alias("level"))
