"""What a run comes to: leftovers in pairs, summary, ageing, bundles of evidence, certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.narrative import masked
from tallyloom.operators.audit import settings_hash
from tallyloom.operators.checks import age_buckets
from tallyloom.operators.matching import ranked

# States of exceptions that are not open, grave ones, and kinds that are like fees.
CLOSED, GRAVE, FEE_LIKE = ("RESOLVED", "CLOSED"), ("HIGH", "CRITICAL"), ("PROCESSOR_FEE", "BANK_FEE", "ROUNDING_DIFFERENCE")
#: Fields that may be handed on, by task.
ALLOWED = {
    "classify": ("amount", "currency", "description", "reference", "date", "status"),
    "extract": ("description",),
    "resolve": ("counterparty",),
    "summarise": ("difference", "currency", "section", "id", "amount"),
    "propose": ("category", "amount", "currency", "description", "date"),
}


def leftover_pairs(unmatched_a: DataFrame, unmatched_b: DataFrame, scored: DataFrame) -> DataFrame:
    """(a_id, b_id): each unmatched record of side A with its best candidate (null without one), and
    the records of side B that are nobody's best candidate, alone."""
    best = ranked(scored.join(unmatched_a.select(F.col("id").alias("a_id")), "a_id", "left_semi")).where("rank = 1").select("a_id", "b_id")
    mine = unmatched_a.select(F.col("id").alias("a_id")).join(best, "a_id", "left")
    alone = unmatched_b.select(F.col("id").alias("b_id")).join(best.select("b_id").distinct(), "b_id", "left_anti")
    return mine.unionByName(alone.withColumn("a_id", F.lit(None).cast("long")))


def run_summary(a: DataFrame, b: DataFrame, matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: balances, difference, what was matched and how, exceptions, and rates.

    ``a`` and ``b`` are (id, units); ``matches`` (decision, status, units, members); ``exceptions``
    (severity, age_days).  A rate over nothing is 0; false matches are not measured: null.
    """
    side = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), F.coalesce(F.sum("units"), F.lit(0)).alias(f"balance_{n}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = matches.agg(
        F.count("*").alias("matches"),
        zero(F.sum(F.abs("units"))).alias("matched_units"),
        zero(F.sum("members")).alias("matched_rows"),
        F.count_if(F.col("decision") == "AUTO_MATCH").alias("auto"),
        F.count_if(F.col("decision") == "SUGGEST").alias("suggested"),
        F.count_if(F.col("status") == "APPROVED").alias("approved"),
    )
    open_ones = exceptions.agg(F.count("*").alias("exceptions"), F.count_if(F.col("severity").isin(*GRAVE)).alias("high_risk"), F.max("age_days").alias("oldest_days"))
    one = side(a, "a")
    for more in (side(b, "b"), found, open_ones):
        one = one.crossJoin(F.broadcast(more))  # one row each
    rows = F.col("rows_a") + F.col("rows_b")
    rate = lambda x, y, places: F.round(F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0)), places)
    return one.withColumns(
        {
            "difference": F.col("balance_a") - F.col("balance_b"),
            "completion_pct": rate(100.0 * F.col("matched_rows"), rows, 2),
            "auto_rate": rate(F.col("auto"), F.col("matches"), 4),
            "review_rate": rate(F.col("suggested") + F.col("exceptions"), rows, 4),
            "false_rate": F.lit(None).cast("double"),
        }
    )


def ageing(exceptions: DataFrame, today: Column) -> DataFrame:
    """(bucket, category, severity, open, exposure, high_risk, overdue, oldest_days) of open exceptions
    (status, category, severity, exposure, opened, due); a table of buckets, to be added up."""
    days = F.datediff(today, "opened")
    still = exceptions.where(~F.col("status").isin(*CLOSED))
    return still.groupBy(age_buckets(days).alias("bucket"), "category", "severity").agg(
        F.count("*").alias("open"),
        F.coalesce(F.sum("exposure"), F.lit(0)).cast("decimal(24,8)").alias("exposure"),
        F.count_if(F.col("severity").isin(*GRAVE)).alias("high_risk"),
        F.count_if(F.col("due") < today).alias("overdue"),
        F.max(days).alias("oldest_days"),
    )


def investigation(exceptions: DataFrame, groups: DataFrame, aged_days: int = 30, most: int = 10) -> DataFrame:
    """(section, place, id, amount): the largest, the aged and the fee-like exceptions (id, category,
    age_days, exposure), and the groups (id, status, amount) that wait; ``most`` of each."""
    from pyspark.sql import Window

    exposure = F.coalesce(F.abs("exposure"), F.lit(0).cast("decimal(24,8)"))
    lists = {
        "largest": (exceptions, exposure.desc(), "exposure"),
        "aged": (exceptions.where(F.col("age_days") >= aged_days), exposure.desc(), "exposure"),
        "fee_like": (exceptions.where(F.col("category").isin(*FEE_LIKE)), exposure.desc(), "exposure"),
        "waiting": (groups.where(F.col("status").isin("SUGGESTED", "PROPOSED")), F.col("id"), "amount"),
    }
    out = None
    for section, (df, order, amount) in lists.items():
        top = df.orderBy(order, "id").limit(most)  # a top-k report
        named = top.withColumn("place", F.row_number().over(Window.orderBy(order, "id"))).select(F.lit(section).alias("section"), "place", "id", F.col(amount).cast("decimal(24,8)").alias("amount"))
        out = named if out is None else out.unionByName(named)
    return out


def explained(lineage: DataFrame, key: str) -> DataFrame:
    """(key, text): where a value came from, in words."""
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("nothing"))
    return lineage.select(key, F.concat(F.col("field"), F.lit(" is "), shown(F.col("value")), F.lit(", from "), shown(F.col("source_value")), F.lit(" as delivered")).alias("text"))


def handed_on(df: DataFrame, task: str) -> DataFrame:
    """The columns that a task may see, texts with account numbers and addresses masked; an
    unknown task sees nothing and is an error."""
    if task not in ALLOWED:
        raise ValueError(f"unknown task: {task}")
    return df.select(*[masked(F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in ALLOWED[task] if c in df.columns])


def certificate_hash(certificate: dict, result_hash: str) -> str:
    """SHA-256 over a certificate, without its own hash, and the hash of the result it closes."""
    return settings_hash({**{k: v for k, v in certificate.items() if k != "certificate_hash"}, "result_hash": result_hash})
