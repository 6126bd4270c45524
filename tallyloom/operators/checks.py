"""Profiles, duplicates, invariants, aggregates and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.values import quantized
from tallyloom.session import cut


def column_profile(df: DataFrame, columns: list[str], low_fill: float = 0.8) -> DataFrame:
    """One row a column: rows, filled, distinct, shortest and longest value, whether the
    fill rate is low.  One pass over the table for all columns: cells are counted per
    (column, value) before anything else."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    values = cells.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    filled = F.col("v").isNotNull() & (F.col("v") != "")
    out = values.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("filled"),
        F.count(F.when(filled, F.lit(1))).alias("distinct_values"),
        F.sum(F.when(filled & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("repeated"),
        F.min(F.when(filled, F.length("v"))).cast("long").alias("shortest"),
        F.max(F.when(filled, F.length("v"))).cast("long").alias("longest"),
    )
    return out.withColumn("low_fill", (F.col("filled") > 0) & (F.col("filled") < low_fill * F.col("row_count")))


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, kind): what a text column holds, from counts of the shapes of its
    values: empty, boolean, currency (three letters, at most 200 of them), date, integer, amount, identifier or text."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns])).alias("x")).select("x.*")
    values = cells.where("v is not null and v <> ''").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    has = lambda pattern: F.sum(F.when(F.col("v").rlike(pattern), F.col("n")).otherwise(0))
    counts = values.groupBy("column_name").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("d"),
        has(r"^(?i:true|false|yes|no|y|n|0|1)$").alias("b"),
        has(r"^\d{4}-\d{2}-\d{2}|^\d{1,2}[./-]\d{1,2}[./-]\d{4}$|^\d{4}/\d{1,2}/\d{1,2}$").alias("t"),
        has(r"^(?i:[a-z]{3})$").alias("c"),
        has(r"^[+-]?\d+$").alias("i"),
        has(r"^[+-]?\d[\d.,]*$").alias("a"),
    )
    kind = (
        F.when(F.col("n").isNull(), "empty")
        .when((F.col("b") == F.col("n")) & (F.col("d") <= 2), "boolean")
        .when((F.col("c") == F.col("n")) & (F.col("d") <= 200), "currency")
        .when(F.col("t") == F.col("n"), "date")
        .when(F.col("i") == F.col("n"), "integer")
        .when(F.col("a") == F.col("n"), "amount")
        .when(F.col("d") > 0.5 * F.col("n"), "identifier")
        .otherwise("text")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").select("column_name", kind.alias("kind"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; null keys count as a value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def over_allocated(members: DataFrame, records: DataFrame) -> DataFrame:
    """(id, groups, allocated, units): records in several groups or allocated beyond
    their amount.  ``members`` is (group_id, id, units), ``records`` (id, units)."""
    used = members.groupBy("id").agg(F.count_distinct("group_id").alias("groups"), F.sum(F.abs("units")).alias("allocated"))
    return used.join(records.select("id", "units"), "id").where((F.col("groups") > 1) | (F.col("allocated") > F.abs("units")))


def age_buckets(days: Column) -> Column:
    """0-7, 8-30, 31-60, 61-90, 90+ days."""
    return F.when(days <= 7, "0-7").when(days <= 30, "8-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")


def histogram_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, sum, min, p50, p95, p99, max per group; a percentile is the value at position
    floor(f * n) from 0, at most the last.

    The counts of distinct values are range-partitioned by (group, value); the offset of
    each range is a prefix sum over the few ranges, so a group of a third of all rows is
    ranked by as many tasks as it has ranges.
    """
    group = F.to_json(F.struct(*[F.col(c) for c in by]))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_g", group)
    ranged = cut(counts.repartitionByRange("_g", value).withColumn("_p", F.spark_partition_id()), "ranges")
    along = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_g", "_p").agg(F.sum("_n").alias("held"))
    offsets = ranges.select("_g", "_p", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("_g")).alias("all"))
    inside = Window.partitionBy("_g", "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, ["_g", "_p"]).withColumn("upto", F.col("before") + F.sum("_n").over(inside))

    def at(fraction: float) -> Column:
        position = F.least(F.floor(F.lit(fraction) * F.col("all")), F.col("all") - 1)
        return F.min(F.when(F.col("upto") > position, F.col(value)))

    return placed.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(F.col(value) * F.col("_n")).alias("total"), F.min(value).alias("lowest"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(value).alias("highest")
    )


def lineage(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, field, source_value, value): where each normalised field came from."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("source_value"), e.cast("string").alias("value")) for c, e in columns.items()]
    return df.select(key, F.inline(F.array(*cells)))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of several checks under each other."""
    return reduce(DataFrame.unionByName, parts)


def unknown_members(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members (group_id, id, ...) of groups whose record does not exist."""
    return members.join(records.select("id"), "id", "left_anti")


def journal_faults(lines: DataFrame, by: str) -> DataFrame:
    """(by, fault) of journals that are no double entry: MIXED_CURRENCIES, UNBALANCED or ZERO.

    ``lines`` has side (debit or credit), currency, amount; sums are compared in the minor
    units of the currency."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0).cast("decimal(24,8)"))
    sums = lines.groupBy(by).agg(F.count_distinct("currency").alias("currencies"), F.first("currency").alias("ccy"), side("debit").alias("debit"), side("credit").alias("credit"))
    fault = F.when(F.col("currencies") != 1, "MIXED_CURRENCIES").when(quantized(F.col("debit"), F.col("ccy")) != quantized(F.col("credit"), F.col("ccy")), "UNBALANCED").when(F.col("debit") == 0, "ZERO")
    return sums.select(by, fault.alias("fault")).where("fault is not null")


def unexplained_difference(records: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(difference, explained, unexplained): the sum of side A less side B, less what closed
    exceptions (status, ids) account for.  ``records`` has side, id, amount."""
    signed = F.when(F.col("side") == "A", F.col("amount")).otherwise(-F.col("amount"))
    closed = exceptions.where(F.col("status").isin("RESOLVED", "CLOSED")).select(F.explode("ids").alias("id"))
    zero = F.lit(0).cast("decimal(24,8)")
    explained = records.join(closed, "id").agg(F.coalesce(F.sum(signed), zero).alias("explained"))
    whole = records.agg(F.coalesce(F.sum(signed), zero).alias("difference"))
    return whole.crossJoin(F.broadcast(explained)).withColumn("unexplained", F.col("difference") - F.col("explained"))  # one row each
