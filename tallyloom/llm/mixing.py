"""Mixing sources to target weights.

Sampling without replacement by exponential keys: each document draws
``-ln(u) / weight`` from a hash of its id, documents are taken in the order of
their keys until the token budget of the source is full.  Whole epochs come first,
the rest is the fractional selection.

The order is never sorted as a whole.  The keys of a source are cut into bins, the
tokens of each bin are added up, and a prefix sum over that small table tells which
bin the budget ends in.  That bin is cut again until few documents are left in it, and
only those are ranked, whatever the weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a source that are ranked at most; only equal keys can be more.
DOCS_PER_BIN = 10_000
#: Bins that a range of keys is cut into at a time.
BINS = 1024


def token_budgets(available: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, tuple[float, int]]:
    """source -> (share, token budget).

    Only sources that have both a target and tokens take part; their shares are
    scaled to sum 1.  The total is the largest at which no source needs more than
    ``max_repeats`` epochs, or ``total_tokens`` if that is smaller.
    """
    usable = [(s, share, reps) for s, share, reps in targets if s is not None and share and share > 0 and reps and reps > 0 and available.get(s, 0) > 0]
    whole = sum(share for _, share, _ in usable)
    if not usable:
        return {}
    most = min(available[s] * reps / (share / whole) for s, share, reps in usable)
    total = most if total_tokens is None else min(most, total_tokens)
    return {s: (share / whole, min(math.floor(total * share / whole), available[s] * reps)) for s, share, reps in usable}


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mixed corpus.

    ``sized`` has doc_id, source, n_tokens and a positive ``weight`` (null or bad
    weights count as 1); ``targets`` has source, target_share, max_repeats (a fixed,
    small table, which alone is brought to the driver, together with totals and bins of
    the listed sources; a source listed twice is an error).  Documents without source, id or tokens
    take no part.  Each source is filled to its budget from below: it lacks less than
    one document.  A document stands ``copies`` <= max_repeats times.  Ties of keys are
    broken by doc_id.  Empty inputs give an empty corpus.
    """
    spark = sized.sparkSession
    listed = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats").collect()]
    names = [s for s, _, _ in listed]
    if len(set(names)) < len(names):
        raise ValueError("a source is listed twice")
    docs = sized.where("doc_id is not null and n_tokens > 0").where(F.col("source").isin(names)).select("doc_id", "source", "n_tokens", "weight")
    sums = {r["source"]: (r["tokens"], r["docs"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    budgets = token_budgets({s: t for s, (t, _) in sums.items()}, listed, total_tokens)
    plan = [(s, budget // sums[s][0], budget % sums[s][0]) for s, (_, budget) in budgets.items()]
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    keyed = docs.withColumn("key", -F.log(unit) / weight)
    ends = _budget_ends(keyed, {s: rest for s, _, rest in plan})
    rows = [(s, epochs, rest, *ends[s]) for s, epochs, rest in plan]
    chosen = spark.createDataFrame(rows, "source string, epochs long, rest long, lo double, hi double, before long")
    placed = keyed.join(F.broadcast(chosen), "source")  # one row a listed source
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_end = (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))
    edge = placed.where(at_end).withColumn("extra", (F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest")).cast("long"))
    rest = placed.where(~at_end).withColumn("extra", (F.col("key") < F.col("lo")).cast("long"))
    columns = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("copies")]
    return edge.select(*columns).unionByName(rest.select(*columns)).where("copies > 0")


def _budget_ends(keyed: DataFrame, rests: dict[str, int]) -> dict[str, tuple[float, float, int]]:
    """source -> (lo, hi, tokens below lo): the range of keys [lo, hi) in which the tokens, in
    the order of keys, pass ``rest``; it holds ``DOCS_PER_BIN`` documents at most, unless
    their keys are equal.

    Each round is one aggregate to ``BINS`` rows a source; ranges come to the driver, three
    numbers a listed source.
    """
    spark = keyed.sparkSession
    bounds = {r["source"]: (r["lo"], math.nextafter(r["hi"], math.inf)) for r in keyed.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
    ends = {s: (*bounds[s], 0) for s in rests}
    open_ranges = dict(ends)
    while open_ranges:
        asked = spark.createDataFrame([(s, lo, hi) for s, (lo, hi, _) in open_ranges.items()], "source string, lo double, hi double")
        near = keyed.join(F.broadcast(asked), "source").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))  # one row a listed source
        place = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = near.groupBy("source", place.alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.min("key").alias("first"), F.max("key").alias("last"))
        left = {}
        for source, rows in _by_source(bins.collect()).items():
            lo, hi, before = open_ranges[source]
            for k, row in enumerate(rows):
                if before + row["tokens"] > rests[source] or k == len(rows) - 1:
                    ends[source] = (row["first"], math.nextafter(row["last"], math.inf), before)
                    if row["docs"] > DOCS_PER_BIN and row["first"] < row["last"]:
                        left[source] = ends[source]
                    break
                before += row["tokens"]
        open_ranges = left
    return ends


def _by_source(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["source"], r["bin"])):
        out.setdefault(row["source"], []).append(row)
    return out


def mix_report(sized: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed or present source: target and reached share, tokens, repeats."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    total = got.agg(F.sum("mixed_tokens").alias("total"))
    return (
        have.join(targets.select("source", "target_share", "max_repeats"), have["source"].eqNullSafe(targets["source"]), "full_outer")
        .select(F.coalesce(have["source"], targets["source"]).alias("source"), "available_tokens", "target_share", "max_repeats")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(total))  # a single row
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
        )
    )
