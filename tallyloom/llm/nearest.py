"""Nearest record in time for the same entity, by tick expansion.

Time is cut into ticks as wide as the tolerance.  Right records are expanded to every
tick from which they can be reached: into their own tick, and to the ticks beside it,
where only the nearest record of an entity-tick is kept on either side.  Left records
then join the ticks on equality of (entity, tick).

A tick in which one entity has many right records is cut into ``FINER`` ticks, these
again where they are still full, and so on: finer ticks are expanded over the other
ones of their coarse tick, again with the nearest kept on either side, and left records
of full ticks go on to the finer ones.  So a left record meets one record before, one
after, and at most ``PER_TICK`` in its own tick, however the records of an entity crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import broadcast_if, cut, scratch

UNKNOWN_PARTIES = ("UNKNOWN", "N/A", "?")
#: Instants that a tick may hold before it is cut finer, and the finer ticks it is cut into.
PER_TICK, FINER = 64, 32
#: Full ticks are told by a broadcast up to so many, else by a shuffle.
BROADCAST_TICKS = 400_000


def party_key(name: Column) -> Column:
    """Upper-cased, trimmed of spaces, runs of spaces reduced to one; null for unknown."""
    folded = F.regexp_replace(F.trim(F.upper(name)), " +", " ")
    return F.when(name.isNotNull() & ~name.isin(*UNKNOWN_PARTIES), folded)


_NONE = "struct<t: bigint, id: bigint>"


def _ticks(instants: DataFrame, full: DataFrame, coarse: tuple[int, int] | None) -> DataFrame:
    """(e, up, k, before, after, inside): what left records of each tick meet.

    ``coarse`` is (width of the coarse ticks ``up``, width of the ticks ``k``); without it
    ticks stand at the top and are expanded to their two neighbours.
    """
    key, edge, none = ["e", "up", "k"], F.struct("t", "id"), F.lit(None).cast(_NONE)
    ends = [F.min(edge).alias("first"), F.max(edge).alias("last")]
    # Only ticks that are not full are gathered.
    small = instants.join(full, key, "left_anti").groupBy(*key).agg(*ends, F.collect_list(edge).alias("inside"))
    large = instants.join(full, key, "left_semi").groupBy(*key).agg(*ends).withColumn("inside", F.lit(None).cast(f"array<{_NONE}>"))
    held = small.unionByName(large)
    spread = lambda at, before, after, inside: F.struct(at.alias("k"), before.alias("before"), after.alias("after"), inside.alias("inside"))
    nothing = F.lit(None).cast(f"array<{_NONE}>")
    if coarse is None:
        k = F.col("k")
        beyond = F.array(spread(k - 1, none, F.col("first"), nothing), spread(k, none, none, F.col("inside")), spread(k + 1, F.col("last"), none, nothing))
    else:
        wide, fine = (F.lit(w) for w in coarse)
        low, high = F.floor(F.col("up") * wide / fine).cast("long"), F.floor(((F.col("up") + 1) * wide - 1) / fine).cast("long")
        beyond = F.transform(F.sequence(low, high), lambda k: spread(k, F.when(k > F.col("k"), F.col("last")), F.when(k < F.col("k"), F.col("first")), F.when(k == F.col("k"), F.col("inside"))))
    reached = held.select("e", "up", F.explode(beyond).alias("x")).select("e", "up", "x.*")
    return reached.groupBy(*key).agg(F.max("before").alias("before"), F.min("after").alias("after"), F.max("inside").alias("inside"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    at: str,
    left_id: str,
    right_id: str,
    tolerance_s: int = 12 * 3600,
) -> DataFrame:
    """(left_id, right_id, distance_us): for each left row its nearest right row.

    The distance is at most ``tolerance_s`` seconds, both ends included; on equal
    distance the earlier right row wins, then the smaller id.  Rows with a null
    entity or time take no part; a left row without partner gives no row.  A right
    row may serve many.  Repeated left rows each get their partner.  Columns beside
    the three named are ignored, so clashing names do no harm; an empty side gives
    an empty result.

    Skew: everything is keyed by (entity, tick), ticks being as fine as an entity's
    records are dense; a tick is one row on the side of the right records.
    """
    width = tolerance_s * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    tick = lambda w: F.floor((F.col("t") - F.pmod("t", F.lit(w))) / F.lit(w)).cast("long")

    def prepared(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(entity).alias("e"), micros.alias("t"), F.col(key).cast("long").alias("id")).where("e is not null and t is not null and id is not null")

    top = F.lit(0).cast("long").alias("up")
    none = F.lit(None).cast(_NONE)
    lefts = prepared(left, left_id).select("e", top, tick(width).alias("k"), "t", "id", none.alias("b"), none.alias("a"))
    instants = prepared(right, right_id).groupBy("e", "t").agg(F.min("id").alias("id")).select("e", top, tick(width).alias("k"), "t", "id")
    with scratch(left.sparkSession) as keep:
        instants, coarse, done = cut(instants, "instants"), None, []
        while True:
            full = broadcast_if(cut(instants.groupBy("e", "up", "k").count().where(F.col("count") > PER_TICK).drop("count"), "full"), BROADCAST_TICKS)
            met = lefts.join(_ticks(instants, full, coarse), ["e", "up", "k"], "left")
            known = lambda kind, own, carried, inside: kind(F.col(own), F.coalesce(F.col(carried), F.col(own)), F.coalesce(inside, F.col(own), F.col(carried)))
            inside_b = F.array_max(F.filter("inside", lambda x: x["t"] <= F.col("t")))
            inside_a = F.array_min(F.filter("inside", lambda x: x["t"] > F.col("t")))
            met = met.select("e", "up", "k", "t", "id", known(F.greatest, "b", "before", inside_b).alias("b"), known(F.least, "a", "after", inside_a).alias("a"))
            if full.isEmpty():
                done.append(met)
                break
            met = cut(met, "met")
            done.append(met.join(full, ["e", "up", "k"], "left_anti"))
            coarse = (width, max(1, width // FINER))
            width = coarse[1]
            finer = lambda df, *more: df.join(full, ["e", "up", "k"], "left_semi").select("e", F.col("k").alias("up"), tick(width).alias("k"), "t", "id", *more)  # noqa: B023, E731
            lefts, instants = finer(met, "b", "a"), cut(finer(instants), "instants")
        swept = done[0]
        for part in done[1:]:
            swept = swept.unionByName(part)
        gap_b, gap_a = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
        take_b = F.coalesce(gap_b <= gap_a, F.col("b").isNotNull())
        found = swept.select(
            F.col("id").alias("left_id"),
            F.when(take_b, F.col("b.id")).otherwise(F.col("a.id")).alias("right_id"),
            F.when(take_b, gap_b).otherwise(gap_a).alias("distance_us"),
        )
        return keep(found.where(F.col("right_id").isNotNull() & (F.col("distance_us") <= tolerance_s * 1_000_000)), "nearest")
