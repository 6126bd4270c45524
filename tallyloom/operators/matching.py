"""Blocking joins, rule joins with two-way uniqueness, ranking and assignment.

Records are rows (id, day, units, ccy, ref, inv, party): ``day`` a date, ``units`` the
amount in thousandths as a long, ``ref`` and ``inv`` normalised identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.functions.values import name_uuid
from tallyloom.session import cut

#: Namespace of the ids of match groups.
GROUP_NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def block_keys(records: DataFrame, spaces: dict[str, list[str]]) -> DataFrame:
    """(space, key, id): each record once per key space and value; nulls give no key."""
    entries = [F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(F.lit(s).alias("space"), F.col(c).cast("string").alias("key"))) for s, cs in spaces.items() for c in cs]
    return records.select("id", F.explode(F.array_distinct(F.array(*entries))).alias("k")).where("k is not null").select("k.space", "k.key", "id")


def blocked_pairs(a: DataFrame, b: DataFrame, spaces_a: dict[str, list[str]], spaces_b: dict[str, list[str]]) -> DataFrame:
    """(a_id, b_id) that share any key: an equi-join per key space, never an OR."""
    left = block_keys(a, spaces_a).withColumnRenamed("id", "a_id")
    right = block_keys(b, spaces_b).withColumnRenamed("id", "b_id")
    return left.join(right, ["space", "key"]).select("a_id", "b_id").distinct()


#: Key spaces of blocking: name -> (fields of the first record, fields of the second).
KEY_SPACES = {
    "external": (["external_transaction_id"], ["external_transaction_id"]),
    "settlement": (["settlement_id", "payout_id", "batch_id"], ["settlement_id", "payout_id", "batch_id"]),
    "invoice": (["inv"], ["inv"]),
    "reference": (["ref"], ["ref", "inv"]),
    "party": (["party"], ["party"]),
    "check": (["check_number"], ["check_number"]),
}


def blocked_by(a: DataFrame, b: DataFrame, spaces: list[str], told: str | None = None) -> DataFrame:
    """(a_id, b_id, spaces): pairs that share a key of the named spaces, with the spaces they share.

    ``told`` names a column of ``a`` with an array of identifiers from its narrative; those
    are held against every identifier of ``b``.  Fields that a side lacks give no key.
    """
    fields = lambda df, side: {s: [c for c in KEY_SPACES[s][side] if c in df.columns] for s in spaces}
    left, right = block_keys(a, fields(a, 0)), block_keys(b, fields(b, 1))
    if told:
        left = left.unionByName(a.select("id", F.explode(told).alias("key")).where("key <> ''").select(F.lit("narrative").alias("space"), "key", "id"))
        every = [c for s in KEY_SPACES if s != "party" for c in KEY_SPACES[s][1] if c in b.columns]
        right = right.unionByName(block_keys(b, {"narrative": every}))
    met = left.withColumnRenamed("id", "a_id").join(right.withColumnRenamed("id", "b_id"), ["space", "key"])
    return met.groupBy("a_id", "b_id").agg(F.sort_array(F.collect_set("space")).alias("spaces"))


def _cells(value: Column, reach: int, wide: bool) -> Column:
    """The cells of width 2 * reach + 1 that hold a value, or all (two at most) within reach."""
    width = F.lit(2 * reach + 1).cast("long")
    at = lambda v: ((v - F.pmod(v, width)) / width).cast("long")
    return F.array_distinct(F.array(at(value - reach), at(value + reach))) if wide else F.array(at(value))


def band_pairs(a: DataFrame, b: DataFrame, tolerance: int, days: int | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id) of equal currency whose units differ by at most ``tolerance``: a range
    join as an equi-join on cells, two on one side and one on the other.

    With ``days`` both have to be dated at most so many days apart, and days are cut into
    cells as well, so that pairs grow with the rows of a few days, not with all; columns named
    in ``same`` have to be equal and known, and are part of the key.
    """
    key = ["ccy", *same]
    known = " and ".join(f"`{c}` is not null" for c in ("units", *key, *(["day"] if days is not None else [])))

    def side(df: DataFrame, p: str, wide: bool) -> DataFrame:
        out = df.where(known).select(F.col("id").alias(f"{p}_id"), *key, F.col("units").alias(f"u_{p}"), *([F.unix_date("day").cast("long").alias(f"d_{p}")] if days is not None else []))
        out = out.withColumn("cell", F.explode(_cells(F.col(f"u_{p}"), tolerance, wide)))
        return out if days is None else out.withColumn("slot", F.explode(_cells(F.col(f"d_{p}"), days, wide)))

    met = side(a, "a", True).join(side(b, "b", False), [*key, "cell", *(["slot"] if days is not None else [])])
    met = met.where(F.abs(F.col("u_a") - F.col("u_b")) <= tolerance)
    return (met if days is None else met.where(F.abs(F.col("d_a") - F.col("d_b")) <= days)).select("a_id", "b_id")


def with_sides(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the columns of both records as a_* and b_*."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return pairs.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")


def two_way_unique(pairs: DataFrame) -> DataFrame:
    """Pairs whose a has one hit only and whose b is claimed once among those."""
    ones = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("a_id"))).where("_n = 1")
    return ones.withColumn("_m", F.count("*").over(Window.partitionBy("b_id"))).where("_m = 1").drop("_n", "_m")


def rule_cascade(pairs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(a_id, b_id, rule): rules in order, each on the records the earlier ones left.

    ``pairs`` is computed once; a rule is a boolean Column over it.  A missing value
    makes a condition null and so the rule false.
    """
    left = cut(pairs, "pairs")
    done: DataFrame | None = None
    for name, condition in rules:
        hits = cut(two_way_unique(left.where(condition).select("a_id", "b_id")).withColumn("rule", F.lit(name)), "rule")
        done = hits if done is None else done.unionByName(hits)
        left = left.join(hits.select("a_id"), "a_id", "left_anti").join(hits.select("b_id"), "b_id", "left_anti")
    return done


def ranked(scored: DataFrame) -> DataFrame:
    """Candidates of each a by falling score (ties: smaller b_id), with the runner-up's
    margin and the number of rivals at four fifths of the top score or more."""
    order = Window.partitionBy("a_id").orderBy(F.col("score").desc(), "b_id")
    whole = Window.partitionBy("a_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .withColumn("runner_up", F.lead("score").over(order))
        .withColumn("top", F.max("score").over(whole))
        .withColumn("rivals", F.sum((F.col("score") >= 0.8 * F.col("top")).cast("long")).over(whole) - 1)
        .withColumn("margin", F.round(F.col("score") - F.coalesce("runner_up", F.lit(0.0)), 6))
        .drop("runner_up", "top")
    )


def contested(scored: DataFrame) -> DataFrame:
    """(b_id, anchors): ledger records that are the top of more than one bank record."""
    return ranked(scored).where("rank = 1").groupBy("b_id").agg(F.count("*").alias("anchors")).where("anchors > 1")


def components(edges: DataFrame) -> DataFrame:
    """(a_id, component): smallest a_id reachable over shared b.

    Each b hangs its anchors on the smallest of them; then every round replaces the
    neighbours of an anchor by its least one and that one's least, which doubles the reach.
    """
    edges = cut(edges.select("a_id", "b_id").distinct(), "edges")
    least = edges.groupBy("b_id").agg(F.min("a_id").alias("low"))
    links = cut(edges.join(least, "b_id").where("a_id > low").select("a_id", "low").distinct(), "links")
    while True:
        own = links.groupBy("a_id").agg(F.min("low").alias("least"))
        above = own.select(F.col("a_id").alias("least"), F.col("least").alias("root"))
        rooted = cut(own.join(above, "least", "left").select("a_id", "least", F.coalesce("root", "least").alias("root")), "rooted")
        rest = links.join(rooted, "a_id").where("low > least").select(F.col("low").alias("a_id"), F.col("root").alias("low"))
        if rest.isEmpty() and rooted.where("root < least").isEmpty():
            found = rooted.select("a_id", F.col("least").alias("component"))
            return edges.select("a_id").distinct().join(found, "a_id", "left").select("a_id", F.coalesce("component", "a_id").alias("component"))
        links = cut(rooted.select("a_id", F.col("root").alias("low")).unionByName(rest).distinct(), "links")


def _augment(pdf: pd.DataFrame) -> pd.DataFrame:
    """A largest assignment inside one component: anchors, the best scored first, are placed by
    a search over alternating paths, kept on a stack of its own."""
    ordered = pdf.sort_values(["score", "b_id"], ascending=[False, True])
    wants = {a: g.tolist() for a, g in ordered.groupby("a_id", sort=False)["b_id"]}
    best = ordered.groupby("a_id")["score"].max()
    owner: dict = {}
    for anchor in sorted(wants, key=lambda x: (-best[x], x)):
        seen: set = set()
        path = [(anchor, iter(wants[anchor]), None)]  # (anchor, what it may still ask for, what it asks for)
        while path:
            a, options, _ = path[-1]
            b = next((b for b in options if b not in seen), None)
            if b is None:
                path.pop()
                continue
            seen.add(b)
            path[-1] = (a, options, b)
            if b in owner:
                path.append((owner[b], iter(wants[owner[b]]), None))
                continue
            for a, _, b in path:
                owner[b] = a
            break
    return pd.DataFrame([(a, b) for b, a in owner.items()], columns=["a_id", "b_id"]).astype({"a_id": "int64", "b_id": "int64"})


def assigned(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """(a_id, b_id): one-to-one assignment of most records over edges above ``least``.

    A path never leaves its component, so components are assigned on their own; a
    component of one anchor takes its top record without leaving the engine.
    """
    every = cut(scored.where(F.col("score") > least).select("a_id", "b_id", "score"), "assign")
    # Lone pairs are settled without looking for components.
    degree_a, degree_b = (F.count("*").over(Window.partitionBy(c)) for c in ("a_id", "b_id"))
    marked = cut(every.withColumn("_a", degree_a).withColumn("_b", degree_b), "degrees")
    lone = marked.where("_a = 1 and _b = 1").select("a_id", "b_id")
    edges = marked.where("_a > 1 or _b > 1").select("a_id", "b_id", "score")
    labelled = cut(edges.join(components(edges), "a_id"), "labelled")
    sizes = labelled.groupBy("component").agg(F.count_distinct("a_id").alias("anchors"))
    alone = labelled.join(sizes.where("anchors = 1"), "component")
    single = ranked(alone.select("a_id", "b_id", "score")).where("rank = 1").select("a_id", "b_id")
    shared = labelled.join(sizes.where("anchors > 1"), "component").select("component", "a_id", "b_id", "score")
    return lone.unionByName(single).unionByName(shared.groupBy("component").applyInPandas(_augment, "a_id long, b_id long"))


# ------------------------------------------------------------------ grouping


def subset_pairs(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """(group_key, first_id, second_id): two pool rows of a key that sum to its target,
    found by an equi-join on the complement."""
    first = pool.select("group_key", F.col("id").alias("first_id"), F.col("units").alias("u1"))
    need = first.join(targets.select("group_key", F.col("units").alias("target")), "group_key").withColumn("rest", F.col("target") - F.col("u1"))
    second = pool.select("group_key", F.col("id").alias("second_id"), F.col("units").alias("rest"))
    return need.join(second, ["group_key", "rest"]).where("first_id < second_id").select("group_key", "first_id", "second_id")


def _search(target: int, units: list[int], most: int, budget: int, tolerance: int = 0) -> tuple[list[tuple[int, ...]], str]:
    """Two subsets of at most ``most`` items at most that sum to ``target`` within ``tolerance``, and how
    the search ended: ``whole``, ``limited`` (the size bound cut a branch that could still have
    reached it) or ``exhausted`` (out of steps).

    Amounts are positive and fall, so the sum of those that may still be added bounds
    every branch.
    """
    sums = [0] * (len(units) + 1)
    for k in range(len(units) - 1, -1, -1):
        sums[k] = sums[k + 1] + units[k]
    found: list[tuple[int, ...]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, target, ())]
    steps, limited = 0, False
    while stack:
        k, rest, chosen = stack.pop()
        steps += 1
        if steps >= budget:
            return found, "exhausted"
        if chosen and abs(rest) <= tolerance:
            found.append(chosen)
            if len(found) > 1:
                break
        if k == len(units) or sums[k] < rest - tolerance:
            continue
        if len(chosen) == most:
            # A branch that only lacks items beyond the bound is no answer.
            limited |= rest > tolerance and units[-1] <= rest + tolerance
            continue
        for j in range(len(units) - 1, k - 1, -1):
            if units[j] <= rest + tolerance:
                stack.append((j + 1, rest - units[j], (*chosen, j)))
    return found, "limited" if limited and len(found) < 2 else "whole"


def _answered(target: int, items: list[dict], most: int, budget: int, tolerance: int, cut_pool: bool) -> tuple[str, list[int]]:
    """(status, members) for one target; items of the other sign can't take part."""
    sign = -1 if target < 0 else 1
    pool = sorted(((sign * int(i["units"]), int(i["id"])) for i in items if sign * int(i["units"]) > 0), key=lambda x: (-x[0], x[1]))
    found, ended = _search(sign * target, [u for u, _ in pool], most, budget, tolerance)
    if ended == "exhausted":
        return ended, []
    if len(found) > 1:
        return "ambiguous", []
    if ended == "limited" or cut_pool:
        return "limited", sorted(pool[k][1] for k in found[0]) if found else []
    return ("unique", sorted(pool[k][1] for k in found[0])) if found else ("none", [])


def subset_groups(targets: DataFrame, pool: DataFrame, most: int = 5, budget: int = 200_000, tolerance: int = 0, most_pool: int = 60) -> DataFrame:
    """(group_key, status, members): the pool rows of a key that sum to its target, within
    ``tolerance`` units.

    ``unique`` only if a whole search found exactly one subset; else ``ambiguous``, ``none``,
    ``exhausted`` (``budget`` steps were not enough) or ``limited``: sets larger than ``most``, or a
    pool larger than ``most_pool`` of which the largest amounts were tried, may hold
    others.  Rows of the other sign than the target's take no part, nor do null amounts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *_answered(int(target), list(items), most, budget, tolerance, bool(n > most_pool))) for key, target, items, n in zip(pdf["group_key"], pdf["target"], pdf["items"], pdf["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["group_key", "status", "members"])

    asked = targets.where("units is not null and units <> 0").select("group_key", F.col("units").alias("target"))
    sided = asked.join(pool.where("units is not null").select("group_key", "id", "units"), "group_key").where(F.signum("units") == F.signum("target"))
    largest = Window.partitionBy("group_key", "target").orderBy(F.abs("units").desc(), "id")
    held = sided.withColumn("k", F.row_number().over(largest)).withColumn("n", F.count("*").over(Window.partitionBy("group_key", "target"))).where(F.col("k") <= most_pool)
    gathered = held.groupBy("group_key", "target").agg(F.max("n").alias("n"), F.collect_list(F.struct("id", "units")).alias("items"))
    none = asked.join(gathered, ["group_key", "target"], "left_anti").select("group_key", F.lit("none").alias("status"), F.array().cast("array<long>").alias("members"))
    return gathered.mapInPandas(run, "group_key long, status string, members array<long>").unionByName(none)


def affine_pool(anchors: DataFrame, pool: DataFrame, tolerance: int, days: int, most_pool: int = 60) -> DataFrame:
    """(anchor_id, target, id, units, n): the rows of the pool that could be parts of an anchor.

    They share currency, party and sign with it, are no larger (but for ``tolerance``) and
    at most ``days`` apart; undated rows take no part.  Days are part of the key, so a
    party meets the rows of a few days only.  Of more than ``most_pool`` those that share the
    batch or settlement come first, then by id; ``n`` tells how many there were.
    """
    slots = lambda df, wide: df.withColumn("slot", F.explode(_cells(F.unix_date("day").cast("long"), days, wide)))
    mine = slots(anchors.where("units <> 0 and party is not null and day is not null"), True).select("slot", F.col("id").alias("anchor_id"), F.col("units").alias("target"), "ccy", "party", F.signum("units").alias("sign"), F.col("day").alias("anchor_day"), *[F.col(c).alias(f"anchor_{c}") for c in ("batch", "settlement") if c in anchors.columns])
    theirs = slots(pool.where("units <> 0 and party is not null and day is not null").withColumn("sign", F.signum("units")), False)
    met = mine.join(theirs, ["ccy", "party", "sign", "slot"])
    near = F.abs(F.datediff("anchor_day", "day")) <= days
    met = met.where(near & (F.abs("units") <= F.abs("target") + tolerance))
    shared = F.lit(0)
    for c in ("batch", "settlement"):
        if c in anchors.columns and c in pool.columns:
            shared = shared - F.when(F.col(c) == F.col(f"anchor_{c}"), 3).otherwise(0)
    order = Window.partitionBy("anchor_id").orderBy(shared, "id")
    counted = met.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("anchor_id")))
    return counted.where(F.col("k") <= most_pool).select("anchor_id", "target", "id", "units", "n")


def grouped_matches(a: DataFrame, b: DataFrame, tolerance: int = 0, days: int = 5, most: int = 5, budget: int = 200_000, most_pool: int = 60) -> DataFrame:
    """(anchor_side, anchor_id, status, members): records that are the sum of several of the other side.

    Anchors of side A come first; what their unique groups use is out for anchors of side B.
    A group counts only if the search was whole and found one subset of two records or
    more; a single record that would do as well makes it ambiguous.  Two anchors that want
    one record get neither (``contested``).  Records are (id, day, units, ccy, party); those
    without party, amount, currency or date take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for anchor, target, items, n in zip(pdf["anchor_id"], pdf["target"], pdf["items"], pdf["n"], strict=True):
                status, members = _answered(int(target), list(items), most, budget, tolerance, bool(n > most_pool))
                single = any(abs(abs(int(i["units"])) - abs(int(target))) <= tolerance for i in items)
                rows.append((anchor, "ambiguous" if single else status, members if status == "unique" and not single and len(members) > 1 else []))
            yield pd.DataFrame(rows, columns=["anchor_id", "status", "members"])

    def direction(anchors: DataFrame, pool: DataFrame, side: str) -> DataFrame:
        held = affine_pool(anchors, pool, tolerance, days, most_pool).groupBy("anchor_id", "target").agg(F.max("n").alias("n"), F.collect_list(F.struct("id", "units")).alias("items"))
        tried = cut(held.where(F.size("items") > 1).mapInPandas(run, "anchor_id long, status string, members array<long>"), "groups")
        claims = tried.select("anchor_id", F.explode("members").alias("id")).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n > 1").select("anchor_id").distinct().withColumn("contested", F.lit(True))
        status = F.when(F.col("contested"), "contested").otherwise(F.col("status"))
        return cut(tried.join(claims, "anchor_id", "left").select(F.lit(side).alias("anchor_side"), "anchor_id", status.alias("status"), F.when(status == "unique", F.col("members")).otherwise(F.array().cast("array<long>")).alias("members")), "groups")

    first = direction(a, b, "A")
    used = first.where("status = 'unique'")
    left_a = a.join(used.select(F.col("anchor_id").alias("id")), "id", "left_anti")
    left_b = b.join(used.select(F.explode("members").alias("id")), "id", "left_anti")
    return first.unionByName(direction(left_b, left_a, "B"))


def match_groups(pairs: DataFrame, run: str, rule: str = "rule") -> DataFrame:
    """(group_id, rule, relation, a_ids, b_ids) of one-to-one matches: the id is a name-based uuid of
    run, rule and sorted members, so a rerun gives the same one."""
    name = F.concat_ws("|", F.lit(run), F.col(rule), F.array_join(F.array_sort(F.array(F.col("a_id").cast("string"), F.col("b_id").cast("string"))), ","))
    return pairs.select(name_uuid(GROUP_NAMESPACE, name).alias("group_id"), F.col(rule).alias("rule"), F.lit("1:1").alias("relation"), F.array("a_id").alias("a_ids"), F.array("b_id").alias("b_ids"))


# ------------------------------------------------------------- entities, intervals


def overlapping(intervals: DataFrame, others: DataFrame, days: int = 31) -> DataFrame:
    """(id, other_id) of intervals (id, lo, hi) that share a day with another one; an unknown bound
    reaches without end.

    Bounded intervals stand in every slot of ``days`` days they touch; the pair counts in the
    slot in which the later of both begins, so none is made distinct.  Unbounded ones meet
    every other by a join of their own.
    """
    slot = lambda c: F.floor(F.unix_date(c) / days)
    bounded = "lo is not null and hi is not null"
    mine = intervals.where(bounded).select("id", "lo", "hi", F.explode(F.sequence(slot("lo"), slot("hi"))).alias("s"))
    theirs = others.where(bounded).select(F.col("id").alias("other_id"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"), F.explode(F.sequence(slot("lo"), slot("hi"))).alias("s"))
    meet = (F.col("lo") <= F.col("ohi")) & (F.col("hi") >= F.col("olo"))
    met = mine.join(theirs, "s").where(meet & (F.col("s") == slot(F.greatest("lo", "olo")))).select("id", "other_id")
    loose = ~F.expr(bounded)
    open_ends = F.coalesce((F.col("lo") <= F.col("ohi")), F.lit(True)) & F.coalesce((F.col("hi") >= F.col("olo")), F.lit(True))
    renamed = others.select(F.col("id").alias("other_id"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    wide = intervals.where(loose).join(renamed, open_ends).select("id", "other_id")
    wide_others = intervals.where(bounded).join(renamed.where("olo is null or ohi is null"), open_ends).select("id", "other_id")
    return met.unionByName(wide).unionByName(wide_others)


def resolved_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.93) -> DataFrame:
    """(name, entity_id, how, similarity): each distinct normalised name looked up by exact name,
    then approved alias, then the best similarity of at least ``least``; else ``unresolved``.

    ``names`` has name; ``entities`` entity_id, name; ``aliases`` alias, entity_id, status.  A
    similar name only comes into question if it shares a word, or a word less one
    letter, with the entity; of equal similarity the smaller id wins.
    """
    asked = names.where("name is not null and name <> ''").select("name").distinct()
    exact = asked.join(entities.groupBy("name").agg(F.min("entity_id").alias("entity_id")), "name").withColumn("how", F.lit("exact_name"))
    known = aliases.where("status = 'APPROVED'").groupBy(F.col("alias").alias("name")).agg(F.min("entity_id").alias("entity_id"))
    after = asked.join(exact.select("name"), "name", "left_anti")
    alias = after.join(known, "name").withColumn("how", F.lit("approved_alias"))
    rest = cut(after.join(alias.select("name"), "name", "left_anti"), "unknown")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        words = F.filter(F.split(F.col(name), " "), lambda w: F.length(w) > 2)
        less_one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
        return df.withColumn("k", F.explode(F.array_distinct(F.concat(words, F.flatten(F.transform(words, less_one))))))

    listed = entities.select("entity_id", F.col("name").alias("entity_name"))
    met = keyed(rest, "name").join(keyed(listed, "entity_name"), "k").select("name", "entity_id", "entity_name").distinct()
    likeness = F.greatest(sim.jaro_winkler_similarity(F.col("name"), F.col("entity_name")), sim.trigram_similarity(F.col("name"), F.col("entity_name")))
    best = met.withColumn("s", likeness).groupBy("name").agg(F.max_by(F.struct("entity_id", "s"), F.struct("s", -F.col("entity_id"))).alias("x"))
    near = rest.join(best, "name", "left")
    enough = F.coalesce(F.col("x.s") >= least, F.lit(False))
    fuzzy = near.select("name", F.when(enough, F.col("x.entity_id")).alias("entity_id"), F.when(enough, "fuzzy").otherwise("unresolved").alias("how"), F.round(F.coalesce("x.s", F.lit(0.0)), 4).alias("similarity"))
    sure = exact.unionByName(alias).select("name", "entity_id", "how", F.lit(1.0).alias("similarity"))
    return sure.unionByName(fuzzy)
