import itertools
import random

from pyspark.sql import functions as F

from tallyloom.operators import audit as au
from tallyloom.operators import checks as ck
from tallyloom.operators import matching as mt

REC = "id long, day date, units long, ccy string, ref string, inv string, party string"


def recs(spark, rows):
    return spark.createDataFrame(rows, REC)


def test_blocking_and_bands_equal_brute_force(spark):
    random.seed(1)
    make = lambda n: [(k, None, random.randint(-200, 200), random.choice(["EUR", "USD", None]), random.choice(["r1", "r2", None, ""]), random.choice(["r1", None]), None) for k in range(n)]
    a, b = make(60), make(70)
    got = {tuple(r) for r in mt.band_pairs(recs(spark, a), recs(spark, b), 7).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(a, b) if x[3] and x[3] == y[3] and abs(x[2] - y[2]) <= 7}
    got = {tuple(r) for r in mt.blocked_pairs(recs(spark, a), recs(spark, b), {"r": ["ref"]}, {"r": ["ref", "inv"]}).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(a, b) if x[4] and x[4] in (y[4], y[5])}
    assert mt.band_pairs(recs(spark, []), recs(spark, b), 7).count() == 0


def test_uniqueness_and_cascade(spark):
    pairs = spark.createDataFrame([(1, 10, 0), (2, 11, 0), (2, 12, 0), (3, 13, 0), (4, 13, 0), (5, 14, 3), (2, 11, 0)], "a_id long, b_id long, du long").distinct()
    got = {tuple(r) for r in mt.two_way_unique(pairs).collect()}
    assert got == {(1, 10, 0), (5, 14, 3)}
    rules = mt.rule_cascade(pairs, [("exact", F.col("du") == 0), ("near", F.col("du") <= 5)])
    assert {tuple(r) for r in rules.collect()} == {(1, 10, "exact"), (5, 14, "near")}


def test_ranking_and_assignment(spark):
    scored = spark.createDataFrame([(1, 10, 0.96), (1, 11, 0.95), (1, 12, 0.1), (2, 10, 0.9), (3, 20, 0.7), (3, 21, 0.7)], "a_id long, b_id long, score double")
    top = {r.a_id: (r.b_id, r.margin, r.rivals) for r in mt.ranked(scored).where("rank = 1").collect()}
    assert top == {1: (10, 0.01, 1), 2: (10, 0.9, 0), 3: (20, 0.0, 1)}
    assert {tuple(r) for r in mt.contested(scored).collect()} == {(10, 2)}
    got = dict((r.a_id, r.b_id) for r in mt.assigned(scored).collect())
    assert got == {1: 11, 2: 10, 3: 20}


def test_subset_sums(spark):
    targets = spark.createDataFrame([(1, 10000), (2, 5), (3, 4), (4, 9)], "group_key long, units long")
    pool = spark.createDataFrame([(1, 1, 4000), (1, 2, 3000), (1, 3, 3000), (1, 4, 500), (2, 5, 2), (2, 6, 3), (2, 7, 3), (3, 8, 5), (4, 9, 9), (4, 10, -9)], "group_key long, id long, units long")
    got = {r.group_key: (r.status, list(r.members)) for r in mt.subset_groups(targets, pool).collect()}
    assert got == {1: ("unique", [1, 2, 3]), 2: ("ambiguous", []), 3: ("none", []), 4: ("unique", [9])}
    assert {tuple(r) for r in mt.subset_pairs(targets, pool).collect()} == {(2, 5, 6), (2, 5, 7)}
    assert mt.subset_groups(targets, pool, budget=1).where("status <> 'exhausted'").count() == 0


def test_checks(spark):
    df = spark.createDataFrame([("a", None, "1"), ("a", "", "2"), ("b", "x", "2")], "k string, v string, n string")
    prof = {r.column_name: r for r in ck.column_profile(df, ["k", "v"]).collect()}
    assert (prof["k"].filled, prof["k"].distinct_values, prof["k"].repeated) == (3, 2, 2)
    assert prof["v"].filled == 1 and prof["v"].low_fill
    kinds = {r.column_name: r.kind for r in ck.column_kinds(df.withColumn("e", F.lit(None).cast("string")), ["k", "n", "e"]).collect()}
    assert kinds == {"k": "identifier", "n": "integer", "e": "empty"}
    nums = spark.createDataFrame([("g", k) for k in range(1, 101)], "g string, v long")
    r = ck.histogram_summary(nums, ["g"], "v").first()
    assert (r.p50, r.p95, r.p99, r.lowest, r.highest, r.total) == (51, 96, 100, 1, 100, 5050)
    events = spark.createDataFrame([("t", k, f"e{k}") for k in range(5)], "t string, k int, body string")
    chain = au.sealed(events, "t", "k", F.col("body")).cache()
    assert au.broken_links(chain, "t", "k", F.col("body")).count() == 0
    forged = chain.withColumn("body", F.when(F.col("k") == 2, "x").otherwise(F.col("body")))
    # A link takes in the one before, so nothing after the forged event holds.
    assert [r.k for r in au.broken_links(forged, "t", "k", F.col("body")).orderBy("k").collect()] == [2, 3, 4]
    assert [tuple(r) for r in au.first_broken(forged, "t", "k", F.col("body")).collect()] == [("t", 2)]
    more = spark.createDataFrame([("t", 5, "e5"), ("u", 1, "f")], "t string, k int, body string")
    again = au.sealed(events.unionByName(more), "t", "k", F.col("body"))
    on = au.sealed(more, "t", "k", F.col("body"), au.heads_of(chain, "t", "k"))
    assert {(r.t, r.k, r.link_hash) for r in on.collect()} <= {(r.t, r.k, r.link_hash) for r in again.collect()}
    h = lambda d: au.result_hash(d, ["k", "v"]).first()
    assert h(df) == h(df.orderBy(F.desc("n")).repartition(3)) and h(df).row_count == 3
    assert h(df) != h(df.withColumn("v", F.coalesce("v", F.lit("")))) and h(df.limit(0)).row_count == 0
    assert au.replayed(df, df.repartition(2), ["k", "v"]).first().same
    assert [r.sequence for r in au.numbered(events, "t", "k", spark.createDataFrame([("t", 7)], "t string, last long")).orderBy("k").collect()] == [8, 9, 10, 11, 12]


def test_band_with_days_and_party(spark):
    import datetime as dt

    random.seed(4)
    make = lambda n: [(k, random.choice([None, *(dt.date(2005, 3, 1) + dt.timedelta(days=d) for d in range(30))]), random.randint(-60, 60), random.choice(["EUR", "USD", None]), None, None, random.choice(["p", "q", None])) for k in range(n)]
    a, b = make(80), make(80)
    near = lambda x, y: x[1] and y[1] and abs((x[1] - y[1]).days) <= 3 and x[3] and x[3] == y[3] and abs(x[2] - y[2]) <= 7
    got = [tuple(r) for r in mt.band_pairs(recs(spark, a), recs(spark, b), 7, days=3).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[0], y[0]) for x, y in itertools.product(a, b) if near(x, y)}
    got = {tuple(r) for r in mt.band_pairs(recs(spark, a), recs(spark, b), 7, days=3, same=("party",)).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(a, b) if near(x, y) and x[6] and x[6] == y[6]}


def test_long_alternating_paths_and_components(spark):
    n = 3000  # deeper than a recursion could go
    edges = [(k, k, 0.9) for k in range(n)] + [(k, k + 1, 0.95) for k in range(n - 1)]
    got = mt._augment(__import__("pandas").DataFrame(edges, columns=["a_id", "b_id", "score"]))
    assert len(got) == n and got["b_id"].is_unique
    chain = spark.createDataFrame([(k, k + j) for k in range(40) for j in (0, 1)] + [(100, 200)], "a_id long, b_id long")
    assert {(r.a_id, r.component) for r in mt.components(chain).collect()} == {(k, 0) for k in range(40)} | {(100, 100)}


def test_subset_bounds(spark):
    targets = spark.createDataFrame([(1, 21), (2, -7), (3, 100_000), (4, None)], "group_key long, units long")
    pool = spark.createDataFrame([*((1, k, k) for k in range(1, 7)), (2, 11, -3), (2, 12, -4), (2, 13, 4), (3, 21, 40_000), (3, 22, 30_000), (3, 23, 30_005)], "group_key long, id long, units long")
    run = lambda **more: {r.group_key: (r.status, list(r.members)) for r in mt.subset_groups(targets, pool, **more).collect()}
    assert run() == {1: ("limited", []), 2: ("unique", [11, 12]), 3: ("none", [])}
    assert run(tolerance=5)[3] == ("unique", [21, 22, 23]) and run(most=6)[1] == ("unique", [1, 2, 3, 4, 5, 6])
    assert run(most=6, most_pool=5)[1][0] == "limited"


def test_groups_in_both_directions(spark):
    import datetime as dt

    day = dt.date(2005, 3, 1)
    a = recs(spark, [(1, day, 10_000, "EUR", None, None, "p"), (2, day, 300, "EUR", None, None, "q"), (3, day, 700, "EUR", None, None, "q"), (4, day, 50, "EUR", None, None, "r"), (5, None, 50, "EUR", None, None, "r")])
    b = recs(spark, [(11, day, 4000, "EUR", None, None, "p"), (12, day, 3000, "EUR", None, None, "p"), (13, day, 3000, "EUR", None, None, "p"), (14, day, 500, "EUR", None, None, "p"), (21, day, 1000, "EUR", None, None, "q"), (31, day, 50, "EUR", None, None, "r"), (32, day, 20, "EUR", None, None, "r"), (33, day, 30, "EUR", None, None, "r")])
    got = {(r.anchor_side, r.anchor_id): (r.status, list(r.members)) for r in mt.grouped_matches(a, b).collect()}
    assert got[("A", 1)] == ("unique", [11, 12, 13]) and got[("B", 21)] == ("unique", [2, 3])
    assert got[("A", 4)] == ("ambiguous", [])  # one record alone would do as well
    assert mt.grouped_matches(a.limit(0), b).where("status = 'unique'").count() == 0


def test_overlaps_and_entities(spark):
    import datetime as dt

    random.seed(6)
    day = lambda k: None if k is None else dt.date(2005, 1, 1) + dt.timedelta(days=k)

    def spans(n):
        out = []
        for k in range(n):
            lo = random.choice([None, random.randint(0, 300)])
            out.append((k, day(lo), day(random.choice([None, (lo or 0) + random.randint(0, 90)]))))
        return out

    x, y = spans(25), spans(25)
    df = lambda rows: spark.createDataFrame(rows, "id long, lo date, hi date")
    low, high = dt.date.min, dt.date.max
    want = {(p[0], q[0]) for p, q in itertools.product(x, y) if (p[1] or low) <= (q[2] or high) and (p[2] or high) >= (q[1] or low)}
    got = [tuple(r) for r in mt.overlapping(df(x), df(y)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    names = spark.createDataFrame([("ACME TRADING",), ("ACME TRADNG",), ("OLD NAME",), ("ZZZ",), (None,)], "name string")
    entities = spark.createDataFrame([(1, "ACME TRADING"), (2, "OTHER WORKS")], "entity_id long, name string")
    aliases = spark.createDataFrame([("OLD NAME", 2, "APPROVED"), ("ZZZ", 1, "PENDING")], "alias string, entity_id long, status string")
    got = {r.name: (r.entity_id, r.how) for r in mt.resolved_entities(names, entities, aliases).collect()}
    assert got == {"ACME TRADING": (1, "exact_name"), "ACME TRADNG": (1, "fuzzy"), "OLD NAME": (2, "approved_alias"), "ZZZ": (None, "unresolved")}
