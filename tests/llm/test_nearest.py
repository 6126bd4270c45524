import datetime as dt
import random

from tallyloom.llm import nearest as nr
from tallyloom.llm.nearest import nearest_in_time, party_key
from pyspark.sql import functions as F

DDL = "row_id long, booked_at timestamp, entity string, tick string"
T0 = dt.datetime(2005, 3, 1)


def brute(left, right, tolerance):
    out = set()
    for i, t, e, _ in left:
        best = min(((abs((u - t).total_seconds()), u, j) for j, u, f, _ in right if None not in (t, u, e, f) and e == f and abs(u - t) <= tolerance), default=None)
        if best:
            out.add((i, best[2]))
    return out


def run(spark, left, right, seconds=12 * 3600):
    rows = nearest_in_time(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), "entity", "booked_at", "row_id", "row_id", seconds)
    return {(r.left_id, r.right_id) for r in rows.collect()}


def test_equals_brute_force(spark):
    random.seed(3)
    for seconds in (60, 3600, 12 * 3600):
        make = lambda n: [(k, None if random.random() < 0.05 else T0 + dt.timedelta(seconds=random.randint(0, 40) * seconds // 7), random.choice(["a", "a", "b", None]), "x") for k in range(n)]  # noqa: B023, E731
        left, right = make(120), make(90)
        assert run(spark, left, right, seconds) == brute(left, right, dt.timedelta(seconds=seconds))


def test_crowded_ticks_are_cut_finer(spark, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(nr, "PER_TICK", 3)
    monkeypatch.setattr(nr, "FINER", 4)
    spot = lambda: T0 + dt.timedelta(seconds=random.choice([0, 0, 43_200, 86_400]), microseconds=random.choice([0, 1, 7, 50, 999, 10**6, random.randint(0, 4 * 10**10)]))
    make = lambda n: [(k, spot(), random.choice(["a", "a", "a", "b", "c"]), "x") for k in range(n)]
    left, right = make(150), make(150)
    assert run(spark, left, right) == brute(left, right, dt.timedelta(hours=12))


def test_ties_edges_and_empty(spark):
    h = dt.timedelta(hours=12)
    left = [(1, T0, "a", None), (1, T0, "a", None)]
    assert run(spark, left, [(7, T0 + h, "a", None), (5, T0 - h, "a", None), (6, T0 - h, "a", None)]) == {(1, 5)}
    assert run(spark, left, [(7, T0 + h + dt.timedelta(microseconds=1), "a", None)]) == set()
    assert run(spark, [], left) == set() and run(spark, left, []) == set()


def test_party_key(spark):
    df = spark.createDataFrame([(" a  b ",), ("?",), (None,), ("unknown",)], "n string")
    assert [r.k for r in df.select(party_key(F.col("n")).alias("k")).collect()] == ["A B", None, None, "UNKNOWN"]
