import pytest

from pyspark.sql import functions as F

from tallyloom.llm import mixing as mx
from tallyloom.llm.mixing import mix_report, mix_sources, token_budgets


def docs(spark, spec):
    rows, k = [], 0
    for source, n, size in spec:
        for _ in range(n):
            rows.append((k, source, size, 1.0 if k % 7 else None, "clash"))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double, bin string")


def goals(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_budgets():
    got = token_budgets({"a": 100, "b": 10, "z": 5}, [("a", 0.5, 1), ("b", 0.3, 4), ("missing", 0.2, 3), (None, 0.1, 1)])
    assert got == {"a": (pytest.approx(0.625), 66), "b": (pytest.approx(0.375), 40)}
    assert token_budgets({}, [("a", 1.0, 1)]) == {}


def test_shares_caps_and_determinism(spark):
    sized = docs(spark, [("big", 3000, 11), ("mid", 400, 7), ("small", 50, 5), (None, 20, 5), ("unlisted", 30, 5), ("empty", 9, 0)])
    targets = goals(spark, [("big", 0.6, 1), ("mid", 0.38, 5), ("small", 0.02, 4), ("absent", 0.1, 2)])
    mixed = mix_sources(sized, targets).cache()
    report = {r.source: r for r in mix_report(sized, mixed, targets).collect()}
    for name, share in (("big", 0.6), ("mid", 0.38), ("small", 0.02)):
        assert report[name].actual_share == pytest.approx(share, abs=0.005)
        assert report[name].most_copies <= report[name].max_repeats
    assert report["absent"].mixed_tokens == 0 and report[None].mixed_tokens == 0
    assert mixed.where("copies < 1").count() == 0
    same = lambda a, b: a.exceptAll(b).count() + b.exceptAll(a).count()
    assert same(mixed, mix_sources(sized.repartition(3), targets)) == 0
    part = mixed.where("source = 'mid'").groupBy("copies").count().collect()
    assert len(part) <= 2  # whole epochs, then a fraction


def test_weights_matter_and_empty(spark):
    sized = docs(spark, [("a", 2000, 10)]).selectExpr("doc_id", "source", "n_tokens", "case when doc_id % 2 = 0 then 8.0 else 1.0 end as weight")
    picked = mix_sources(sized, goals(spark, [("a", 1.0, 1)]), total_tokens=4000)
    even = picked.where("doc_id % 2 = 0").count()
    assert even > 0.75 * picked.count() and 390 <= picked.count() <= 400
    assert mix_sources(sized.limit(0), goals(spark, [("a", 1.0, 1)])).count() == 0
    assert mix_sources(sized, goals(spark, [])).count() == 0


def test_the_end_is_small_for_every_weight(spark, monkeypatch):
    monkeypatch.setattr(mx, "DOCS_PER_BIN", 20)
    monkeypatch.setattr(mx, "BINS", 8)
    sized = docs(spark, [("a", 4000, 10)]).withColumn("weight", F.lit(0.25))
    keyed = sized.selectExpr("doc_id", "source", "n_tokens", "-ln((pmod(xxhash64(doc_id), 100000) + 0.5) / 100000) / weight as key")
    for rest in (0, 5, 12_345, 39_990, 39_999):
        lo, hi, before = mx._budget_ends(keyed, {"a": rest})["a"]
        inside, below = keyed.where(f"key >= {lo!r} and key < {hi!r}").count(), keyed.where(f"key < {lo!r}").count()
        assert 1 <= inside <= 20 and before == below * 10 and before <= rest < (below + inside) * 10 + 1
    for tokens in (12_345, 39_999):
        mixed = mix_sources(sized, goals(spark, [("a", 1.0, 1)]), total_tokens=tokens)
        assert mixed.count() == tokens // 10
    with pytest.raises(ValueError):
        mix_sources(sized, goals(spark, [("a", 0.5, 1), ("a", 0.5, 1)]))
