from tallyloom.operators.copydiff import copy_differences

DDL = "id string, x string, n int, _key string"


def diff(spark, source, copy, **kw):
    rows = copy_differences(spark.createDataFrame(source, DDL), spark.createDataFrame(copy, DDL), "id", ["x", "n"], **kw).collect()
    return sorted((r.id, r.finding, r.source_value, r.copy_value) for r in rows)


def test_cells_nulls_repeats_and_missing(spark):
    source = [("a", "1", 1, "z"), ("a", "1", 1, "y"), ("b", None, 2, ""), ("c", None, None, ""), ("", "e", 5, None), (None, "q", 1, "")]
    copy = [("a", "1 ", 1, ""), ("b", "v", 2, ""), ("c", None, None, ""), ("d", "x", 0, ""), ("", "e", 6, None), (None, "r", 2, "")]
    assert diff(spark, source, copy) == [("", "n", "5", "6"), ("a", "x", "1", "1 "), ("b", "x", None, "v"), ("d", "missing_in_source", None, None)]


def test_empty_sides(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [("a", "1", 1, "")], []) == [("a", "missing_in_copy", None, None)]
    assert diff(spark, [], [("a", "1", 1, "")]) == [("a", "missing_in_source", None, None)]


def test_one_key_on_a_third_of_rows_and_many_buckets(spark):
    source = [("hot", "v", 1, str(k)) for k in range(300)] + [(f"k{k}", "x" * 5000, k, "") for k in range(600)]
    copy = [("hot", "w", 1, "")] + [(f"k{k}", "x" * 5000, k + (k % 100 == 0), "") for k in range(600)]
    got = diff(spark, source, copy, rows_hint=10_000_000)
    assert [g for g in got if g[0] == "hot"] == [("hot", "x", "v", "w")]
    assert len(got) == 7
