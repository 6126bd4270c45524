import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.plans.reconcile import QUERIES


def name_tables(tmp_path, spark, xs, ys):
    for table, names in (("source_a", xs), ("source_b", ys)):
        spark.createDataFrame([(n,) for n in names], "counterparty string").write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def invented_names(count, seed):
    """Names that share a legal form, with slips, accents, other alphabets and long ones."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    few = ["GmbH", "Ωmega ΩΣ GmbH", "İstanbul gmbh", "中文 GmbH", "aaaa aaab GmbH", "A", "a-", "", "--", "x" * 64 + " GmbH", "GmbH " + "ab" * 40, "GmbH " + "ba " * 45, "GmbH 😀😀 a"]
    return [*few, *(f"{word()} {word()}{draw.choice(['', ',', '.'])} {draw.choice(['GmbH', 'GMBH', 'Gmb'])}" for _ in range(count))]


WHOLE = {
    "jaro_winkler_similarity_whole": lambda x, y: F.round(sim.jaro_winkler_similarity(x, y), 6),
    "levenshtein_similarity_whole": lambda x, y: F.round(sim.levenshtein_similarity(x, y), 6),
    "trigram_similarity_whole": lambda x, y: F.round(sim.trigram_similarity(x, y), 6),
    "token_set_ratio_whole": sim.token_set_ratio,
}


@pytest.mark.parametrize("name", WHOLE)
def test_names_of_one_word_are_many_tasks(spark, tmp_path, name):
    d = name_tables(tmp_path, spark, [None, *invented_names(700, 1)], invented_names(300, 2))
    most = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(most)
    spark.conf.set(most, "-1")  # as for tables too large for it
    got = QUERIES[name](spark, d).withColumn("task", F.spark_partition_id()).cache()
    got.count()
    spark.conf.set(most, old)
    pairs = got.groupBy("x", "y").count()
    assert pairs.where("count > 1").count() == 0 and got.count() > 150_000
    # The word that all share is no task of its own: no task has half of the pairs.
    assert got.groupBy("task").count().agg(F.max("count")).first()[0] < got.count() / 2
    score = got.columns[2]
    assert got.where(~F.col(score).eqNullSafe(WHOLE[name](F.col("x"), F.col("y")))).count() == 0
    got.unpersist()
