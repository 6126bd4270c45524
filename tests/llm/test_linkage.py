import datetime as dt
from decimal import Decimal

import numpy as np

from tallyloom.llm.linkage import LabelModel, bank_records, ledger_records, link_records, with_repeats
from tallyloom.llm.names import link_names

A = "row_id long, date date, description string, reference string, counterparty string, amount decimal(24,8), currency string, day string"
B = "row_id long, date date, memo string, reference string, invoice string, counterparty string, amount decimal(24,8), currency string, raw1 string"
D0 = dt.date(2005, 3, 1)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.column_stack([np.where(rng.random(4000) < acc, truth, ~truth) for acc in (0.9, 0.8, 0.85, 0.7)]).astype(int)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first: correlated
    pats, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q = LabelModel().fit(pats, counts.astype(float), pats.mean(axis=1))
    assert ((q[back.reshape(-1)] > 0.5) == truth).mean() > 0.9


def tables(spark):
    bank, ledger = [], []
    for k in range(60):
        day, amount, party = D0 + dt.timedelta(days=k % 20), Decimal(f"{100 + 7 * k}.{k:02d}"), f"Robert Tefgirsom{'abcdefghij'[k % 10]}"
        bank.append((k, day, "TRF", f"INV-{10_000 + 37 * k:06d}", party, amount, "EUR", "x"))
        ledger.append((1000 + k, day - dt.timedelta(days=k % 3), "m", f"VCH-{k:06d}", f"INV {10_000 + 37 * k:06d}", party, amount, "EUR", "x"))
    bank[5] = (5, bank[5][1], "TRF", None, *bank[5][4:])  # no reference
    bank[6] = (6, bank[6][1], f"TRF {bank[6][3]}", None, None, *bank[6][5:])  # only in the text, party unknown
    bank[7] = (7, bank[7][1], "TRF", bank[7][3][:-2] + bank[7][3][-2:][::-1], *bank[7][4:])  # digits swapped
    bank[8] = (8, bank[8][1], "TRF", bank[8][3], bank[8][4], bank[8][5] - Decimal("0.03"), "EUR", "x")  # a fee
    bank[9] = (9, None, *bank[9][2:])
    bank.append((100, D0, "fee", None, None, Decimal("-1.00"), "EUR", "x"))
    bank.append((101, None, None, None, None, None, None, None))
    ledger.append((2000, D0, None, None, None, None, None, None, None))
    return spark.createDataFrame(bank, A), spark.createDataFrame(ledger, B)


def link(spark, a, b):
    parties = link_names(a.selectExpr("counterparty as name").unionAll(b.selectExpr("counterparty as name"))).select("name", "party", "stem")
    return link_records(bank_records(a, parties), ledger_records(b, parties))


def test_pairs_and_confidence(spark):
    a, b = tables(spark)
    rows = link(spark, a, b).collect()
    got = {(r.a, r.b) for r in rows}
    assert got == {(k, 1000 + k) for k in range(60)}
    assert all(0.5 <= r.confidence <= 1 for r in rows)


def test_empty_sides_and_repeats(spark):
    a, b = tables(spark)
    assert link(spark, a.limit(0), b).count() == 0
    assert link(spark, a, b.limit(0)).count() == 0
    pairs = spark.createDataFrame([(1, 10, 0.9)], "a long, b long, confidence double")
    repeats = spark.createDataFrame([(1, 2), (10, 11), (10, 12)], "first_row_id long, repeat_row_id long")
    assert {(r.a, r.b) for r in with_repeats(pairs, repeats).collect()} == {(x, y) for x in (1, 2) for y in (10, 11, 12)}


def test_a_record_that_loses_its_reference_finds_its_partner(spark):
    a, b = tables(spark)
    day, party = D0, "Robert Tefgirsoma"
    bank = [(300, day, "TRF", "INV-990001", party, Decimal("495.34"), "EUR", "x"), (301, day, "TRF", "INV-990001", party, Decimal("465.21"), "EUR", "x")]
    # Both bank rows name the first invoice; the second one's own partner names none.
    ledger = [(3000, day, "m", "VCH-1", "INV-990001", party, Decimal("495.34"), "EUR", "x"), (3001, day, "m", "VCH-2", None, party, Decimal("465.21"), "EUR", "x")]
    rows = link(spark, a.unionByName(spark.createDataFrame(bank, A)), b.unionByName(spark.createDataFrame(ledger, B))).collect()
    assert {(300, 3000), (301, 3001)} <= {(r.a, r.b) for r in rows}


def test_like_payments_all_pair(spark):
    a, b = tables(spark)
    same = (D0, "TRF", None, "Robert Tefgirsoma", Decimal("77.70"), "EUR", "x")
    bank = [(400 + k, *same) for k in range(5)]
    ledger = [(4000 + k, D0, "m", "VCH-1", None, *same[3:]) for k in range(6)]
    rows = link(spark, a.unionByName(spark.createDataFrame(bank, A)), b.unionByName(spark.createDataFrame(ledger, B))).collect()
    assert {(r.a, r.b) for r in rows if r.a >= 400} == {(400 + k, 4000 + k) for k in range(5)}
