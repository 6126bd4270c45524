import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.llm import history as hs
from tallyloom.llm.history import HashHistory, admit_batch, deliveries, identity_code, repeated_rows, repeats

DDL = "row_id long, batch_no int, id string, booked_at timestamp, description string, reference string, counterparty string, amount decimal(24,8), currency string, clock string"
T0 = dt.datetime(2005, 3, 1, 10, 20, 30, 123000)


def row(k, ident, at=T0, text="TRF steel", ref="INV-1", party="Acme", amount="10.50", batch=1):
    return (k, batch, ident, at, text, ref, party, Decimal(amount) if amount else None, "EUR", "clash")


ROWS = [
    row(1, "BST-1234567890"),
    row(2, "bst 12345 67890"),  # written differently
    row(3, "IMP9999-000001", text="TRF ste"),  # new id, cut text
    row(4, "BST-1234567809", at=T0 + dt.timedelta(days=1)),  # digits swapped, next day
    row(5, "IMP9999-000002", at=T0 + dt.timedelta(minutes=26)),  # whole minutes off
    row(6, "BST-5555555555", at=T0 + dt.timedelta(seconds=1)),  # another payment alike
    row(7, "BST-6666666666", at=T0 + dt.timedelta(days=9)),  # same clock, another week
    row(8, "BST-7777777777", amount="11.00"),  # same clock, other amount
    row(9, "BST-8888888888", at=None, text=None, ref=None, party=None, amount=None),
    row(10, "BST-8888888888-01", at=None, text="", ref=None, party=None, amount=None),
    row(11, None, at=None, text="z" * 50_000),
    row(12, "BST-1234567890", batch=2),
]


def test_repeats(spark):
    df = spark.createDataFrame([*ROWS, (None, *ROWS[0][1:])], DDL)
    got = {tuple(r) for r in repeated_rows(df, "description").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (1, 12), (9, 10)}
    assert repeated_rows(df.limit(0), "description").count() == 0


def test_tables_at_once_stay_apart(spark):
    a = spark.createDataFrame([row(1, "X-1234567890")], DDL).selectExpr("*", "'A' as side")
    b = spark.createDataFrame([row(2, "X-1234567890")], DDL).selectExpr("*", "'B' as side")
    both = a.unionByName(b)
    assert repeated_rows(both, "description", "side").count() == 0
    assert repeated_rows(both, "description").count() == 1


def by_batches(spark, df):
    """Admitted one by one against a history of four buckets."""
    history = HashHistory(spark, 4)
    for n in sorted(r.batch_no for r in df.select("batch_no").distinct().collect()):
        admit_batch(history, df.where(f"batch_no < {n}"), df.where(f"batch_no = {n}"), "description")
    history.drop()
    return {tuple(r) for r in repeats(history).collect()}


def test_batches_equal_one_pass(spark, monkeypatch):
    monkeypatch.setattr(hs, "COMPACT_EVERY", 2)
    df = spark.createDataFrame([(r[0], k // 3, *r[2:]) for k, r in enumerate(ROWS)], DDL)
    whole = {tuple(r) for r in repeated_rows(df, "description", batch=None).collect()}
    assert by_batches(spark, df) == whole
    assert {tuple(r) for r in repeated_rows(df, "description", least=1).collect()} == whole
    assert deliveries(df, "batch_no", 5) == [(0, 1), (2, 3)] and deliveries(df.limit(0), "batch_no") == []


def test_chains_reach_the_first_row_through_batches(spark):
    chain = [
        row(1, "BST-1111111111", batch=1),
        row(2, "BST-1111111111", at=T0 + dt.timedelta(seconds=7), batch=2),  # the same identity, another clock
        row(3, "BST-3333333333", at=T0 + dt.timedelta(seconds=7), batch=3),  # another identity, that clock
        # Two records that a third delivery ties together are one.
        row(10, "BST-4444444444", at=T0 + dt.timedelta(seconds=11), ref="A", party=None, text=None, batch=1),
        row(11, "BST-5555555555", at=T0 + dt.timedelta(seconds=13), ref="B", party=None, text=None, batch=2),
        row(12, "BST-4444444444", at=T0 + dt.timedelta(seconds=13), ref="B", party=None, text=None, batch=3),
    ]
    df = spark.createDataFrame(chain, DDL)
    assert by_batches(spark, df) == {(1, 2), (1, 3), (10, 11), (10, 12)}
    assert {tuple(r) for r in repeated_rows(df, "description", batch=None).collect()} == {(1, 2), (1, 3), (10, 11), (10, 12)}


def test_identity_codes(spark):
    ids = ["BST-0234567890", "bst 02345 67890", "BST/0234.567.890", "Bst_234567890", "BST-0234567890-01", "BST-0234567890/2", "BST-0234567890-R", "BST-0234567890_resend", "BST-0234567890 DUP"]
    df = spark.createDataFrame([(i,) for i in [*ids, "A-12345678901234", "A-12345678901235", "X-7", "none", "", None]], "id string")
    got = [r.c for r in df.select(identity_code(F.col("id")).alias("c")).collect()]
    assert got == ["234567890"] * len(ids) + ["12345678901234", "12345678901235", "7", None, None, None]


def test_like_payments_minutes_apart(spark):
    rows = [row(1, "X-1", text="PAYMENT ORDER steel works march", ref=None, party=None), row(2, "X-2", at=T0 + dt.timedelta(minutes=3), text="PAYMENT ORDER copper wire april", ref=None, party=None), row(3, "X-3", text="rent flat a", ref=None, party=None, amount="6"), row(4, "X-4", at=T0 + dt.timedelta(minutes=3), text="rent flat b", ref=None, party=None, amount="6")]
    assert repeated_rows(spark.createDataFrame(rows, DDL), "description").count() == 0


def test_a_record_on_a_third_of_rows(spark):
    rows = [row(k, "BST-1111111111") for k in range(100)] + [row(1000 + k, f"BST-{k:010d}", at=T0 + dt.timedelta(milliseconds=1001 * (k + 1))) for k in range(200)]
    got = repeated_rows(spark.createDataFrame(rows, DDL), "description").collect()
    assert len(got) == 99 and {r.first_row_id for r in got} == {0}


def test_whole_texts_are_compared(spark):
    bare = dict(ref=None, party="Acme")
    rows = [
        # Without a clock: numbers behind like beginnings are other payments.
        row(1, None, at=None, text="paiement facture 3020247", **bare),
        row(2, None, at=None, text="paiement facture 3020251", **bare),
        row(3, None, at=None, text="Paiement, facture 3020247", **bare),
        row(4, None, at=None, text="paiement facture 3020247 du mois", **bare),
        row(5, None, at=None, text="paiement fac", **bare),
        # Under a reference a text may be cut short.
        row(10, None, at=None, text="paiement facture", ref="F-1", amount="20"),
        row(11, None, at=None, text="paiement", ref="F-1", amount="20"),
        row(12, None, at=None, text="virement", ref="F-1", amount="20"),
        # With a clock the text alone may tell, wherever its letters stand.
        row(20, None, text="-" * 45 + "steel for May", ref=None, party=None, amount="30"),
        row(21, None, text="steel for", ref=None, party=None, amount="30"),
        row(22, None, text="steel for June", ref=None, party="Other", amount="40"),
        row(23, None, text="steel for May", ref=None, party="Acme", amount="40"),
    ]
    got = {tuple(r) for r in repeated_rows(spark.createDataFrame(rows, DDL), "description").collect()}
    assert got == {(1, 3), (1, 4), (10, 11), (20, 21)}
