import datetime as dt
import hashlib
import hmac
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import formats as fm
from tallyloom.functions import narrative as nv
from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import audit as au
from tallyloom.operators import checks as ck
from tallyloom.operators import mapping as mp
from tallyloom.operators import quality as ql
from tallyloom.operators import reporting as rp
from tallyloom.operators import rules as rl
from tallyloom.operators import scoring as sc
from tallyloom.sources import connectors as cn
from tallyloom.sources.writers import PACKAGE, SETTINGS, write_audit_package, write_by_tenant, zip_export


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_amounts_that_are_none(spark):
    good = {"EUR 1,234.50": "1234.5", "1 234.5": "1234.5", "1'234": "1234", "-5": "-5", "5-": "-5", "+5": "5", "(1,000.25)": "-1000.25", "$3": "3", ".5": "0.5", "7.": "7", "12 USD": "12"}
    bad = ["12-34", "1,2,3", "2024-01-05", "(5", "5)", "(-5)", "-5-", "1,23", "12,3456", "abc", "", " ", "--5", "1.2.3", None]
    got = {r.x: r.v for r in column(spark, [*good, *bad]).select("x", vl.parsed_amount(F.col("x")).alias("v")).collect()}
    assert {k: got[k] for k in good} == {k: Decimal(v) for k, v in good.items()}
    assert all(got[k] is None for k in bad)
    comma = {"1.234,50": "1234.5", "5,5-": "-5.5", "1234": "1234", "1,234.5": None, "1.23": None}
    got = {r.x: r.v for r in column(spark, comma).select("x", vl.parsed_amount(F.col("x"), True).alias("v")).collect()}
    assert got == {k: v and Decimal(v) for k, v in comma.items()}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["2024-01-05", "2024-1-5"], "ISO_YMD"), (["20240105"], "YMD_COMPACT"), (["05 Mar 2024", "06 mar 2024"], "DMY_MONTHNAME_SPACE"), (["Mar 5, 2024"], "MDY_MONTHNAME"), (["5.3.2024"], "DMY_DOT"),
        (["01/02/2024", "13/02/2024"], "DMY_NUMERIC"), (["01/02/2024", "01-13-2024"], "MDY_NUMERIC"), (["01/02/2024", None, ""], "AMBIGUOUS"), (["13/01/2024", "01/13/2024"], "CONTRADICTORY"), (["2024-01-05", "x"], "UNKNOWN"), (["2024-13-05"], "UNKNOWN"), ([None, " "], None),
    ],
)
def test_date_formats(spark, values, want):
    assert column(spark, values).agg(fm.date_format(F.col("x")).alias("f")).first().f == want


@pytest.mark.parametrize(("values", "want"), [(["1,234.56", "7"], "DOT_DECIMAL"), (["1.234,56"], "COMMA_DECIMAL"), (["1,5", "1.5"], "AMBIGUOUS"), (["12", "-3"], "PLAIN"), (["EUR 1.5", "(2.25)"], "DOT_DECIMAL"), (["a1.5"], "UNKNOWN"), ([None], None)])
def test_number_formats(spark, values, want):
    assert column(spark, values).agg(fm.number_format(F.col("x")).alias("f")).first().f == want


def test_dates_by_label(spark):
    rows = column(spark, ["05-Mar-2024", "5/3/2024", None]).select(fm.date_by_label(F.col("x"), "DMY_MONTHNAME").alias("a"), fm.date_by_label(F.col("x"), "DMY_NUMERIC").alias("b")).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 3, 5), None), (None, dt.date(2024, 3, 5)), (None, None)]
    with pytest.raises(ValueError):
        fm.date_by_label(F.col("x"), "YDM")


def test_narratives(spark):
    texts = ["STRIPE PAYOUT 8F42 for INV-0042", "PayPal transfer: AB-12", "strp-9X77", "pay po_12345678Ab", "P.O. AB12 / Acme Works", "cheque 445", "EREF:XY-99", "DE89370400440532013000", "ADYEN none", None]
    found = [[(x.kind, x.normalized, x.provider) for x in r.f] for r in column(spark, texts).select(nv.extract_references(F.col("x")).alias("f")).collect()]
    assert found[0] == [("settlement_id", "8F42", "stripe"), ("invoice_number", "INV0042", None)]
    assert found[1:4] == [[("settlement_id", "AB12", "paypal")], [("settlement_id", "STRP9X77", "stripe")], [("settlement_id", "PO12345678AB", "stripe")]]
    assert [f[0][:2] for f in found[4:8]] == [("purchase_order", "AB12"), ("check_number", "445"), ("reference", "XY99"), ("counterparty_account", "DE89370400440532013000")]
    assert found[8:] == [[], []]
    ends = [r.e for r in column(spark, ["x / Acme Works", "x | A", "Acme", "a/b/7-Up", None]).select(nv.trailing_entity(F.col("x")).alias("e")).collect()]
    assert ends == ["Acme Works", None, None, None, None]
    masks = [tuple(r) for r in column(spark, ["DE89 3704 0044 0532 0130 00 and 4111-1111-1111-1111", "a@b.org 123456789", None]).select(nv.masked(F.col("x")), nv.mask_count(F.col("x"))).collect()]
    assert masks == [("[IBAN] and [CARD]", 2), ("[EMAIL] [ACCOUNT]", 2), (None, None)]
    secret = column(spark, ['{"a": {"api_key": "x\\"y"}, "n": 1, "my_token" : 5, "list": [{"password": null}]}']).select(nv.redacted_json(F.col("x")).alias("r")).first().r
    assert json.loads(secret) == {"a": {"api_key": "[REDACTED]"}, "n": 1, "my_token": "[REDACTED]", "list": [{"password": "[REDACTED]"}]}
    pair = spark.range(1).select(nv.redacted_map(F.create_map(F.lit("Secret_id"), F.lit("s"), F.lit("b"), F.lit("t"))).alias("m")).first().m
    assert pair == {"Secret_id": "[REDACTED]", "b": "t"}
    assert column(spark, ["ﬁne"]).select(tx.normalize_text(F.col("x"), True).alias("n")).first().n == "FINE"


def test_money(spark):
    df = spark.createDataFrame([(Decimal(10), "EUR", Decimal(4), "EUR", Decimal(0))], "x decimal(24,8), xc string, y decimal(24,8), yc string, z decimal(24,8)")
    x, xc, y, yc, z = (F.col(c) for c in df.columns)
    assert df.select(vl.money_sum(x, xc, y, yc), vl.money_difference(x, xc, y, yc)).first() == (Decimal(14), Decimal(6))
    assert tuple(df.select(vl.within_share(x, y, "1.5"), vl.within_share(x, z, "9"), vl.within_share(z, z, "0"), vl.fee_explains(x, -F.lit(6), y), vl.fx_explains(x, F.lit("0.4").cast("decimal(24,8)"), y)).first()) == (True, False, True, True, True)
    with pytest.raises(Exception, match="different currencies"):
        df.select(vl.money_sum(x, xc, y, F.lit("USD"))).collect()


def test_mapping(spark):
    found = mp.suggested([("Date", "date"), ("Memo", "text"), ("InvoiceNo", "identifier"), ("Value", "amount"), ("Ccy", "currency"), ("Amount", "date"), ("Empty Reference", "empty")])
    assert {f: b.column for f, b in found.columns.items()} == {"invoice_number": "InvoiceNo", "reference": "Memo", "currency": "Ccy", "amount": "Value", "transaction_date": "Date"}
    assert not found.faults() and found.columns["invoice_number"].confidence == 0.95
    assert len(mp.Mapping({"nonsense": mp.Bound("x"), "reference": mp.Bound("x")}).faults()) == 4
    rows = spark.createDataFrame([("05/03/2024", "1.234,50", "STRIPE PAYOUT 8F42 / Acme Works", None, "x"), ("2024-03-05", "1,2", None, " ", "y"), (None, None, "", "R-1", "z")], "d string, v string, t string, r string, `odd name` string")
    mapping = mp.Mapping({"transaction_date": mp.Bound("d", "DMY_NUMERIC"), "amount": mp.Bound("v", "COMMA_DECIMAL", negate=True), "description": mp.Bound("t"), "reference": mp.Bound("r")}, {"currency": "eur"})
    a, b, c = mp.apply_mapping(rows, mapping, ["odd name"]).collect()
    assert (a.transaction_date, a.amount, a.currency, a.debit_credit, a.reference, a.settlement_id, a.counterparty_name, a["_errors"]) == (dt.date(2024, 3, 5), Decimal("-1234.5"), "EUR", "credit", "8F42", "8F42", "Acme Works", [])
    assert b.amount == Decimal("-1.2") and b["_errors"] == ["transaction_date can't be read"]
    assert c["_errors"] == ["amount is missing"] and c.reference == "R-1" and c["odd name"] == "z"
    with pytest.raises(ValueError):
        mp.apply_mapping(rows, mp.Mapping())
    assert mp.apply_mapping(rows.limit(0), mapping).count() == 0


PAIR = "a_id long, b_id long, a_amount decimal(24,8), b_amount decimal(24,8), a_currency string, b_currency string, a_best_date date, b_best_date date, a_normalized_reference string, b_normalized_reference string, a_normalized_counterparty string, b_normalized_counterparty string"


def pair(**more):
    base = dict(a_id=1, b_id=2, a_amount=Decimal("1250"), b_amount=Decimal("1250"), a_currency="EUR", b_currency="EUR", a_best_date=dt.date(2026, 8, 15), b_best_date=dt.date(2026, 8, 15), a_normalized_reference="INV4930", b_normalized_reference="INV4930", a_normalized_counterparty="ACME", b_normalized_counterparty="ACME")
    return tuple({**base, **more}.values())


def test_score_bands(spark):
    late = dt.date(2026, 8, 18)
    rows = [pair(), pair(a_normalized_reference=None, b_normalized_reference=None), pair(b_best_date=late), pair(a_best_date=None), pair(b_currency="USD"), pair(b_normalized_reference="INV5000")]
    df = sc.features(spark.createDataFrame(rows, PAIR)).select(sc.score().alias("s"), sc.reasons()["code"].alias("r"), sc.warnings().alias("w"), sc.hard_conflicts(sc.warnings()).alias("h"))
    same, bare, days, undated, foreign, other = df.collect()
    assert same.s >= 0.995 and bare.s < 0.8 and 0.8 <= days.s < 0.995
    assert same.r == ["REFERENCE_EXACT", "AMOUNT_EXACT", "CURRENCY_EXACT", "DATE_SAME_DAY", "COUNTERPARTY_EXACT"] and same.w == []
    assert undated.w == ["NO_COMPARABLE_DATE"] and foreign.w == ["CONFLICT_CURRENCY_MISMATCH"] and foreign.h == 1
    assert other.w == ["CONFLICT_REFERENCE_DISAGREES"]


def test_rules(spark):
    df = spark.createDataFrame([pair(), pair(b_best_date=dt.date(2026, 8, 17), b_amount=Decimal("1250.25")), pair(a_best_date=None, a_normalized_reference=None)], PAIR)
    for name in ("invoice_number",):
        df = df.withColumns({f"a_normalized_{name}": F.lit("INV1"), f"b_normalized_{name}": F.lit("INV1")})
    df = df.withColumns({f"{s}_external_transaction_id": F.lit(None).cast("string") for s in "ab"})
    got = [(r.rule, r.score) for r in rl.rule_scores(df, list(rl.BANK_RULES)).collect()]
    assert sorted(got) == [("amount_date_counterparty", 0.7), ("amount_date_counterparty", 1.0), ("exact_reference", 1.0), ("invoice_amount_date", 1.0)]
    assert [r.name for r in rl.ordered([rl.BANK_RULES[3], rl.BANK_RULES[0], rl.BANK_RULES[1]])] == ["exact_external_id", "exact_reference", "amount_date_counterparty"]
    with pytest.raises(ValueError):
        rl.ordered([rl.BANK_RULES[0]] * 2)
    holds, strength = rl.compiled(rl.Condition("reference", "exact"))
    assert [tuple(r) for r in df.select(holds, strength).collect()][-1] == (False, 0.0)
    with pytest.raises(ValueError):
        rl.compiled(rl.Condition("reference", "guess"))


def test_quality_levels(spark):
    ddl = "record_id string, external_id string, checksum string, kind string, amount decimal(24,8), currency string, date date, reference string, invoice string"
    day = dt.date(2024, 1, 1)
    clean = spark.createDataFrame([("1", "e1", "c1", "k", Decimal(5), "EUR", day, "r", None), ("2", "e2", "c2", "k", Decimal(6), "EUR", day, "r", None)], ddl)
    assert ql.quality_findings(clean, expected_total=11, rows_before=2).count() == 0
    assert ql.gate_level(ql.quality_findings(clean)).first().level == "PASS"
    warned = {r.code for r in ql.quality_findings(clean, warned=("x",), rows_before=1).collect()}
    assert warned == {"COLUMN_WARNING", "ROW_COUNT_CHANGE"}
    assert {r.code for r in ql.quality_findings(clean.limit(0), read=0).collect()} == {"FILE_EMPTY"}
    assert ql.gate_level(ql.quality_findings(clean.limit(0), read=3)).first().level == "FAIL"


def test_controls(spark):
    lines = spark.createDataFrame([(1, "debit", "EUR", Decimal("5")), (1, "credit", "EUR", Decimal("5.004")), (2, "debit", "EUR", Decimal(5)), (3, "debit", "EUR", Decimal(5)), (3, "credit", "USD", Decimal(5)), (4, "debit", "EUR", Decimal(0))], "j long, side string, currency string, amount decimal(24,8)")
    assert {(r.j, r.fault) for r in ck.journal_faults(lines, "j").collect()} == {(2, "UNBALANCED"), (3, "MIXED_CURRENCIES"), (4, "ZERO")}
    assert au.settings_hash({"b": 1, "a": [1, 2]}) == au.settings_hash({"a": [1, 2], "b": 1})
    first = rp.certificate_hash({"run": 1, "certificate_hash": ""}, "h")
    assert first == rp.certificate_hash({"certificate_hash": first, "run": 1}, "h") != rp.certificate_hash({"run": 1}, "i")
    shown = rp.handed_on(spark.createDataFrame([("a@b.org", "secret")], "description string, other string"), "extract")
    assert shown.columns == ["description"] and shown.first()[0] == "[EMAIL]"
    with pytest.raises(ValueError):
        rp.handed_on(shown, "nothing")


def test_signatures_and_cursor(spark):
    for secret in ("k", "long " * 30):
        got = column(spark, ["1.héllo"]).select(cn.hmac_sha256(secret, F.col("x")).alias("h")).first().h
        assert got == hmac.new(secret.encode(), "1.héllo".encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("b", None), ("b", "t=x,v1=1"), (None, "t=1,v1=1")], "body string, header string")
    assert [r[0] for r in rows.select(cn.notice_verdict(F.col("body"), F.col("header"), "k", F.lit(1))).collect()] == ["malformed", "malformed", "invalid_signature"]
    cursor = cn.Cursor().advanced("p9", "2024-01-01").advanced("p8")
    assert cn.Cursor.from_json(cursor.to_json()) == cursor == cn.Cursor("p8", "2024-01-01", 2) and cn.Cursor.from_json(None) == cn.Cursor()


def test_recorded_pages(spark, tmp_path):
    payout = {"id": "po_1", "amount": 98245, "currency": "eur", "arrival_date": 1756598400, "summary": {"gross": 105000, "fee": 1755}, "transactions": [{"id": "t1", "type": "charge", "amount": 100000, "fee": 1755}]}
    write = lambda n, records: (tmp_path / f"page-{n:03d}.json").write_text(json.dumps({"data": records}))
    write(1, [payout, payout])
    write(2, [{"id": "po_2", "amount": 500, "currency": "jpy", "created": 1756598400}, {"amount": 1}])
    spark.dataSource.register(cn.RecordedPages)
    raw = spark.read.format("recorded_pages").load(str(tmp_path))
    got = {r.payout_id: (r.amount, r.gross_amount, r.fee_amount, str(r.transaction_date), r.description) for r in cn.payouts(raw, "record", "c").collect()}
    assert got["po_1"][:3] == (Decimal("982.45"), Decimal(1050), Decimal("17.55")) and got["po_1"][3] == "2025-08-31"
    assert got["po_2"] == (Decimal(500), None, None, "2025-08-31", "PAYOUT po_2") and len(got) == 2
    assert {r.payout_id for r in cn.payout_faults(raw, "record").where("payout_id is not null").collect()} == {"po_2"}
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("recorded_pages").load(str(tmp_path))
        job = stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", state).start()
        job.processAllAvailable()
        job.stop()
        return spark.read.parquet(rows).count()

    assert run() == 4
    write(3, [payout])
    assert run() == 5  # the first pages are not read again


def test_packages(spark, tmp_path):
    table = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string")
    manifest = write_audit_package({n: table for n, _ in PACKAGE}, {n: {"x": 1} for n in SETTINGS}, str(tmp_path / "p"))
    listed = json.loads((tmp_path / "p" / "manifest.json").read_text())
    assert len(listed) == manifest.count() >= 10 and all(len(m["checksum"]) == 64 for m in listed)
    with pytest.raises(ValueError):
        write_audit_package({"exceptions": table}, {}, str(tmp_path / "q"))
    files = {n: str(tmp_path / "p" / f"{n}.json") for n in SETTINGS}
    for name in ("a.zip", "b.zip"):
        zip_export(files, str(tmp_path / name))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    with pytest.raises(Exception, match="another tenant"):
        write_by_tenant(table, str(tmp_path / "t"), "v", only="a")


def test_scores_without_dates_or_sides(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([(10,), (11,)], "id long")
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2)], "a_id long, b_id long, score double")
    assert {tuple(r) for r in rp.leftover_pairs(left, right, scored).select("a_id", "b_id").collect()} == {(1, 10), (2, None), (None, 11)}
    none = lambda ddl: spark.createDataFrame([], ddl)
    empty = rp.run_summary(none("id long, units long"), none("id long, units long"), none("decision string, status string, units long, members int"), none("severity string, age_days int")).first()
    assert (empty.difference, empty.completion_pct, empty.auto_rate, empty.review_rate, empty.false_rate) == (0, 0.0, 0.0, 0.0, None)
