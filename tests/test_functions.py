import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.functions import text as tx
from tallyloom.functions import values as vl


def one(spark, expr, **cols):
    ddl = ", ".join(f"{k} {'decimal(24,8)' if isinstance(v, Decimal) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], ddl).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" a  b\t", "A B"), ("", None), (None, None), ("x y", "X Y")],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, tx.normalize_text(F.col("x")), x=raw) == want


def test_references(spark):
    assert one(spark, tx.normalize_reference(F.col("x")), x="inv-00 12/a") == "INV0012A"
    assert one(spark, tx.normalize_invoice_number(F.col("x")), x="INV-0004930") == "INV4930"
    assert one(spark, tx.normalize_name(F.col("x")), x="Acme Trading Co. Ltd.") == "ACME TRADING"
    assert one(spark, tx.normalize_name(F.col("x")), x="LTD") == "LTD"
    assert one(spark, tx.normalize_bank_description(F.col("x")), x="SEPA Transfer to ACME ref 12") == "ACME 12"
    found = one(spark, tx.extract_references(F.col("x")), x="STRIPE PAYOUT 8F42 inv 4930 INV-4930 PO-ABC12 CHK 123")
    assert [(r.kind, r.normalized) for r in found] == [("settlement_id", "8F42"), ("invoice_number", "INV4930"), ("purchase_order", "ABC12"), ("check_number", "123")]
    assert one(spark, tx.extract_references(F.col("x")), x="nothing") == []
    assert one(spark, tx.masked(F.col("x")), x="mail a.b@c.org acct 1234567890") == "mail [EMAIL] acct [ACCOUNT]"
    assert one(spark, tx.account_mask(F.col("x")), x="12345678") == "****5678"
    assert one(spark, tx.without_accents(F.col("x")), x="Dogzerosléx") == "Dogzeroslex"


def test_similarities(spark):
    assert round(sim.jaro_winkler("ACME", "ACMA"), 4) == 0.8833
    assert sim.jaro_winkler("", "") == 1.0 and sim.jaro("", "a") == 0.0
    assert one(spark, sim.token_set_ratio(F.col("x"), F.col("y")), x="alpha beta", y="BETA alpha") == 1.0
    assert one(spark, sim.token_set_ratio(F.col("x"), F.col("y")), x="alpha", y="beta") == 0.0
    assert one(spark, sim.levenshtein_similarity(F.col("x"), F.col("y")), x="", y="") == 1.0
    assert one(spark, sim.jaro_winkler_similarity(F.col("x"), F.col("y")), x=None, y="a") is None


def test_values(spark):
    assert one(spark, vl.minor_units(F.col("a"), F.col("c")), a=Decimal("2.345"), c="EUR") == 235
    assert one(spark, vl.minor_units(F.col("a"), F.col("c")), a=Decimal("-2.345"), c="EUR") == -235
    assert one(spark, vl.minor_units(F.col("a"), F.col("c")), a=Decimal("2.5"), c="JPY") == 3
    for raw, comma, want in (("EUR 1,234.50", False, "1234.50"), ("(12.00)", False, "-12"), ("1.234,50-", True, "-1234.5"), ("abc", False, None)):
        got = one(spark, vl.parsed_amount(F.col("x"), comma), x=raw)
        assert got == (None if want is None else Decimal(want))
    assert one(spark, vl.name_uuid(str(uuid.NAMESPACE_URL), F.col("x")), x="Zürich") == str(uuid.uuid5(uuid.NAMESPACE_URL, "Zürich"))
    assert str(one(spark, vl.parsed_date(F.col("x")), x="20050102")) == "2005-01-02"
    assert one(spark, vl.parsed_date(F.col("x")), x="01/02/2005") is None


def test_masks_of_every_identity(spark, tmp_path):
    import re

    from tallyloom.plans.reconcile import QUERIES

    ids = ["BST-1234567890", " BST 03540 13050", "bst/12345.67890", "BST-1234567890-01", "1234567890123", "IMP9999-000001", "", "x", "abc", "abcd", "abcde"]
    for table in ("copy_a", "copy_b"):
        spark.createDataFrame([(i,) for i in ids], "id string").write.parquet(f"{tmp_path}/{table}.parquet")

    def brute(text):
        for pattern, word in tx.MASKS:
            text = re.sub(pattern, word, text)
        return text

    assert {tuple(r) for r in QUERIES["masked_identities_whole"](spark, str(tmp_path)).collect()} == {(i, brute(i)) for i in ids}
    stars = lambda i: i if len(i) <= 4 else "*" * (len(i) - 4) + i[-4:]
    assert {tuple(r) for r in QUERIES["account_mask"](spark, str(tmp_path)).collect()} == {(i, stars(i)) for i in ids}


def test_whole_name_pairs_against_brute_force(spark, tmp_path):
    import re

    from tallyloom.plans.reconcile import QUERIES

    xs, ys = ["Falsinegtef, Dora", "Müller Bau", "Xcme Trading", "Ωmega", None], ["Dora Falsinegtef", "Dr. Dora Falsinegtef", "Muller Bau", "Acme Trading", "cme", "Ωmega", "Zeta"]
    for table, names in (("source_a", xs), ("source_b", ys)):
        spark.createDataFrame([(n,) for n in names], "counterparty string").write.parquet(f"{tmp_path}/{table}.parquet")

    def keys(name):
        words = re.findall(r"\w+", name.lower())
        return {k for w in words for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) if k}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            row, old = [i], row
            for j, q in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (p != q)))
        return row[-1]

    want = {(x, y) for x in xs if x for y in ys if keys(x) & keys(y)}
    assert {("Falsinegtef, Dora", "Dora Falsinegtef"), ("Müller Bau", "Muller Bau"), ("Xcme Trading", "Acme Trading"), ("Ωmega", "Ωmega")} <= want
    got = {name: {(r[0], r[1]): r[2] for r in QUERIES[f"{name}_whole"](spark, str(tmp_path)).collect()} for name in ("levenshtein_similarity", "trigram_similarity", "token_set_ratio", "jaro_winkler_similarity")}
    assert all(set(scores) == want for scores in got.values())
    assert got["levenshtein_similarity"] == {(x, y): pytest.approx(1 - edits(x, y) / max(len(x), len(y)), abs=1e-6) for x, y in want}
    assert got["jaro_winkler_similarity"] == {(x, y): pytest.approx(sim.jaro_winkler(x, y), abs=1e-6) for x, y in want}
    assert got["token_set_ratio"]["Falsinegtef, Dora", "Dora Falsinegtef"] == 1
