"""Queries of ingestion, rules, evidence, reads and controls, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import formats as fm
from tallyloom.functions import narrative as nv
from tallyloom.functions import similarity as sim
from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import audit as au
from tallyloom.operators import checks as ck
from tallyloom.operators import mapping as mp
from tallyloom.operators import matching as mt
from tallyloom.operators import quality as ql
from tallyloom.operators import reporting as rp
from tallyloom.operators import rules as rl
from tallyloom.operators import scoring as sc
from tallyloom.plans.reconcile import _NORM, _SQL_SIDES, ORACLES, QUERIES, bank, ledger, query
from tallyloom.session import read_table
from tallyloom.sources import connectors as cn

__all__ = ["ORACLES", "QUERIES"]  # with those of this module

# ------------------------------------------------------------------ ingestion

_STYLES = ("ISO_YMD", "YMD_SLASH", "YMD_COMPACT", "DMY_MONTHNAME", "DMY_MONTHNAME_SPACE", "MDY_MONTHNAME", "DMY_DOT", "DMY_NUMERIC", "MDY_NUMERIC")


@query(
    f"""WITH w AS (SELECT o_custkey % 9 AS style, count(*) AS n, max(day(o_orderdate)) AS d, max(month(o_orderdate)) AS m FROM orders GROUP BY 1)
        SELECT style, CASE WHEN style < 7 THEN {list(_STYLES)}[style + 1] WHEN d <= 12 THEN 'AMBIGUOUS' ELSE {list(_STYLES)}[style + 1] END AS date_format,
          CASE style % 3 WHEN 0 THEN 'DOT_DECIMAL' WHEN 1 THEN 'COMMA_DECIMAL' ELSE 'PLAIN' END AS number_format FROM w"""
)
def detected_formats(spark: SparkSession, d: str) -> DataFrame:
    """Dates and amounts of the orders, written in nine and three ways, and told apart again."""
    orders = read_table(spark, d, "orders").withColumn("style", F.col("o_custkey") % 9)
    patterns = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "MM-dd-yyyy")
    day, number = F.lit(None).cast("string"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    for k, pattern in enumerate(patterns):
        day = F.when(F.col("style") == k, F.date_format("o_orderdate", pattern)).otherwise(day)
    amount = F.when(F.col("style") % 3 == 0, number).when(F.col("style") % 3 == 1, F.translate(number, ",.", ".,")).otherwise(F.floor("o_totalprice").cast("string"))
    written = orders.select("style", day.alias("day"), amount.alias("amount"))
    dates = written.groupBy("style").agg(fm.date_format(F.col("day")).alias("date_format"), fm.number_format(F.col("amount")).alias("number_format"))
    return dates


_CELL = r"^(?:[+-]?{n}|{n}[+-]|\({n}\))$"
_DOT_N = r"(?:(?:[0-9]{1,3}(?:[,''\x{00A0} ][0-9]{3})+|[0-9]+)(?:\.[0-9]*)?|\.[0-9]+)"
_COMMA_N = r"(?:(?:[0-9]{1,3}(?:[.''\x{00A0} ][0-9]{3})+|[0-9]+)(?:,[0-9]*)?|,[0-9]+)"


@query(
    f"""WITH c AS (SELECT raw_id, decimal_mark, unnest(string_split(raw_text, field_sep)) AS cell, generate_subscripts(string_split(raw_text, field_sep), 1) AS pos FROM raw_lines JOIN source_files USING (file_id) WHERE raw_text IS NOT NULL),
        b AS (SELECT *, trim(regexp_replace(trim(cell), '^(?:[A-Za-z]{{3}}|[$€£¥])\\s*|\\s*(?:[A-Za-z]{{3}}|[$€£¥])$', '', 'g')) AS body FROM c),
        v AS (SELECT *, CASE WHEN decimal_mark = ',' THEN regexp_matches(body, '{_CELL.format(n=_COMMA_N)}') ELSE regexp_matches(body, '{_CELL.format(n=_DOT_N)}') END AS ok,
               regexp_replace(body, '[^0-9,.]', '', 'g') AS digits FROM b),
        x AS (SELECT raw_id, pos, (CASE WHEN regexp_matches(body, '^[-(]|-$') THEN -1 ELSE 1 END) * TRY_CAST(CASE WHEN decimal_mark = ',' THEN replace(replace(digits, '.', ''), ',', '.') ELSE replace(digits, ',', '') END AS DECIMAL(24, 8)) AS value FROM v WHERE ok)
        SELECT raw_id, CAST(pos AS INTEGER) AS pos, CAST(CAST(value AS DECIMAL(24, 8)) AS VARCHAR) AS value FROM x WHERE value IS NOT NULL"""
)
def parsed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every raw line that is an amount in the number format of its file."""
    lines = read_table(spark, d, "raw_lines").join(F.broadcast(read_table(spark, d, "source_files")), "file_id")  # one row a file
    cells = lines.where("raw_text is not null").select("raw_id", "decimal_mark", F.posexplode(F.split("raw_text", F.concat(F.lit("\\Q"), F.col("field_sep"), F.lit("\\E")))).alias("k", "cell"))
    value = F.when(F.col("decimal_mark") == ",", vl.parsed_amount(F.col("cell"), True)).otherwise(vl.parsed_amount(F.col("cell")))
    return cells.select("raw_id", (F.col("k") + 1).alias("pos"), value.cast("string").alias("value")).where("value is not null")


_LEDGER_MAPPING = mp.Mapping({"source_record_id": mp.Bound("id"), "transaction_date": mp.Bound("day", "ISO_YMD"), "description": mp.Bound("memo"), "reference": mp.Bound("reference"), "invoice_number": mp.Bound("invoice"), "counterparty_name": mp.Bound("counterparty"), "amount": mp.Bound("amount"), "currency": mp.Bound("currency")})


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "source_b").withColumns({"day": F.col("date").cast("string"), "amount": F.col("amount").cast("string")})
    return mp.apply_mapping(rows, _LEDGER_MAPPING, ["row_id"])


@query(
    f"""SELECT row_id, nullif(trim(id), '') AS source_record_id, CAST(date AS VARCHAR) AS transaction_date, CAST(amount AS VARCHAR) AS amount, nullif(upper(trim(currency)), '') AS currency,
          CASE WHEN amount > 0 THEN 'debit' WHEN amount < 0 THEN 'credit' ELSE 'unknown' END AS debit_credit, {_NORM.format('reference')} AS normalized_reference,
          regexp_replace({_NORM.format('invoice')}, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') AS normalized_invoice_number,
          CAST((amount IS NULL)::INT + (coalesce(trim(currency), '') = '')::INT AS INTEGER) AS errors FROM source_b"""
)
def mapped_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows as text, mapped to typed fields."""
    return _mapped(spark, d).select(
        "row_id", "source_record_id", F.col("transaction_date").cast("string").alias("transaction_date"), F.col("amount").cast("string").alias("amount"), "currency", "debit_credit", "normalized_reference", "normalized_invoice_number", F.size("_errors").alias("errors")
    )


@query("SELECT row_id, CASE WHEN debit <> 0 AND credit <> 0 THEN 'both a debit and a credit' WHEN coalesce(debit, 0) = 0 AND coalesce(credit, 0) = 0 THEN 'neither a debit nor a credit' END AS fault, CAST(CASE WHEN coalesce(debit, 0) <> 0 AND coalesce(credit, 0) = 0 THEN abs(debit) WHEN coalesce(credit, 0) <> 0 AND coalesce(debit, 0) = 0 THEN -abs(credit) END AS VARCHAR) AS amount FROM (SELECT row_id, CASE WHEN row_id % 5 <> 0 THEN amount END AS debit, CASE WHEN row_id % 7 = 0 OR row_id % 5 = 0 AND row_id % 2 = 0 THEN amount END AS credit FROM source_a)")
def mapped_debit_credit(spark: SparkSession, d: str) -> DataFrame:
    """Amounts spread over a debit and a credit column: one, both or neither of them filled."""
    k = F.col("row_id")
    rows = read_table(spark, d, "source_a").select("row_id", "currency", F.when(k % 5 != 0, F.col("amount")).cast("string").alias("dr"), F.when((k % 7 == 0) | ((k % 5 == 0) & (k % 2 == 0)), F.col("amount")).cast("string").alias("cr"))
    mapped = mp.apply_mapping(rows, mp.Mapping({"currency": mp.Bound("currency")}, debit="dr", credit="cr"), ["row_id"])
    fault = F.get(F.filter("_errors", lambda e: e.startswith("both") | e.startswith("neither")), F.lit(0))
    return mapped.select("row_id", fault.alias("fault"), F.col("amount").cast("string").alias("amount"))


@query()
def mapping_suggested(spark: SparkSession, d: str) -> DataFrame:
    """The fields that the columns of copy_b seem to hold, from their headers and kinds."""
    table = read_table(spark, d, "copy_b")
    kinds = {r.column_name: r.kind for r in ck.column_kinds(table, table.columns).collect()}  # one row a column
    found = mp.suggested([(c, kinds[c]) for c in table.columns]).columns
    return spark.createDataFrame([(f, b.column, b.confidence) for f, b in found.items()], "field string, column_name string, confidence double")


@query(
    """WITH r AS (SELECT *, sha256(coalesce('=' || id, '~') || chr(31) || coalesce('=' || CAST(date AS VARCHAR), '~') || chr(31) || coalesce('=' || memo, '~') || chr(31) || coalesce('=' || CAST(amount AS VARCHAR), '~')) AS checksum FROM source_b)
       SELECT * FROM (
         SELECT 'INVALID_CURRENCY' AS code, 'FAIL' AS level, count(*) AS affected FROM r WHERE coalesce(length(currency) <> 3, true)
         UNION ALL SELECT 'MISSING_DATE', 'WARN', count(*) FROM r WHERE date IS NULL
         UNION ALL SELECT 'DUPLICATE_SOURCE_ROW', 'WARN', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY checksum HAVING count(*) > 1)
         UNION ALL SELECT 'DUPLICATE_SOURCE_RECORD_ID', 'FAIL', count(*) FROM (SELECT id FROM r WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
         UNION ALL SELECT 'DUPLICATE_TRANSACTION_ID', 'FAIL', count(*) FROM (SELECT invoice FROM r WHERE invoice IS NOT NULL GROUP BY invoice HAVING count(*) > 1)
         UNION ALL SELECT 'HIGH_BLANK_REFERENCE_RATE', 'WARN', CASE WHEN count(*) FILTER (reference IS NULL AND invoice IS NULL) >= 0.2 * count(*) THEN count(*) FILTER (reference IS NULL AND invoice IS NULL) ELSE 0 END FROM r
         UNION ALL SELECT 'INCONSISTENT_SIGNS', 'WARN', count(*) FROM (SELECT memo FROM r WHERE memo IS NOT NULL GROUP BY memo HAVING count(*) FILTER (amount >= 0) > 0 AND count(*) FILTER (amount < 0) > 0)
         UNION ALL SELECT 'MIXED_CURRENCIES', 'WARN', CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END FROM (SELECT DISTINCT currency FROM r)
         UNION ALL SELECT 'TOTAL_IMBALANCE', 'FAIL', 1 UNION ALL SELECT 'ROW_COUNT_CHANGE', 'WARN', count(*) FROM r
         UNION ALL SELECT 'ROW_MAPPING_FAILED', 'FAIL', 3 UNION ALL SELECT 'MALFORMED_ROWS', 'FAIL', 2 UNION ALL SELECT 'AMBIGUOUS_DATE_FORMAT', 'WARN', 1) WHERE affected > 0"""
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every finding on the ledger rows; the counts handed in from reading and mapping are fixed."""
    b = read_table(spark, d, "source_b")
    checksum = vl.row_checksum(*[F.col(c) for c in ("id", "date", "memo", "amount")])
    rows = b.select(F.col("id").alias("record_id"), F.col("invoice").alias("external_id"), checksum.alias("checksum"), F.col("memo").alias("kind"), "amount", "currency", "date", "reference", "invoice")
    return ql.quality_findings(rows, errors=3, malformed=2, ambiguous=("day",), expected_total=-1.0, rows_before=1)


# ------------------------------------------------------------- rules and evidence

_PAIRS_SQL = f"""{_SQL_SIDES.strip()},
p AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.ref = b.ref OR a.ref = b.inv),
q AS (SELECT p.a_id, p.b_id, x.amount AS xa, y.amount AS ya, x.currency AS xc, y.currency AS yc, x.date AS xd, y.date AS yd, x.description AS xt, y.memo AS yt,
      a.ref AS xr, b.ref AS yr, regexp_replace(b.inv, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') AS yi, y.invoice AS y_invoice, y.reference AS y_reference, x.reference AS x_reference,
      nullif(regexp_replace(trim(regexp_replace(upper(strip_accents(x.counterparty)), '[^A-Z0-9]+', ' ', 'g')), '([^ ])(?: (?:{'|'.join(tx.LEGAL_SUFFIXES)}))+$', '\\1'), '') AS xp,
      nullif(regexp_replace(trim(regexp_replace(upper(strip_accents(y.counterparty)), '[^A-Z0-9]+', ' ', 'g')), '([^ ])(?: (?:{'|'.join(tx.LEGAL_SUFFIXES)}))+$', '\\1'), '') AS yp
    FROM p JOIN a ON a.id = p.a_id JOIN b ON b.id = p.b_id JOIN source_a x ON x.row_id = p.a_id JOIN source_b y ON y.row_id = p.b_id)"""
_GRAMS2 = "list_distinct(list_transform(range(1, length({0}) + 2), lambda k: ('  ' || upper({0}) || ' ')[k:k+2]))"
_TRI = "CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(" + _GRAMS2.format("{0}") + ", " + _GRAMS2.format("{1}") + ")) / len(list_distinct(list_concat(" + _GRAMS2.format("{0}") + ", " + _GRAMS2.format("{1}") + ")))::DOUBLE END"


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with an equal reference, with the fields of both records as rules name them."""
    a, b = read_table(spark, d, "source_a"), read_table(spark, d, "source_b")
    party = tx.normalize_name(tx.without_accents(F.col("counterparty")))
    shared = ["amount", "currency", F.col("date").alias("best_date"), "reference", tx.normalize_reference(F.col("reference")).alias("normalized_reference"), party.alias("normalized_counterparty")]
    described = lambda c: [F.col(c).alias("description"), tx.normalize_bank_description(F.col(c)).alias("normalized_description")]
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    left = a.select(F.col("row_id").alias("a_id"), *shared, *described("description"), *none("invoice_number", "normalized_invoice_number"))
    right = b.select(F.col("row_id").alias("b_id"), *shared, *described("memo"), F.col("invoice").alias("invoice_number"), tx.normalize_invoice_number(F.col("invoice")).alias("normalized_invoice_number"))
    side = lambda df, p: df.select(*[F.col(c).alias(c if c == f"{p}_id" else f"{p}_{c}") for c in df.columns])
    pairs = mt.blocked_pairs(bank(spark, d), ledger(spark, d), {"ref": ["ref"]}, {"ref": ["ref", "inv"]})
    return pairs.join(side(left, "a"), "a_id").join(side(right, "b"), "b_id")


_CONDITIONS = (
    rl.Condition("amount", "exact"), rl.Condition("currency", "normalized_exact"), rl.Condition("date", "within_days", 3), rl.Condition("amount", "within_absolute", 0.5), rl.Condition("amount", "within_percentage", 0.02),
    rl.Condition("reference", "similarity_at_least", 0.9), rl.Condition("reference", "trigram_at_least", 0.5), rl.Condition("description", "token_set_at_least", 0.2), rl.Condition("raw_description", "contains", other="invoice_number"),
    rl.Condition("reference", "both_present"), rl.Condition("amount", "sign_opposite"), rl.Condition("amount", "net_equals", other="amount"),
)


def _condition_sql() -> str:
    words = lambda t: f"list_distinct(list_filter(string_split_regex({t}, ' '), lambda w: w <> ''))"
    noise = lambda t: f"nullif(array_to_string(list_filter(string_split_regex(upper({t}), '[^A-Z0-9]+'), lambda w: w <> '' AND w NOT IN {tx.NOISE_WORDS}), ' '), '')"
    joined = lambda t: f"array_to_string(list_sort({t}), ' ')"
    tests = [
        ("xa = ya", "1.0"), ("upper(trim(xc)) = upper(trim(yc))", "1.0"), ("abs(xd - yd) <= 3", "1.0 - abs(xd - yd) / 4.0::DOUBLE"), ("abs(xa - ya) <= 0.5", "1.0 - CAST(abs(xa - ya) AS DOUBLE) / 0.5::DOUBLE"),
        ("CASE WHEN ya = 0 THEN xa = 0 ELSE share <= 0.02 END", "CASE WHEN ya = 0 THEN 1.0 ELSE 1.0 - share / 0.02::DOUBLE END"),
        ("jaro_winkler_similarity(xr, yr) >= 0.9", "jaro_winkler_similarity(xr, yr)"), ("tri >= 0.5", "tri"), ("tok >= 0.2", "tok"),
        (f"length(yi) >= 4 AND contains({_NORM.format('xt')}, yi)", "1.0"), ("xr IS NOT NULL AND yr IS NOT NULL", "1.0"), ("xa * ya < 0", "1.0"), ("xa = ya", "1.0"),
    ]
    parts = " UNION ALL ".join(f"SELECT a_id, b_id, {k} AS condition, round(CASE WHEN {test} THEN {strength} END::DOUBLE, 6) AS strength FROM m WHERE {test}" for k, (test, strength) in enumerate(tests))
    return f"""WITH {_PAIRS_SQL},
      n AS (SELECT *, {noise('xt')} AS xn, {noise('yt')} AS yn, CAST(abs(xa - ya) AS DOUBLE) / nullif(CAST(abs(ya) AS DOUBLE), 0) AS share, {_TRI.format('xr', 'yr')} AS tri FROM q),
      t AS (SELECT *, {words('xn')} AS xw, {words('yn')} AS yw FROM n), g AS (SELECT *, {joined('xw')} AS xs, {joined('yw')} AS ys FROM t),
      m AS (SELECT *, CASE WHEN len(list_intersect(xw, yw)) = 0 THEN 0.0::DOUBLE ELSE round(0.7::DOUBLE * (len(list_intersect(xw, yw)) / len(list_distinct(list_concat(xw, yw)))::DOUBLE) + 0.3::DOUBLE * ({_TRI.format('xs', 'ys')}), 6) END AS tok FROM g) {parts}"""


@query(_condition_sql())
def rule_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Each of the twelve kinds of conditions over all pairs of an equal reference: where it
    holds, and how strongly."""
    cells = []
    for k, c in enumerate(_CONDITIONS):
        holds, strength = rl.compiled(c)
        cells.append(F.when(holds, F.struct(F.lit(k).alias("condition"), F.round(strength, 6).alias("strength"))))
    return paired(spark, d).select("a_id", "b_id", F.explode(F.array(*cells)).alias("x")).where("x is not null").select("a_id", "b_id", "x.*")


@query(
    f"""WITH {_PAIRS_SQL}
        SELECT a_id, b_id, 'exact_reference' AS rule, 1.0::DOUBLE AS score FROM q WHERE xc = yc AND xa = ya AND xr = yr
        UNION ALL SELECT a_id, b_id, 'amount_date_counterparty', round((40.0::DOUBLE * (1 - CAST(abs(xa - ya) AS DOUBLE) / 0.5::DOUBLE) + 20.0::DOUBLE * (1 - abs(xd - yd) / 4.0::DOUBLE) + 40.0::DOUBLE * jaro_winkler_similarity(xp, yp)) / 100.0::DOUBLE, 6)
          FROM q WHERE xc = yc AND abs(xa - ya) <= 0.5 AND abs(xd - yd) <= 3 AND jaro_winkler_similarity(xp, yp) >= 0.9::DOUBLE"""
)
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rules for bank and ledger rows, as data, over all pairs of an equal reference."""
    pairs = paired(spark, d).withColumns({f"{s}_external_transaction_id": F.lit(None).cast("string") for s in "ab"})
    return rl.rule_scores(pairs, list(rl.BANK_RULES)).select("a_id", "b_id", "rule", "score")


def _evidence_sql() -> str:
    graded = "CASE WHEN {0} THEN 1.0::DOUBLE WHEN {1} >= 0.85 THEN {1} ELSE 0 END"
    told = f"coalesce(length({_NORM.format('y_invoice')}) >= 4 AND contains({_NORM.format('xt')}, {_NORM.format('y_invoice')}), false) OR coalesce(length(yr) >= 4 AND contains({_NORM.format('xt')}, yr), false) OR coalesce(length(xr) >= 4 AND contains({_NORM.format('yt')}, xr), false)"
    words = lambda t: f"list_distinct(list_filter(string_split_regex({t}, ' '), lambda w: w <> ''))"
    noise = lambda t: f"nullif(array_to_string(list_filter(string_split_regex(upper({t}), '[^A-Z0-9]+'), lambda w: w <> '' AND w NOT IN {tx.NOISE_WORDS}), ' '), '')"
    joined = lambda t: f"array_to_string(list_sort({t}), ' ')"
    return f"""WITH {_PAIRS_SQL},
      n AS (SELECT *, {noise('xt')} AS xn, {noise('yt')} AS yn, coalesce(xr = yr, false) AS ref_same, coalesce(jaro_winkler_similarity(xr, yr), 0) AS ref_like, coalesce(yi = xr, false) AS inv_same, coalesce(xp = yp, false) AS party_same,
              coalesce(greatest(jaro_winkler_similarity(xp, yp), {_TRI.format('xp', 'yp')}), 0) AS party_like, abs(xd - yd) AS days, {told} AS told FROM q),
      t AS (SELECT *, {words('xn')} AS xw, {words('yn')} AS yw FROM n), g AS (SELECT *, {joined('xw')} AS xs, {joined('yw')} AS ys FROM t),
      m AS (SELECT *, CASE WHEN xn IS NULL OR yn IS NULL OR len(list_intersect(xw, yw)) = 0 THEN 0.0::DOUBLE ELSE round(0.7::DOUBLE * (len(list_intersect(xw, yw)) / len(list_distinct(list_concat(xw, yw)))::DOUBLE) + 0.3::DOUBLE * ({_TRI.format('xs', 'ys')}), 6) END AS tok FROM g),
      s AS (SELECT *, CASE WHEN xr IS NOT NULL AND yr IS NOT NULL THEN 35.0::DOUBLE * {graded.format('ref_same', 'ref_like')} ELSE 0 END + 25.0::DOUBLE * CASE WHEN xa = ya THEN 1.0::DOUBLE WHEN abs(xa - ya) <= 0.5 THEN 1.0::DOUBLE - CAST(abs(xa - ya) AS DOUBLE) / 0.5::DOUBLE ELSE 0 END
                + CASE WHEN xc = yc THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN xp IS NOT NULL AND yp IS NOT NULL THEN 10.0::DOUBLE * {graded.format('party_same', 'party_like')} ELSE 0 END
                + CASE WHEN xn IS NOT NULL AND yn IS NOT NULL AND tok >= 0.85 THEN 5.0::DOUBLE * tok ELSE 0 END + CASE WHEN days IS NOT NULL THEN 10.0::DOUBLE * greatest(0, 1.0::DOUBLE - days / 4.0::DOUBLE) ELSE 0 END + CASE WHEN told THEN 15.0::DOUBLE ELSE 0 END AS earned,
              CASE WHEN xr IS NOT NULL AND yr IS NOT NULL THEN 35.0::DOUBLE ELSE 0 END + 30.0::DOUBLE + CASE WHEN xp IS NOT NULL AND yp IS NOT NULL THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN xn IS NOT NULL AND yn IS NOT NULL THEN 5.0::DOUBLE ELSE 0 END
                + CASE WHEN days IS NOT NULL THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN told THEN 15.0::DOUBLE ELSE 0 END + CASE WHEN ref_same OR inv_same THEN 0.0::DOUBLE ELSE 45.0::DOUBLE END AS whole FROM m)
      SELECT a_id, b_id, round(least(earned / whole, 1.0::DOUBLE), 6) AS score,
        CAST((ref_same)::INT + (inv_same)::INT + 1 + (xc = yc)::INT + (days IS NOT NULL)::INT + (told)::INT + (NOT ref_same AND ref_like >= 0.85)::INT + (party_same OR party_like >= 0.85)::INT + (tok >= 0.85)::INT AS INTEGER) AS reasons,
        CAST((xc <> yc)::INT + (coalesce(regexp_matches(xr, '[0-9]') AND regexp_matches(yr, '[0-9]') AND xr <> yr, false) AND NOT inv_same)::INT AS INTEGER) AS conflicts FROM s"""


@query(_evidence_sql())
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Score from all features, number of reasons and of hard conflicts of all pairs of an equal
    reference."""
    scored = sc.features(paired(spark, d))
    return scored.select("a_id", "b_id", sc.score(0.5, 3).alias("score"), F.size(sc.reasons()).alias("reasons"), sc.hard_conflicts(sc.warnings(0.5, 3)).alias("conflicts"))


@query()
def pair_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for and against each pair, in words and codes."""
    return sc.features(paired(spark, d)).select("a_id", "b_id", sc.reasons().alias("reasons"), sc.warnings().alias("warnings"))


@query(
    f"""WITH {_PAIRS_SQL} SELECT a_id, b_id FROM q WHERE xc = yc AND (abs(xa - ya) <= 0.01 OR CAST(abs(xa - ya) AS DOUBLE) / nullif(CAST(abs(ya) AS DOUBLE), 0) <= 0.02) AND coalesce(abs(xd - yd) <= 5, true)"""
)
def eligible_by_share(spark: SparkSession, d: str) -> DataFrame:
    """Pairs near enough in amount, absolutely or by a fiftieth, and in time."""
    none = {f"{s}_{c}": F.lit(None).cast("string") for s in "ab" for c in ("status", "source_account_id")}
    return paired(spark, d).withColumns(none).where(sc.eligible(share=0.02)).select("a_id", "b_id")


@query(
    f"""WITH {_SQL_SIDES.strip()}, s AS (SELECT a.id AS a_id, b.id AS b_id, 'reference' AS s FROM a JOIN b ON a.ref IN (b.ref, b.inv) UNION SELECT a.id, b.id, 'party' FROM a JOIN b ON a.party = b.party WHERE a.party NOT IN ('UNKNOWN', 'N/A', '?') AND a.day = b.day)
        SELECT a_id, b_id, array_to_string(list_sort(list(s)), ',') AS spaces FROM s GROUP BY 1, 2"""
)
def blocking_spaces(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by reference, and by party on the same day, with the spaces they share."""
    party = lambda df: df.withColumn("party", F.when(~F.col("party").isin("UNKNOWN", "N/A", "?") & F.col("day").isNotNull(), F.concat_ws("|", "party", F.col("day").cast("string"))))
    return mt.blocked_by(party(bank(spark, d)), party(ledger(spark, d)), ["reference", "party"]).select("a_id", "b_id", F.array_join("spaces", ",").alias("spaces"))


@query()
def grouped_matches(spark: SparkSession, d: str) -> DataFrame:
    """Bank rows that are sums of ledger rows of one party, and the other way round."""
    return mt.grouped_matches(bank(spark, d), ledger(spark, d), tolerance=0, days=3, most=3)


@query(
    """WITH p AS (SELECT l_orderkey AS k, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS id, min(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * 100) AS BIGINT)) AS u FROM lineitem GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM p), t AS (SELECT k, CAST(sum(u) AS BIGINT) AS target FROM r WHERE n <= 3 GROUP BY k HAVING count(*) = 3),
       s AS (SELECT t.k, [x.id] AS m FROM t JOIN p x USING (k) WHERE x.u = target UNION ALL SELECT t.k, [x.id, y.id] FROM t JOIN p x USING (k) JOIN p y ON y.k = t.k AND x.id < y.id WHERE x.u + y.u = target
             UNION ALL SELECT t.k, [x.id, y.id, z.id] FROM t JOIN p x USING (k) JOIN p y ON y.k = t.k AND x.id < y.id JOIN p z ON z.k = t.k AND y.id < z.id WHERE x.u + y.u + z.u = target)
       SELECT k AS group_key, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN count(*) = 1 THEN array_to_string(list_sort(first(m)), ',') ELSE '' END AS members FROM s GROUP BY k"""
)
def subset_sum_triples(spark: SparkSession, d: str) -> DataFrame:
    """The first three lines of each order, found again from their sum among all of them."""
    from pyspark.sql import Window

    lines = read_table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * 100, 0).cast("long")
    pool = lines.select(F.col("l_orderkey").alias("group_key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), cents.alias("units")).groupBy("group_key", "id").agg(F.min("units").alias("units"))
    first = pool.withColumn("n", F.row_number().over(Window.partitionBy("group_key").orderBy("id"))).where("n <= 3")
    targets = first.groupBy("group_key").agg(F.sum("units").alias("units"), F.count("*").alias("n")).where("n = 3").drop("n")
    found = mt.subset_groups(targets, pool, most=3)
    # A set of three lines always exists; the size bound alone leaves others open.
    status = F.when(F.col("status").isin("unique", "limited"), "found").otherwise(F.col("status"))
    return found.select("group_key", status.alias("status"), F.array_join("members", ",").alias("members"))


@query(f"WITH {_SQL_SIDES.strip()}, p AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.ref = b.ref OR a.ref = b.inv) SELECT count(*) AS groups, count(DISTINCT a_id || '|' || b_id) AS ids FROM p")
def match_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one-to-one pairs with ids by name: as many ids as pairs."""
    pairs = mt.blocked_pairs(bank(spark, d), ledger(spark, d), {"ref": ["ref"]}, {"ref": ["ref", "inv"]}).withColumn("rule", F.lit("reference"))
    return mt.match_groups(pairs, "run-1").agg(F.count("*").alias("groups"), F.count_distinct("group_id").alias("ids"))


@query()
def resolved_entities(spark: SparkSession, d: str) -> DataFrame:
    """Parties of the bank rows among those of the ledger: exact, by alias, by likeness."""
    name = lambda t: read_table(spark, d, t).where("counterparty not in ('UNKNOWN', 'N/A', '?')").select(tx.normalize_name(tx.without_accents(F.col("counterparty"))).alias("name")).where("name is not null").distinct()
    entities = name("source_b").select(F.xxhash64("name").alias("entity_id"), "name")
    aliases = spark.createDataFrame([], "alias string, entity_id long, status string")
    return mt.resolved_entities(name("source_a"), entities, aliases)


# ------------------------------------------------------------------------ values


@query("SELECT a.row_id AS a_id, b.row_id AS b_id, abs(a.date - b.date) AS days, abs(a.amount - b.amount) <= 0.5 AS by_amount, CASE WHEN b.amount = 0 THEN a.amount = 0 ELSE abs(a.amount - b.amount) <= 0.02 * abs(b.amount) END AS by_share, abs(a.amount - abs(a.amount - b.amount) - b.amount) <= 0 AS by_fee, CAST(a.amount - b.amount AS VARCHAR) AS difference FROM source_a a JOIN source_b b ON a.reference = b.reference AND a.currency = b.currency")
def tolerances(spark: SparkSession, d: str) -> DataFrame:
    """Distance in days and money, and the tolerance tests, of pairs of an equal reference and
    currency."""
    side = lambda t, p: read_table(spark, d, t).select(F.col("row_id").alias(f"{p}_id"), F.col("date").alias(f"{p}_day"), F.col("amount").alias(p), F.col("currency").alias(f"{p}_ccy"), "reference", "currency")
    both = side("source_a", "a").join(side("source_b", "b"), ["reference", "currency"])
    a, b = F.col("a"), F.col("b")
    return both.select("a_id", "b_id", vl.date_distance(F.col("a_day"), F.col("b_day")).alias("days"), vl.within_absolute(a, b, "0.5").alias("by_amount"), vl.within_share(a, b, "0.02").alias("by_share"), vl.fee_explains(a, F.abs(a - b), b).alias("by_fee"), vl.money_difference(a, F.col("a_ccy"), b, F.col("b_ccy")).cast("string").alias("difference"))


@query(f"WITH n AS (SELECT DISTINCT {_NORM.format('a.reference')} AS x, {_NORM.format('b.reference')} AS y FROM source_a a JOIN source_b b ON a.date = b.date AND a.currency = b.currency AND a.amount = b.amount) SELECT x, y, round(jaro_similarity(x, y), 6) AS similarity FROM n WHERE x IS NOT NULL AND y IS NOT NULL")
def jaro_similarity(spark: SparkSession, d: str) -> DataFrame:
    """References of rows of equal day and amount."""
    side = lambda t, n: read_table(spark, d, t).select("date", "currency", "amount", tx.normalize_reference(F.col("reference")).alias(n))
    pairs = side("source_a", "x").join(side("source_b", "y"), ["date", "currency", "amount"]).where("x is not null and y is not null").select("x", "y").distinct()
    return pairs.select("x", "y", F.round(sim.jaro_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("SELECT event_id, regexp_replace(replace(props, '\"token\"', '\"token\"'), '(\"[^\"]*(?:token|secret|password|iban)[^\"]*\"\\s*:\\s*)(?:\"[^\"]*\"|-?[0-9.]+|true|false|null)', '\\1\"[REDACTED]\"', 'gi') AS props FROM (SELECT event_id, '{\"access_token\": \"t' || event_id || '\", \"n\": ' || event_id || ', \"o\": {\"password\": ' || event_id || '}, \"p\": ' || coalesce(props, 'null') || '}' AS props FROM events)")
def redacted_props(spark: SparkSession, d: str) -> DataFrame:
    """Event properties with secrets put in beside them, and taken out again at any depth."""
    k = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"access_token": "t'), k, F.lit('", "n": '), k, F.lit(', "o": {"password": '), k, F.lit('}, "p": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return read_table(spark, d, "events").select("event_id", nv.redacted_json(text).alias("props"))


# ------------------------------------------------------------------ reads, controls


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT row_id, id, currency FROM source_a WHERE row_id IN (SELECT min(row_id) FROM source_a GROUP BY id HAVING count(*) > 1)")
def many_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Rows fetched by a table of ids: a semi-join."""
    a = read_table(spark, d, "source_a")
    asked = a.groupBy("id").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")).where("n > 1").select("row_id")
    return a.join(asked, "row_id", "left_semi").select("row_id", "id", "currency")


@query("SELECT count(*) AS n, CAST(round(sum(amount) * 1000) AS BIGINT) AS units FROM source_a WHERE id IN (SELECT id FROM copy_a)")
def balance_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "copy_a").select("id")
    return read_table(spark, d, "source_a").join(ids, "id", "left_semi").agg(F.count("*").alias("n"), F.round(F.sum("amount") * 1000, 0).cast("long").alias("units"))


@query("SELECT row_id, CAST(amount AS VARCHAR) AS exposure FROM (SELECT row_id, CASE WHEN reference IS NOT NULL THEN abs(amount) END AS amount FROM source_b) ORDER BY amount DESC NULLS LAST, row_id LIMIT 25 OFFSET 25")
def exposure_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows by falling exposure, the unknown ones last."""
    rows = read_table(spark, d, "source_b").select("row_id", F.when(F.col("reference").isNotNull(), F.abs("amount")).alias("exposure"))
    return rows.orderBy(F.col("exposure").desc_nulls_last(), "row_id").offset(25).limit(25).select("row_id", F.col("exposure").cast("string").alias("exposure"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def name_page(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").orderBy("c_name", "c_custkey").offset(20).limit(20).select("c_custkey", "c_name")


@query("SELECT event_id, CAST(ts AS VARCHAR) AS ts FROM events ORDER BY events.ts DESC, event_id LIMIT 20")
def created_page(spark: SparkSession, d: str) -> DataFrame:
    newest = read_table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(20)
    whole = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    part = F.rtrim(F.date_format("ts", "SSSSSS"), F.lit("0"))
    return newest.select("event_id", F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part)).alias("ts"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    """One tenant only: its key is filtered before anything else."""
    events = read_table(spark, d, "events")
    first = events.agg(F.min("user_id").alias("user_id"))
    return events.join(F.broadcast(first), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))  # one row


_FILE_SPAN = "SELECT row_number() OVER (ORDER BY file_id) AS id, CAST(received_at AS DATE) AS lo, CASE WHEN side = 'A' THEN CAST(received_at AS DATE) + 6 END AS hi FROM source_files"
_MIX_SPAN = "SELECT row_number() OVER (ORDER BY source) AS id, DATE '2005-02-01' + CAST(7 * row_number() OVER (ORDER BY source) AS INTEGER) AS lo, DATE '2005-02-10' + CAST(7 * row_number() OVER (ORDER BY source) AS INTEGER) AS hi FROM mix_targets"


@query(f"WITH f AS ({_FILE_SPAN}), m AS ({_MIX_SPAN}) SELECT f.id, m.id AS other_id FROM f JOIN m ON f.lo <= m.hi AND coalesce(f.hi, DATE '9999-12-31') >= m.lo")
def overlapping_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Spans of deliveries, some without end, against locked periods."""
    from pyspark.sql import Window

    files = read_table(spark, d, "source_files").select(F.row_number().over(Window.orderBy("file_id")).cast("long").alias("id"), F.to_date("received_at").alias("lo"), F.when(F.col("side") == "A", F.date_add(F.to_date("received_at"), 6)).alias("hi"))
    k = F.row_number().over(Window.orderBy("source"))
    locks = read_table(spark, d, "mix_targets").select(k.cast("long").alias("id"), F.date_add(F.lit("2005-02-01").cast("date"), 7 * k).alias("lo"), F.date_add(F.lit("2005-02-10").cast("date"), 7 * k).alias("hi"))
    return mt.overlapping(files, locks)


@query("SELECT DISTINCT a.row_id FROM source_a a WHERE a.id IN (SELECT id FROM source_a WHERE batch_no % 2 = 0)")
def active_claims(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose record stands in a group that is active (here: an even batch)."""
    a = read_table(spark, d, "source_a")
    return a.join(a.where("batch_no % 2 = 0").select("id"), "id", "left_semi").select("row_id")


@query("SELECT a.row_id, f.file_id FROM source_a a JOIN source_files f ON f.side = 'A' AND CAST(f.received_at AS DATE) = a.date")
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the deliveries of their day as evidence."""
    files = read_table(spark, d, "source_files").where("side = 'A'").select("file_id", F.to_date("received_at").alias("date"))
    return read_table(spark, d, "source_a").join(files, "date").select("row_id", "file_id")


@query("WITH r AS (SELECT 'A' AS side, row_id AS id, amount, batch_no FROM source_a UNION ALL SELECT 'B', row_id, amount, batch_no FROM source_b) SELECT CAST(sum(s) AS VARCHAR) AS difference, CAST(sum(CASE WHEN batch_no % 3 = 0 THEN s ELSE 0 END) AS VARCHAR) AS explained, CAST(sum(CASE WHEN batch_no % 3 = 0 THEN 0 ELSE s END) AS VARCHAR) AS unexplained FROM (SELECT *, CASE WHEN side = 'A' THEN amount ELSE -amount END AS s FROM r)")
def unexplained_difference(spark: SparkSession, d: str) -> DataFrame:
    """Difference of both sides, less what closed exceptions (here: every third batch) explain."""
    side = lambda t, s: read_table(spark, d, t).select(F.lit(s).alias("side"), F.col("row_id").alias("id"), "amount", "batch_no")
    rows = side("source_a", "A").unionByName(side("source_b", "B"))
    status = F.when(F.col("batch_no") % 3 == 0, "CLOSED").otherwise("OPEN")
    exceptions = rows.select(status.alias("status"), F.array("id").alias("ids"))
    return ck.unexplained_difference(rows.drop("batch_no"), exceptions).select(*[F.col(c).cast("decimal(24,8)").cast("string").alias(c) for c in ("difference", "explained", "unexplained")])


_SIDED = "SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'debit' ELSE 'credit' END AS side, CAST(l_quantity AS DECIMAL(24, 8)) AS amount FROM lineitem"


@query(f"WITH j AS (SELECT l_orderkey, sum(CASE WHEN side = 'debit' THEN amount ELSE 0 END) AS debit, sum(CASE WHEN side = 'credit' THEN amount ELSE 0 END) AS credit FROM ({_SIDED}) GROUP BY 1) SELECT l_orderkey, CASE WHEN round(debit, 2) <> round(credit, 2) THEN 'UNBALANCED' ELSE 'ZERO' END AS fault FROM j WHERE round(debit, 2) <> round(credit, 2) OR debit = 0")
def journal_balance(spark: SparkSession, d: str) -> DataFrame:
    """Orders as journals, every other line a debit: which are no double entry."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "debit").otherwise("credit").alias("side"), F.lit("EUR").alias("currency"), F.col("l_quantity").cast("decimal(24,8)").alias("amount"))
    return ck.journal_faults(lines, "l_orderkey")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 100 AS sequence FROM events")
def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Gapless numbers that go on from the last one of each tenant."""
    events = read_table(spark, d, "events")
    heads = events.select("user_id").distinct().withColumn("last", F.lit(100).cast("long"))
    return au.numbered(events, "user_id", "event_id", heads).select("user_id", "event_id", "sequence")


@query("SELECT batch_no AS group_id, id FROM source_a WHERE id NOT IN (SELECT id FROM copy_a)")
def unknown_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups (batches) that the other system does not know."""
    return ck.unknown_members(read_table(spark, d, "source_a").select(F.col("batch_no").alias("group_id"), "id"), read_table(spark, d, "copy_a")).select("group_id", "id")


@query("SELECT true AS same")
def replay_same(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the same rows, differently spread, give one hash."""
    pairs = mt.blocked_pairs(bank(spark, d), ledger(spark, d), {"ref": ["ref"]}, {"ref": ["ref", "inv"]})
    return au.replayed(pairs, pairs.repartition(7, "b_id"), ["a_id", "b_id"]).select("same")


# ------------------------------------------------------------- processors, reports


def _raw_payouts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as payouts in JSON, their lines as components; every eleventh states a cent more."""
    cents = lambda c: F.round(F.col(c).cast("decimal(18,2)") * 100, 0).cast("long")
    line = F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("charge").alias("type"), cents("l_extendedprice").alias("amount"), F.col("l_linenumber").cast("long").alias("fee"))
    lines = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("transactions"), F.sum(cents("l_extendedprice") - F.col("l_linenumber")).alias("net"))
    whole = F.struct(
        F.concat(F.lit("po_"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("net") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("amount"), F.when(F.col("o_orderkey") % 5 == 0, "jpy").otherwise("eur").alias("currency"),
        F.unix_timestamp("o_orderdate").alias("arrival_date"), F.struct(cents("o_totalprice").alias("gross"), F.lit(7).cast("long").alias("fee")).alias("summary"), "transactions",
    )
    orders = read_table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.to_json(whole).alias("record"))


_PAYOUT_SQL = """n AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * 100) AS BIGINT) - l_linenumber) AS BIGINT) AS net FROM lineitem GROUP BY 1),
  p AS (SELECT o_orderkey AS k, net, net + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS stated, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 100 END AS unit, CAST(o_orderdate AS DATE) AS day, CAST(round(CAST(o_totalprice AS DECIMAL(18, 2)) * 100) AS BIGINT) AS gross FROM orders JOIN n ON k = o_orderkey)"""


@query(f"WITH {_PAYOUT_SQL} SELECT 'po_' || k AS payout_id, CAST(day AS VARCHAR) AS day, CASE unit WHEN 1 THEN 'JPY' ELSE 'EUR' END AS currency, round(stated / unit, 2) AS amount, round(gross / unit, 2) AS gross, round(7.0 / unit, 2)::DOUBLE AS fee FROM p")
def payout_records(spark: SparkSession, d: str) -> DataFrame:
    p = cn.payouts(_raw_payouts(spark, d), "record", "conn")
    return p.select("payout_id", F.col("transaction_date").cast("string").alias("day"), "currency", *[F.round(F.col(c).cast("double"), 2).alias(n) for c, n in (("amount", "amount"), ("gross_amount", "gross"), ("fee_amount", "fee"))])


@query(f"WITH {_PAYOUT_SQL} SELECT 'po_' || k AS payout_id, round(stated / unit, 2) AS stated, round(net / unit, 2) AS components FROM p WHERE stated <> net")
def payout_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Payouts that their components don't add up to."""
    return cn.payout_faults(_raw_payouts(spark, d), "record").select("payout_id", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("stated", "components")])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid_signature' WHEN 2 THEN 'stale_timestamp' ELSE 'malformed' END AS verdict FROM events")
def signed_notices(spark: SparkSession, d: str) -> DataFrame:
    """Events as signed notices: rightly signed, forged, too old, without a signature."""
    events = read_table(spark, d, "events").select("event_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("body"))
    kind, stamp = F.col("event_id") % 4, F.lit("1000000")
    signed = F.concat(F.lit("t=1000000,v1=00,v1="), cn.hmac_sha256("s3cret", F.concat(stamp, F.lit("."), F.when(kind == 1, F.concat("body", F.lit("!"))).otherwise(F.col("body")))))
    header = F.when(kind == 3, "t=1000000").otherwise(signed)
    return events.select("event_id", cn.notice_verdict(F.col("body"), header, "s3cret", F.when(kind == 2, 1_000_301).otherwise(1_000_100)).alias("verdict"))


def _exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as exceptions."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "CLOSED").otherwise("OPEN")
    category = F.element_at(F.array(*[F.lit(c) for c in ("WRONG_AMOUNT", "BANK_FEE", "TIMING_DIFFERENCE")]), (k % 3 + 1).cast("int"))
    severity = F.when(k % 7 == 0, "HIGH").otherwise("LOW")
    opened = F.to_date("o_orderdate")
    return read_table(spark, d, "orders").select(k.alias("id"), status.alias("status"), category.alias("category"), severity.alias("severity"), F.col("o_totalprice").cast("decimal(24,8)").alias("exposure"), opened.alias("opened"), F.date_add(opened, 7).alias("due"), F.datediff(F.lit("1998-09-01").cast("date"), opened).alias("age_days"))


_EXCEPTION_SQL = "x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, ['WRONG_AMOUNT', 'BANK_FEE', 'TIMING_DIFFERENCE'][o_orderkey % 3 + 1] AS category, CASE WHEN o_orderkey % 7 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, o_totalprice AS exposure, CAST(o_orderdate AS DATE) AS opened, DATE '1998-09-01' - CAST(o_orderdate AS DATE) AS age FROM orders)"


@query(f"WITH {_EXCEPTION_SQL} SELECT CASE WHEN age <= 7 THEN '0-7' WHEN age <= 30 THEN '8-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '90+' END AS bucket, category, severity, count(*) AS open, CAST(round(sum(exposure)) AS BIGINT) AS exposure, count(*) FILTER (severity = 'HIGH') AS high_risk, count(*) FILTER (opened + 7 < DATE '1998-09-01') AS overdue, CAST(max(age) AS INTEGER) AS oldest_days FROM x WHERE status <> 'CLOSED' GROUP BY 1, 2, 3")
def exception_ageing(spark: SparkSession, d: str) -> DataFrame:
    return rp.ageing(_exceptions(spark, d), F.lit("1998-09-01").cast("date")).withColumn("exposure", F.round("exposure", 0).cast("long"))


@query(f"""WITH {_EXCEPTION_SQL}, l AS (SELECT 'largest' AS section, id, exposure AS amount FROM x UNION ALL SELECT 'aged', id, exposure FROM x WHERE age >= 30 UNION ALL SELECT 'fee_like', id, exposure FROM x WHERE category = 'BANK_FEE'),
        w AS (SELECT 'waiting' AS section, o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 1), r AS (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY round(amount, 2) DESC, id) AS place FROM l UNION ALL SELECT section, id, row_number() OVER (ORDER BY id) FROM w)
        SELECT section, CAST(place AS INTEGER) AS place, id FROM r WHERE place <= 10""")
def investigation_bundle(spark: SparkSession, d: str) -> DataFrame:
    x = _exceptions(spark, d).withColumn("exposure", F.round("exposure", 2))
    groups = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 1, "SUGGESTED").otherwise("APPROVED").alias("status"), F.col("o_totalprice").alias("amount"))
    return rp.investigation(x, groups).select("section", "place", "id")


@query(f"""WITH {_EXCEPTION_SQL}, m AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0) AS auto, count(*) FILTER (l_linenumber % 2 = 1) AS sug, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS u FROM lineitem),
        a AS (SELECT count(*) AS n, CAST(sum(CAST(round(amount * 1000) AS BIGINT)) AS BIGINT) AS u FROM source_a), b AS (SELECT count(*) AS n, CAST(sum(CAST(round(amount * 1000) AS BIGINT)) AS BIGINT) AS u FROM source_b), e AS (SELECT count(*) AS n, count(*) FILTER (severity = 'HIGH') AS h, max(age) AS o FROM x)
        SELECT a.u AS balance_a, b.u AS balance_b, a.u - b.u AS difference, m.n AS matches, m.u AS matched_units, m.auto AS auto, e.n AS exceptions, e.h AS high_risk, CAST(e.o AS INTEGER) AS oldest_days, round(200.0::DOUBLE * m.n / (a.n + b.n), 2) AS completion_pct, round(m.auto / m.n::DOUBLE, 4) AS auto_rate, round((m.sug + e.n) / (a.n + b.n)::DOUBLE, 4) AS review_rate FROM a, b, m, e""")
def whole_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of a run; lines stand in for matches of two rows each."""
    lines = read_table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "AUTO_MATCH").otherwise("SUGGEST").alias("decision"), F.lit("SUGGESTED").alias("status"), F.col("l_quantity").cast("long").alias("units"), F.lit(2).alias("members"))
    whole = rp.run_summary(bank(spark, d).select("id", "units"), ledger(spark, d).select("id", "units"), lines, _exceptions(spark, d))
    return whole.select("balance_a", "balance_b", "difference", "matches", "matched_units", "auto", "exceptions", "high_risk", "oldest_days", "completion_pct", "auto_rate", "review_rate")


@query(f"""WITH {_SQL_SIDES.strip()}, p AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id, abs(a.units - b.units) AS g FROM a JOIN b ON a.ref = b.ref OR a.ref = b.inv),
        t AS (SELECT a_id, b_id FROM p QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY g, b_id) = 1)
        SELECT a.id AS a_id, t.b_id FROM a LEFT JOIN t ON t.a_id = a.id UNION ALL SELECT NULL, b.id FROM b WHERE b.id NOT IN (SELECT b_id FROM t)""")
def leftover_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every bank row with its best candidate by amount, and the ledger rows that are nobody's."""
    a, b = bank(spark, d), ledger(spark, d)
    pairs = mt.with_sides(mt.blocked_pairs(a, b, {"ref": ["ref"]}, {"ref": ["ref", "inv"]}), a, b)
    scored = pairs.select("a_id", "b_id", (-F.abs(F.col("a_units") - F.col("b_units"))).cast("double").alias("score"))
    return rp.leftover_pairs(a.select("id"), b.select("id"), scored).select("a_id", "b_id")


@query(f"SELECT row_id, 'reference is ' || coalesce('''' || {_NORM.format('reference')} || '''', 'nothing') || ', from ' || coalesce('''' || reference || '''', 'nothing') || ' as delivered' AS text FROM source_a")
def lineage_explained(spark: SparkSession, d: str) -> DataFrame:
    cells = ck.lineage(read_table(spark, d, "source_a"), "row_id", {"reference": tx.normalize_reference(F.col("reference"))})
    return rp.explained(cells, "row_id").select("row_id", "text")


@query("SELECT category, amount, currency FROM (SELECT 'X' AS category, CAST(amount AS VARCHAR) AS amount, currency, counterparty FROM source_b)")
def handed_on_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a task may see of ledger rows: nothing but its fields."""
    rows = read_table(spark, d, "source_b").select(F.lit("X").alias("category"), F.col("amount").cast("string").alias("amount"), "currency", "counterparty", "id")
    return rp.handed_on(rows, "propose")
