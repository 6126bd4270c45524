"""Queries over the bank and ledger tables, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.functions import text as tx
from tallyloom.functions import values as vl
from tallyloom.operators import audit as au
from tallyloom.operators import checks as ck
from tallyloom.operators import matching as mt
from tallyloom.operators import namepairs as npairs
from tallyloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _a(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_a")


def _b(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_b")


def _units(amount: Column) -> Column:
    return F.round(amount * 1000, 0).cast("long")


def bank(spark: SparkSession, d: str) -> DataFrame:
    """source_a as matching records."""
    return _a(spark, d).select(F.col("row_id").alias("id"), F.col("date").alias("day"), _units(F.col("amount")).alias("units"), F.col("currency").alias("ccy"), tx.normalize_reference(F.col("reference")).alias("ref"), F.upper("counterparty").alias("party"), "description")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """source_b as matching records."""
    return _b(spark, d).select(F.col("row_id").alias("id"), F.col("date").alias("day"), _units(F.col("amount")).alias("units"), F.col("currency").alias("ccy"), tx.normalize_reference(F.col("reference")).alias("ref"), tx.normalize_reference(F.col("invoice")).alias("inv"), F.upper("counterparty").alias("party"))


_SQL_SIDES = """
a AS (SELECT row_id AS id, date AS day, CAST(round(amount * 1000) AS BIGINT) AS units, currency AS ccy,
        nullif(regexp_replace(upper(reference), '[^A-Z0-9]+', '', 'g'), '') AS ref, upper(counterparty) AS party, description FROM source_a),
b AS (SELECT row_id AS id, date AS day, CAST(round(amount * 1000) AS BIGINT) AS units, currency AS ccy,
        nullif(regexp_replace(upper(reference), '[^A-Z0-9]+', '', 'g'), '') AS ref, nullif(regexp_replace(upper(invoice), '[^A-Z0-9]+', '', 'g'), '') AS inv, upper(counterparty) AS party FROM source_b)
"""
_NORM = "nullif(regexp_replace(upper({0}), '[^A-Z0-9]+', '', 'g'), '')"

# ------------------------------------------------------------------ projections


@query("SELECT row_id, nullif(trim(regexp_replace(upper(description), '\\s+', ' ', 'g')), '') AS normalized FROM source_a")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", tx.normalize_text(F.col("description")).alias("normalized"))


@query(f"SELECT row_id, {_NORM.format('reference')} AS normalized FROM source_a")
def normalize_reference(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", tx.normalize_reference(F.col("reference")).alias("normalized"))


@query(f"SELECT row_id, regexp_replace({_NORM.format('invoice')}, '^([A-Z]*)0*([0-9]+)$', '\\1\\2') AS normalized FROM source_b")
def normalize_invoice_number(spark: SparkSession, d: str) -> DataFrame:
    return _b(spark, d).select("row_id", tx.normalize_invoice_number(F.col("invoice")).alias("normalized"))


@query(
    f"SELECT row_id, nullif(array_to_string(list_filter(string_split_regex(upper(description), '[^A-Z0-9]+'), lambda w: w <> '' AND w NOT IN {tx.NOISE_WORDS}), ' '), '') AS normalized FROM source_a"
)
def normalize_bank_description(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", tx.normalize_bank_description(F.col("description")).alias("normalized"))


@query(
    f"""SELECT DISTINCT counterparty, nullif(regexp_replace(trim(regexp_replace(upper(strip_accents(counterparty)), '[^A-Z0-9]+', ' ', 'g')), '([^ ])(?: (?:{'|'.join(tx.LEGAL_SUFFIXES)}))+$', '\\1'), '') AS normalized
        FROM source_b WHERE counterparty IS NOT NULL"""
)
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    names = _b(spark, d).select("counterparty").where("counterparty is not null").distinct()
    return names.select("counterparty", tx.normalize_name(tx.without_accents(F.col("counterparty"))).alias("normalized"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(upper(description), '[^A-Z0-9]+'), lambda x: x <> '')) AS w FROM source_a) GROUP BY w")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select(F.explode(tx.tokenize(F.col("description"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    """SELECT row_id, 'invoice_number' AS kind, v AS value, regexp_replace(upper(v), '[^A-Z0-9]+', '', 'g') AS normalized
       FROM (SELECT row_id, unnest(regexp_extract_all(description, '(?i)\\b((?:INV|INVOICE|RECHNUNG|FACTUUR)[-\\s#]?[A-Z]?\\d[A-Z0-9-]*)\\b', 1)) AS v FROM source_a)
       QUALIFY row_number() OVER (PARTITION BY row_id, normalized ORDER BY v) = 1"""
)
def extract_invoices(spark: SparkSession, d: str) -> DataFrame:
    found = _a(spark, d).select("row_id", F.inline(tx.extract_references(F.col("description"))))
    return found.where("kind = 'invoice_number'").select("row_id", "kind", "value", "normalized")


@query()
def extract_references(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", F.inline(tx.extract_references(F.col("description"))))


@query(
    f"""SELECT row_id, coalesce(length({_NORM.format('reference')}) >= 4 AND contains({_NORM.format('description')}, {_NORM.format('reference')}), false) AS found FROM source_a"""
)
def description_contains(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", tx.description_contains(F.col("reference"), F.col("description")).alias("found"))


@query("SELECT id, regexp_replace(id, '[0-9]{9,}', '[ACCOUNT]', 'g') AS masked FROM copy_a WHERE regexp_full_match(id, '[A-Z]{3}-[0-9]{10}')")
def masked_identities(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "copy_a").where(F.col("id").rlike("^[A-Z]{3}-[0-9]{10}$")).select("id", tx.masked(F.col("id")).alias("masked"))


@query()
def masked_identities_whole(spark: SparkSession, d: str) -> DataFrame:
    """Identities of every form; the SQL of ``masked_identities`` holds for the usual form only."""
    return read_table(spark, d, "copy_a").select("id", tx.masked(F.col("id")).alias("masked"))


@query("SELECT id, repeat('*', length(id) - 4) || right(id, 4) AS masked FROM copy_b WHERE length(id) >= 4")
def account_mask(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "copy_b").select("id", tx.account_mask(F.col("id")).alias("masked"))


_EXP = "CASE WHEN currency IN ('JPY','KRW','ISK','CLP','VND','UGX','XAF','XOF','XPF','BIF','DJF','GNF','KMF','PYG','RWF','VUV') THEN 0 WHEN currency IN ('KWD','BHD','IQD','JOD','LYD','OMR','TND') THEN 3 ELSE 2 END"


@query(f"SELECT row_id, CASE {_EXP} WHEN 0 THEN CAST(round(amount) AS BIGINT) WHEN 3 THEN CAST(round(amount * 1000) AS BIGINT) ELSE CAST(round(amount * 100) AS BIGINT) END AS units FROM source_a")
def minor_units(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", vl.minor_units(F.col("amount"), F.col("currency")).alias("units"))


@query("SELECT row_id, CASE WHEN amount > 0 THEN 'debit' WHEN amount < 0 THEN 'credit' ELSE 'unknown' END AS direction FROM source_a")
def direction_inference(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", vl.direction(F.lit(None).cast("string"), F.col("amount")).alias("direction"))


@query("SELECT row_id, CAST(round(amount * 100) AS BIGINT) AS cents FROM source_a WHERE amount <> 0")
def debit_credit_fold(spark: SparkSession, d: str) -> DataFrame:
    two = _a(spark, d).where("amount <> 0").select("row_id", F.when(F.col("amount") > 0, F.col("amount")).alias("debit"), F.when(F.col("amount") < 0, -F.col("amount")).alias("credit"))
    return two.select("row_id", F.round(vl.folded_amount(F.col("debit"), F.col("credit")) * 100, 0).cast("long").alias("cents"))


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18, 2)) * 100) AS BIGINT) AS cents FROM orders")
def parsed_amounts(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    written = F.concat(F.lit("EUR "), F.format_number("amount", 2))
    return orders.select("o_orderkey", F.round(vl.parsed_amount(written) * 100, 0).cast("long").alias("cents"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders")
    style = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return orders.select("o_orderkey", vl.parsed_date(style).cast("string").alias("day"))


@query("SELECT row_id, CAST(coalesce(date, CAST(loaded_at AS DATE)) AS VARCHAR) AS day FROM source_a")
def best_date(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", vl.best_date(F.col("date"), F.to_date("loaded_at")).cast("string").alias("day"))


@query(
    """WITH s AS (SELECT row_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', id, CAST(row_id AS VARCHAR)))) AS h FROM source_a)
       SELECT row_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM s"""
)
def name_uuids(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", vl.name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat_ws("|", "id", F.col("row_id").cast("string"))).alias("uuid"))


@query("SELECT row_id, sha256(coalesce('=' || id, '~') || chr(31) || coalesce('=' || description, '~') || chr(31) || coalesce('=' || reference, '~')) AS checksum FROM source_a")
def row_checksums(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).select("row_id", vl.row_checksum(F.col("id"), F.col("description"), F.col("reference")).alias("checksum"))


def _name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of either table with the same first six letters."""
    names = lambda t, n: read_table(spark, d, t).select(F.col("counterparty").alias(n)).where("counterparty is not null").distinct()
    key = lambda n: F.upper(F.substring(n, 1, 6))
    return names("source_a", "x").withColumn("k", key("x")).join(names("source_b", "y").withColumn("k", key("y")), "k").select("x", "y")


_SQL_NAMES = "n AS (SELECT DISTINCT a.counterparty AS x, b.counterparty AS y FROM source_a a JOIN source_b b ON upper(a.counterparty[1:6]) = upper(b.counterparty[1:6]))"


@query(f"WITH {_SQL_NAMES} SELECT x, y, round(1.0 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE, 6) AS similarity FROM n WHERE x SIMILAR TO '[ -~]*' AND y SIMILAR TO '[ -~]*'")
def levenshtein_similarity(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = lambda c: F.col(c).rlike(r"\A[ -~]*\z")  # noqa: E731 - the other engine counts bytes
    return _name_pairs(spark, d).where(ascii_only("x") & ascii_only("y")).select("x", "y", F.round(sim.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda k: ('  ' || upper({0}) || ' ')[k:k+2]))"


@query(
    f"""WITH {_SQL_NAMES}, g AS (SELECT x, y, {_GRAMS.format('x')} AS gx, {_GRAMS.format('y')} AS gy FROM n)
        SELECT x, y, round(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy)))::DOUBLE, 6) AS similarity FROM g"""
)
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _name_pairs(spark, d).select("x", "y", F.round(sim.trigram_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    f"""WITH {_SQL_NAMES}, t AS (SELECT x, y, list_distinct(list_filter(string_split_regex(upper(x), '[^A-Z0-9]+'), lambda w: w <> '')) AS tx, list_distinct(list_filter(string_split_regex(upper(y), '[^A-Z0-9]+'), lambda w: w <> '')) AS ty FROM n),
        s AS (SELECT *, array_to_string(list_sort(tx), ' ') AS sx, array_to_string(list_sort(ty), ' ') AS sy FROM t),
        g AS (SELECT *, {_GRAMS.format('sx')} AS gx, {_GRAMS.format('sy')} AS gy FROM s)
        SELECT x, y, CASE WHEN len(list_intersect(tx, ty)) = 0 THEN 0.0::DOUBLE
             ELSE round(0.7::DOUBLE * (len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty)))::DOUBLE) + 0.3::DOUBLE * (len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy)))::DOUBLE), 6) END AS ratio FROM g"""
)
def token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _name_pairs(spark, d).select("x", "y", sim.token_set_ratio(F.col("x"), F.col("y")).alias("ratio"))


@query(f"WITH {_SQL_NAMES} SELECT x, y, round(jaro_winkler_similarity(x, y), 6) AS similarity FROM n WHERE x SIMILAR TO '[ -~]*' AND y SIMILAR TO '[ -~]*'")
def jaro_winkler_similarity(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = lambda c: F.col(c).rlike(r"\A[ -~]*\z")
    return _name_pairs(spark, d).where(ascii_only("x") & ascii_only("y")).select("x", "y", F.round(sim.jaro_winkler_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


def _worded_names(spark: SparkSession, d: str, text: Column) -> list[DataFrame]:
    """Distinct names of either table with their lower-case words and the text to be scored."""
    words = F.array_join(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    names = (read_table(spark, d, t).select(F.col("counterparty").alias("name")).where("name is not null").distinct() for t in ("source_a", "source_b"))
    return [n.select("name", words.alias("words"), text.alias("text")) for n in names]


@query()
def levenshtein_similarity_whole(spark: SparkSession, d: str) -> DataFrame:
    """The queries named whole score all names, whatever their letters and order of words;
    the SQL of the others holds for one block of six letters (and two for ASCII) only."""
    return npairs.scored_pairs(*_worded_names(spark, d, F.col("name")), npairs.Levenshtein, "similarity")


@query()
def trigram_similarity_whole(spark: SparkSession, d: str) -> DataFrame:
    return npairs.scored_pairs(*_worded_names(spark, d, F.upper("name")), npairs.Trigrams, "similarity")


@query()
def token_set_ratio_whole(spark: SparkSession, d: str) -> DataFrame:
    line = F.array_join(F.sort_array(F.array_distinct(tx.tokenize(F.col("name")))), " ")
    return npairs.scored_pairs(*_worded_names(spark, d, line), npairs.TokenSets, "ratio")


@query()
def jaro_winkler_similarity_whole(spark: SparkSession, d: str) -> DataFrame:
    return npairs.scored_pairs(*_worded_names(spark, d, F.col("name")), npairs.JaroWinkler, "similarity")


# ---------------------------------------------------------------- scans, filters


@query("SELECT row_id, id, currency FROM source_a WHERE date BETWEEN DATE '2005-02-15' AND DATE '2005-03-15' AND currency = 'EUR'")
def period_filter(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).where(F.col("date").between("2005-02-15", "2005-03-15") & (F.col("currency") == "EUR")).select("row_id", "id", "currency")


@query(
    """SELECT row_id, CAST(date AS VARCHAR) AS day, description FROM source_a
       WHERE contains(upper(description), 'ORDER') OR contains(upper(reference), 'ORDER') OR contains(upper(counterparty), 'ORDER')
       ORDER BY date DESC NULLS LAST, row_id LIMIT 50 OFFSET 50"""
)
def text_search_page(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c: F.coalesce(F.upper(c).contains("ORDER"), F.lit(False))
    rows = _a(spark, d).where(hit("description") | hit("reference") | hit("counterparty"))
    return rows.orderBy(F.col("date").desc_nulls_last(), "row_id").offset(50).limit(50).select("row_id", F.col("date").cast("string").alias("day"), "description")


# ------------------------------------------------------------------------ joins


def _blocked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = bank(spark, d), ledger(spark, d)
    return mt.blocked_pairs(a, b, {"ref": ["ref"]}, {"ref": ["ref", "inv"]}), a, b


@query(f"WITH {_SQL_SIDES} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.ref = b.ref OR a.ref = b.inv")
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _blocked(spark, d)[0]


@query(f"WITH {_SQL_SIDES} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.ccy = b.ccy AND abs(a.units - b.units) <= 50")
def amount_band_join(spark: SparkSession, d: str) -> DataFrame:
    return mt.band_pairs(bank(spark, d), ledger(spark, d), 50)


_ELIGIBLE = "a.ccy = b.ccy AND (a.day IS NULL OR b.day IS NULL OR abs(a.day - b.day) <= 5) AND abs(a.units - b.units) <= 500"


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    pairs, a, b = _blocked(spark, d)
    both = mt.with_sides(pairs, a, b)
    gap = F.abs(F.datediff("a_day", "b_day"))
    return both.where((F.col("a_ccy") == F.col("b_ccy")) & (gap.isNull() | (gap <= 5)) & (F.abs(F.col("a_units") - F.col("b_units")) <= 500))


@query(f"WITH {_SQL_SIDES} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON (a.ref = b.ref OR a.ref = b.inv) WHERE {_ELIGIBLE}")
def eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d).select("a_id", "b_id")


_UNIQUE_SQL = """, h AS ({hits}), f AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY a_id) = 1)
    SELECT a_id, b_id FROM f QUALIFY count(*) OVER (PARTITION BY b_id) = 1"""


@query(f"WITH {_SQL_SIDES}" + _UNIQUE_SQL.format(hits=f"SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM a JOIN b ON (a.ref = b.ref OR a.ref = b.inv) WHERE {_ELIGIBLE} AND a.units = b.units AND abs(a.day - b.day) <= 3"))
def exact_reference_match(spark: SparkSession, d: str) -> DataFrame:
    hits = _eligible(spark, d).where((F.col("a_units") == F.col("b_units")) & (F.abs(F.datediff("a_day", "b_day")) <= 3))
    return mt.two_way_unique(hits.select("a_id", "b_id"))


@query(f"WITH {_SQL_SIDES}" + _UNIQUE_SQL.format(hits="SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.ccy = b.ccy AND a.party = b.party AND abs(a.units - b.units) <= 500 AND abs(a.day - b.day) <= 3"))
def counterparty_tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = bank(spark, d), ledger(spark, d)
    return mt.two_way_unique(mt.band_pairs(a, b, 500, days=3, same=("party",)))


_RULE_1 = "abs(a.units - b.units) = 0 AND abs(a.day - b.day) <= 3"
_CASCADE_SQL = f"""WITH {_SQL_SIDES}, p AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id, a.units - b.units AS du, abs(a.day - b.day) AS dd FROM a JOIN b ON (a.ref = b.ref OR a.ref = b.inv) WHERE {_ELIGIBLE}),
    h1 AS (SELECT * FROM p WHERE du = 0 AND dd <= 3 QUALIFY count(*) OVER (PARTITION BY a_id) = 1),
    r1 AS (SELECT a_id, b_id FROM h1 QUALIFY count(*) OVER (PARTITION BY b_id) = 1),
    p2 AS (SELECT * FROM p ANTI JOIN r1 USING (a_id)), q2 AS (SELECT * FROM p2 WHERE b_id NOT IN (SELECT b_id FROM r1)),
    h2 AS (SELECT * FROM q2 WHERE abs(du) <= 50 AND dd <= 5 QUALIFY count(*) OVER (PARTITION BY a_id) = 1),
    r2 AS (SELECT a_id, b_id FROM h2 QUALIFY count(*) OVER (PARTITION BY b_id) = 1),
    m AS (SELECT a_id, b_id, 'exact' AS rule FROM r1 UNION ALL SELECT a_id, b_id, 'rounding' FROM r2)"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    pairs = _eligible(spark, d).select("a_id", "b_id", (F.col("a_units") - F.col("b_units")).alias("du"), F.abs(F.datediff("a_day", "b_day")).alias("dd"))
    return mt.rule_cascade(pairs, [("exact", (F.col("du") == 0) & (F.col("dd") <= 3)), ("rounding", (F.abs("du") <= 50) & (F.col("dd") <= 5))])


@query(_CASCADE_SQL + " SELECT a_id, b_id, rule FROM m")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d)


@query(_CASCADE_SQL + " SELECT id FROM a WHERE id NOT IN (SELECT a_id FROM m)")
def unmatched_bank(spark: SparkSession, d: str) -> DataFrame:
    return bank(spark, d).select("id").join(_cascade(spark, d).select(F.col("a_id").alias("id")), "id", "left_anti")


@query(_CASCADE_SQL + " SELECT id FROM b WHERE id NOT IN (SELECT b_id FROM m)")
def unmatched_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("id").join(_cascade(spark, d).select(F.col("b_id").alias("id")), "id", "left_anti")


@query(
    """WITH w AS (SELECT source AS s, row_number() OVER (ORDER BY source) AS k FROM mix_targets),
       lock AS (SELECT s, DATE '2005-02-01' + CAST(k * 7 AS INTEGER) AS lo, DATE '2005-02-01' + CAST(k * 7 + 4 AS INTEGER) AS hi FROM w)
       SELECT row_id, s AS lock_name FROM source_a JOIN lock ON date IS NULL OR date BETWEEN lo AND hi"""
)
def locked_rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    locks = read_table(spark, d, "mix_targets").select(F.col("source").alias("lock_name"), F.row_number().over(Window.orderBy("source")).alias("k"))
    start = F.lit("2005-02-01").cast("date")
    locks = locks.select("lock_name", F.date_add(start, F.col("k") * 7).alias("lo"), F.date_add(start, F.col("k") * 7 + 4).alias("hi"))
    # A fixed table of eight rows: every row is held against each lock.
    return _a(spark, d).join(F.broadcast(locks), F.col("date").isNull() | F.col("date").between(F.col("lo"), F.col("hi"))).select("row_id", "lock_name")


# -------------------------------------------------------------- scores, ranking


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Evidence score of pairs in an amount band: reference, amount, date, party."""
    a, b = bank(spark, d), ledger(spark, d)
    both = mt.with_sides(mt.band_pairs(a, b, 500, days=5), a, b)
    known = F.col("a_ref").isNotNull() & F.coalesce("b_inv", "b_ref").isNotNull()
    same = F.coalesce((F.col("a_ref") == F.col("b_inv")) | (F.col("a_ref") == F.col("b_ref")), F.lit(False))
    gap = F.abs(F.datediff("a_day", "b_day"))
    party_known = F.col("a_party").isNotNull() & F.col("b_party").isNotNull()
    earned = F.when(same, 35.0).otherwise(0.0) + 25.0 * (1 - F.abs(F.col("a_units") - F.col("b_units")) / 501) + 10.0 * (1 - gap / 6) + F.when(F.col("a_party") == F.col("b_party"), 10.0).otherwise(0.0)
    available = F.when(known, 35.0).otherwise(0.0) + 35.0 + F.when(party_known, 10.0).otherwise(0.0) + F.when(same, 0.0).otherwise(45.0)
    return both.select("a_id", "b_id", F.round(F.least(earned / available, F.lit(1.0)), 6).alias("score"))


_SCORED_SQL = f"""WITH {_SQL_SIDES}, p AS (SELECT a.id AS a_id, b.id AS b_id, a.units - b.units AS du, abs(a.day - b.day) AS dd,
      a.ref IS NOT NULL AND coalesce(b.inv, b.ref) IS NOT NULL AS known, coalesce(a.ref = b.inv, false) OR coalesce(a.ref = b.ref, false) AS same,
      a.party IS NOT NULL AND b.party IS NOT NULL AS pk, coalesce(a.party = b.party, false) AS ps
    FROM a JOIN b ON a.ccy = b.ccy AND abs(a.units - b.units) <= 500 AND abs(a.day - b.day) <= 5),
  s AS (SELECT a_id, b_id, round(least((CASE WHEN same THEN 35.0::DOUBLE ELSE 0 END + 25.0::DOUBLE * (1 - abs(du) / 501::DOUBLE) + 10.0::DOUBLE * (1 - dd / 6::DOUBLE) + CASE WHEN ps THEN 10.0::DOUBLE ELSE 0 END)
      / (CASE WHEN known THEN 35.0::DOUBLE ELSE 0 END + 35.0::DOUBLE + CASE WHEN pk THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN same THEN 0::DOUBLE ELSE 45.0 END), 1.0::DOUBLE), 6) AS score FROM p)"""


@query(_SCORED_SQL + " SELECT a_id, b_id, score FROM s")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query(_SCORED_SQL + " SELECT a_id, b_id, score, CAST(row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def candidate_top_k(spark: SparkSession, d: str) -> DataFrame:
    return mt.ranked(_scored(spark, d)).where("rank <= 3").select("a_id", "b_id", "score", "rank")


@query(
    _SCORED_SQL
    + """ , r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second, max(score) OVER (PARTITION BY a_id) AS top FROM s WINDOW w AS (PARTITION BY a_id ORDER BY score DESC, b_id)),
      t AS (SELECT a_id, CAST(sum(CASE WHEN score >= 0.8::DOUBLE * top THEN 1 ELSE 0 END) - 1 AS BIGINT) AS rivals FROM r GROUP BY a_id)
      SELECT a_id, b_id, score, round(score - coalesce(second, 0::DOUBLE), 6) AS margin, rivals FROM r JOIN t USING (a_id) WHERE k = 1"""
)
def ambiguity_margin(spark: SparkSession, d: str) -> DataFrame:
    return mt.ranked(_scored(spark, d)).where("rank = 1").select("a_id", "b_id", "score", "margin", "rivals")


@query(_SCORED_SQL + " , t AS (SELECT a_id, b_id FROM s QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1) SELECT b_id, count(*) AS anchors FROM t GROUP BY b_id HAVING count(*) > 1")
def reverse_contention(spark: SparkSession, d: str) -> DataFrame:
    return mt.contested(_scored(spark, d))


@query()
def assign_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return mt.assigned(_scored(spark, d), 0.5)


@query("SELECT row_id, currency, CAST(round(amount * 1000) AS BIGINT) AS units FROM source_a ORDER BY abs(amount) DESC, row_id LIMIT 10")
def largest_ten(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).orderBy(F.abs("amount").desc(), "row_id").limit(10).select("row_id", "currency", _units(F.col("amount")).alias("units"))


# ------------------------------------------------------------------- grouping


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Targets and pools: each order's lines; the target is the smallest and the largest together."""
    lines = read_table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * 100, 0).cast("long")
    pool = lines.select(F.col("l_orderkey").alias("group_key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), cents.alias("units"))
    pool = pool.groupBy("group_key", "id").agg(F.min("units").alias("units"))
    targets = pool.groupBy("group_key").agg((F.min("units") + F.max("units")).alias("units"), F.count("*").alias("n")).where("n >= 2").drop("n")
    return targets, pool


_POOL_SQL = """p AS (SELECT l_orderkey AS group_key, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS id, min(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * 100) AS BIGINT)) AS units FROM lineitem GROUP BY 1, 2),
  t AS (SELECT group_key, min(units) + max(units) AS target FROM p GROUP BY 1 HAVING count(*) >= 2)"""


@query(f"WITH {_POOL_SQL} SELECT x.group_key, x.id AS first_id, y.id AS second_id FROM t JOIN p x USING (group_key) JOIN p y ON y.group_key = x.group_key AND x.id < y.id AND x.units + y.units = t.target")
def subset_sum_pairs(spark: SparkSession, d: str) -> DataFrame:
    targets, pool = _orders(spark, d)
    return mt.subset_pairs(targets, pool)


@query()
def subset_sum_groups(spark: SparkSession, d: str) -> DataFrame:
    targets, pool = _orders(spark, d)
    return mt.subset_groups(targets, pool)


# ------------------------------------------------------- aggregates, checks, audit


@query("SELECT currency, count(*) AS n, CAST(round(sum(amount) * 1000) AS BIGINT) AS units FROM source_a GROUP BY currency")
def totals_by_currency(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).groupBy("currency").agg(F.count("*").alias("n"), _units(F.sum("amount")).alias("units"))


@query("SELECT id, count(*) AS n FROM source_a GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return ck.duplicate_keys(_a(spark, d), ["id"])


@query("SELECT counterparty, count(DISTINCT sign(amount)) AS signs FROM source_a WHERE amount <> 0 AND counterparty IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sign(amount)) > 1")
def sign_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _a(spark, d).where("amount <> 0 and counterparty is not null").groupBy("counterparty").agg(F.count_distinct(F.signum(F.col("amount").cast("double"))).alias("signs")).where("signs > 1")


_PROFILED = ("id", "reference", "counterparty", "currency")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, sum(n)::BIGINT AS row_count, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS filled, count(CASE WHEN ok THEN 1 END) AS distinct_values, sum(CASE WHEN ok AND n > 1 THEN n ELSE 0 END)::BIGINT AS repeated,
            min(CASE WHEN ok THEN length(v) END)::BIGINT AS shortest, max(CASE WHEN ok THEN length(v) END)::BIGINT AS longest, sum(CASE WHEN ok THEN n ELSE 0 END) > 0 AND sum(CASE WHEN ok THEN n ELSE 0 END) < 0.8 * sum(n) AS low_fill
            FROM (SELECT {c} AS v, count(*) AS n, coalesce({c}, '') <> '' AS ok FROM source_a GROUP BY {c})"""
        for c in _PROFILED
    )
)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return ck.column_profile(_a(spark, d), list(_PROFILED))


@query()
def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ck.column_kinds(_a(spark, d), ["id", "date", "reference", "counterparty", "amount", "currency", "batch_no"])


@query(
    """SELECT CASE WHEN g <= 7 THEN '0-7' WHEN g <= 30 THEN '8-30' WHEN g <= 60 THEN '31-60' WHEN g <= 90 THEN '61-90' ELSE '90+' END AS bucket, currency, count(*) AS n, CAST(round(sum(abs(amount)) * 1000) AS BIGINT) AS units, max(g)::INTEGER AS oldest
       FROM (SELECT DATE '2005-05-01' - date AS g, currency, amount FROM source_b WHERE date IS NOT NULL) GROUP BY 1, 2"""
)
def aging_report(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit("2005-05-01").cast("date"), "date")
    return _b(spark, d).where("date is not null").groupBy(ck.age_buckets(days).alias("bucket"), "currency").agg(F.count("*").alias("n"), _units(F.sum(F.abs("amount"))).alias("units"), F.max(days).alias("oldest"))


@query(
    """WITH o AS (SELECT currency, CAST(round(amount * 1000) AS BIGINT) AS units FROM source_a WHERE amount IS NOT NULL), l AS (SELECT currency, list_sort(list(units)) AS v FROM o GROUP BY 1)
       SELECT currency, len(v) AS n, list_sum(v)::BIGINT AS total, v[1] AS lowest, v[least(len(v), CAST(floor(0.5::DOUBLE * len(v)) AS BIGINT) + 1)] AS p50, v[least(len(v), CAST(floor(0.95::DOUBLE * len(v)) AS BIGINT) + 1)] AS p95,
              v[least(len(v), CAST(floor(0.99::DOUBLE * len(v)) AS BIGINT) + 1)] AS p99, v[len(v)] AS highest FROM l"""
)
def histogram_summary(spark: SparkSession, d: str) -> DataFrame:
    return ck.histogram_summary(_a(spark, d).select("currency", _units(F.col("amount")).alias("units")), ["currency"], "units")


@query(_CASCADE_SQL + " SELECT rule, count(*) AS matches, CAST(sum(a.units) AS BIGINT) AS units FROM m JOIN a ON a.id = m.a_id GROUP BY rule")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    matched = _cascade(spark, d).join(bank(spark, d).select(F.col("id").alias("a_id"), "units"), "a_id")
    return matched.groupBy("rule").agg(F.count("*").alias("matches"), F.sum("units").alias("units"))


@query(_CASCADE_SQL + " SELECT b_id AS id, count(*) AS groups FROM m GROUP BY b_id HAVING count(*) > 1")
def invariant_exclusivity(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).groupBy(F.col("b_id").alias("id")).agg(F.count("*").alias("groups")).where("groups > 1")


@query("SELECT id, count(DISTINCT batch_no) AS groups, CAST(sum(abs(round(amount * 1000))) AS BIGINT) AS allocated, CAST(max(round(amount * 1000)) AS BIGINT) AS units FROM source_a GROUP BY id HAVING count(DISTINCT batch_no) > 1 OR sum(abs(round(amount * 1000))) > abs(max(round(amount * 1000)))")
def invariant_allocation(spark: SparkSession, d: str) -> DataFrame:
    rows = _a(spark, d).select("id", F.col("batch_no").alias("group_id"), _units(F.col("amount")).alias("units"))
    return ck.over_allocated(rows, rows.groupBy("id").agg(F.max("units").alias("units")))


@query(
    f"""SELECT row_id, 'reference' AS field, reference AS source_value, {_NORM.format('reference')} AS value FROM source_a
        UNION ALL SELECT row_id, 'currency', currency, upper(trim(currency)) FROM source_a"""
)
def lineage_long(spark: SparkSession, d: str) -> DataFrame:
    return ck.lineage(_a(spark, d), "row_id", {"reference": tx.normalize_reference(F.col("reference")), "currency": F.upper(F.trim("currency"))})


def _payload() -> Column:
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))


# A link takes in the link before it, so the SQL has to walk each chain.
_CHAIN_SQL = """RECURSIVE e AS (SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || '|' || event_type || '|' || CAST(user_id AS VARCHAR)) AS content_hash,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  c AS (SELECT user_id, event_id, content_hash, k, '' AS previous_hash, sha256(content_hash) AS link_hash FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_id, e.content_hash, e.k, c.link_hash, sha256(c.link_hash || e.content_hash) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)"""


@query(f"WITH {_CHAIN_SQL} SELECT user_id, event_id, content_hash, previous_hash, link_hash FROM c")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return au.sealed(read_table(spark, d, "events"), "user_id", "event_id", _payload()).select("user_id", "event_id", "content_hash", "previous_hash", "link_hash")


def _forged(spark: SparkSession, d: str) -> DataFrame:
    """Sealed chains in which the content of some events was changed afterwards."""
    events = au.sealed(read_table(spark, d, "events"), "user_id", "event_id", _payload())
    return events.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))


@query("SELECT user_id, event_id FROM events QUALIFY event_id >= min(CASE WHEN event_id % 97 = 0 THEN event_id END) OVER (PARTITION BY user_id)")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return au.broken_links(_forged(spark, d), "user_id", "event_id", _payload()).select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS first_bad FROM events WHERE event_id % 97 = 0 GROUP BY user_id")
def audit_first_broken(spark: SparkSession, d: str) -> DataFrame:
    return au.first_broken(_forged(spark, d), "user_id", "event_id", _payload())


@query(
    _CASCADE_SQL
    + """, h AS (SELECT sha256('=' || a_id || chr(31) || '=' || b_id || chr(31) || '=' || rule) AS h FROM m),
      k AS (SELECT h[1:3] AS k, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS b FROM h GROUP BY 1)
      SELECT CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(b, '' ORDER BY k)) AS result_hash FROM k"""
)
def result_hash(spark: SparkSession, d: str) -> DataFrame:
    return au.result_hash(_cascade(spark, d), ["a_id", "b_id", "rule"])


@query(
    """SELECT 'DUPLICATE_SOURCE_RECORD_ID' AS code, sum(n - 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM source_a GROUP BY id HAVING count(*) > 1)
       UNION ALL SELECT 'MISSING_DATE', count(*) FROM source_a WHERE date IS NULL
       UNION ALL SELECT 'BLANK_REFERENCE', count(*) FROM source_a WHERE coalesce(trim(reference), '') = ''
       UNION ALL SELECT 'UNKNOWN_CURRENCY', count(*) FROM source_a WHERE upper(trim(currency)) NOT IN (SELECT code FROM currency_codes)"""
)
def quality_findings(spark: SparkSession, d: str) -> DataFrame:
    a, codes = _a(spark, d), read_table(spark, d, "currency_codes").select(F.col("code").alias("c"))
    count = lambda df, code: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    repeats = ck.duplicate_keys(a, ["id"]).agg(F.sum(F.col("n") - 1).alias("n")).select(F.lit("DUPLICATE_SOURCE_RECORD_ID").alias("code"), "n")
    unknown = a.where("currency is not null").join(codes, F.upper(F.trim("currency")) == F.col("c"), "left_anti")
    return ck.union_findings([repeats, count(a.where("date is null"), "MISSING_DATE"), count(a.where("coalesce(trim(reference), '') = ''"), "BLANK_REFERENCE"), count(unknown, "UNKNOWN_CURRENCY")])


@query("SELECT DISTINCT id, description, reference, counterparty FROM source_a")
def stream_dedupe_ingest(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.streaming.ingest import deduplicated_stream

    return deduplicated_stream(spark, f"{d}/source_a.parquet", ["id", "description", "reference", "counterparty"])

