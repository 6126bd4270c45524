"""The queries of this subpackage, by name, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.history import repeated_rows
from tallyloom.llm.linkage import BROADCAST_NAMES, BROADCAST_REPEATS, bank_records, ledger_records, linked_records, with_repeats
from tallyloom.llm.mixing import mix_report, mix_sources
from tallyloom.llm.names import link_names, variant_pairs
from tallyloom.llm.nearest import nearest_in_time, party_key
from tallyloom.llm.pii import disclosure, personal_spans, sanitised, scan
from tallyloom.llm.tokens import encode_corpus, token_counts
from tallyloom.session import broadcast_if, cut, read_table, scratch


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (read_table(spark, sf_dir, t).select(F.col("counterparty").alias("name")) for t in ("source_a", "source_b"))
    return a.unionAll(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(link_names(_typed_names(spark, sf_dir)))


def p1_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(_typed_names(spark, sf_dir)).select("name", "n", "party")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables under common names; their row ids differ."""
    shared = ["row_id", "batch_no", "id", "booked_at", "amount", "currency", "reference", "counterparty"]
    a = read_table(spark, sf_dir, "source_a").select(*shared, F.col("description").alias("text"), F.lit("A").alias("side"))
    b = read_table(spark, sf_dir, "source_b").select(*shared, F.col("memo").alias("text"), F.lit("B").alias("side"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _delivered(spark, sf_dir)
    repeats = repeated_rows(rows, "text", "side")
    sides = rows.select(F.col("row_id").alias("first_row_id"), "side")
    return repeats.join(sides, "first_row_id").select("side", "first_row_id", "repeat_row_id")


def _payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Linked records, and the repeats of either side."""
    with scratch(spark) as keep:
        parties = broadcast_if(link_names(_typed_names(spark, sf_dir), learn=False).select("name", "party", "stem"), BROADCAST_NAMES)
        # All batches are at hand, so they are admitted as one.
        again = keep(repeated_rows(_delivered(spark, sf_dir), "text", "side", batch=None), "again")
        copies = broadcast_if(again.select(F.col("repeat_row_id").alias("id")), BROADCAST_REPEATS)
        first = lambda records: cut(records.join(copies, "id", "left_anti"), "records")
        bank = first(bank_records(read_table(spark, sf_dir, "source_a"), parties))
        ledger = first(ledger_records(read_table(spark, sf_dir, "source_b"), parties))
        return keep(linked_records(bank, ledger), "pairs"), again


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_repeats(*_payments(spark, sf_dir))
    return pairs.select(F.col("a").alias("a_row_id"), F.col("b").alias("b_row_id"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_repeats(*_payments(spark, sf_dir))
    return pairs.select(F.col("a").alias("a_row_id"), F.col("b").alias("b_row_id"), F.round("confidence", 6).alias("confidence"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (read_table(spark, sf_dir, t).withColumn("entity", party_key(F.col("counterparty"))) for t in ("source_a", "source_b"))
    pairs = nearest_in_time(a, b, "entity", "booked_at", "row_id", "row_id")
    return pairs.select(F.col("left_id").alias("a_row_id"), F.col("right_id").alias("b_row_id"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in tokens, and as quality weight the mean length of a
    token: text in a wrong encoding or of rare symbols falls into short tokens."""
    sized = cut(token_counts(read_table(spark, sf_dir, "documents"), ["doc_id", "source"]), "sized")
    per_token = F.col("n_chars") / F.nullif(F.col("n_tokens"), F.lit(0))
    return sized.withColumn("weight", F.least(F.greatest(per_token / 4, F.lit(0.25)), F.lit(1.0)))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets")
    return mix_report(sized, mix_sources(sized, targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p9_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitised(read_table(spark, sf_dir, "documents"))


def p9_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = disclosure(cut(scan(read_table(spark, sf_dir, "documents")), "pii-scan"))
    return terms.withColumns({c: F.round(c, 6) for c in ("bits", "surprise")})


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_parties, p2_found, p5_found, p5_links, p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_text, p9_terms)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            WITH a AS (SELECT row_id, booked_at, regexp_replace(trim(upper(counterparty), ' '), ' +', ' ', 'g') AS e FROM source_a
                       WHERE booked_at IS NOT NULL AND counterparty NOT IN ('UNKNOWN', 'N/A', '?')),
                 b AS (SELECT row_id, booked_at, regexp_replace(trim(upper(counterparty), ' '), ' +', ' ', 'g') AS e FROM source_b
                       WHERE booked_at IS NOT NULL AND counterparty NOT IN ('UNKNOWN', 'N/A', '?'))
            SELECT a.row_id AS a_row_id, b.row_id AS b_row_id
            FROM a JOIN b ON a.e = b.e AND b.booked_at BETWEEN a.booked_at - INTERVAL 12 HOUR AND a.booked_at + INTERVAL 12 HOUR
            QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY abs(epoch_us(a.booked_at) - epoch_us(b.booked_at)), b.booked_at, b.row_id) = 1
        """,
    }
