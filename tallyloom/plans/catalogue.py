"""The queries of the core, by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.copydiff import copy_differences
from tallyloom.operators.rejects import LAYOUT, accepted, parse_records, rejected
from tallyloom.plans.pipeline import ORACLES, QUERIES
from tallyloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(*(read_table(spark, sf_dir, t) for t in ("raw_lines", "source_files", "currency_codes")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_parsed(spark, sf_dir)).select("raw_id", "reason")


def _written(rows: DataFrame) -> DataFrame:
    """Typed rows with dates and amounts as text, so that engines compare alike."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ("date", "amount")})


def p3_rows_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(accepted(_parsed(spark, sf_dir), "A"))


def p3_rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(accepted(_parsed(spark, sf_dir), "B"))


def p4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for side in ("A", "B"):
        source, copy = (read_table(spark, sf_dir, f"{kind}_{side.lower()}") for kind in ("source", "copy"))
        columns = [c for c in LAYOUT[side] if c != "id"]
        parts.append(copy_differences(source, copy, "id", columns).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1]).select("side", "id", "finding", "source_value", "copy_value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_cells(spark, sf_dir).select("side", "id", "finding")


def queries() -> dict[str, Query]:
    return {**QUERIES, **{q.__name__: q for q in (p3_found, p3_rows_a, p3_rows_b, p4_found, p4_cells)}}


def _differences_sql(side: str, names: tuple[str, ...]) -> str:
    table = side.lower()
    cells = " UNION ALL ".join(
        f"SELECT '{side}', s.id, '{c}', CAST(s.{c} AS VARCHAR), CAST(k.{c} AS VARCHAR) FROM s{table} s JOIN copy_{table} k ON s.id = k.id WHERE s.{c} IS DISTINCT FROM k.{c}"
        for c in names
        if c != "id"
    )
    return f"""SELECT '{side}' AS side, s.id AS id, 'missing_in_copy' AS finding, NULL AS source_value, NULL AS copy_value FROM s{table} s ANTI JOIN copy_{table} k ON s.id = k.id
        UNION ALL SELECT '{side}', k.id, 'missing_in_source', NULL, NULL FROM copy_{table} k ANTI JOIN s{table} s ON s.id = k.id
        UNION ALL {cells}"""


#: Records as one regular expression a separator: fields, or null where quoting breaks.
_RECORDS_SQL = """
l AS (SELECT r.raw_id, r.raw_text AS t, f.* EXCLUDE (file_id, received_at), '("(?:[^"]|"")*"|[^"' || f.field_sep || '\r\n]*)' AS field
      FROM raw_lines r JOIN source_files f USING (file_id) WHERE r.line_no <> 1 AND trim(r.raw_text, ' ' || chr(9)) <> ''),
c AS (SELECT *, CASE WHEN regexp_full_match(t, field || '(?:[' || field_sep || ']' || field || ')*', 's')
        THEN list_transform(regexp_extract_all(field_sep || t, '[' || field_sep || ']' || field, 1, 's'), lambda x: CASE WHEN x[1:1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS cells FROM l),
v AS (SELECT *, coalesce(len(cells) = n_columns, false) AS whole, cells[2] AS d, trim(replace(cells[n_columns - 1], chr(9), ' '), ' ') AS a, upper(trim(replace(cells[n_columns], chr(9), ' '), ' ')) AS ccy FROM c),
w AS (SELECT *, regexp_replace(a, '^[+-]', '') AS body FROM v),
x AS (SELECT *, CASE WHEN instr(body, decimal_mark) > 0 THEN body[1:instr(body, decimal_mark) - 1] ELSE body END AS int_part, CASE WHEN instr(body, decimal_mark) > 0 THEN body[instr(body, decimal_mark) + 1:] END AS part FROM w),
y AS (SELECT *, CASE WHEN group_mark IS NULL OR contains(int_part, chr(1)) THEN int_part ELSE replace(int_part, group_mark, chr(1)) END AS g FROM x),
z AS (SELECT *, coalesce((regexp_full_match(int_part, '[0-9]+') OR (group_mark IS NOT NULL AND regexp_full_match(replace(g, chr(1), '_'), '[0-9]{1,3}(?:_[0-9]{3})+'))) AND length(replace(g, chr(1), '')) <= 16
        AND (part IS NULL OR regexp_full_match(part, '[0-9]{1,8}')), false) AS a_ok,
        CASE WHEN regexp_replace(d, '[0-9]', '0', 'g') = regexp_replace(date_pattern, '[yMd]', '0', 'g')
          THEN TRY_CAST(substr(d, instr(date_pattern, 'yyyy'), 4) || '-' || substr(d, instr(date_pattern, 'MM'), 2) || '-' || substr(d, instr(date_pattern, 'dd'), 2) AS DATE) END AS day,
        ccy IN (SELECT code FROM currency_codes) AS c_ok FROM y)"""


def _rows_sql(side: str) -> str:
    cells = ", ".join(f"cells[{k}] AS {c}" for k, c in enumerate(LAYOUT[side], 1) if c not in ("date", "amount", "currency"))
    number = "CAST((CASE WHEN a[1:1] = '-' THEN '-' ELSE '' END) || replace(g, chr(1), '') || '.' || coalesce(part, '0') AS DECIMAL(24, 8))"
    return f"WITH {_RECORDS_SQL} SELECT raw_id, {cells}, CAST(day AS VARCHAR) AS date, CAST({number} AS VARCHAR) AS amount, ccy AS currency FROM z WHERE side = '{side}' AND whole AND a_ok AND day IS NOT NULL AND c_ok"


def oracle_sql() -> dict[str, str]:
    ctes = ", ".join(f"s{s.lower()} AS (SELECT DISTINCT {', '.join(LAYOUT[s])} FROM source_{s.lower()} WHERE id IS NOT NULL)" for s in "AB")
    cells = f"WITH {ctes}, cells AS ({_differences_sql('A', LAYOUT['A'])} UNION ALL {_differences_sql('B', LAYOUT['B'])})"
    return {
        **ORACLES,
        "p3_found": f"""WITH {_RECORDS_SQL} SELECT raw_id, 'quoting' AS reason FROM z WHERE cells IS NULL
            UNION ALL SELECT raw_id, 'column_count' FROM z WHERE cells IS NOT NULL AND NOT whole
            UNION ALL SELECT raw_id, 'bad_amount' FROM z WHERE whole AND NOT a_ok
            UNION ALL SELECT raw_id, 'bad_date' FROM z WHERE whole AND day IS NULL
            UNION ALL SELECT raw_id, 'bad_currency' FROM z WHERE whole AND NOT c_ok""",
        "p3_rows_a": _rows_sql("A"),
        "p3_rows_b": _rows_sql("B"),
        "p4_found": f"{cells} SELECT side, id, finding FROM cells",
        "p4_cells": f"{cells} SELECT side, id, finding, source_value, copy_value FROM cells",
    }
