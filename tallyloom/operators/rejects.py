"""Rows that fail to parse: a quote-aware state machine over raw records.

Every record is cut into chunks of equal width.  All chunks of an Arrow batch
are run through the machine at the same time from *every* possible start state,
which gives each chunk a map "state before -> state after".  Composing the maps
along a record gives the true start state of each of its chunks; one replay from
those states then marks separators, quotes and the first offending offset.  The
work per character is constant, whatever the length of a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Machine states.
START, BARE, QUOTED, CLOSED, BROKEN = range(5)
N_STATES = 5
# Character classes.
OTHER, QUOTE, SEP, BREAK, PAD = range(5)

CHUNK = 64

#: STEP[class, state] -> next state.  A quote may only open a field or close it;
#: a line break is data inside quotes only; BROKEN is never left.
STEP = np.array(
    [
        [BARE, BARE, QUOTED, BROKEN, BROKEN],  # other
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],  # quote
        [START, START, QUOTED, START, BROKEN],  # separator
        [BROKEN, BROKEN, QUOTED, BROKEN, BROKEN],  # line break
        [START, BARE, QUOTED, CLOSED, BROKEN],  # padding
    ],
    dtype=np.uint8,
)


def tokenize(texts: list[str | None], seps: list[str | None]) -> tuple[list[list[str] | None], np.ndarray]:
    """Fields of each record, or None with the offset where quoting breaks.

    Offsets count code points from 0; an unclosed quote is reported at the end
    of the record; -1 stands for a record without fault.
    """
    n = len(texts)
    faults = np.full(n, -1, dtype=np.int64)
    if not n:
        return [], faults
    lengths = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=n)
    flat = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(n), lengths)
    sep_code = np.fromiter((ord(s) if s and len(s) == 1 else 0xFFFFFFFF for s in seps), dtype=np.uint32, count=n)

    kinds = np.zeros(len(flat), dtype=np.uint8)
    kinds[(flat == 10) | (flat == 13)] = BREAK
    kinds[flat == sep_code[owner]] = SEP
    kinds[flat == 34] = QUOTE

    # Lay the characters out as one row per chunk.
    per_record = np.maximum((lengths + CHUNK - 1) // CHUNK, 1)
    first_chunk = np.cumsum(per_record) - per_record
    starts = np.cumsum(lengths) - lengths
    position = np.arange(len(flat)) - starts[owner]
    grid = np.full((int(per_record.sum()), CHUNK), PAD, dtype=np.uint8)
    grid[first_chunk[owner] + position // CHUNK, position % CHUNK] = kinds

    # Map of every chunk: all start states at once.
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (len(grid), 1))
    for column in grid.T:
        maps = STEP[column[:, None], maps]

    # Compose along the records: each round doubles the chunks that a map reaches back over.
    place = np.arange(len(grid)) - np.repeat(first_chunk, per_record)
    reach, span = maps, 1
    while span < per_record.max():
        far = np.flatnonzero(place >= span)
        joined = reach.copy()
        joined[far] = np.take_along_axis(reach[far], reach[far - span], axis=1)
        reach, span = joined, 2 * span
    entry = np.full(len(grid), START, dtype=np.uint8)
    entry[1:] = np.where(place[1:] > 0, reach[:-1, START], START)
    state = reach[first_chunk + per_record - 1, START]

    # Replay from the true start states.
    after = np.empty_like(grid)
    current = entry
    for j in range(CHUNK):
        current = STEP[grid[:, j], current]
        after[:, j] = current
    states = after[first_chunk[owner] + position // CHUNK, position % CHUNK]

    broken = np.flatnonzero(states == BROKEN)
    if len(broken):
        hit, where = np.unique(owner[broken], return_index=True)
        faults[hit] = position[broken[where]]
    unclosed = state == QUOTED
    faults[unclosed] = lengths[unclosed]

    cuts = np.flatnonzero((kinds == SEP) & (states == START))
    cut_owner, cut_pos = owner[cuts], position[cuts]
    lo = np.searchsorted(cut_owner, np.arange(n))
    hi = np.searchsorted(cut_owner, np.arange(n), side="right")
    quoted = np.zeros(n, dtype=bool)
    quoted[owner[kinds == QUOTE]] = True

    out: list[list[str] | None] = []
    for i, text in enumerate(texts):
        if text is None or faults[i] >= 0:
            out.append(None)
            continue
        if not quoted[i]:
            out.append(text.split(seps[i]) if hi[i] > lo[i] else [text])
            continue
        fields, begin = [], 0
        for end in [*cut_pos[lo[i] : hi[i]].tolist(), len(text)]:
            field = text[begin:end]
            fields.append(field[1:-1].replace('""', '"') if field[:1] == '"' else field)
            begin = end + 1
        out.append(fields)
    return out, faults


def _tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields, faults = tokenize(batch["raw_text"].to_pylist(), batch["field_sep"].to_pylist())
        columns = {name: batch[name] for name in batch.schema.names if name not in ("raw_text", "field_sep")}
        columns["fields"] = pa.array(fields, pa.list_(pa.string()))
        columns["fault_at"] = pa.array(faults, pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def plain_number(raw: Column, decimal_mark: Column, group_mark: Column) -> Column:
    """``raw`` as decimal(24,8) if it is a plain number in the dialect, else null."""
    body = F.regexp_replace(F.trim(F.translate(raw, "\t", " ")), r"^[+-]", "")
    negative = F.trim(F.translate(raw, "\t", " ")).startswith("-")
    mark_at = F.when(decimal_mark.isNull(), F.lit(0)).otherwise(F.instr(body, decimal_mark))
    whole = F.when(mark_at > 0, F.substring(body, F.lit(1), mark_at - 1)).otherwise(body)
    part = F.when(mark_at > 0, F.substring(body, mark_at + 1, F.length(body)))
    # A private character stands in for the file's own grouping mark.
    slot = ""
    grouped = F.when(group_mark.isNull() | whole.contains(slot), whole).otherwise(F.replace(whole, group_mark, F.lit(slot)))
    digits = F.replace(grouped, F.lit(slot), F.lit(""))
    ok = (
        (whole.rlike(r"\A[0-9]+\z") | (grouped.rlike(rf"\A[0-9]{{1,3}}(?:{slot}[0-9]{{3}})+\z") & group_mark.isNotNull()))
        & (F.length(digits) <= 16)
        & (part.isNull() | part.rlike(r"\A[0-9]{1,8}\z"))
    )
    text = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits, F.lit("."), F.coalesce(part, F.lit("0")))
    return F.when(ok, text.try_cast("decimal(24,8)"))


def written_date(raw: Column, pattern: Column) -> Column:
    """``raw`` as a date if it is written digit for digit in ``pattern``, else null."""
    shape = F.regexp_replace(pattern, "[yMd]", "0")
    same_shape = F.regexp_replace(F.translate(raw, "0123456789", "0000000000"), "\\A\\z", "") == shape
    piece = lambda token: F.substring(raw, F.instr(pattern, token), F.lit(len(token)))
    iso = F.concat_ws("-", piece("yyyy"), piece("MM"), piece("dd"))
    return F.when(same_shape, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


#: Columns of the two kinds of file, in file order.
LAYOUT = {
    "A": ("id", "date", "description", "reference", "counterparty", "amount", "currency"),
    "B": ("id", "date", "memo", "reference", "invoice", "counterparty", "amount", "currency"),
}


def parse_records(raw_lines: DataFrame, source_files: DataFrame, currency_codes: DataFrame) -> DataFrame:
    """One row per record that is neither header nor blank: typed columns and reasons.

    ``reasons`` is an array of (reason, offset): ``quoting`` with the code point
    where quoting breaks; else ``column_count`` with the number of fields found;
    else any of ``bad_amount``, ``bad_date``, ``bad_currency`` with the index of
    the field.  An empty array marks a valid row.  A record whose file is not
    listed in ``source_files`` has the reason ``unknown_file``.  A null
    ``raw_text`` counts as blank and is skipped; a null ``line_no`` is a data
    line; extra columns of the inputs are ignored; repeated records are each
    reported.  Empty tables give an empty result.

    The dialects travel with the records (an ordinary join: Spark broadcasts the
    file list only below its own size threshold, else AQE splits hot files).
    """
    dialects = source_files.select(
        F.col("file_id").alias("_file"), "side", "field_sep", "decimal_mark", "group_mark", "date_pattern", "n_columns"
    )
    lines = (
        raw_lines.select("raw_id", "file_id", "line_no", "raw_text")
        .where("raw_text is not null and trim(translate(raw_text, '\t', ' ')) <> '' and coalesce(line_no, 0) <> 1")
        .join(dialects, F.col("file_id") == F.col("_file"), "left")
        .drop("_file")
    )
    schema = "raw_id long, file_id string, line_no int, side string, decimal_mark string, group_mark string, date_pattern string, n_columns int, fields array<string>, fault_at long"
    lines = lines.select(
        F.col("raw_id").cast("long"), "file_id", F.col("line_no").cast("int"), "side", "decimal_mark", "group_mark", "date_pattern", F.col("n_columns").cast("int"), "raw_text", "field_sep"
    )
    cells = lines.mapInArrow(_tokenize_batches, schema)

    def cell(name: str) -> Column:
        """The field called ``name``, which stands elsewhere in either layout."""
        at = {side: names.index(name) + 1 for side, names in LAYOUT.items() if name in names}
        value = F.lit(None).cast("string")
        for side, k in at.items():
            value = F.when(F.col("side") == side, F.try_element_at("fields", F.lit(k))).otherwise(value)
        return value

    names = list(dict.fromkeys([*LAYOUT["A"], *LAYOUT["B"]]))
    whole = (F.col("fault_at") < 0) & (F.size("fields") == F.col("n_columns"))
    cells = cells.select(
        "*",
        whole.alias("_whole"),
        *[F.when(whole, cell(n)).alias(f"_{n}") for n in names],
    )
    known = currency_codes.select(F.col("code").alias("_code")).where("code is not null").distinct()
    cells = cells.withColumn("_ccy", F.upper(F.trim(F.translate("_currency", "\t", " ")))).join(
        known, F.col("_ccy") == F.col("_code"), "left"
    )
    cells = cells.withColumn("_num", plain_number(F.col("_amount"), F.col("decimal_mark"), F.col("group_mark"))).withColumn(
        "_day", written_date(F.col("_date"), F.col("date_pattern"))
    )
    spot = lambda name: F.when(F.col("side") == "A", F.lit(LAYOUT["A"].index(name))).otherwise(F.lit(LAYOUT["B"].index(name)))
    reason = lambda word, offset: F.struct(F.lit(word).alias("reason"), offset.cast("long").alias("offset"))
    values = F.array_compact(
        F.array(
            F.when(F.col("_num").isNull(), reason("bad_amount", spot("amount"))),
            F.when(F.col("_day").isNull(), reason("bad_date", spot("date"))),
            F.when(F.col("_code").isNull(), reason("bad_currency", spot("currency"))),
        )
    )
    reasons = (
        F.when(F.col("side").isNull(), F.array(reason("unknown_file", F.lit(0))))
        .when(F.col("fault_at") >= 0, F.array(reason("quoting", F.col("fault_at"))))
        .when(~F.col("_whole"), F.array(reason("column_count", F.size("fields"))))
        .otherwise(values)
    )
    return cells.select(
        "raw_id",
        "file_id",
        "line_no",
        "side",
        F.col("_id").alias("id"),
        F.col("_day").alias("date"),
        F.col("_description").alias("description"),
        F.col("_memo").alias("memo"),
        F.col("_reference").alias("reference"),
        F.col("_invoice").alias("invoice"),
        F.col("_counterparty").alias("counterparty"),
        F.col("_num").alias("amount"),
        F.col("_code").alias("currency"),
        reasons.alias("reasons"),
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """The failures of ``parse_records``: (raw_id, reason, offset), one row per reason."""
    return parsed.select("raw_id", F.inline("reasons"))


def accepted(parsed: DataFrame, side: str) -> DataFrame:
    """The valid typed rows of one side (``A`` or ``B``) of ``parse_records``."""
    return parsed.where((F.size("reasons") == 0) & (F.col("side") == side)).select("raw_id", *LAYOUT[side])
