import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators.rejects import CHUNK, accepted, parse_records, rejected, tokenize


def by_hand(text, sep):
    """Fields by a plain loop over the characters, or None."""
    fields, cell, state = [], "", "start"
    for c in text:
        if state == "quoted":
            if c == '"':
                state = "closed"
            else:
                cell += c
        elif c == sep:
            fields.append(cell)
            cell, state = "", "start"
        elif c in "\r\n":
            return None
        elif c == '"':
            if state == "start":
                state = "quoted"
            elif state == "closed":
                cell, state = cell + '"', "quoted"
            else:
                return None
        elif state == "closed":
            return None
        else:
            cell, state = cell + c, "bare"
    return None if state == "quoted" else [*fields, cell]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='ab",;\n|é😀', max_size=3 * CHUNK), st.sampled_from(",;|")), max_size=8))
def test_tokenizer_equals_plain_loop(records):
    fields, faults = tokenize([t for t, _ in records], [s for _, s in records])
    for (text, sep), got, fault in zip(records, fields, faults, strict=True):
        assert got == by_hand(text, sep)
        assert (fault >= 0) == (got is None)


def test_offsets_and_long_records():
    fields, faults = tokenize(['a,"b"c', 'x,"open', '"' + "y" * 100_000 + '",z', "", None], [","] * 5)
    assert list(faults) == [5, 7, -1, -1, -1]
    assert fields[2] == ["y" * 100_000, "z"] and fields[3] == [""] and fields[4] is None


FILES = "file_id string, side string, field_sep string, decimal_mark string, group_mark string, date_pattern string, n_columns int, extra string"
LINES = "raw_id long, file_id string, line_no int, raw_text string, side string"


def parse(spark, lines, files=None):
    files = files or [("f", "A", ";", ",", ".", "dd.MM.yyyy", 7, "x"), ("g", "B", ",", ".", None, "yyyyMMdd", 8, None)]
    rows = [(k, f, n, t, "clash") for k, (f, n, t) in enumerate(lines)]
    codes = spark.createDataFrame([("EUR", 2), (None, 1)], "code string, minor_digits int")
    return parse_records(spark.createDataFrame(rows, LINES), spark.createDataFrame(files, FILES), codes)


def test_reasons_and_rows(spark):
    lines = [
        ("f", 1, "id;date;description;reference;counterparty;amount;currency"),
        ("f", 2, "i;31.12.2004;d;;p; -1.234,50\t; eur "),
        ("f", 3, "i;31.02.2004;d;;p;12,;USD"),
        ("f", 4, "i;01.01.2004;d;p;1,0;EUR"),
        ("f", 5, 'i;01.01.2004;d"e;;p;1,0;EUR'),
        ("f", 6, " \t"),
        ("f", 7, None),
        ("g", None, '7,20040229,"a\nb",,,q,12345678901234567,EUR'),
        ("g", 9, '7,20040229,"a ""b""",,,q,+12.5,EUR'),
        ("?", 2, "1,2"),
        ("f", 8, "i;1.1.2004;d;;p;1.23,0;"),
    ]
    parsed = parse(spark, lines).cache()
    got = {(r.raw_id, r.reason) for r in rejected(parsed).collect()}
    assert got == {(2, "bad_date"), (2, "bad_amount"), (2, "bad_currency"), (3, "column_count"), (4, "quoting"), (7, "bad_amount"), (9, "unknown_file"), (10, "bad_date"), (10, "bad_amount"), (10, "bad_currency")}
    a = accepted(parsed, "A").collect()
    assert [(r.raw_id, r.date, r.amount, r.currency) for r in a] == [(1, dt.date(2004, 12, 31), Decimal("-1234.50000000"), "EUR")]
    b = accepted(parsed, "B").collect()
    assert [(r.raw_id, r.memo, r.amount) for r in b] == [(8, 'a "b"', Decimal("12.50000000"))]


def test_empty_tables(spark):
    assert parse(spark, []).count() == 0
    assert rejected(parse(spark, [("f", 2, "a")], [("h", "A", ",", ".", None, "yyyyMMdd", 7, None)])).collect()[0].reason == "unknown_file"
