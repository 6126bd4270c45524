import json
import zipfile

import pytest

from tallyloom.sources import readers as rd
from tallyloom.sources.writers import write_by_tenant, write_package
from tallyloom.streaming.ingest import deduplicated_stream, new_rows


def test_sniffing():
    assert rd.sniff_encoding("é".encode("latin-1")) == "ISO-8859-1"
    assert rd.sniff_encoding(b"\xef\xbb\xbfabc") == "UTF-8"
    assert rd.sniff_separator('a;b;c\n1;"x,y,z";3\n4;5,0;6\n') == ";"
    assert rd.unique_headers(["a", "", "a", None, "a"]) == ["a", "column_2", "a_1", "column_4", "a_2"]


def test_delimited(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('id;name\n1;"a;b"\n2;"c"";d"\n3\n4;x;y\n ; \n5;é\n')
    rows, bad = rd.read_delimited(spark, str(f))
    assert {r.id: r.name for r in rows.collect()} == {"1": "a;b", "2": 'c";d', "5": "é"}
    assert bad.count() == 2
    assert rd.read_any(spark, str(f))[0].columns == ["id", "name"]
    (tmp_path / "e.csv").write_text("")
    assert rd.read_delimited(spark, str(tmp_path / "e.csv"))[0].count() == 0


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"n": 1, "data": [{"id": 1, "s": {"x": True}, "l": [1, 2]}, {"id": 2, "s": None, "l": None}]}))
    rows = {r["id"]: (r["s.x"], r["l"]) for r in rd.read_any(spark, str(tmp_path / "a.json"))[0].collect()}
    assert rows == {"1": ("TRUE", "[1,2]"), "2": (None, None)}
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert rd.read_any(spark, str(tmp_path / "b.jsonl"))[0].count() == 2


def test_writers_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("t", 1), ("t", 1), ("u", 2)], "tenant string, v int")
    write_by_tenant(df, str(tmp_path / "w"), "tenant")
    assert spark.read.parquet(str(tmp_path / "w")).count() == 3
    manifest = write_package({"items": (df, ["v"], "csv"), "events": (df, ["v"], "json")}, str(tmp_path / "p"))
    assert {len(r.checksum) for r in manifest.collect()} == {64}
    got = deduplicated_stream(spark, str(tmp_path / "w"), ["v"])
    assert sorted(r.v for r in got.collect()) == [1, 2]
    assert new_rows(df, df.where("v = 2"), ["v"]).count() == 1


def test_heads_of_16_bit_letters():
    assert rd.sniff_encoding("a;b;c".encode("utf-16-le")) == "UTF-16LE" and rd.sniff_encoding("a;b;c".encode("utf-16-be")) == "UTF-16BE"
    assert rd.sniff_encoding("a\u2019s".encode("cp1252")) == "windows-1252"


def test_records_of_a_split_file(spark, tmp_path):
    f = tmp_path / "big.csv"
    f.write_text("id,name\n" + "".join(f"{k},row {k}\n" if k % 1000 else f"{k}\n" for k in range(1, 6001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, bad = rd.file_records(spark, str(f))
        assert rows.rdd.getNumPartitions() > 1
        assert {(int(r.id), r["__row__"]) for r in rows.collect()} == {(k, k) for k in range(1, 6001) if k % 1000}
        assert sorted(r.record_no for r in bad.collect()) == [1000, 2000, 3000, 4000, 5000, 6000]
        assert rows.select("__id__").distinct().count() == 5994
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "q.csv").write_text('id,name\n1,"two\nlines"\n2,x\n')
    assert {r.id: r.name for r in rd.read_delimited(spark, str(tmp_path / "q.csv"))[0].collect()} == {"1": "two\nlines", "2": "x"}


def test_several_arrays_have_to_be_named(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": [{"x": 1}], "b": [{"y": 2}]}))
    with pytest.raises(ValueError):
        rd.read_json(spark, str(tmp_path / "m.json"))
    assert rd.read_json(spark, str(tmp_path / "m.json"), "b").first()["y"] == "2"


def test_workbook(spark, tmp_path):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet xmlns="http://x"><sheetData><row r="1">{cell("A1", "id")}{cell("B1", "name")}</row><row r="2"><c r="A2"><v>7</v></c>{cell("B2", " x ")}</row><row r="4"><c r="B4" t="s"><v>0</v></c></row><row r="5">{cell("D5", "far")}</row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://x"><si><t>shared</t></si></sst>')
    rows, bad = rd.read_any(spark, str(tmp_path / "w.xlsx"))
    assert {(r.id, r.name, r["__row__"]) for r in rows.collect()} == {("7", "x", 2), (None, "shared", 4)}
    assert [r.record_no for r in bad.collect()] == [5]


def test_files_known_and_screened(spark, tmp_path):
    for name, content in (("a.csv", b"x,y"), ("b.csv", b"x,y"), ("c.csv", b""), ("d.exe", b"MZ"), ("e.csv", b"a\x00b"), ("f.xlsx", b"no zip")):
        (tmp_path / name).write_bytes(content)
    found = rd.file_checksums(spark, str(tmp_path))
    fresh = rd.new_files(found, found.where("length = 0"))
    assert fresh.where("path like '%b.csv' or path like '%c.csv'").count() == 0 and fresh.where("path like '%a.csv'").count() == 1
    verdicts = {r.path[-5:]: r.verdict for r in rd.screened(spark, str(tmp_path)).collect()}
    assert verdicts == {"a.csv": "ok", "b.csv": "ok", "c.csv": "empty", "d.exe": "unknown_ending", "e.csv": "wrong_content", ".xlsx": "wrong_content"}


def test_a_second_call_takes_new_files_only(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1,), (2,)], "v int").coalesce(1).write.parquet(src)
    assert sorted(r.v for r in deduplicated_stream(spark, src, ["v"], store).collect()) == [1, 2]
    spark.createDataFrame([(2,), (3,), (None,)], "v int").coalesce(1).write.mode("append").parquet(src)
    again = deduplicated_stream(spark, src, ["v"], store)
    assert sorted((r.v for r in again.collect()), key=str) == [1, 2, 3, None]
    batches = list((tmp_path / "store" / "checkpoint" / "offsets").glob("[0-9]*"))
    assert len(batches) == 2  # one batch a call: nothing was read twice


def test_scratch_folders_go(spark, tmp_path):
    from tallyloom import session as ss

    def held():
        fs, at = ss.file_system(spark, f"{ss.shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}")
        return {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()

    ss.cut(spark.range(3), "warm")
    before = held()
    with ss.scratch(spark) as keep:
        ss.cut(spark.range(3), "inner")
        kept = keep(spark.range(4), "outer")
    assert {n.rsplit("-", 1)[0] for n in held() - before} == {"outer"} and kept.count() == 4
