"""Reading delivered files: format by name, dialect by a look at the head, rejects apart.

Heads are read as a stream, so the size of a file does not matter; a delimited file is split
among tasks unless its head shows line breaks inside quotes.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.values import name_uuid
from tallyloom.session import cut, file_system

#: Namespace of the ids of rows of files.
FILE_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

#: Bytes of a file that are looked at to tell encoding and separator.
HEAD_BYTES = 65_536
SEPARATORS = (",", ";", "\t", "|")


def sniff_encoding(head: bytes) -> str:
    """The encoding of a file by byte order mark, else the first that decodes its head."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    # Text in 16-bit letters without a mark has a zero in every other byte.
    if len(head) >= 4 and 0 in head:
        for at, name in ((1, "UTF-16LE"), (0, "UTF-16BE")):
            if head[at::2].count(0) > 0.4 * len(head) / 2:
                return name
    for short in range(4 if len(head) >= HEAD_BYTES else 1):  # a full head may end inside a character
        try:
            head[: len(head) - short].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    # The signs from 0x80 to 0x9F are letters and quotes in one code page, controls in the other.
    return "windows-1252" if any(0x80 <= c <= 0x9F for c in head) else "ISO-8859-1"


def sniff_separator(head: str, lines: int = 20) -> str:
    """The separator that occurs equally often in most of the first lines, outside quotes."""
    rows = [r for r in head.splitlines()[:lines] if r.strip()]
    scores = {}
    for sep in SEPARATORS:
        counts = Counter(len([p for k, p in enumerate(r.split('"')) if k % 2 == 0 for _ in range(p.count(sep))]) for r in rows)
        often, times = max(((n, c) for n, c in counts.items() if n), key=lambda x: x[1], default=(0, 0))
        scores[sep] = (times, often)
    return max(SEPARATORS, key=lambda s: scores[s])


def unique_headers(names: list[str | None]) -> list[str]:
    """Blank headers become column_N, repeats get _1, _2 ..."""
    out: list[str] = []
    for k, name in enumerate(names, 1):
        base = (name or "").strip() or f"column_{k}"
        new, n = base, 0
        while new in out:
            n += 1
            new = f"{base}_{n}"
        out.append(new)
    return out


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file of a path, read as a stream."""
    fs, at = file_system(spark, path)
    status = fs.getFileStatus(at)
    if status.isDirectory():
        files = sorted((s for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().getName())
        if not files:
            return b""
        status = files[0]
    stream = fs.open(status.getPath())
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(HEAD_BYTES, status.getLen()))))
    finally:
        stream.close()


def numbered_records(raw: DataFrame) -> DataFrame:
    """``raw`` with ``_file`` and ``_record``, the place of the row in its file from 1: places inside
    a task come from the order in which it reads, their offsets from the counts of the tasks
    before it."""
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"), F.col("_metadata.file_block_start").alias("_b"))
    placed = cut(placed, "records")
    blocks = placed.groupBy("_file", "_b").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("_file", "_b", "first", before.alias("before"))
    return placed.join(F.broadcast(offsets), ["_file", "_b"]).withColumn("_record", F.col("before") + F.col("_m") - F.col("first") + 1).drop("_p", "_m", "_b", "first", "before")  # one row a block


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None, tagged: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a delimited file or folder: all columns text, trimmed; ``tagged`` adds
    ``__file__`` and ``__row__``.

    Rows with another number of fields than the header are rejected, as (file, record_no,
    raw_text), never padded; record_no counts the records below the header.  An empty
    file gives empty tables.
    """
    head = _head(spark, path)
    encoding = encoding or sniff_encoding(head)
    text = head.decode(encoding, "replace").lstrip("\ufeff")
    separator = separator or sniff_separator(text)
    first = text.splitlines()[0] if text.strip() else ""
    names = unique_headers(next(csv.reader([first], delimiter=separator), [])) if first else []
    if not names:
        none = spark.createDataFrame([], "file string, record_no long, raw_text string")
        return none.drop("file", "record_no"), none
    # A line with an odd number of quotes ends inside a field.
    broken = any(line.count('"') % 2 for line in text.splitlines()[:-1])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", broken or encoding.startswith("UTF-16")).option("escape", '"').option("enforceSchema", True)
    raw = numbered_records(reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(schema).csv(path))
    blank = " AND ".join(f"coalesce(trim(`{n}`), '') = ''" for n in names) or "true"
    rows = raw.where("_corrupt IS NULL").where(f"NOT ({blank})").select(*[F.trim(F.col(f"`{n}`")).alias(n) for n in names], *([F.col("_file").alias("__file__"), F.col("_record").alias("__row__")] if tagged else []))
    return rows, raw.where("_corrupt IS NOT NULL").select(F.col("_file").alias("file"), F.col("_record").alias("record_no"), F.col("_corrupt").alias("raw_text"))


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns under dotted names; arrays as JSON text; true and false in capitals."""
    cells = []

    def walk(kind: T.DataType, path: list[str]) -> None:
        column = F.col(".".join(f"`{p}`" for p in path))
        name = ".".join(path)
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f.dataType, [*path, f.name])
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            cells.append(F.to_json(column).alias(name))
        elif isinstance(kind, T.BooleanType):
            cells.append(F.upper(column.cast("string")).alias(name))
        else:
            cells.append(column.cast("string").alias(name))

    for field in df.schema:
        walk(field.dataType, [field.name])
    return df.select(*cells)


def read_json(spark: SparkSession, path: str, records: str | None = None) -> DataFrame:
    """Records of JSON files, flattened: lines or an array; or, in an object, the array at
    ``records`` or the only array it has."""
    head = _head(spark, path).decode("utf-8", "replace").lstrip("﻿ \r\n\t")
    lines = head.startswith("{") and "\n{" in head
    df = spark.read.option("multiLine", not lines).json(path)
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if records is None and head.startswith("{") and not lines and arrays:
        if len(arrays) > 1:
            raise ValueError(f"several arrays, name one: {', '.join(arrays)}")
        records = arrays[0]
    if records:
        df = df.select(F.explode(records).alias("_r")).select("_r.*")
    return flattened(df)


_CELL = re.compile(r"([A-Z]+)[0-9]+")


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells) of the first sheet of a workbook."""
    book = zipfile.ZipFile(io.BytesIO(content))
    local = lambda e: e.tag.rpartition("}")[2]
    texts = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    shared = [texts(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = sorted((n for n in book.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    for _, row in ElementTree.iterparse(book.open(sheets[0])) if sheets else ():
        if local(row) != "row":
            continue
        cells: list[str | None] = []
        for c in row:
            at = 0
            for letter in (_CELL.match(c.get("r", "")) or [None, ""])[1]:
                at = at * 26 + ord(letter) - 64
            cells += [None] * (max(at, len(cells) + 1) - len(cells))
            value = next((e.text for e in c if local(e) == "v"), None)
            kind = c.get("t")
            if kind == "inlineStr":
                value = texts(c)
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "b" and value is not None:
                value = "TRUE" if value == "1" else "FALSE"
            cells[max(at, 1) - 1 if at else -1] = value
        yield int(row.get("r", 0)), cells
        row.clear()


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the first sheet of workbooks with one header: all columns text, with
    ``__file__`` and ``__row__``; rows with more cells than the header are rejected, missing
    cells at their end are null.  A workbook is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(file, n, cells) for n, cells in _sheet_rows(content)]
                yield pd.DataFrame(rows, columns=["file", "n", "cells"])

    sheet = cut(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, n long, cells array<string>"), "sheet")
    top = sheet.orderBy("n", "file").limit(1).collect()  # one row
    names = unique_headers(list(top[0]["cells"])) if top else []
    body = sheet.where(F.col("n") > (top[0]["n"] if top else 0)).where(F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    fits = F.size("cells") <= len(names)
    rows = body.where(fits).select(*[F.trim(F.get("cells", F.lit(k))).alias(n) for k, n in enumerate(names)], F.col("file").alias("__file__"), F.col("n").alias("__row__"))
    return rows, body.where(~fits).select("file", F.col("n").alias("record_no"), F.to_json("cells").alias("raw_text"))


def read_any(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a file by the ending of its name."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    none = lambda: spark.createDataFrame([], "file string, record_no long, raw_text string")
    if ending in ("json", "jsonl", "ndjson"):
        return read_json(spark, path), none()
    if ending in ("csv", "tsv", "txt"):
        return read_delimited(spark, path, "\t" if ending == "tsv" else None)
    if ending in ("xlsx", "xlsm"):
        return read_workbook(spark, path)
    if ending in ("parquet", "orc"):
        return spark.read.format(ending).load(path), none()
    raise ValueError(f"no reader for {path}")


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files without content, which the reader of bytes passes over."""
    fs, at = file_system(spark, path)
    files = fs.globStatus(at) or []
    listed = [s for top in files for s in (fs.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return spark.createDataFrame([(s.getPath().toString(), 0) for s in listed if s.isFile() and s.getLen() == 0], "path string, length long")


#: Files up to this size are hashed by the tasks, larger ones as a stream.
HASH_BYTES = 1 << 30


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, checksum) of the files below a path: the same bytes, the same file."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= HASH_BYTES).select("path", "length", F.sha2("content", 256).alias("checksum"))
    large = [(r["path"], r["length"], _stream_hash(spark, r["path"])) for r in files.where(F.col("length") > HASH_BYTES).select("path", "length").collect()]
    empty = _empty_files(spark, path).withColumn("checksum", F.sha2(F.lit(b""), 256))
    return small.unionByName(spark.createDataFrame(large, "path string, length long, checksum string")).unionByName(empty)


def _stream_hash(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delivered files as a source: rows carry ``__file__``, ``__row__`` and
    ``__id__``, a name-based uuid of both, so the same file gives the same ids again."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    rows, rejects = read_workbook(spark, path) if ending in ("xlsx", "xlsm") else read_delimited(spark, path, "\t" if ending == "tsv" else None, tagged=True)
    file = F.element_at(F.split("__file__", "/"), -1)
    return rows.withColumn("__id__", name_uuid(FILE_NAMESPACE, F.concat_ws("|", file, F.col("__row__").cast("string")))), rejects


def new_files(checksums: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content is not stored yet; of several alike the first by path."""
    first = checksums.groupBy("checksum").agg(F.min("path").alias("path"), F.first("length").alias("length"))
    return first.join(stored.select("checksum").distinct(), "checksum", "left_anti").select("path", "length", "checksum")


# What files of an ending begin with.
MAGIC = {"xlsx": "504B0304", "xlsm": "504B0304", "parquet": "50415231"}


def screened(spark: SparkSession, path: str, most_bytes: int = 1 << 30, endings: tuple[str, ...] = ("csv", "tsv", "txt", "json", "jsonl", "ndjson", "xlsx", "parquet")) -> DataFrame:
    """(path, length, verdict) of uploaded files: ``ok``, or why one is not read: ``empty``,
    ``too_large``, ``unknown_ending``, ``wrong_content`` (another format, or binary under a text
    ending)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content").unionByName(_empty_files(spark, path).withColumn("content", F.lit(b"")))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    head = F.hex(F.substring("content", 1, 512))
    magic = F.lit(False)
    for word, sign in MAGIC.items():
        magic = magic | ((ending == word) & ~head.startswith(sign))
    # A zero byte, at whole bytes, that no mark of 16-bit letters explains.
    binary = ~ending.isin(*MAGIC) & head.rlike(r"\A(?:[0-9A-F]{2})*?00") & ~head.rlike(r"\A(?:FFFE|FEFF)")
    verdict = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(~ending.isin(*endings), "unknown_ending").when(magic | binary, "wrong_content").otherwise("ok")
    return files.select("path", "length", verdict.alias("verdict"))
