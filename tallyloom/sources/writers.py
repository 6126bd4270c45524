"""Writing results: partitioned tables, packages with a manifest of checksums, archives."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import file_system
from tallyloom.sources.readers import file_checksums


def write_by_tenant(df: DataFrame, path: str, tenant: str, only: str | None = None) -> None:
    """Append rows below one folder a tenant; a row without tenant, or of another tenant than
    ``only``, stops the write before anything is committed."""
    bad = F.col(tenant).isNull() if only is None else ~F.col(tenant).eqNullSafe(F.lit(only))
    guarded = df.withColumn(tenant, F.when(bad, F.raise_error(F.lit("row without tenant" if only is None else "row of another tenant"))).otherwise(F.col(tenant)))
    guarded.write.mode("append").partitionBy(tenant).parquet(path)


def write_package(tables: dict[str, tuple[DataFrame, list[str], str]], path: str) -> DataFrame:
    """Write named tables, each ordered by its key, as CSV or JSON lines, and return the manifest
    (path, length, checksum).  ``tables``: name -> (table, key, ``csv`` or ``json``)."""
    manifests = []
    for name, (df, key, form) in tables.items():
        out = df.repartitionByRange(*[F.col(k) for k in key]).sortWithinPartitions(*key).write.mode("overwrite")
        (out.option("header", True) if form == "csv" else out).format(form).save(f"{path}/{name}")
        manifests.append(file_checksums(df.sparkSession, f"{path}/{name}/part-*"))
    manifest = manifests[0]
    for m in manifests[1:]:
        manifest = manifest.unionByName(m)
    return manifest


# The members of an audit package, as (name, form); tables are ordered by their first column.
PACKAGE = (("source-manifest", "csv"), ("matched-items", "csv"), ("exceptions", "csv"), ("approvals", "csv"), ("audit-events", "json"), ("evidence", "csv"))
SETTINGS = ("summary", "snapshot", "rule-config", "model-config")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_audit_package(tables: dict[str, DataFrame], settings: dict[str, object], path: str) -> DataFrame:
    """An audit package: the tables of ``PACKAGE`` and the settings of ``SETTINGS`` as JSON, each with
    its checksum in ``manifest.json``; returns the manifest.  A missing member is an error."""
    if missing := [n for n, _ in PACKAGE if n not in tables] + [n for n in SETTINGS if n not in settings]:
        raise ValueError(f"missing members: {', '.join(missing)}")
    spark = next(iter(tables.values())).sparkSession
    manifest = write_package({n: (tables[n], tables[n].columns[:1], form) for n, form in PACKAGE}, path)
    for name in SETTINGS:
        _write_text(spark, f"{path}/{name}.json", json.dumps(settings[name], sort_keys=True, default=str))
        manifest = manifest.unionByName(file_checksums(spark, f"{path}/{name}.json"))
    listed = [r.asDict() for r in manifest.orderBy("path").collect()]  # one row a file
    _write_text(spark, f"{path}/manifest.json", json.dumps(listed, sort_keys=True))
    return manifest


def zip_export(files: dict[str, str], archive: str) -> None:
    """Local files by name in one archive: sorted names and a fixed time, so the same content gives
    the same bytes.  Files are copied piece by piece."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for name in sorted(files):
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_DEFLATED
            with open(files[name], "rb") as source, out.open(entry, "w") as target:
                while piece := source.read(1 << 20):
                    target.write(piece)
