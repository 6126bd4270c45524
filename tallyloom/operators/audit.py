"""Hash chains, hashes of results and settings, sequence numbers.

A chain is sequential within its tenant by its nature, so a tenant is one task; but the
task streams through its sorted events and remembers one hash, however many there are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a row's hash that choose its bucket in ``result_hash``: 4096 buckets.
BUCKET_DIGITS = 3


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tenant, last = None, ""
    for batch in batches:
        names, heads, contents = (batch.column(n).to_pylist() for n in ("_tenant", "_head", "content_hash"))
        previous, links = [], []
        for name, head, content in zip(names, heads, contents, strict=True):
            if name != tenant:
                tenant, last = name, head or ""
            previous.append(last)
            last = hashlib.sha256((last + content).encode()).hexdigest()
            links.append(last)
        kept = [n for n in batch.schema.names if n not in ("_tenant", "_head")]
        arrays = [batch.column(n) for n in kept] + [pa.array(previous, pa.string()), pa.array(links, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "previous_hash", "link_hash"])


def sealed(events: DataFrame, by: str, order: str, payload: Column, heads: DataFrame | None = None) -> DataFrame:
    """Events with ``content_hash``, ``previous_hash`` and ``link_hash``: each link takes in the link
    before it, so one forged event breaks all after it.

    ``heads`` (by, link_hash) are the last links of chains that go on; others begin with an
    empty one.  Ties of ``order`` follow the content.  Events with a null tenant are one chain.
    """
    own = events.withColumn("content_hash", F.sha2(payload, 256)).withColumn("_tenant", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("~")))
    if heads is None:
        own = own.withColumn("_head", F.lit(None).cast("string"))
    else:
        own = own.join(heads.select(F.concat(F.lit("="), F.col(by).cast("string")).alias("_tenant"), F.col("link_hash").alias("_head")), "_tenant", "left")
    kept = [c for c in own.columns if c not in ("_tenant", "_head")]
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in kept) + ", previous_hash string, link_hash string"
    return own.repartition("_tenant").sortWithinPartitions("_tenant", order, "content_hash").select("_tenant", "_head", *kept).mapInArrow(_fold, schema)


def heads_of(chain: DataFrame, by: str, order: str) -> DataFrame:
    """(by, link_hash): where each chain goes on."""
    return chain.groupBy(by).agg(F.max_by("link_hash", order).alias("link_hash"))


def broken_links(events: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """The events of stored chains whose link is not the one that the contents up to them give:
    a forged event and all after it."""
    stored = [c for c in ("content_hash", "previous_hash") if c in events.columns]
    fresh = sealed(events.drop(*stored).withColumnRenamed("link_hash", "_stored"), by, order, payload)
    broken = fresh.where(~F.col("link_hash").eqNullSafe(F.col("_stored")))
    return broken.drop("content_hash", "previous_hash", "link_hash").withColumnRenamed("_stored", "link_hash")


def first_broken(events: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """(by, first_bad): where each broken chain diverges.

    Each stored link is held against its stored neighbour and its content only, so all are
    checked in parallel.
    """
    before = F.coalesce(F.lag("link_hash").over(Window.partitionBy(by).orderBy(order, "content_hash")), F.lit(""))
    right = (F.col("previous_hash") == before) & (F.col("link_hash") == F.sha2(F.concat(before, F.sha2(payload, 256)), 256))
    return events.withColumn("_right", F.coalesce(right, F.lit(False))).where("not _right").groupBy(by).agg(F.min(order).alias("first_bad"))


def numbered(batch: DataFrame, by: str, order: str, heads: DataFrame | None = None) -> DataFrame:
    """The batch with ``sequence``: gapless from the last number of each tenant, (by, last) in
    ``heads``, on."""
    own = batch.withColumn("sequence", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long"))
    if heads is None:
        return own
    last = heads.select(F.col(by).alias("_by"), F.col("last").alias("_last"))
    return own.join(last, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("sequence", F.col("sequence") + F.coalesce("_last", F.lit(0))).drop("_by", "_last")


def result_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_count, result_hash): one SHA-256 of a table, whatever the order of its rows.

    Rows are hashed, sorted within buckets by the first digits of their hash, each bucket is
    hashed, and at last the list of buckets; null and empty are kept apart.  A bucket holds
    a 4096th of the row hashes.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    rows = df.select(F.sha2(F.concat_ws("\u001f", *cells), 256).alias("h"))
    buckets = rows.groupBy(F.substring("h", 1, BUCKET_DIGITS).alias("k")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("b"))
    whole = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.sort_array(F.collect_list(F.struct("k", "b"))).alias("all"))
    return whole.select("row_count", F.sha2(F.array_join(F.transform("all", lambda x: x["b"]), ""), 256).alias("result_hash"))


def settings_hash(settings: object) -> str:
    """SHA-256 of settings or a snapshot of ids as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def replayed(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(same, first_hash, second_hash): whether two runs gave the same rows."""
    x, y = (result_hash(df, columns).select(F.col("result_hash").alias(n)) for df, n in ((first, "first_hash"), (second, "second_hash")))
    return x.crossJoin(F.broadcast(y)).select((F.col("first_hash") == F.col("second_hash")).alias("same"), "first_hash", "second_hash")  # one row each


def canonical_checksum(fields: dict[str, Column]) -> Column:
    """SHA-256 of a row as compact JSON with sorted keys, null kept as null, text escaped."""
    names = sorted(fields)
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"}), 256)
