"""Differences between two copies of a table, field by field.

Both copies are cut into hash buckets of the key and cogrouped as Arrow tables.
Inside a bucket the keys of the copy are sorted once, the keys of the source are
found by binary search, and each column is compared by a null-aware mask; the
masks are then emitted as cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shuffle_width

#: Rows that one bucket is meant to hold.
ROWS_PER_BUCKET = 40_000


def _compare(columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def unique_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and the row that stands for each."""
        keys = table["_key"].combine_chunks().to_numpy(zero_copy_only=False).astype(object)
        return np.unique(keys, return_index=True) if len(keys) else (keys, np.array([], dtype=np.int64))

    def compare(source: pa.Table, copy: pa.Table) -> pa.Table:
        left_keys, left_rows = unique_keys(source)
        right_keys, right_rows = unique_keys(copy)
        at = np.searchsorted(right_keys, left_keys) if len(right_keys) else np.zeros(len(left_keys), dtype=np.int64)
        inside = at < len(right_keys)
        found = np.zeros(len(left_keys), dtype=bool)
        found[inside] = right_keys[at[inside]] == left_keys[inside]
        only_right = np.ones(len(right_keys), dtype=bool)
        only_right[at[found]] = False

        ids = [pa.array(left_keys[~found], pa.string()), pa.array(right_keys[only_right], pa.string())]
        words = [np.full((~found).sum(), "missing_in_copy", object), np.full(only_right.sum(), "missing_in_source", object)]
        a = source.take(pa.array(left_rows[found])).combine_chunks()
        b = copy.take(pa.array(right_rows[at[found]])).combine_chunks()
        olds, news = [pa.nulls(len(ids[0]), pa.string()), pa.nulls(len(ids[1]), pa.string())], [pa.nulls(len(ids[0]), pa.string()), pa.nulls(len(ids[1]), pa.string())]
        for name in columns:
            x, y = a[name], b[name]
            same = pc.fill_null(pc.equal(x, y), False)
            differ = pc.and_not(pc.invert(same), pc.and_(pc.is_null(x), pc.is_null(y)))
            ids.append(a["_key"].filter(differ).cast(pa.string()))
            words.append(np.full(pc.sum(differ).as_py() or 0, name, object))
            olds.append(x.filter(differ).cast(pa.string()))
            news.append(y.filter(differ).cast(pa.string()))
        flat = lambda parts: pa.chunked_array([c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])], pa.string())
        return pa.table(
            {"id": flat(ids), "finding": pa.array(np.concatenate(words), pa.string()), "source_value": flat(olds), "copy_value": flat(news)}
        )

    return compare


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows that are equal to another one of the batch."""
    for batch in batches:
        keys = batch.column(0).dictionary_encode()
        if len(keys.dictionary) < len(keys):
            table = pa.Table.from_batches([batch])
            table = table.group_by(table.column_names).aggregate([]).select(batch.schema.names)
            yield from table.combine_chunks().cast(batch.schema).to_batches()
        else:
            yield batch


def copy_differences(source: DataFrame, copy: DataFrame, key: str, columns: list[str], rows_hint: int | None = None) -> DataFrame:
    """(id, finding, source_value, copy_value) for each missing row and differing cell.

    ``finding`` is ``missing_in_copy``, ``missing_in_source`` or the column that
    differs.  Keys are compared as stored; repeated rows of either side count
    once, and identical repeats are folded batch by batch before the one shuffle, so that a
    key that holds a third of all rows reaches its bucket as a few rows.  Rows
    with a null key identify nothing and are left out.  Null differs from any
    value and not from null.  Columns outside ``columns`` are ignored; an empty
    table makes every row of the other side missing.

    The number of buckets follows the rows of the larger side (``rows_hint`` if known, else
    counts, which tables answer from their metadata), so a bucket stays at
    ``ROWS_PER_BUCKET`` whatever the size.
    """
    spark = source.sparkSession
    rows = rows_hint if rows_hint is not None else max(source.count(), copy.count())
    buckets = max(shuffle_width(spark), -(-rows // ROWS_PER_BUCKET))

    def bucketed(df: DataFrame) -> DataFrame:
        picked = df.select(F.col(key).cast("string").alias("_key"), *[F.col(f"`{c}`") for c in columns]).where("_key is not null")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
        folded = picked.mapInArrow(_folded, schema)
        return folded.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))

    left, right = bucketed(source), bucketed(copy)
    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(
        _compare(columns), "id string, finding string, source_value string, copy_value string"
    )
