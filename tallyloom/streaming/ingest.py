"""Incremental ingest with Structured Streaming: new rows only, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.values import row_checksum
from tallyloom.session import file_system, is_file, scratch_path


def ingest_new(spark: SparkSession, path: str, columns: list[str], store: str) -> DataFrame:
    """Take the files of ``path`` that were not taken before into ``store``; its distinct rows.

    ``store`` is a folder that lasts: its ``checkpoint`` remembers which files were read, so
    another call goes on where the last one stopped; its ``rows`` hold each row once
    with a checksum, against which every micro-batch is held.  A batch that is repeated
    after a failure finds its rows stored and adds none.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = is_file(spark, path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    source = source.option("pathGlobFilter", name) if single else source
    rows = source.parquet(folder if single else path).select(*columns).withColumn("_checksum", row_checksum(*[F.col(c) for c in columns]))
    target, kept = f"{store}/rows", rows.schema

    def store_batch(batch: DataFrame, _number: int) -> None:
        new_rows(batch, stored_rows(batch.sparkSession, target, kept), ["_checksum"]).write.mode("append").parquet(target)

    job = rows.writeStream.foreachBatch(store_batch).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return stored_rows(spark, target, kept).drop("_checksum")


def stored_rows(spark: SparkSession, target: str, schema) -> DataFrame:  # noqa: ANN001
    """The table at ``target``, empty if there is none yet."""
    fs, at = file_system(spark, target)
    return spark.read.schema(schema).parquet(target) if fs.exists(at) else spark.createDataFrame([], schema)


def deduplicated_stream(spark: SparkSession, path: str, columns: list[str], store: str | None = None) -> DataFrame:
    """The distinct rows of parquet files, ingested as a stream; without ``store`` everything is
    taken anew into a scratch folder."""
    return ingest_new(spark, path, columns, store or scratch_path(spark, "stream"))


def new_rows(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a batch whose key is not stored yet, each once."""
    return batch.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti")
