"""Deduplicating new batches against everything already accepted.

A record is treated like a document.  The hash of its identity is its *content hash*;
the hash of clock with amount and currency (without a clock: reference and party with
those) is the hash of its *paragraphs*, the parts that survive editing.  Hashes live in
one table bucketed by hash.  A delivery is appended to it and then held against it
bucket by bucket, so neither the history nor the delivery moves again; only of rows that
share a hash the parts are read, and what covers what is decided on them exactly.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import broadcast_if, cut, remove, scratch, scratch_path, shuffle_width

MINUTE_US = 60_000_000
#: A redelivered row may be re-booked by up to a day, and by less than an hour on top.
SLOT_US = 25 * 60 * MINUTE_US
#: Consecutive batches are admitted together until they hold so many rows.
ROWS_PER_DELIVERY = 1_000_000
#: Rows that share a hash are sought by a broadcast of their ids up to so many, else by a shuffle.
BROADCAST_IDS = 1_000_000
#: After so many deliveries the files of each bucket are written together again.
COMPACT_EVERY = 16


def fold(text: Column) -> Column:
    """Lower case, letters and digits only; null and empty text alike become ''."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def identity_code(identity: Column) -> Column:
    """The digits of an identity, without prefix, grouping, zeros in front and resend suffix;
    null without digits.

    The suffix is what follows the first digits, letters being no grouping (``-R``,
    ``_resend``), or one or two digits behind a dash or slash and at least six digits.
    """
    usual = identity.rlike(r"\A[A-Za-z]{0,4}[^A-Za-z0-9]?[0-9]{10}\z")
    body = F.regexp_extract(F.regexp_replace(identity, r"(?<=[0-9]{6})[-/][0-9]{1,2}\z", ""), r"[0-9](?:[^A-Za-z0-9]*[0-9])*", 0)
    digits = F.when(usual, F.right(identity, F.lit(10))).otherwise(F.regexp_replace(body, "[^0-9]", ""))
    return F.nullif(F.ltrim(digits, F.lit("0")), F.lit(""))


def record_parts(rows: DataFrame, text: str, within: str | None = None) -> DataFrame:
    """The comparable parts of delivered rows; texts are still as written.

    Rows are compared only if they agree in the column ``within``, if one is named.
    """
    return rows.where("row_id is not null").select(
        F.col("row_id").cast("long").alias("row_id"),
        (F.col(within).cast("string") if within else F.lit("")).alias("within"),
        identity_code(F.col("id")).alias("code"),
        F.unix_micros(F.col("booked_at").cast("timestamp")).alias("micros"),
        F.col("amount").cast("decimal(24,8)").alias("amount"),
        F.upper(F.trim("currency")).alias("currency"),
        F.col(text).alias("raw_text"),
        F.col("reference").alias("raw_ref"),
        F.col("counterparty").alias("raw_party"),
    )


def _clock() -> Column:
    """Seconds and fractions of the booking time: they survive when whole minutes or
    the day are corrected."""
    return F.pmod("micros", F.lit(MINUTE_US))


def hash_rows(parts: DataFrame) -> DataFrame:
    """(h, row_id): the content hash and the paragraph hash of each record."""
    value = [F.col("within"), F.col("amount"), F.col("currency")]
    # Without a clock reference and party stand in, folded for no other rows; the text may
    # have been cut short and is left to the exact check.
    plain = F.xxhash64(F.lit("plain"), fold(F.col("raw_ref")), fold(F.col("raw_party")), *value)
    timed = F.when(F.col("micros").isNotNull(), F.xxhash64(F.lit("clock"), _clock(), *value)).otherwise(plain)
    coded = F.when(F.col("code").isNotNull(), F.xxhash64(F.lit("code"), "within", "code"))
    return parts.select("row_id", coded.alias("coded"), timed.alias("timed")).unpivot("row_id", ["coded", "timed"], "kind", "h").where("h is not null").select("h", "row_id")


class HashHistory:
    """The hashes of all accepted rows in a table bucketed by hash, and the links found
    between those rows."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or shuffle_width(spark)
        self.deliveries = 0
        self.links: list[DataFrame] = []
        self._fresh_table()

    def _fresh_table(self) -> None:
        self.table = f"hash_history_{uuid.uuid4().hex[:12]}"
        self.path = scratch_path(self.spark, self.table, lasting=True)

    def _append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "h").write.format("parquet").mode("append").bucketBy(self.buckets, "h").option("path", self.path).saveAsTable(self.table)

    def append(self, hashed: DataFrame) -> None:
        """Add (h, row_id) rows; each bucket gets one file, and now and then its
        files are written together."""
        self.deliveries += 1
        self._append(hashed.withColumn("delivery", F.lit(self.deliveries)))
        if self.deliveries % COMPACT_EVERY == 0:
            old, at = self.table, self.path
            self._fresh_table()
            self._append(self.spark.table(old))
            self.spark.sql(f"drop table {old}")
            remove(self.spark, at)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def sharing(self) -> DataFrame:
        """(row_id) of the rows, old and new, that share a hash with a row of the last
        delivery: an aggregate and a semi-join inside each bucket."""
        counted = self.rows().groupBy("h").agg(F.count("*").alias("n"), F.max("delivery").alias("last"))
        shared = counted.where((F.col("n") > 1) & (F.col("last") == self.deliveries)).select("h")
        return self.rows().join(shared.hint("shuffle_hash"), "h", "left_semi").select("row_id").distinct()

    def drop(self) -> None:
        """Remove the hashes; links found so far stay."""
        self.spark.sql(f"drop table if exists {self.table}")
        remove(self.spark, self.path)


def _text_keys(asked: DataFrame) -> DataFrame:
    """(row_id, k1, k2): rows of (row_id, k1, k2, text) get one key if under the given key
    their texts are equal, or one text begins the other.

    A text stands under itself whole, and under each of its beginnings that is the whole
    text of another row.
    """
    under = lambda text: (F.xxhash64("k1", text).alias("k1"), F.xxhash64(F.lit("text"), text, "k2").alias("k2"))
    whole = asked.select("row_id", *under(F.col("text")))
    long = F.length("text")
    # Only keys with texts of several lengths go on; each row has as many beginnings.
    lengths = asked.groupBy("k1", "k2").agg(F.collect_set(long).alias("lengths")).where(F.size("lengths") > 1)
    begun = asked.join(lengths, ["k1", "k2"]).withColumn("n", F.explode(F.filter("lengths", lambda n: n < long)))
    begun = begun.select("row_id", *under(F.col("text").substr(F.lit(1), F.col("n"))))
    return whole.unionByName(begun.join(whole.select("k1", "k2"), ["k1", "k2"], "left_semi").select("row_id", "k1", "k2"))


def _evidence(parts: DataFrame) -> DataFrame:
    """(row_id, k1, k2): keys under which two rows deliver one record, as 128 bits.

    Same code with the same amount; or same clock, amount and currency in a common
    time slot, covered by one of text, reference and counterparty; or, without a
    clock, everything agreeing.  Each row stands in its own slot and the next, so
    rows nearer than one slot always meet.  Texts agree if one begins the other, as
    redeliveries cut them short; without a clock only if there is a reference, or all
    digits stand in both, as one beginning may be of many payments.
    """
    # Amounts are hashed once; both halves of a key build on it.
    folded = [fold(F.col(f"raw_{n}")).alias(n) for n in ("text", "ref", "party")]
    value = [F.xxhash64("within", "amount", "currency").alias("value"), F.xxhash64("currency", "amount", "within", F.lit(2)).alias("value2")]
    parts = parts.select("row_id", "code", *value, *folded, _clock().alias("clock"), F.floor(F.col("micros") / F.lit(SLOT_US)).cast("long").alias("slot"))
    word = lambda kind, *cs: F.struct(F.xxhash64(F.lit(kind), *cs, "value").alias("k1"), F.xxhash64("value2", *cs, F.lit(kind)).alias("k2"))
    timed = F.col("clock").isNotNull()
    bare = (F.col("text") == "") & (F.col("ref") == "") & (F.col("party") == "")
    keys, texts = [], []
    for step in (0, 1):
        at = [F.col("clock"), F.col("slot") + step]
        for part in ("ref", "party"):
            keys.append(F.when(timed & (F.col(part) != ""), word(part, *at, F.lit(part), F.col(part))))
        keys.append(F.when(timed & bare, word("bare", *at)))
        texts.append(F.when(timed, word("text", *at)))
    keys.append(F.when(F.col("code").isNotNull(), word("code", F.lit("code"), F.col("code"))))
    keys.append(F.when(~timed, word("plain", F.lit("plain"), F.col("text"), F.col("ref"), F.col("party"))))
    digits = F.regexp_replace("text", r"\P{N}+", "")
    texts.append(F.when(~timed & (F.col("ref") != ""), word("plain-ref", F.col("ref"), F.col("party"))))
    texts.append(F.when(~timed & (F.col("ref") == "") & (digits != ""), word("plain-digits", digits, F.col("party"))))

    def listed(df: DataFrame, columns: list[Column], *more: str) -> DataFrame:
        names = [f"_{n}" for n in range(len(columns))]
        keyed = df.select("row_id", *more, *[c.alias(n) for n, c in zip(names, columns, strict=True)]).unpivot(["row_id", *more], names, "kind", "k")
        return keyed.where("k is not null").select("row_id", "k.k1", "k.k2", *more)

    asked = cut(listed(parts.where("text <> ''"), texts, "text"), "texts")
    return listed(parts, keys).unionByName(_text_keys(asked))


def linked_rows(parts: DataFrame) -> DataFrame:
    """(row_id, first): each row and the smallest row under one of its keys.

    Rows are folded per key before they move, so a key that a third of all rows share is
    one aggregate, never a group.
    """
    evidence = cut(_evidence(parts), "keys")
    shared = evidence.groupBy("k1", "k2").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last")).where("first < last").drop("last")
    return evidence.join(shared, ["k1", "k2"]).where("row_id > first").select("row_id", "first").distinct()


def first_of_record(links: DataFrame) -> DataFrame:
    """(row_id, first): the smallest row reachable from each row over links (row_id, first)
    with first < row_id.

    Each round hangs the neighbours of a row on the smallest of them, and so doubles the
    reach; rounds end when every row has one neighbour that has none below it.
    """
    links = cut(links, "links")
    while True:
        least = links.groupBy("row_id").agg(F.min("first").alias("least"))
        below = least.select(F.col("row_id").alias("least"), F.col("least").alias("root"))
        rooted = cut(least.join(below, "least", "left").select("row_id", "least", F.coalesce("root", "least").alias("root")), "rooted")
        # Neighbours that are not the least one have to reach it too.
        rest = links.join(rooted.select("row_id", "least", "root"), "row_id").where("first > least")
        if rest.isEmpty() and rooted.where("root < least").isEmpty():
            return rooted.select("row_id", F.col("least").alias("first"))
        links = cut(rooted.select("row_id", F.col("root").alias("first")).unionByName(rest.select(F.col("first").alias("row_id"), F.col("root").alias("first"))).distinct(), "links")


def admit_batch(history: HashHistory, accepted: DataFrame, batch: DataFrame, text: str, within: str | None = None) -> DataFrame:
    """Append the hashes of a batch to the history and check it: (row_id, first) links between
    its rows and with accepted ones.

    ``accepted`` is the stored table of rows, as loaded, of earlier batches; the batch
    may be in it already.  Only the batch is hashed and moved; the history is scanned in
    place, bucket by bucket, and of the accepted rows those are taken that share a
    hash.  The links also stay with the history: ``repeats`` follows chains of them
    through all batches.
    """
    with scratch(history.spark) as keep:
        history.append(hash_rows(record_parts(batch, text, within)))
        hot = broadcast_if(cut(history.sharing(), "hot"), BROADCAST_IDS)
        # Both are read apart and never made distinct: a row in both links to itself only.
        both = accepted.unionByName(batch).join(hot, "row_id", "left_semi")
        found = keep(linked_rows(cut(record_parts(both, text, within), "suspects")), "links")
    history.links.append(found)
    return found


def repeats(history: HashHistory) -> DataFrame:
    """(first_row_id, repeat_row_id) over everything admitted so far.

    A row that ties two records together, each accepted as new before, makes them one.
    """
    if not history.links:
        return history.spark.createDataFrame([], "first_row_id long, repeat_row_id long")
    with scratch(history.spark) as keep:
        found = keep(first_of_record(reduce(DataFrame.unionByName, history.links)), "repeats")
    return found.select(F.col("first").alias("first_row_id"), F.col("row_id").alias("repeat_row_id"))


def deliveries(rows: DataFrame, batch: str, least: int = ROWS_PER_DELIVERY) -> list[tuple[int, int]]:
    """(first, last) batch numbers of each delivery: consecutive batches with ``least`` rows
    together.  Only the sizes of batches come to the driver, one number each."""
    out, begin, held = [], None, 0
    for number, n in rows.groupBy(batch).count().where(F.col(batch).isNotNull()).orderBy(batch).collect():
        begin, held, last = number if begin is None else begin, held + n, number
        if held >= least:
            out.append((begin, last))
            begin, held = None, 0
    return [*out, (begin, last)] if begin is not None else out


def repeated_rows(rows: DataFrame, text: str, within: str | None = None, batch: str | None = "batch_no", least: int = ROWS_PER_DELIVERY) -> DataFrame:
    """(first_row_id, repeat_row_id) for each row that repeats an accepted record: the
    batches are admitted one after the other.

    ``rows`` needs row_id, id, booked_at, amount, currency, reference, counterparty,
    the column named ``text`` and that named ``batch`` (null: everything is one batch);
    other columns are ignored.  Rows with a null ``row_id`` are left out; rows
    with a null batch come last, as one batch.  Nulls in other columns never count as
    agreement, save that rows without clock must agree in all folded parts (null and
    empty text being one; a text cut short agrees under a reference, or if it kept all
    digits).  Rows delivered letter for letter again, in the same batch or later, are
    repeats.  An empty table gives an empty result.  With ``within``, several tables whose
    row ids differ are handled at once, each on its own.
    """
    history = HashHistory(rows.sparkSession)
    rows = rows.select("row_id", "id", "booked_at", "amount", "currency", "reference", "counterparty", text, *([within] if within else []), *([batch] if batch else []))
    spans = deliveries(rows, batch, least) if batch else []
    steps = [(F.col(batch) < lo, F.col(batch).between(lo, hi)) for lo, hi in spans]
    if batch and rows.where(F.col(batch).isNull()).limit(1).count():
        steps.append((F.col(batch).isNotNull(), F.col(batch).isNull()))
    if len(steps) < 2:  # one delivery holds everything
        steps = [(F.lit(False), F.lit(True))]
    for before, now in steps:
        admit_batch(history, rows.where(before), rows.where(now), text, within)
    history.drop()
    return repeats(history)
