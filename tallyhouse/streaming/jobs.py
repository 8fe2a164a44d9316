"""The same jobs over streams of files: batches in, facts, ledgers and changes out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tallyhouse.operators import history, ingest
from tallyhouse.sources.generations import Store
from tallyhouse.sources.payloads import delete_folder


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all machines share: ``spark.checkpoint.dir``. On one machine it may be unset, and the warehouse serves; a cluster has to name it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/{name}_{uuid.uuid4().hex}"


def table_writer(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a step's rows below a new shared folder and reads them back, so that steps after it don't compute it again."""
    folder = work_folder(spark, name)

    def write(rows: DataFrame, label: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{label}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{label}")

    return write


def append_new(keys: list[str], target: str, by: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends rows whose keys the table at ``target`` doesn't hold; replaying a batch adds nothing.

    The table is partitioned by ``by``, one of the keys or a column that they decide, and only the partitions that the batch
    touches are read, so the cost of a batch doesn't grow with the table as long as what is sent together lies in few of them.
    A batch is computed once, and one shuffle finds its repeats and what is held.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.withColumn("_held", F.lit(False))
            touched = [r[0] for r in batch.select(by).distinct().collect()]  # the partitions of the files of one batch
            try:
                held = batch.sparkSession.read.schema(batch.schema).parquet(target)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":  # before the first batch there is no table
                    raise
            else:
                there = F.col(by).isin([x for x in touched if x is not None])
                held = held.where(there | F.col(by).isNull() if None in touched else there)
                rows = rows.unionByName(held.withColumn("_held", F.lit(True)))
            rest = [F.any_value(c).alias(c) for c in batch.columns if c not in keys]
            fresh = rows.groupBy(*keys).agg(F.max("_held").alias("_held"), *rest).where("not _held")
            fresh.select(*batch.columns).write.mode("append").partitionBy(by).parquet(target, compression="zstd")
        finally:
            batch.unpersist()

    return write


class Following(NamedTuple):
    """A stream whose micro-batches go on from what the one before has left.

    ``step`` takes the rows held and a batch, and gives rows of ``schema`` with ``kind``: ``change`` is what the batch gives,
    ``open`` is what is held from then on.
    """

    stream: DataFrame
    step: Callable[[DataFrame, DataFrame], DataFrame]
    schema: str


def stored(stream: DataFrame | Following, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through to Parquet files: a folder for each micro-batch, so a batch that is replayed replaces itself.

    What a ``Following`` stream holds is written with each batch, in the same step, and the batch before is where the next one
    reads it: a batch replayed finds what it found at first. Only the last two are kept.
    """
    following = isinstance(stream, Following)
    source = stream.stream if following else stream
    fields = T.StructType.fromDDL(stream.schema).fields if following else source.schema.fields
    kinds = [T.StructField("kind", T.StringType())] if following else []

    def write(batch: DataFrame, number: int) -> None:
        if following:
            held = T.StructType([*fields, *kinds])
            read = batch.sparkSession.read.schema(held)
            held = read.parquet(f"{folder}/out/batch={number - 1}") if number else batch.sparkSession.createDataFrame([], held)
            stream.step(held.where("kind = 'open'").drop("kind"), batch).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/out/batch={number}")
            if number > 1:
                delete_folder(batch.sparkSession, f"{folder}/out/batch={number - 2}/kind=open")
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    started = source.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    started.trigger(availableNow=True).start().awaitTermination()
    out = source.sparkSession.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType()), *kinds])).parquet(f"{folder}/out")
    return out.where("kind = 'change'").drop("kind") if following else out


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key, from the updates that batches have stored."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def once_each(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Rows without repeats of their keys that come within a time of each other; the state is bounded by it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def sightings_ledger(stream: DataFrame) -> DataFrame:
    """The ledger of a stream of sightings, one running row for each (dataset, id)."""
    return stream.groupBy("dataset_key", "external_id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("sightings"))


def drained(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str) -> None:
    """All that is there now goes through ``write``; the checkpoint below ``folder`` remembers what has been read."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def ingest_into(store: Store, name: str, prices: Callable[[DataFrame], DataFrame], order: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A sink that commits each micro-batch as one run against the open prices; a batch that is replayed finds itself committed."""

    def write(batch: DataFrame, number: int) -> None:
        ingest.ingested(store, f"{name}-{number}", prices(batch), order=order)

    return write


def periods_into(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """A sink of observations that closes and opens price periods: table ``period`` has the closed ones, ``open_period`` the open one of each offer as each batch left it, ``late`` the rows that came too late.

    The open periods are a table of the store, so they are committed together with what the batch closed, and a replayed batch
    changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        run = f"{name}-{number}"
        if store.generation_of(run) is not None:
            return
        found = history.periods_after(store.read("open_period"), batch)
        store.commit(run, split=found.withColumn("generation", F.lit(store.current()[0] + 1).cast("long")))

    return write


CHANGE = "offer_id long, observed_at timestamp, price double, currency string, reason string"


def changes_after(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The price events of a batch (``kind`` change) and the open price of every offer after it (``kind`` open).

    Held and new rows are sorted together by offer, and the held one goes before new ones of its time: whatever comes before it
    is late. One shuffle and one sort serve all of it, and an offer with very many rows spills to disk.
    """
    columns = ["offer_id", "observed_at", "price", "currency"]
    rows = batch.select(*columns, F.lit(False).alias("held")).unionByName(held.select(*columns, F.lit(True).alias("held")))
    own = Window.partitionBy("offer_id").orderBy("observed_at", F.col("held").desc(), "price", "currency")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.lag(c).over(own)
    late = F.max("held").over(whole) & ~F.max("held").over(so_far)
    differs = lambda c: ~F.col(c).eqNullSafe(before(c))
    reason = F.when(late, "late").when(before("held").isNull(), "first_seen").when(differs("currency"), "currency_change").when(differs("price"), "price_change")
    marked = rows.select(*columns, F.when(~F.col("held"), reason).alias("reason"), F.lead("held").over(own).isNull().alias("last"))
    kinds = F.array_compact(F.array(F.when(F.col("reason").isNotNull(), "change"), F.when(F.col("last"), "open")))
    return marked.select(*columns, "reason", F.explode(kinds).alias("kind"))


def price_changes(stream: DataFrame) -> Following:
    """An event whenever an offer's price or currency differs from its open one. Rows older than the open one are reported late and change nothing.

    What is held is one row for each offer, its open price, and stays: without it a later price couldn't be told from a change.
    A batch's rows of one offer are sorted together, so files should be cut by time. Through ``stored``.
    """
    return Following(stream, changes_after, CHANGE)
