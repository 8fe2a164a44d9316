"""Which observations a retention policy keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.operators import history
from tallyhouse.operators.history import in_order, week_of
from tallyhouse.sources.generations import Store, compare

POLICIES = ("keep_all", "daily", "weekly", "archive_only")


def retained(obs: DataFrame, policies: dict[int, str], default: str, before) -> DataFrame:
    """The observations that stay: protected ones, recent ones, and by the source's policy the last of each day or week.

    Sources with ``keep_all`` keep everything, with ``archive_only`` nothing beyond protected and recent rows. One shuffle by
    offer serves the bounds and the buckets: all conditions are windows over the same key, and rows are never multiplied.
    """
    policy: Column = F.lit(default)
    for source, name in policies.items():
        policy = F.when(F.col("source_id") == source, name).otherwise(policy)
    old = F.col("business_date") < F.lit(before).cast("date")
    week = F.concat_ws("-", F.year("business_date"), F.lpad(week_of("business_date").cast("string"), 2, "0"))
    bucket = F.when(policy == "daily", F.col("business_date").cast("string")).when(policy == "weekly", week)
    own = Window.partitionBy("offer_id")
    marked = obs.withColumn("_old", old).withColumn("_policy", policy).withColumn("_bucket", bucket)
    last = F.row_number().over(Window.partitionBy("offer_id", "_old", "_bucket").orderBy(in_order().desc())) == 1
    kept = ~F.col("_old") | (F.col("_policy") == "keep_all") | (F.col("_bucket").isNotNull() & F.col("_last"))
    for c, f in (("business_date", F.min), ("business_date", F.max), ("price", F.min), ("price", F.max)):
        kept = kept | (F.col(c) == F.col(f"_{f.__name__}_{c}"))
    for c, f in (("business_date", F.min), ("business_date", F.max), ("price", F.min), ("price", F.max)):
        marked = marked.withColumn(f"_{f.__name__}_{c}", f(c).over(own))
    return marked.withColumn("_last", last).where(kept).select(*obs.columns)


def report(obs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows before, kept and dropped of each source."""
    counts = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    return counts(obs, "before").join(counts(kept, "kept"), "source_id", "left").select("source_id", "before", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("before") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def pinned(pins: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pin and whether the observation that it names is there: 'kept' or 'stale'."""
    rows = pins.join(obs.select(*keys, F.lit(True).alias("_there")).distinct(), keys, "left")
    return rows.select(*keys, F.when(F.col("_there"), "kept").otherwise("stale").alias("pin"))


def missing_from(facts: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Protected observations (first, latest, lowest, highest of each offer) that aren't among the kept ones."""
    return history.protected(facts).select(*keys).distinct().join(kept.select(*keys), keys, "left_anti")


def verification(before: dict[str, DataFrame], after: dict[str, DataFrame], facts: str, keys: list[str]) -> DataFrame:
    """entity, rows_before, rows_after, missing, strangers, verdict for each table.

    The facts may lose rows, but no protected one (``missing``) and no row may come or change (``strangers``); what is protected
    is derived anew from the facts before, not from what chose the rows. Every other table has to be carried whole, by number
    and digest. Rows meet by 128 bits of hash, so whole ones aren't shuffled.
    """
    columns = sorted(before[facts].columns)
    whole = F.struct(*columns, *[F.isnull(c) for c in columns])  # a hash passes over nulls
    signed = [rows[facts].select(*[F.xxhash64(F.lit(seed), whole).alias(f"_{seed}") for seed in "ab"], F.lit(n).alias("_n")) for rows, n in ((before, -1), (after, 1))]
    more = signed[0].unionByName(signed[1]).groupBy("_a", "_b").agg(F.sum("_n").alias("_n")).where("_n > 0")  # equal rows cancel out
    strangers = more.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("strangers"))
    missing = missing_from(before[facts], after[facts], keys).agg(F.count("*").alias("missing"))
    rows = compare(before, after)
    lost = rows.join(missing.join(strangers))  # one row
    own = F.col("entity") == facts
    verdict = F.when(own & (F.col("missing") > 0), "protected rows lost").when(own & (F.col("strangers") > 0), "strange rows").when(~own & ~F.col("same"), "not carried whole").otherwise("kept")
    number = lambda c: F.when(own, F.col(c)).otherwise(0).cast("long").alias(c)
    return lost.select("entity", "rows_before", "rows_after", number("missing"), number("strangers"), verdict.alias("verdict"))


def compacted(store: Store, run_ref: str, facts: str, keys: list[str], policies: dict[int, str], default: str, before) -> DataFrame:
    """A retention run: the kept facts are written as a new generation, checked, and put in force with all other tables as they were.

    Gives the verification of the generation against the one before it, and leaves that in force if anything is wrong. Done
    again under the same reference it changes nothing and gives the same rows.
    """
    done = store.generation_of(run_ref)
    number = store.current()[0] if done is None else done - 1
    old = {name: store.read(name, number) for name in store.schemas}
    if done is not None:
        return verification(old, {name: store.read(name, number + 1) for name in store.schemas}, facts, keys)
    kept, told = retained(old[facts], policies, default, before), []

    def check(read) -> list[str]:
        rows = verification(old, {name: read(name) for name in store.schemas}, facts, keys)
        told.append((rows.collect(), rows.schema))  # a row for each table
        return [f"{r['entity']}: {r['verdict']}" for r in told[0][0] if r["verdict"] != "kept"]

    store.commit(run_ref, replaced={facts: kept}, check=check)
    return store.spark.createDataFrame(*told[0])
