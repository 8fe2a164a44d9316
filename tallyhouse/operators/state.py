"""What a run of a source writes: its report, variants, retired offers, confirmations, rates, rule versions, schema versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.operators import history


def run_reports(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row for each run: its status and counts.

    ``rows`` has run_ref and ``error`` for each row of usable batches, null where the row was stored; ``rejected`` has run_ref,
    reason and size of the batches that couldn't be used. A run without errors is a success, one with some is partial, and one
    of which nothing was stored has failed.
    """
    good = rows.groupBy("run_ref").agg(F.count("*").alias("seen"), F.count("error").alias("errors"), F.array_sort(F.collect_set("error")).alias("reasons"))
    bad = rejected.groupBy("run_ref").agg(F.sum("size").alias("seen"), F.sum("size").alias("errors"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    every = good.unionByName(bad).groupBy("run_ref").agg(
        F.sum("seen").alias("rows_seen"),
        (F.sum("seen") - F.sum("errors")).alias("rows_stored"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), ", ").alias("reasons"),
    )
    status = F.when(F.col("rows_stored") == 0, "failed").when(F.col("rows_stored") < F.col("rows_seen"), "partial").otherwise("success")
    return every.select("run_ref", status.alias("status"), "rows_seen", "rows_stored", "reasons")


def variant_key(external_id: Column, fingerprint: Column) -> Column:
    """A variant is known by the source's own id, else by its options; never by its SKU."""
    return F.coalesce(F.nullif(F.trim(external_id), F.lit("")), F.concat(F.lit("fp:"), fingerprint))


def variants_after(stored: DataFrame, batch: DataFrame, keys: list[str], learned: list[str]) -> tuple[DataFrame, DataFrame]:
    """The variants after a batch, and its events (keys, event).

    Stored variants keep their identity; ``learned`` columns take what the batch says and never lose what it doesn't. A retired
    variant that comes again is active again ('returned'), one that isn't known is 'new'.
    """
    said = batch.select(*keys, *[F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in learned], F.lit(True).alias("_here"))
    both = stored.withColumn("_known", F.lit(True)).join(said, keys, "full_outer")
    status = F.when(F.col("_here"), "active").otherwise(F.col("status"))
    event = F.when(F.col("_known").isNull(), "new").when(F.col("_here") & (F.col("status") != "active"), "returned")
    after = both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in learned], status.alias("status"))
    return after, both.select(*keys, event.alias("event")).where("event is not null")


#: Fixed value: the provenance of an offer's unit that no witness stands behind.
UNWITNESSED = "legacy_unwitnessed"


def replaced_offers(offers: DataFrame) -> DataFrame:
    """Active offers whose unit no witness stands behind, of variants that have an active offer with a witness: those are superseded."""
    named = F.col("provenance").isNotNull() & ~F.col("provenance").isin("", UNWITNESSED)
    active = offers.where("status = 'active'")
    by_name = active.where(named).select("variant_id").distinct()
    return active.where(F.col("provenance") == UNWITNESSED).join(by_name, "variant_id", "left_semi")


def run_status(runs: DataFrame) -> DataFrame:
    """``status`` of each (source, run) from its volume breach: a run that fell short is partial."""
    return runs.withColumn("status", F.when(F.col("breach").isNull(), "success").otherwise("partial"))


def confirmed_periods(seen: DataFrame) -> DataFrame:
    """Price periods with ``confirmed_at``: the last moment at which a successful run saw the period's price, else when it was first detected.

    ``seen`` are observations with the ``status`` of their run. Periods are derived from all of them, whatever became of their
    runs; only successful runs confirm.
    """
    at = F.max(F.when(F.col("status") == "success", F.col("observed_at"))).alias("_at")
    return history.timeline(seen, more=(at,)).withColumn("confirmed_at", F.coalesce("_at", "first_detected_at")).drop("_at")


def carried(derived: DataFrame, before: DataFrame, same: list[str]) -> DataFrame:
    """Derived periods again, with the later of their own confirmation and that of the same period before (equal in ``same``)."""
    old = before.groupBy(*same).agg(F.max("confirmed_at").alias("_old"))
    rows = derived.join(old, same, "left")
    return rows.withColumn("confirmed_at", F.greatest("confirmed_at", "_old")).drop("_old")


def rates_after(stored: DataFrame, batch: DataFrame, most: float = 1e6) -> DataFrame:
    """Rates by (currency, as_of, source_key) after a batch; the last of equal keys stays (``at``). US dollars and implausible rates aren't stored."""
    fit = (F.col("per_usd") > 0) & (F.col("per_usd") <= most) & (F.upper("currency") != "USD")
    rows = stored.withColumn("_new", F.lit(0)).unionByName(batch.where(fit).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct("per_usd", "source_kind"), F.struct("_new", "at")).alias("r")
    return rows.groupBy("currency", "as_of", "source_key").agg(last).select("currency", "as_of", "source_key", "r.*")


def rules_after(stored: DataFrame, declared: DataFrame, keys: list[str], values: list[str], day) -> DataFrame:
    """All versions of the rules after a declaration on a day.

    Open rules that it repeats stay open; changed ones are closed and open anew; ones it no longer names are closed; new ones
    open. Closed versions never change. ``stored`` has valid_from and valid_to besides keys and values.
    """
    today = F.lit(day).cast("date")
    now = declared.select(*keys, F.struct(*values).alias("_now"))
    same = F.col("_now").eqNullSafe(F.struct(*values))
    open_ = F.col("valid_to").isNull()
    kept = stored.join(now, keys, "left").withColumn("valid_to", F.when(open_ & ~F.coalesce(same, F.lit(False)), today).otherwise(F.col("valid_to")))
    held = stored.where(open_).select(*keys, F.struct(*values).alias("_held"))
    fresh = now.join(held, keys, "left").where(~F.col("_held").eqNullSafe(F.col("_now")))
    opened = fresh.select(*keys, "_now.*", today.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return kept.select(*keys, *values, "valid_from", "valid_to").unionByName(opened)


def schema_verdict(old: Column, new: Column) -> Column:
    """What becomes of a dataset's schema (arrays of field keys): a lost field refuses, more fields open a version, the rest is the same."""
    lost, more = F.size(F.array_except(old, new)) > 0, F.size(F.array_except(new, old)) > 0
    return F.when(old.isNull(), "first").when(lost, "refused").when(more, "widened").otherwise("same")


def schemas_after(schemas: DataFrame) -> DataFrame:
    """``verdict``, ``version`` and ``schema_hash`` of datasets with old and new field keys; a refused schema leaves the old version in force."""
    verdict = schema_verdict(F.col("old"), F.col("new"))
    in_force = F.array_sort(F.when(F.col("verdict") == "refused", F.col("old")).otherwise(F.col("new")))
    rows = schemas.withColumn("verdict", verdict)
    version = F.when(F.col("verdict") == "widened", 2).otherwise(1)
    return rows.withColumn("version", version).withColumn("schema_hash", F.sha2(F.array_join(in_force, ","), 256))


def schema_history(seen: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, verdict, version: what became of each schema that a dataset showed, in order of ``at``, its versions counted on.

    A set of fields that had a version gets that one again ('same' if it is in force, else 'known'); one that holds all fields
    in force and more opens the next; one that lost a field is refused, and the version in force stays. ``seen`` has ``fields``
    (array of field keys); a dataset has a row for each schema that it showed, and they are walked through together.
    """
    walk = """aggregate(seen, cast(named_struct('known', array(), 'out', array()) as struct<known:array<array<string>>,out:array<struct<at:{at},verdict:string,version:int>>>), (s, x) ->
        named_struct('known', if(size(s.known) = 0 or (not array_contains(s.known, x.fields) and size(array_except(element_at(s.known, -1), x.fields)) = 0), concat(s.known, array(x.fields)), s.known),
                     'out', concat(s.out, array(named_struct('at', x.at,
                         'verdict', case when size(s.known) = 0 then 'first' when element_at(s.known, -1) = x.fields then 'same' when array_contains(s.known, x.fields) then 'known'
                                         when size(array_except(element_at(s.known, -1), x.fields)) > 0 then 'refused' else 'widened' end,
                         'version', cast(case when size(s.known) = 0 then 1 when array_contains(s.known, x.fields) then array_position(s.known, x.fields)
                                         when size(array_except(element_at(s.known, -1), x.fields)) > 0 then size(s.known) else size(s.known) + 1 end as int))))))"""
    at = seen.schema["at"].dataType.simpleString()
    rows = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.array_sort("fields").alias("fields")))).alias("seen"))
    return rows.select(*keys, F.explode(F.expr(walk.format(at=at))["out"]).alias("r")).select(*keys, "r.*")


def set_difference(earlier: Column, later: Column) -> Column:
    """How the fields of a later key compare with those of an earlier one: narrowed if some are lost, else widened or comparable."""
    lost, more = F.size(F.array_except(earlier, later)) > 0, F.size(F.array_except(later, earlier)) > 0
    return F.when(earlier.isNull(), "first").when(lost, "narrowed").when(more, "widened").otherwise("comparable")


#: Logs that may be pruned; facts never are.
PRUNABLE = ("change_event", "crawl_issue")


def pruned(name: str, log: DataFrame, at: str, before) -> DataFrame:
    """A derived log without what is older than a date."""
    if name not in PRUNABLE:
        raise ValueError(f"{name} holds facts and is never pruned")
    return log.where(F.col(at) >= F.lit(before).cast("date"))


def administered(tables: dict[str, DataFrame], renamed: dict[str, str], archived: list[str], wiped: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables keyed by source_key after sources are renamed, archived (kept, marked) or wiped, and a row for each table and source: the action, rows before (n) and after (remaining), its name and mark then.

    Each table is read once for its counts.
    """
    after, counts = {}, None
    key = F.col("source_key")
    names = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else F.create_map().cast("map<string,string>")
    action = F.when(key.isin(wiped), "wiped").when(key.isin(archived), "archived").when(F.map_contains_key(names, key), "renamed").otherwise("kept")
    now = F.coalesce(F.try_element_at(names, key), key)
    for name, df in tables.items():
        count = df.groupBy(F.lit(name).alias("entity"), "source_key").agg(F.count("*").alias("n"))
        counts = count if counts is None else counts.unionByName(count)
        after[name] = df.where(action != "wiped").withColumn("archived", action == "archived").withColumn("source_key", now)
    stays = action != "wiped"
    counts = counts.select(
        "entity", "source_key", action.alias("action"), "n", F.when(stays, F.col("n")).otherwise(0).alias("remaining"), F.when(stays, now).alias("now_called"), F.when(stays, action == "archived").alias("archived")
    )
    return after, counts


def lag_by(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``before``: the value of the row before, of the same key."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
