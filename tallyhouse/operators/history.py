"""Price history: latest values, change-only timelines, moves, extremes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The total order of an offer's observations.
ORDER = ("observed_at", "ord1", "ord2", "ord3", "ord4")


def in_order() -> Column:
    return F.struct(*ORDER)


def _first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark keeps the best row of each task before the shuffle (window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_per_offer(obs: DataFrame) -> DataFrame:
    """One observation for each offer: observed before reported, then the newest business date, then the newest row."""
    return _first_by(obs, ["offer_id"], (F.col("provenance") == "observed").desc(), F.col("business_date").desc(), in_order().desc())


def newest_per_offer(obs: DataFrame) -> DataFrame:
    """One observation for each offer by time alone."""
    return _first_by(obs, ["offer_id"], in_order().desc())


def previous_different(obs: DataFrame, latest: DataFrame) -> DataFrame:
    """offer_id, previous: the newest price in the latest price's currency that differs from it."""
    now = latest.select("offer_id", F.col("price").alias("now"), F.col("currency").alias("now_currency"))
    rows = obs.join(now, "offer_id").where((F.col("currency") == F.col("now_currency")) & (F.col("price") != F.col("now")))
    return rows.groupBy("offer_id").agg(F.max_by("price", in_order()).alias("previous"))


def timeline(obs: DataFrame, price: list[str] = ["price"], currency: str = "currency", identity: list[str] = ["tax_included"], more: tuple[Column, ...] = ()) -> DataFrame:  # noqa: B006
    """Change-only periods of each offer (gaps and islands).

    A period opens where price, currency or another identifying field differs from the row before; ``opened_because`` names
    the first of first_seen, currency_change, price_change, fields_changed that holds. ``closed_at`` is the next period's
    start, null for the open one. ``more`` are further aggregates over the rows of a period.
    """
    own = Window.partitionBy("offer_id").orderBy(*ORDER)
    was = lambda c: F.lag(c).over(own)
    differs = lambda cs: F.lit(False) if not cs else F.greatest(*[~F.col(c).eqNullSafe(was(c)) for c in cs], F.lit(False))
    why = F.when(was("observed_at").isNull(), "first_seen").when(differs([currency]), "currency_change").when(differs(price), "price_change").when(differs(identity), "fields_changed")
    marked = obs.withColumn("why", why).withColumn("period_no", F.count("why").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    periods = marked.groupBy("offer_id", "period_no").agg(
        F.max("why").alias("opened_because"),
        F.min("observed_at").alias("first_detected_at"),
        F.max("observed_at").alias("last_confirmed_at"),
        F.count("*").alias("n_observations"),
        *[F.min(c).alias(c) for c in (*price, currency, *identity)],
        *more,
    )
    return periods.withColumn("closed_at", F.lead("first_detected_at").over(Window.partitionBy("offer_id").orderBy("period_no")))


#: A period as it is carried from batch to batch; ``last`` is the order of its newest row.
PERIOD = "offer_id long, period_no long, opened_because string, first_detected_at {at}, last_confirmed_at {at}, n_observations long, price {price}, currency string, tax_included int, last struct<observed_at:{at},ord1:long,ord2:long,ord3:long,ord4:long>"


def periods_after(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The periods of the offers of a batch, by ``kind``: ``period`` is closed, ``open_period`` is open after it, ``late`` is a row that comes too late to have a place in them.

    ``held`` has open periods as batches before left them, the last of an offer and any older ones. A batch's rows go on from it as
    ``timeline`` goes on within a table: the same price, currency and tax position continue it, anything else closes it and opens
    the next. Rows that aren't after the newest one before are late and change nothing. Offers without a row on time give none.

    Held periods stand in the order of their newest row, after new rows of its time: all that comes before is late, or was held
    before. One shuffle and one sort serve the windows over them, and an offer with very many rows spills to disk.
    """
    same = ["price", "currency", "tax_included"]
    was = F.struct("period_no", "opened_because", "first_detected_at", "n_observations").alias("_p")
    rows = batch.withColumn("_held", F.lit(False)).unionByName(held.select("offer_id", "last.*", *same, was, F.lit(True).alias("_held")), allowMissingColumns=True)
    own = Window.partitionBy("offer_id").orderBy(*ORDER, "_held")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.count(F.when(F.col("_held"), 1))
    rows = rows.withColumns(
        {
            "_past": seen.over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > seen.over(so_far),
            "_before": F.lag(F.struct(*same)).over(own),
            "_after": F.lead(F.struct(*same, "observed_at")).over(own),
            "_row": F.row_number().over(own),
        }
    )
    differs = lambda c, side: ~F.col(c).eqNullSafe(F.col(f"{side}.{c}"))
    why = F.when(F.col("_before").isNull(), "first_seen").when(differs("currency", "_before"), "currency_change").when(differs("price", "_before"), "price_change").when(differs("tax_included", "_before"), "fields_changed")
    rows = rows.withColumn("_why", F.when(~F.col("_held") & ~F.col("_past"), why))
    opened = F.struct(F.col("_why").alias("opened_because"), F.col("observed_at").alias("first_detected_at"), (F.col("_row") - 1).cast("long").alias("ahead"))
    resumed = F.struct("_p.opened_because", "_p.first_detected_at", (F.col("_row") - F.col("_p.n_observations")).alias("ahead"))
    start = F.when(F.col("_held"), resumed).when(F.col("_why").isNotNull(), opened)
    rows = rows.withColumns(
        {
            "_start": F.last(start, True).over(so_far),
            "_no": F.count("_why").over(so_far) + F.coalesce(F.last("_p.period_no", True).over(so_far), F.lit(0)),
        }
    )
    ends = differs("price", "_after") | differs("currency", "_after") | differs("tax_included", "_after")
    on_time = F.when(F.col("_after").isNull(), F.when(~F.col("_held"), "open_period")).when(ends, "period")
    found = rows.withColumn("kind", F.when(F.col("_past"), F.when(~F.col("_held"), "late")).otherwise(on_time)).where("kind is not null")
    late = F.col("kind") == "late"
    return found.select(
        *["offer_id", *same, "kind"],
        *[F.when(late, F.col(c)).alias(c) for c in batch.columns if c not in ("offer_id", *same)],
        F.col("_no").alias("period_no"), "_start.opened_because", "_start.first_detected_at", F.col("observed_at").alias("last_confirmed_at"), (F.col("_row") - F.col("_start.ahead")).alias("n_observations"),
        F.col("_after.observed_at").alias("closed_at"), F.when(F.col("kind") == "open_period", in_order()).alias("last"),
    )


def current_state(obs: DataFrame) -> DataFrame:
    """The last observation of each offer with when it was first and last seen."""
    last = F.max_by(F.struct("price", "currency", "availability", "stock_quantity"), in_order())
    return obs.groupBy("offer_id").agg(last.alias("last"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("confirmed_at"), F.count("*").alias("n")).select("offer_id", "last.*", "first_seen_at", "confirmed_at", "n")


def moves(obs: DataFrame) -> DataFrame:
    """Each observed row against the observed row before: currency_change, price_up, price_down, availability_change; rows without a move are left out."""
    own = Window.partitionBy("offer_id").orderBy(*ORDER)
    rows = obs.where("provenance = 'observed'").withColumn("before", F.lag(F.struct("price", "currency", "availability")).over(own)).where("before is not null")
    kind = F.when(F.col("currency") != F.col("before.currency"), "currency_change").when(F.col("price") > F.col("before.price"), "price_up").when(F.col("price") < F.col("before.price"), "price_down").when(F.col("availability") != F.col("before.availability"), "availability_change")
    return rows.withColumn("change_type", kind).where("change_type is not null")


def week_of(day: str | Column) -> Column:
    """Monday-based week of the year, 00 before its first Monday."""
    day = F.col(day) if isinstance(day, str) else day
    weekday = (F.dayofweek(day) + 5) % 7  # Monday 0
    return F.floor((F.dayofyear(day) + 6 - weekday) / 7).cast("int")


def survivors(obs: DataFrame, bucket: str, before) -> DataFrame:
    """The last observation of each offer in each day or week before a date."""
    if bucket not in ("day", "week"):
        raise ValueError(bucket)
    part = [F.col("business_date")] if bucket == "day" else [F.year("business_date"), week_of("business_date")]
    window = Window.partitionBy("offer_id", *part).orderBy(in_order().desc())
    return obs.where(F.col("business_date") < F.lit(before).cast("date")).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def published(obs: DataFrame) -> DataFrame:
    """What is published of each offer: its latest observed row, or all its reported rows where nothing was observed."""
    own = Window.partitionBy("offer_id")
    seen = F.col("provenance") == "observed"
    order = own.orderBy(seen.desc(), F.col("business_date").desc(), in_order().desc())
    rows = obs.withColumn("_any", F.max(seen).over(own)).withColumn("_n", F.row_number().over(order))
    return rows.where((F.col("_n") == 1) | ~F.col("_any")).drop("_any", "_n")


def protected(obs: DataFrame, other: str | None = None) -> DataFrame:
    """First, latest, lowest and highest observations of each offer, ties kept, one row for each reason; rows without one under ``other``, if it is named.

    The four bounds of an offer come from one aggregation; the observations meet them in one join.
    """
    bounds = obs.groupBy("offer_id").agg(F.min("business_date").alias("first"), F.max("business_date").alias("latest"), F.min("price").alias("minimum"), F.max("price").alias("maximum"))
    reason = {"first": "business_date", "latest": "business_date", "minimum": "price", "maximum": "price"}
    hit = F.array_compact(F.array(*[F.when(F.col(c) == F.col(k), F.lit(k)) for k, c in reason.items()]))
    if other:
        hit = F.when(F.size(hit) == 0, F.array(F.lit(other))).otherwise(hit)
    return obs.join(bounds, "offer_id").select(*obs.columns, F.explode(hit).alias("reason"))


def is_protected() -> Column:
    """Whether an observation is a first, latest, lowest or highest one of its offer: windows over one key, so nothing is read twice."""
    own = Window.partitionBy("offer_id")
    bounds = [F.col(c) == f(c).over(own) for c in ("business_date", "price") for f in (F.min, F.max)]
    return bounds[0] | bounds[1] | bounds[2] | bounds[3]


def extremes(obs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Lowest, highest, first, current and previous differing price of each offer in its current currency, with the change.

    ``carry`` names columns of the latest observation that come along.

    One window names each offer's latest price and currency, and the aggregation runs over the same partitioning: one shuffle.
    """
    rank = F.struct((F.col("provenance") == "observed").alias("seen"), "business_date", *ORDER, "price", "currency", *carry)
    rows = obs.withColumn("_now", F.max(rank).over(Window.partitionBy("offer_id"))).where("currency = _now.currency")
    other = F.col("price") != F.col("_now.price")
    out = rows.groupBy("offer_id").agg(
        F.first("currency").alias("currency"),
        F.first("_now.price").alias("current"),
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        F.count("*").alias("n"),
        F.min_by("price", in_order()).alias("first"),
        F.max_by(F.when(other, F.col("price")), F.when(other, in_order())).alias("previous"),
        F.max("business_date").alias("confirmed_at"),
        F.first("_now.business_date").alias("business_date"),
        *[F.first(f"_now.{c}").alias(c) for c in carry],
    )
    change = F.col("current") - F.col("previous")
    share = F.when(F.col("previous") != 0, F.round(change.cast("double") / F.col("previous").cast("double") * 100, 4))
    return out.withColumn("change", change).withColumn("change_pct", share)


def price_on(asked: DataFrame, periods: DataFrame) -> DataFrame:
    """The price of (offer_id, day) rows: confirmed, last_known, before_tracking or no_history.

    One equi-join on the offer; the interval and the backward fallback are conditional aggregates over the offer's periods.
    """
    p = periods.select("offer_id", F.struct(F.to_date("first_detected_at").alias("first"), F.col("period_no"), F.to_date("last_confirmed_at").alias("last"), "price", "currency").alias("p"))
    started = F.when(F.col("p.first") <= F.col("day"), F.col("p"))
    found = asked.join(p, "offer_id", "left").groupBy("offer_id", "day").agg(F.max(started).alias("q"), F.count("p").alias("periods"))
    status = F.when(F.col("periods") == 0, "no_history").when(F.col("q").isNull(), "before_tracking").when(F.col("q.last") >= F.col("day"), "confirmed").otherwise("last_known")
    return found.select("offer_id", "day", status.alias("status"), F.col("q.price").alias("price"), F.col("q.currency").alias("currency"))


def changes_only(series: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """Rows of a reported series whose value differs from the one before."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(key).orderBy(*at))
    return series.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")


def anchored(series: DataFrame, current: DataFrame, key: str, at: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The change points of reported series that are anchored, and a verdict for every series (key, points, verdict).

    A series states no currency or unit of its own, so it counts only if its last value equals the one published now
    (``current``: key and value). 'unanchored' ends elsewhere; for 'no anchor' nothing is published.
    """
    last = series.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias("_last"), F.count("*").alias("points"))
    now = current.select(key, F.col(value).alias("_now"))
    verdict = F.when(F.col("_now").isNull(), "no anchor").when(F.col("_now") == F.col("_last"), "anchored").otherwise("unanchored")
    verdicts = last.join(now, key, "left").select(key, "points", verdict.alias("verdict"))
    good = verdicts.where("verdict = 'anchored'").select(key)
    return changes_only(series.join(good, key, "left_semi"), key, at, value), verdicts


def absences(presence: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """missing_since, returned_at of each key from the runs it was seen in: runs are numbered, and a jump in numbers is an absence. The last one stays open."""
    numbered = runs.select("run", F.row_number().over(Window.orderBy("run")).alias("no"))  # a row for each run
    seen = presence.join(numbered, "run")
    after = Window.partitionBy(*keys).orderBy("no")
    next_ = seen.withColumn("next_no", F.lead("no").over(after)).withColumn("returned_at", F.lead("run").over(after))
    gaps = next_.where("next_no > no + 1 or next_no is null")
    start = numbered.select(F.col("run").alias("missing_since"), (F.col("no") - 1).alias("no"))
    return gaps.join(start, "no").select(*keys, "missing_since", "returned_at")
