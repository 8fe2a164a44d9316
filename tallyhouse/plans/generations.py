"""Queries of tables that change together: retention, ingest and streams committed as generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import text as x
from tallyhouse.operators import history, ingest, retention
from tallyhouse.plans.pipelines import BAD, LINE, batches
from tallyhouse.plans.prices import PERIODS, RETAINED
from tallyhouse.plans.register import query
from tallyhouse.sources import payloads as P
from tallyhouse.sources.generations import Store
from tallyhouse.streaming import jobs


def schema_of(df) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


CARRIED = ("offer", "product", "site")
KEYS = ["offer_id", "business_date", "ord1", "ord2", "ord3"]


def warehouse_store(v) -> Store:
    """The facts and what goes with them as a first generation."""
    tables = {"obs": v.obs, **{k: getattr(v, k) for k in CARRIED}}
    store = Store(v.spark, jobs.work_folder(v.spark, "warehouse"), {k: schema_of(df) for k, df in tables.items()})
    store.commit("load", replaced=tables)
    return store


@query(
    "t23_retention_generation",
    f"""SELECT 'obs' AS entity, (SELECT count(*) FROM obs) AS rows_before, (SELECT count(*) FROM obs o WHERE EXISTS (SELECT 1 FROM ({RETAINED}) AS k
     WHERE k.offer_id = o.offer_id AND k.business_date = o.business_date AND k.ord1 = o.ord1 AND k.ord2 = o.ord2 AND k.ord3 = o.ord3)) AS rows_after,
     CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS strangers, 'kept' AS verdict
    {''.join(f" UNION ALL SELECT '{k}', count(*), count(*), 0, 0, 'kept' FROM {k}" for k in CARRIED)}""",
)
def _(v):
    # The kept observations become a generation of their own, checked against the one before and put in force in one step.
    return retention.compacted(warehouse_store(v), "retention", "obs", KEYS, {0: "keep_all", 1: "daily"}, "weekly", "1998-01-01")


WAVES = 2
GOOD = f"l_orderkey // 100 % 40 NOT IN ({BAD}) AND l_quantity <> 13 AND l_linenumber <> 7"
ROWS = f"""(SELECT DISTINCT l_partkey * 5 + l_suppkey % 5 AS offer_id, l_partkey AS product_id, l_orderkey // 100 % {WAVES} AS wave, l_orderkey, l_linenumber, l_suppkey, l_quantity
 FROM lineitem WHERE {GOOD})"""
CHANGED = f"""(SELECT *, CASE WHEN lag(l_quantity) OVER w IS DISTINCT FROM l_quantity THEN 1 ELSE 0 END AS opens, last_value(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS open_price
 FROM {ROWS} AS r WINDOW w AS (PARTITION BY offer_id ORDER BY wave, l_orderkey, l_linenumber, l_suppkey, l_quantity))"""
ORDER = ("order_no", "line_no", "supplier", "price")


def price_rows(payloads):
    """Price rows of usable batches, each with what is wrong with it."""
    rows = P.named_rows(P.checked(payloads, LINE)[0], LINE)
    number = lambda c: F.col(c).cast("long")
    price = x.parse_money("l_quantity")
    # 132 bits in 22 characters: the hash is what most of a stored row is.
    digest = F.substring(F.base64(F.unhex(F.sha2(F.concat_ws("|", *LINE), 256))), 1, 22)
    error = F.when(F.col("l_linenumber") == "7", "out of scope").when(price.isNull(), "unreadable price")
    return rows.select(
        F.expr("cast(l_partkey as long) * 5 + cast(l_suppkey as long) % 5").alias("offer_id"),
        number("l_partkey").alias("product_id"),
        F.to_date(F.substring("scraped_at", 1, 10)).alias("business_date"),
        digest.alias("record_hash"),
        x.canonical_amount(price).alias("price_key"),
        F.lit("observed").alias("provenance"),
        number("l_orderkey").alias("order_no"), number("l_linenumber").alias("line_no"), number("l_suppkey").alias("supplier"), price.cast("double").alias("price"),
        error.alias("error"),
    )


def run_store(v, name: str) -> Store:
    return Store(v.spark, jobs.work_folder(v.spark, name), ingest.RUN_TABLES)


def committed(v) -> Store:
    """Two runs over the batches, with details of some parts in each; the first is sent again, and the second states some brands anew."""
    store, payloads = run_store(v, "runs"), batches(v, unreadable=13)
    stated = lambda code, value, wave: v.part.where(F.col("p_partkey") % WAVES == wave).select(F.col("p_partkey").alias("product_id"), F.lit(code).alias("code"), value.alias("raw_value"))
    for wave in (0, 0, 1):
        details = stated("brand", F.col("p_brand"), wave).unionByName(stated("type", F.col("p_type"), wave))
        if wave == 1:
            details = details.unionByName(stated("brand", F.upper("p_brand"), 0))
        ingest.ingested(store, f"wave {wave}", price_rows(payloads.where(F.col("run_ref").cast("long") % WAVES == wave)), details, ORDER)
    return store


@query(
    "t1_ingest_committed",
    f"SELECT offer_id, CAST(sum(opens) AS BIGINT) AS observations, CAST(max(open_price) AS DOUBLE) AS open_price FROM {CHANGED} AS c GROUP BY offer_id",
)
def _(v):
    # Each run is one commit over observations, open prices, products, details and its report.
    store = committed(v)
    stored = store.read("observation").groupBy("offer_id").agg(F.count("*").alias("observations"))
    open_ = ingest.newest(store.read("open_price"), ["offer_id"], "price_key")
    return stored.join(open_, "offer_id").select("offer_id", "observations", F.col("price_key").cast("double").alias("open_price"))


@query(
    "t9_details_committed",
    f"""SELECT p_partkey AS product_id, 'brand' AS code, CASE WHEN p_partkey % {WAVES} = 0 THEN upper(p_brand) ELSE p_brand END AS raw_value
    FROM part WHERE p_partkey IN (SELECT product_id FROM {ROWS} AS r)
    UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_partkey IN (SELECT product_id FROM {ROWS} AS r WHERE r.wave <= p_partkey % {WAVES})""",
)
def _(v):
    # Details attach to products that some run's prices have registered; stating a code again retires its old value.
    return ingest.details_in_force(committed(v))


@query(
    "r1_streaming_commits",
    f"""SELECT 'new' AS outcome, CAST(sum(opens) AS BIGINT) AS n FROM {CHANGED} AS c
    UNION ALL SELECT 'confirmed', CAST(sum(1 - opens) AS BIGINT) FROM {CHANGED} AS c
    UNION ALL SELECT 'duplicate', 2 * (SELECT count(*) FROM lineitem WHERE {GOOD}) - (SELECT count(*) FROM {ROWS} AS r)""",
)
def _(v):
    # Everything comes twice, as clients send again what nobody acknowledged, in a delivery of its own or in the same: nothing is stored twice.
    store, folder, payloads = run_store(v, "runs"), jobs.work_folder(v.spark, "deliveries"), batches(v, unreadable=13)
    for wave, copies in ((0, 1), (0, 1), (1, 2)):
        own = payloads.where(F.col("run_ref").cast("long") % WAVES == wave).drop("bad")
        (own.unionByName(own) if copies == 2 else own).write.mode("append").json(f"{folder}/in", compression="gzip")
        stream = jobs.file_stream(v.spark, f"{folder}/in", f"{P.PAYLOAD}, bad string", "json", per_trigger=1000)
        jobs.drained(stream, jobs.ingest_into(store, "delivery", price_rows, ORDER), folder)
    total = store.read("run").agg(F.sum("new"), F.sum("confirmed"), F.sum("duplicates"))
    return total.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("new", "confirmed", "duplicate"))), F.array(*total.columns))).alias("outcome", "n"))


@query(
    "r2_streaming_periods",
    f"""SELECT * FROM (SELECT offer_id, period_no, opened_because, first_detected_at, last_confirmed_at, n_observations, CAST(price AS DOUBLE) AS price, currency, tax_included,
    lead(first_detected_at) OVER (PARTITION BY offer_id ORDER BY period_no) AS closed_at FROM {PERIODS} AS p) AS q WHERE closed_at IS NOT NULL""",
)
def _(v):
    # Observations come in three deliveries; each closes and opens periods from where the one before left them.
    columns = ["offer_id", *history.ORDER, "price", "currency", "tax_included"]
    folder, rows = jobs.work_folder(v.spark, "periods"), v.obs.select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    period = history.PERIOD.format(at=kinds["observed_at"], price=kinds["price"])
    store = Store(v.spark, f"{folder}/store", {"period": period.partition(", last struct")[0] + f", closed_at {kinds['observed_at']}", "open_period": f"{period}, generation long", "late": schema_of(rows)})
    delivery = F.when(F.col("observed_at") < "1995-01-01", 0).when(F.col("observed_at") < "1999-01-01", 1).otherwise(2)
    for k in range(3):
        rows.where(delivery == k).write.mode("append").parquet(f"{folder}/in", compression="zstd")
        jobs.drained(jobs.file_stream(v.spark, f"{folder}/in", rows.schema, per_trigger=1000), jobs.periods_into(store, "delivery"), folder)
    found = store.read("period").withColumn("price", F.col("price").cast("double"))
    return found.select("offer_id", "period_no", "opened_because", "first_detected_at", "last_confirmed_at", "n_observations", "price", "currency", "tax_included", "closed_at")
