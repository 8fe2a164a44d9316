"""Queries of ingest that writes state, each over state derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import text as x
from tallyhouse.operators import directory, history, lookups, state
from tallyhouse.plans.pipelines import BAD, LINE, REASONS, batches
from tallyhouse.plans.prices import MOVES, ORD
from tallyhouse.plans.register import query
from tallyhouse.sources import payloads as P
from tallyhouse.streaming import jobs

RUN_SQL = f"""
SELECT CAST(run AS VARCHAR) AS run_ref, CASE WHEN stored = 0 THEN 'failed' WHEN stored < seen THEN 'partial' ELSE 'success' END AS status,
       seen AS rows_seen, stored AS rows_stored,
       CASE WHEN run % 40 IN ({BAD}) THEN CASE run % 40 {REASONS} END ELSE concat_ws(', ', CASE WHEN outs > 0 THEN 'out of scope' END, CASE WHEN noprice > 0 THEN 'unreadable price' END) END AS reasons
FROM (SELECT run, count(*) + CASE WHEN run % 40 = 7 THEN 1 ELSE 0 END AS seen,
             count(*) FILTER (WHERE run % 40 NOT IN ({BAD}) AND l_quantity <> 13 AND l_linenumber <> 7) AS stored,
             count(*) FILTER (WHERE l_linenumber = 7) AS outs, count(*) FILTER (WHERE l_quantity = 13 AND l_linenumber <> 7) AS noprice
      FROM (SELECT *, l_orderkey // 100 AS run FROM lineitem) AS l GROUP BY run) AS r
"""


@query("t1_ingest_run", RUN_SQL)
def _(v):
    # A row that the scope doesn't name, or whose price can't be read, is an error of its own; the rest of its run is stored.
    usable, bad = P.checked(batches(v, unreadable=13), LINE)
    rows = P.named_rows(usable, LINE)
    error = F.when(F.col("l_linenumber") == "7", "out of scope").when(x.parse_money("l_quantity").isNull(), "unreadable price")
    return state.run_reports(rows.select("run_ref", error.alias("error")), bad.select("run_ref", "reason", F.size("rows").cast("long").alias("size")))


STORED_VARIANT = """(SELECT p_partkey // 10 AS product_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE concat('fp:no=', p_partkey, '|size=',
 p_size) END AS variant,
 CASE WHEN p_size % 5 <> 0 THEN concat('S', p_partkey) END AS sku, p_name AS label, CASE WHEN p_size % 7 = 0 THEN 'retired' ELSE 'active' END AS status
 FROM part WHERE p_brand <> 'Brand#3')"""
VARIANT_BATCH = """(SELECT p_partkey // 10 AS product_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE concat('fp:no=', p_partkey, '|size=',
 p_size) END AS variant,
 concat('S', p_partkey) AS sku, CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE '' END AS label FROM part WHERE p_type <> 'ECONOMY')"""
VARIANTS_SQL = f"""
SELECT coalesce(s.product_id, b.product_id) AS product_id, coalesce(s.variant, b.variant) AS variant, coalesce(b.sku, s.sku) AS sku, coalesce(nullif(b.label,
 ''), s.label) AS label,
       CASE WHEN b.variant IS NOT NULL THEN 'active' ELSE s.status END AS status, CASE WHEN s.variant IS NULL THEN 'new' WHEN b.variant IS NOT NULL AND s.status <> 'active' THEN 'returned' END AS event
FROM {STORED_VARIANT} AS s FULL OUTER JOIN {VARIANT_BATCH} AS b ON b.product_id = s.product_id AND b.variant = s.variant
"""


@query("t3_variant_identity", VARIANTS_SQL)
def _(v):
    # Half the variants have an id of the source, the others only their options; SKUs and labels are filled in late.
    number = F.col("p_partkey").cast("string")
    options = F.create_map(F.lit("no"), number, F.lit("size"), F.col("p_size").cast("string"))
    key = state.variant_key(F.when(F.col("p_size") % 2 == 0, number).otherwise(" "), x.option_fingerprint(options))
    rows = v.part.withColumn("product_id", F.expr("p_partkey div 10")).withColumn("variant", key).withColumn("code", F.concat(F.lit("S"), number))
    stored = rows.where("p_brand <> 'Brand#3'").select(
        "product_id", "variant", F.when(F.col("p_size") % 5 != 0, F.col("code")).alias("sku"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") % 7 == 0, "retired").otherwise("active").alias("status"),
    )
    label = F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise("")
    batch = rows.where("p_type <> 'ECONOMY'").select("product_id", "variant", F.col("code").alias("sku"), label.alias("label"))
    after, events = state.variants_after(stored, batch, ["product_id", "variant"], ["sku", "label"])
    return after.join(events, ["product_id", "variant"], "left")


#: Status of each source's monthly run: partial if it fell short of ten rows or dropped by more than a fifth.
RUN_STATUS = """(SELECT source_id, run_id, CASE WHEN rows < 10 OR coalesce(1 - rows / previous > 0.2, FALSE) THEN 'partial' ELSE 'success' END AS status
 FROM (SELECT *, lag(rows) OVER (PARTITION BY source_id ORDER BY run_id) AS previous
 FROM (SELECT source_id, run_id, count(*) AS rows
 FROM obs
 GROUP BY source_id, run_id) AS r) AS x)"""


def run_states(v):
    runs = v.facts.groupBy("source_id", F.col("run_id").alias("run")).agg(F.count("*").alias("rows"))
    return state.run_status(lookups.volume_breaches(runs, 10, 0.2)).select("source_id", F.col("run").alias("run_id"), "status")


@query(
    "a7_last_successful_run",
    f"""SELECT source_id, count(*) AS runs, max(CASE WHEN status = 'success' THEN run_id END) AS last_success
    FROM {RUN_STATUS} AS r
    GROUP BY source_id""",
)
def _(v):
    good = F.max(F.when(F.col("status") == "success", F.col("run_id")))
    return run_states(v).groupBy("source_id").agg(F.count("*").alias("runs"), good.alias("last_success"))


CONFIRMED_SQL = f"""
SELECT offer_id, period_no, min(observed_at) AS first_detected_at, coalesce(max(observed_at) FILTER (WHERE status = 'success'), min(observed_at)) AS confirmed_at
FROM (SELECT *, count(why) OVER (PARTITION BY offer_id ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS period_no FROM (
 SELECT *, CASE WHEN lag(observed_at) OVER w IS NULL OR lag(currency) OVER w <> currency OR lag(price) OVER w <> price OR lag(tax_included) OVER w <> tax_included THEN 1 END AS why
 FROM (SELECT obs.*, r.status FROM obs JOIN {RUN_STATUS} AS r ON r.source_id = obs.source_id AND r.run_id = obs.run_id) AS o
 WINDOW w AS (PARTITION BY offer_id ORDER BY {ORD})) AS m) AS p
GROUP BY offer_id, period_no
"""


@query("t6_confirmed_periods", CONFIRMED_SQL)
def _(v):
    # Derived twice, from the history up to a day and from all of it: what the first has confirmed outlives the second.
    seen = v.obs.join(run_states(v), ["source_id", "run_id"])
    early = state.confirmed_periods(seen.where("observed_at < timestamp_ntz'1998-01-01'"))
    rows = state.carried(state.confirmed_periods(seen), early, ["offer_id", "first_detected_at", "price", "currency", "tax_included"])
    return rows.select("offer_id", "period_no", "first_detected_at", "confirmed_at")


READINGS = "(SELECT offer_id, product_id // 3 AS variant_id, CASE WHEN unit_code IS NULL THEN 'legacy_unwitnessed' ELSE 'name:quantity' END AS provenance, status FROM offer)"
REPLACED_SQL = f"""
SELECT DISTINCT a.offer_id, a.variant_id FROM {READINGS} AS a JOIN {READINGS} AS b ON b.variant_id = a.variant_id
WHERE a.status = 'active' AND b.status = 'active' AND a.provenance = 'legacy_unwitnessed' AND b.provenance = 'name:quantity'
"""


@query("t8_replaced_offers", REPLACED_SQL)
def _(v):
    # Three neighbouring products are one variant, read three times; offers without a unit are readings that nobody can name.
    said = F.when(F.col("unit_code").isNull(), state.UNWITNESSED).otherwise("name:quantity")
    readings = v.offer.select("offer_id", F.expr("product_id div 3").alias("variant_id"), said.alias("provenance"), "status")
    return state.replaced_offers(readings).select("offer_id", "variant_id")


CURRENCY = "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'EGP' ELSE 'SAR' END"
IMPLIED = f"""(SELECT currency, as_of, source_key, local / usd AS per_usd, 'shop' AS source_kind, n FROM (
 SELECT *, count(*) OVER (PARTITION BY currency, as_of, source_key) AS n,
        row_number() OVER (PARTITION BY currency, as_of, source_key ORDER BY l_shipdate DESC, o DESC, local DESC, l_partkey DESC) AS rn
 FROM (SELECT {CURRENCY} AS currency, strftime(l_shipdate, '%Y-%m') AS as_of, r_name AS source_key, l_extendedprice AS local, p_retailprice AS usd, l_shipdate,
 l_orderkey * 10 + l_linenumber AS o, l_partkey
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN region ON r_regionkey = l_suppkey % 5 WHERE l_extendedprice > 0 AND p_retailprice > 0) AS l) AS x
 WHERE rn = 1)"""


def implied(v):
    """Rates that rows with a local price and a dollar price beside it imply, by source and month."""
    rows = v.lineitem.join(v.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(v.region, F.expr("r_regionkey = l_suppkey % 5")).select(
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"), "EGP").otherwise("SAR").alias("currency"),
        F.date_format("l_shipdate", "yyyy-MM").alias("as_of"),
        F.col("r_name").alias("source_key"),
        F.col("l_extendedprice").alias("local"),
        F.col("p_retailprice").alias("usd"),
        F.struct("l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice", "l_partkey").alias("at"),
    )
    return directory.implied_rates(rows, ["as_of", "source_key"])


@query("t10_implied_rates", f"SELECT currency, as_of, source_key, per_usd, source_kind, n FROM {IMPLIED} AS i")
def _(v):
    return implied(v).select("currency", "as_of", "source_key", "per_usd", F.lit("shop").alias("source_kind"), "n")


STATED = """(SELECT currency, as_of, source_key, per_usd, source_kind FROM (
 SELECT CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'SAR' ELSE 'EGP' END AS currency, strftime(o_orderdate, '%Y-%m') AS as_of, CASE WHEN o_orderpriority = '1-URGENT' THEN 'ASIA' ELSE 'provider' END AS source_key,
 CASE WHEN o_orderpriority = '2-HIGH' THEN 0 - o_totalprice ELSE o_totalprice / 100000 END AS per_usd, CASE WHEN o_orderpriority = '1-URGENT' THEN 'shop' ELSE 'provider' END AS source_kind,
 o_orderdate, o_orderkey FROM orders) AS o
 WHERE currency <> 'USD' AND per_usd > 0 AND per_usd <= 1000000
 QUALIFY row_number() OVER (PARTITION BY currency, as_of, source_key ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
RATES_SQL = f"""
SELECT currency, as_of, source_key, per_usd, source_kind FROM (
 SELECT currency, as_of, source_key, per_usd, source_kind FROM {STATED} AS b

 UNION ALL SELECT currency, as_of, source_key, per_usd, source_kind
 FROM {IMPLIED} AS s WHERE NOT EXISTS (SELECT 1
 FROM {STATED} AS b WHERE b.currency = s.currency AND b.as_of = s.as_of AND b.source_key = s.source_key)) AS r
"""


@query("t11_stored_rates", RATES_SQL)
def _(v):
    # What rows imply is stored; then a batch of stated rates comes, of a provider and of one shop, with dollars and nonsense in it.
    at = F.struct(F.lit(0).cast("timestamp").alias("day"), F.lit(0).cast("long").alias("key"))
    stored = implied(v).select("currency", "as_of", "source_key", "per_usd", F.lit("shop").alias("source_kind"), at.alias("at"))
    shop = F.col("o_orderpriority") == "1-URGENT"
    batch = v.orders.select(
        F.when(F.col("o_orderstatus") == "F", "USD").when(F.col("o_orderstatus") == "O", "SAR").otherwise("EGP").alias("currency"),
        F.date_format("o_orderdate", "yyyy-MM").alias("as_of"),
        F.when(shop, "ASIA").otherwise("provider").alias("source_key"),
        F.when(F.col("o_orderpriority") == "2-HIGH", -F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 100000).alias("per_usd"),
        F.when(shop, "shop").otherwise("provider").alias("source_kind"),
        F.struct(F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderkey").cast("long").alias("key")).alias("at"),
    )
    rows = state.rates_after(stored, batch)
    return rows.select("currency", "as_of", "source_key", "per_usd", "source_kind")


def _rules_sql(when: str) -> str:
    return f"""(SELECT source_key, region, material_key, tax_mode, rate FROM (
 SELECT r_name AS source_key, n_name AS region, p_type AS material_key, CASE WHEN l_linestatus = 'O' THEN 'incl' ELSE 'excl' END AS tax_mode, CAST(round(l_tax * 100) AS INT) AS rate,
 l_shipdate, l_orderkey * 10 + l_linenumber AS o, l_extendedprice, l_partkey
 FROM lineitem JOIN part ON p_partkey = l_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
 JOIN region ON r_regionkey = l_suppkey % 5
 WHERE {when}) AS t
 QUALIFY row_number() OVER (PARTITION BY source_key, region, material_key ORDER BY l_shipdate DESC, o DESC, l_extendedprice DESC, l_partkey DESC) = 1)"""


OLD_RULES, NEW_RULES = _rules_sql("l_shipdate < TIMESTAMP '1995-01-01'"), _rules_sql("l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-07-01'")
SCD_SQL = f"""
SELECT o.source_key, o.region, o.material_key, o.tax_mode, o.rate, DATE '1995-01-01' AS valid_from, CASE WHEN n.rate IS NULL OR n.rate <> o.rate OR n.tax_mode <> o.tax_mode THEN DATE '1999-07-01' END AS valid_to
FROM {OLD_RULES} AS o LEFT JOIN {NEW_RULES} AS n ON n.source_key = o.source_key AND n.region = o.region AND n.material_key = o.material_key
UNION ALL
SELECT n.source_key, n.region, n.material_key, n.tax_mode, n.rate, DATE '1999-07-01', NULL
FROM {NEW_RULES} AS n LEFT JOIN {OLD_RULES} AS o ON n.source_key = o.source_key AND n.region = o.region AND n.material_key = o.material_key
WHERE o.rate IS NULL OR n.rate <> o.rate OR n.tax_mode <> o.tax_mode
"""


@query("t12_tax_rules_scd2", SCD_SQL)
def _(v):
    # Rules as the sold lines show them: those in force before 1995, and those that the first half of 1999 declares.
    rows = v.lineitem.join(v.part.select("p_partkey", F.col("p_type").alias("material_key")), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(v.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(v.nation.select("n_nationkey", F.col("n_name").alias("region")), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.join(v.region.select("r_regionkey", F.col("r_name").alias("source_key")), F.expr("r_regionkey = l_suppkey % 5"))
    keys, values = ["source_key", "region", "material_key"], ["tax_mode", "rate"]
    rule = F.struct(F.when(F.col("l_linestatus") == "O", "incl").otherwise("excl").alias("tax_mode"), F.round(F.col("l_tax") * 100).cast("int").alias("rate"))
    # One scan gives the last rule of either time; it is written, as both are compared with each other.
    then, later = F.expr("l_shipdate < timestamp_ntz'1995-01-01'"), F.expr("l_shipdate >= timestamp_ntz'1999-01-01' and l_shipdate < timestamp_ntz'1999-07-01'")
    at = F.struct("l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice", "l_partkey")
    last = lambda when, name: F.max_by(F.when(when, rule), F.when(when, at)).alias(name)
    both = jobs.table_writer(v.spark, "rules")(rows.where(then | later).groupBy(*keys).agg(last(then, "stored"), last(later, "declared")), "last")
    of = lambda name: both.where(F.col(name).isNotNull()).select(*keys, f"{name}.*")
    stored = of("stored").withColumn("valid_from", F.lit("1995-01-01").cast("date")).withColumn("valid_to", F.lit(None).cast("date"))
    return state.rules_after(stored, of("declared"), keys, values, "1999-07-01")


SCHEMAS_SQL = """
SELECT product_id, verdict, CASE WHEN verdict = 'widened' THEN 2 ELSE 1 END AS version, sha256(array_to_string(list_sort(CASE WHEN verdict = 'refused' THEN old ELSE new END),
 ',')) AS schema_hash FROM (
 SELECT n.product_id, o.old, n.new, CASE WHEN o.old IS NULL THEN 'first' WHEN NOT list_has_all(n.new, o.old) THEN 'refused' WHEN NOT list_has_all(o.old,
 n.new) THEN 'widened' ELSE 'same' END AS verdict
 FROM (SELECT product_id, list(DISTINCT availability) AS new FROM obs WHERE year(observed_at) = 1995 GROUP BY product_id) AS n
 LEFT JOIN (SELECT product_id, list(DISTINCT availability) AS old FROM obs WHERE year(observed_at) = 1994 GROUP BY product_id) AS o ON o.product_id = n.product_id) AS s
"""


@query("t15_schema_versions", SCHEMAS_SQL)
def _(v):
    # A product's fields are the availability words it was seen with: those of one year against those of the year before.
    fields = lambda year, name: v.facts.where(F.year("observed_at") == year).groupBy("product_id").agg(F.collect_set("availability").alias(name))
    rows = fields(1995, "new").join(fields(1994, "old"), "product_id", "left")
    return state.schemas_after(rows).select("product_id", "verdict", "version", "schema_hash")


FIELD_SETS_SQL = f"""
SELECT offer_id, CASE WHEN a IS NULL THEN 'first' WHEN (a AND NOT a2) OR (t AND NOT t2) THEN 'narrowed' WHEN (a2 AND NOT a) OR (t2 AND NOT t) THEN 'widened' ELSE 'comparable' END AS verdict,
 count(*) AS n
FROM (SELECT offer_id, availability <> 'unknown' AS a2, tax_included = 1 AS t2, lag(availability <> 'unknown') OVER w AS a, lag(tax_included = 1) OVER w AS t
      FROM obs WINDOW w AS (PARTITION BY offer_id ORDER BY {ORD})) AS x GROUP BY 1, 2
"""


@query("u6_field_sets", FIELD_SETS_SQL)
def _(v):
    # The fields that each observation's price key holds, against those of the observation before.
    known = F.when(F.col("availability") != "unknown", F.col("availability"))
    taxed = F.when(F.col("tax_included") == 1, "incl")
    _, fields = directory.price_key(price=F.col("ord3"), currency=F.col("currency"), availability=known, tax=taxed)
    rows = state.lag_by(v.facts.withColumn("fields", fields), "offer_id", list(history.ORDER), "fields")
    verdict = state.set_difference(F.col("before"), F.col("fields"))
    return rows.groupBy("offer_id", verdict.alias("verdict")).agg(F.count("*").alias("n"))


PRUNED_SQL = f"""
SELECT change_type, count(*) AS before, CAST(sum(CASE WHEN business_date >= DATE '1998-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS kept
FROM {MOVES} AS m GROUP BY change_type
"""


@query("t24_pruned_log", PRUNED_SQL)
def _(v):
    log = history.moves(v.obs)
    kept = state.pruned("change_event", log, "business_date", "1998-01-01").groupBy("change_type").agg(F.count("*").alias("kept"))
    rows = log.groupBy("change_type").agg(F.count("*").alias("before")).join(kept, "change_type", "left")
    return rows.select("change_type", "before", F.coalesce("kept", F.lit(0)).alias("kept"))


KEYED = {
    "obs": "SELECT s.source_key FROM obs o JOIN site s ON s.source_id = o.source_id",
    "offer": "SELECT s.source_key FROM offer o JOIN site s ON s.source_id = o.source_id",
    "product": "SELECT s.source_key FROM product o JOIN site s ON s.source_id = o.source_id",
    "tax_rule": "SELECT source_key FROM tax_rule",
}
ACTIONS = "CASE source_key WHEN 'EUROPE' THEN 'wiped' WHEN 'AFRICA' THEN 'archived' WHEN 'ASIA' THEN 'renamed' ELSE 'kept' END"
ADMIN_SQL = f"""
SELECT entity, source_key, {ACTIONS} AS action, count(*) AS n, CASE WHEN source_key = 'EUROPE' THEN 0 ELSE count(*) END AS remaining,
       CASE source_key WHEN 'ASIA' THEN 'ORIENT' WHEN 'EUROPE' THEN NULL ELSE source_key END AS now_called, CASE WHEN source_key <> 'EUROPE' THEN source_key = 'AFRICA' END AS archived
FROM ({' UNION ALL '.join(f"SELECT '{k}' AS entity, source_key FROM ({q}) AS {k}_keys" for k, q in KEYED.items())}) AS t GROUP BY entity, source_key
"""


@query("t25_renamed_source", ADMIN_SQL)
def _(v):
    keyed = {"obs": v.facts.join(v.site, "source_id"), "offer": v.offer.join(v.site, "source_id"), "product": v.product.join(v.site, "source_id"), "tax_rule": v.tax_rule}
    return state.administered(keyed, {"ASIA": "ORIENT"}, ["AFRICA"], ["EUROPE"])[1]


ABSENT_SQL = """
SELECT dataset_key, external_id, (SELECT min(run_date)
 FROM (SELECT DISTINCT run_date FROM sighting) AS r
 WHERE r.run_date > x.run_date) AS missing_since, next_run AS returned_at
 FROM (
 SELECT dataset_key, external_id, run_date, no, lead(run_date) OVER w AS next_run, lead(no) OVER w AS next_no FROM (
  SELECT DISTINCT s.dataset_key, s.external_id, s.run_date, r.no
  FROM sighting s JOIN (SELECT run_date, row_number() OVER (ORDER BY run_date) AS no
  FROM (SELECT DISTINCT run_date FROM sighting) AS d) AS r ON r.run_date = s.run_date) AS p
 WINDOW w AS (PARTITION BY dataset_key, external_id ORDER BY no)) AS x
WHERE (next_no > no + 1 OR next_no IS NULL) AND run_date < (SELECT max(run_date) FROM sighting)
"""


@query("t28_absence_intervals", ABSENT_SQL)
def _(v):
    presence = v.sighting.select("dataset_key", "external_id", F.col("run_date").alias("run")).distinct()
    return history.absences(presence, v.sighting.select(F.col("run_date").alias("run")).distinct(), ["dataset_key", "external_id"])

