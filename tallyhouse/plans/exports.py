"""Queries of what leaves the warehouse, and of what people read there: export rows, grids, folds, details, bundles, boards."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyhouse.functions import text as x
from tallyhouse.operators import audits, charter, export, history, ingest, lookups, matching, retention
from tallyhouse.plans.directory import LEDGER
from tallyhouse.plans.prices import LATEST, ORD, PERIODS, RATE, double
from tallyhouse.plans.register import query
from tallyhouse.sources import pages as H, payloads as P
from tallyhouse.streaming import jobs

FLAT = f"""(SELECT l.*, f.region, f.unit_code, f.basis_quantity, f.status, p.product_name, p.brand, p.category_path, p.material_key, p.curation, s.source_key
 FROM {LATEST} AS l JOIN offer f ON f.offer_id = l.offer_id
 JOIN product p ON p.source_id = l.source_id AND p.product_id = l.product_id
 JOIN site s ON s.source_id = l.source_id)"""
RANGES = f"""(SELECT o.offer_id, min(o.price) AS price_min, max(o.price) AS price_max, count(*) AS n, max(o.business_date) AS confirmed_at,
 last(o.price ORDER BY {', '.join('o.' + c for c in ORD.split(', '))}) FILTER (WHERE o.price <> l.price) AS previous
 FROM {LATEST} AS l JOIN obs o ON o.offer_id = l.offer_id AND o.currency = l.currency GROUP BY o.offer_id)"""
RULED = """LEFT JOIN LATERAL (SELECT t.tax_mode, t.tax_rate_pct, t.tax_evidence FROM tax_rule t
 WHERE t.source_key = l.source_key AND t.region IN (l.region, '*') AND t.material_key IN (l.material_key, '*')
 ORDER BY CASE WHEN t.region <> '*' THEN 2 ELSE 0 END + CASE WHEN t.material_key <> '*' THEN 1 ELSE 0 END DESC LIMIT 1) AS t ON TRUE"""
SIDE = "CASE WHEN l.tax_included = 1 THEN 'Incl. ' ELSE 'Excl. ' END"
PERCENT = "concat(regexp_replace(CAST(CAST(t.tax_rate_pct AS DECIMAL(9,2)) AS VARCHAR), '\\.?0+$', ''), '%')"
LABEL = f"""CASE WHEN t.tax_evidence = 'stated' AND t.tax_rate_pct IS NOT NULL THEN concat({SIDE}, {PERCENT}, ' tax')
 WHEN t.tax_evidence = 'general' THEN CASE WHEN l.tax_included = 1 THEN 'Tax included, rate not published' ELSE 'Tax excluded, rate not published' END ELSE 'Tax treatment unverified' END"""
SHORT = f"CASE WHEN t.tax_evidence = 'stated' AND t.tax_rate_pct IS NOT NULL THEN concat({SIDE}, {PERCENT}) WHEN t.tax_evidence = 'general' THEN concat({SIDE}, '—') ELSE 'Unverified' END"
CENTS = "((CAST(l.price * 10000 AS HUGEINT) * 200000000 + CAST(round(u.per_usd * 1000000) AS HUGEINT) * 10000) // (20000 * CAST(round(u.per_usd * 1000000) AS HUGEINT)))"
#: Tenths of a percent of a change, halves away from zero.
TENTHS = "((CAST(abs(l.price - r.previous) * 10000 AS HUGEINT) * 2000 + CAST(r.previous * 10000 AS HUGEINT)) // (2 * CAST(r.previous * 10000 AS HUGEINT)))"
EXPORT_SQL = {
    "product_name": "l.product_name",
    "product_name_ar": "''",
    "country_code_alpha2": "l.region",
    "country": "l.region",
    "brand": "l.brand",
    "brand_ar": "''",
    "category": "l.category_path",
    "category_ar": "l.material_key",
    "product_id": "l.product_id",
    "variant": "''",
    "variant_ar": "''",
    "sku": "concat('S', l.product_id)",
    "price": "CAST(l.price AS DOUBLE)",
    "unit": "CASE WHEN l.unit_code IS NULL THEN '' WHEN l.basis_quantity = 1 THEN concat('per ', l.unit_code) ELSE concat('per ', CAST(l.basis_quantity AS VARCHAR), ' ', l.unit_code) END",
    "price_basis": "CASE WHEN l.unit_code IS NULL AND l.basis_quantity % 2 = 0 THEN concat(format('{:,}', CAST(l.basis_quantity * 50 AS BIGINT)), ' kg') ELSE '' END",
    "price_before": "CAST(l.price_before AS DOUBLE)",
    "price_sale": "CAST(NULL AS DOUBLE)",
    "price_trade": "CAST(NULL AS DOUBLE)",
    "discount": "CASE WHEN l.price_before > l.price THEN CAST(round(l.price_before - l.price, 2) AS DOUBLE) END",
    "discount_pct": "CASE WHEN l.price_before > l.price THEN round(CAST(l.price_before - l.price AS DOUBLE) / CAST(l.price_before AS DOUBLE) * 100, 1) END",
    "currency": "l.currency",
    "availability": "l.availability",
    "tax_included": "CASE WHEN l.tax_included = 1 THEN 'yes' ELSE 'no' END",
    "tax_evidence": "coalesce(t.tax_evidence, 'unknown')",
    "tax_rate_pct": "CAST(t.tax_rate_pct AS DOUBLE)",
    "tax_statement": "''",
    "price_changed_on": "l.business_date",
    "last_confirmed_on": "r.confirmed_at",
    "official_source": "''",
    "official_source_link": "''",
    "product_link": "concat('https://shop.example/', l.product_id)",
    "tax": LABEL,
    "curation": "l.curation",
    "price_previous": "CAST(r.previous AS DOUBLE)",
    "price_change": f"CASE WHEN r.previous IS NULL THEN '' ELSE printf('%+.2f (%+.1f%%)', CAST(round(l.price - r.previous, 2) AS DOUBLE), sign(l.price - r.previous) * {TENTHS} / 10.0) END",
    "price_min": "CAST(r.price_min AS DOUBLE)",
    "price_max": "CAST(r.price_max AS DOUBLE)",
    "observations": "r.n",
    "price_usd": f"CASE WHEN u.per_usd IS NULL THEN '' ELSE concat({CENTS} // 100, '.', lpad(CAST({CENTS} % 100 AS VARCHAR), 2, '0')) END",
    "category_leaf": "split_part(l.category_path, ' > ', 3)",
    "category_leaf_ar": "''",
} | {f"category_l{k}{s}": f"split_part(l.category_path, ' > ', {k})" if not s else "''" for k in range(1, 11) for s in ("", "_ar")}
ROWS_SQL = f"""
SELECT l.offer_id, l.source_key, {', '.join(f'{e} AS {name}' for name, e in EXPORT_SQL.items())}
FROM {FLAT} AS l JOIN {RANGES} AS r ON r.offer_id = l.offer_id LEFT JOIN {RATE} AS u ON u.currency = l.currency {RULED}
"""

CARRIED = ("source_id", "product_id", "tax_included", "availability", "price_before")


def current(v):
    """Every offer's current price with its history, dimensions, tax rule and rate: one scan of the facts."""
    rows = v.flat(history.extremes(v.obs, CARRIED), priced=True)
    rows = lookups.most_specific(rows, v.tax_rule, ["region", "material_key"], ["source_key"])
    rows = rows.join(lookups.rate_by_authority(v.currency_rate).select("currency", "per_usd"), "currency", "left")
    names = {"current": "price", "lowest": "price_min", "highest": "price_max", "previous": "price_previous", "n": "observations"}
    return rows.withColumnsRenamed(names)


@query("p7_export_rows", ROWS_SQL)
def _(v):
    by_weight = F.col("unit_code").isNull()
    rows = current(v).withColumns(
        {
            "sku": F.concat(F.lit("S"), F.col("product_id").cast("string")),
            "category_flat": F.col("material_key"),
            "weight": F.when(by_weight, F.col("basis_quantity") * 50),
            "weight_unit": F.when(by_weight, "kg"),
            "quantity_is_decimal": F.col("basis_quantity") % 2 == 0,
            "product_link": F.concat(F.lit("https://shop.example/"), F.col("product_id").cast("string")),
        }
    )
    return export.export_rows(rows, ["offer_id", "source_key"])


GRID_SQL = f"""
SELECT *, CAST(dense_rank() OVER (ORDER BY tax) AS INT) AS tax_id FROM (
 SELECT *, count(*) OVER () > 20000 AS truncated FROM (
  SELECT l.offer_id, l.product_name, l.region, CAST(l.price AS DOUBLE) AS price, l.currency, {SHORT} AS tax,
         CAST(r.price_min AS DOUBLE) AS price_min, CAST(r.price_max AS DOUBLE) AS price_max, r.n AS observations,
         l.brand AS axis_brand, l.material_key AS axis_finish, count(*) OVER (PARTITION BY l.product_id, l.price, l.currency, l.region) AS alike
  FROM {FLAT} AS l JOIN {RANGES} AS r ON r.offer_id = l.offer_id {RULED} WHERE l.source_key = 'ASIA') AS g
 ORDER BY product_name, region, offer_id LIMIT 20000) AS shown
"""


@query("p10_grid_rows", GRID_SQL)
def _(v):
    # One source's grid: the source is pushed into the scan of the facts before anything is joined. Tax states are numbered over the rows shown.
    own = v.obs.join(v.site.where("source_key = 'ASIA'").select("source_id"), "source_id", "left_semi")
    rows = v.flat(history.extremes(own, CARRIED), priced=True)
    rows = lookups.most_specific(rows, v.tax_rule, ["region", "material_key"], ["source_key"])
    mode = F.when(F.col("tax_included") == 1, "incl").otherwise("excl")
    tax = x.tax_short_label(mode, F.col("tax_rate_pct"), F.coalesce("tax_evidence", F.lit("unknown")))
    grid = rows.select(
        "offer_id",
        "product_name",
        "region",
        F.col("current").cast("double").alias("price"),
        "currency",
        tax.alias("tax"),
        F.col("lowest").cast("double").alias("price_min"),
        F.col("highest").cast("double").alias("price_max"),
        F.col("n").alias("observations"),
        F.col("brand").alias("axis_brand"),
        F.col("material_key").alias("axis_finish"),
        F.count("*").over(Window.partitionBy("product_id", "current", "currency", "region")).alias("alike"),
    )
    shown = export.capped(grid, ["product_name", "region", "offer_id"], 20_000)
    return shown.withColumn("tax_id", F.dense_rank().over(Window.orderBy("tax")))


@query(
    "o7_truncation_flag",
    """SELECT offer_id, region, (SELECT count(*)
    FROM offer) > 5000 AS truncated FROM offer
    ORDER BY region, offer_id LIMIT 5000""",
)
def _(v):
    return export.capped(v.offer.select("offer_id", "region"), ["region", "offer_id"], 5000)


@query(
    "p15_record_page",
    """SELECT c_custkey, c_name, CASE WHEN (SELECT count(*)
    FROM customer WHERE c_custkey > 100) > 30 THEN max(c_custkey) OVER () END AS next_cursor
    FROM (SELECT c_custkey, c_name FROM customer
    WHERE c_custkey > 100
    ORDER BY c_custkey LIMIT 30) AS p""",
)
def _(v):
    page = lookups.after_key(v.customer.select("c_custkey", "c_name"), "c_custkey", 100, 30)  # thirty rows
    last = F.max("c_custkey").over(Window.partitionBy())
    return page.select("c_custkey", "c_name", F.when(F.col("has_more"), last).alias("next_cursor"))


DETAILS_SQL = """
SELECT a.product_id, o.region, concat('S', o.offer_id) AS sku, a.attribute_group, a.label, a.raw_value
FROM (SELECT p_partkey AS product_id, 'Details' AS attribute_group, 'brand' AS label, p_brand AS raw_value FROM part
      UNION ALL SELECT p_partkey, 'Details', 'brand_ar', upper(p_brand) FROM part WHERE p_size % 3 = 0
      UNION ALL SELECT p_partkey, 'Make', 'Finish', p_type FROM part UNION ALL SELECT p_partkey, 'Make', 'Size', CAST(p_size AS VARCHAR) FROM part) AS a
JOIN (SELECT product_id, min(offer_id) AS offer_id, min(region) AS region FROM offer WHERE status = 'active' GROUP BY product_id) AS o ON o.product_id = a.product_id
"""


def attributes(v):
    """Details of products in long form: code, label where one is published, group where one is known."""
    rows = "stack(4, 'brand', null, null, p_brand, 'brand_ar', null, ' ', if(p_size % 3 = 0, upper(p_brand), null), 'finish', 'Finish', 'Make', p_type, 'size', 'Size', 'Make', cast(p_size as string))"
    long = v.part.select(F.col("p_partkey").alias("product_id"), F.expr(rows).alias("code", "label", "attribute_group", "raw_value"))
    return long.withColumn("attribute_group", F.trim("attribute_group")).where("raw_value is not null")


@query("j16_details_export", DETAILS_SQL)
def _(v):
    offers = v.offer.withColumn("sku", F.concat(F.lit("S"), F.col("offer_id").cast("string")))
    return export.details(attributes(v), offers)


FOLD_SQL = f"""
SELECT product_id, CAST(price AS DOUBLE) AS price, currency, region, min(offer_id) AS offer_id, string_agg(CAST(offer_id AS VARCHAR), ',' ORDER BY offer_id) AS offer_ids,
 count(*) AS variants,
       CAST(min(price_min) AS DOUBLE) AS price_min, CAST(max(price_max) AS DOUBLE) AS price_max, string_agg(concat('S', source_id, '-', product_id), ', ' ORDER BY source_id) AS sku, string_agg(DISTINCT brand, ', ') AS variant,
       CASE WHEN count(DISTINCT availability) = 1 THEN min(availability) END AS availability, CASE WHEN count(DISTINCT tax_included) = 1 THEN min(tax_included) END AS tax_included
FROM (SELECT l.*, r.price_min, r.price_max FROM {FLAT} AS l JOIN {RANGES} AS r ON r.offer_id = l.offer_id) AS c GROUP BY product_id, price, currency, region
"""


@query("a18_folded_variants", FOLD_SQL)
def _(v):
    sku = F.concat(F.lit("S"), F.col("source_id").cast("string"), F.lit("-"), F.col("product_id").cast("string"))
    rows = v.flat(history.extremes(v.obs, CARRIED), priced=True).withColumnsRenamed({"current": "price", "lowest": "price_min", "highest": "price_max"})
    out = export.folded(rows.withColumn("sku", sku).withColumn("variant", F.col("brand")), ["sku", "variant"], ["availability", "tax_included"])
    ids = F.array_join(F.transform("offer_ids", lambda i: i.cast("string")), ",")
    return out.withColumn("offer_ids", ids).withColumns({c: F.col(c).cast("double") for c in ("price", "price_min", "price_max")})


HEADED_SQL = """
SELECT p_name, count(*) AS n, CASE WHEN count(*) > 1 THEN string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) END AS rows, count(*) > 1 AS nested
FROM (SELECT p_partkey, concat(p_name, ' ', p_retailprice) AS p_name FROM part) AS p GROUP BY p_name
"""


@query("a25_headings", HEADED_SQL)
def _(v):
    rows = v.part.select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string")).alias("p_name"))
    out = export.headed(rows, "p_name", "p_partkey")
    return out.withColumn("rows", F.array_join(F.transform("rows", lambda k: k.cast("string")), ","))


BUNDLE = {"current": "offer_id long, region string, price double, currency string", "details": "product_id long, code string, raw_value string", "history": "offer_id long, observed_at timestamp_ntz, ord1 long, price double"}
BUNDLE_SQL = f"""
SELECT t.*, k.format FROM (
 SELECT 'current' AS "table", source_key, count(*) AS rows, 4 AS columns FROM {FLAT} AS l GROUP BY source_key
 UNION ALL SELECT 'details', s.source_key, count(*), 3 FROM product p JOIN site s ON s.source_id = p.source_id GROUP BY s.source_key
 UNION ALL SELECT 'history', s.source_key, count(*), 4 FROM obs o JOIN site s ON s.source_id = o.source_id GROUP BY s.source_key) AS t
CROSS JOIN (VALUES ('json'), ('csv')) AS k(format)
"""


def bundle(v, flat=None):
    """The tables of an export."""
    flat = v.flat(history.latest_per_offer(v.facts)) if flat is None else flat
    brand = v.product.join(v.site, "source_id").select("source_key", "product_id", F.lit("brand").alias("code"), F.col("brand").alias("raw_value"))
    return {
        "current": flat.select("source_key", "offer_id", "region", *double("price"), "currency"),
        "details": brand,
        "history": v.obs.join(v.site, "source_id").select("source_key", "offer_id", "observed_at", "ord1", *double("price")),
        "never": brand.limit(0),
    }


@query("s10_exported_offers", BUNDLE_SQL)
def _(v):
    folder = jobs.work_folder(v.spark, "bundle")
    export.write_bundle(bundle(v), folder)
    read = {k: f"{schema}, source_key string" for k, schema in BUNDLE.items()}
    found = [export.contents(v.spark, folder, read, kind).withColumn("format", F.lit(kind)) for kind in ("json", "csv")]
    return found[0].unionByName(found[1]).drop("digest")


FAULTS_SQL = f"""
SELECT source_key, CASE source_key WHEN 'ASIA' THEN 'missing' WHEN 'ORIENT' THEN 'unexpected' ELSE 'changed' END AS fault FROM (
 SELECT DISTINCT source_key FROM {FLAT} AS l
 WHERE source_key = 'ASIA' OR (source_key = 'EUROPE' AND currency = 'EGP')
 UNION ALL SELECT 'ORIENT' WHERE EXISTS (SELECT 1
 FROM {FLAT} AS l WHERE source_key = 'ASIA')) AS f
"""


@query("s11_export_faults", FAULTS_SQL)
def _(v):
    # An export of all sources, and a second one in which one source has another name and the rows of one lost their Egyptian prices.
    flat = v.flat(history.latest_per_offer(v.facts)).select("source_key", "offer_id", "region", *double("price"), "currency")
    flat = jobs.table_writer(v.spark, "faults")(flat, "flat")  # both exports are made from it
    key = F.col("source_key")
    other = flat.where((key != "EUROPE") | (F.col("currency") != "EGP")).withColumn("source_key", F.when(key == "ASIA", "ORIENT").otherwise(key))
    read, sides = {"current": f"{BUNDLE['current']}, source_key string"}, []
    for rows in (flat, other):
        folder = jobs.work_folder(v.spark, "bundle")
        export.write_bundle({"current": rows}, folder)
        sides.append(export.contents(v.spark, folder, read))
    return export.faults(*sides, ["table", "source_key"]).select("source_key", "fault")


@query("s12_packed_stream", "SELECT p_partkey, p_name FROM part")
def _(v):
    stream = P.packed({("shop", "part"): v.part.select("p_partkey", "p_name"), ("shop", "nation"): v.nation, ("other", "part"): v.part.select("p_partkey", "p_name")})
    folder = jobs.work_folder(v.spark, "pack")
    P.write_pack(stream, folder)
    return P.unpacked(P.read_pack(v.spark, folder), "shop", "part", "p_partkey long, p_name string")


CONTRACTS = [
    ("ASIA", "shop", "*", "*", "*", 10, 0.2),
    ("EUROPE", "shop", "NATION_7,NATION_8", "*", "*", 10, 0.5),
    ("AFRICA", "directory", "*", "*", "ECONOMY,PROMO", 5, 0.3),
]
CONTRACT = "source_key string, family string, regions string, scope string, materials string, min_rows int, max_drop double"
CONTRACTS_SQL = f"""
SELECT s.source_key, c.family, c.regions, c.scope, c.materials, c.min_rows, CAST(c.max_drop AS DOUBLE) AS max_drop, o.rows, CASE WHEN c.family IS NULL THEN 'undeclared' WHEN o.rows < c.min_rows THEN 'below minimum' ELSE 'declared' END AS state
FROM site s JOIN (SELECT source_id, count(*) AS rows FROM obs GROUP BY source_id) AS o ON o.source_id = s.source_id
LEFT JOIN (VALUES {', '.join(map(str, CONTRACTS))}) AS c(source_key, family, regions, scope, materials, min_rows, max_drop) ON c.source_key = s.source_key
"""


def contracts(v):
    return v.spark.createDataFrame(CONTRACTS, CONTRACT)


@query("s9_source_contracts", CONTRACTS_SQL)
def _(v):
    seen = v.facts.groupBy("source_id").agg(F.count("*").alias("rows"))
    rows = v.site.join(seen, "source_id").join(contracts(v), "source_key", "left")
    state_ = F.when(F.col("family").isNull(), "undeclared").when(F.col("rows") < F.col("min_rows"), "below minimum").otherwise("declared")
    return rows.withColumn("state", state_).drop("source_id")


BOARD_SQL = """
SELECT category, state, count(*) AS n FROM (
 SELECT 'shop' AS category, CASE WHEN source_key IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'declared' ELSE 'undeclared' END AS state FROM site
 UNION ALL SELECT 'directory', CASE WHEN count(DISTINCT run_date) >= 30 THEN 'current' ELSE 'behind' END FROM sighting GROUP BY dataset_key) AS b GROUP BY category, state
"""


@query("u7_source_board", BOARD_SQL)
def _(v):
    declared = contracts(v).select("source_key", F.lit("declared").alias("state"))
    shops = v.site.join(declared, "source_key", "left").select(F.lit("shop").alias("category"), F.coalesce("state", F.lit("undeclared")).alias("state"))
    runs = v.sighting.groupBy("dataset_key").agg(F.count_distinct("run_date").alias("runs"))
    directories = runs.select(F.lit("directory").alias("category"), F.when(F.col("runs") >= 30, "current").otherwise("behind").alias("state"))
    return shops.unionByName(directories).groupBy("category", "state").agg(F.count("*").alias("n"))


PUBLISHED_SQL = """
SELECT o.offer_id, o.ord1, o.ord2, o.ord3, m.material_id, m.material_name, p.brand, CAST(o.price AS DOUBLE) AS price, o.provenance FROM (
 SELECT *, max(CASE WHEN provenance = 'observed' THEN 1 ELSE 0 END) OVER (PARTITION BY offer_id) AS any_observed,
        row_number() OVER (PARTITION BY offer_id ORDER BY CASE WHEN provenance = 'observed' THEN 0 ELSE 1 END, business_date DESC, observed_at DESC, ord1 DESC,
        ord2 DESC, ord3 DESC, ord4 DESC) AS rn FROM obs) AS o
JOIN product p ON p.source_id = o.source_id AND p.product_id = o.product_id JOIN part ON p_partkey = o.product_id
JOIN material m ON m.material_name = p.product_name
WHERE (o.rn = 1 OR o.any_observed = 0) AND p_size % 3 = 1
"""


@query("j2_published_prices", PUBLISHED_SQL)
def _(v):
    # Decisions on pairs of equal names: approved, approved and undone, or separated first; only what is approved and open is published.
    pairs = v.part.join(v.material, F.col("p_name") == F.col("material_name")).select(F.col("p_partkey").alias("product_id"), "material_id", "material_name", "p_size")
    third = F.col("p_size") % 3
    said = F.array(F.when(third == 2, F.lit("separate")).otherwise("approve"), F.when(third == 0, F.lit("undo")).when(third == 2, "approve"))
    events = pairs.select("product_id", "material_id", F.posexplode(said).alias("at", "decision")).where("decision is not null")
    approved = matching.decisions(events).where("state = 'approved'").join(pairs.select("product_id", "material_id", "material_name"), ["product_id", "material_id"])
    rows = v.priced(history.published(v.facts)).join(approved, "product_id").join(v.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand")), "product_id")
    return rows.select("offer_id", "ord1", "ord2", "ord3", "material_id", "material_name", "brand", *double("price"), "provenance")


PINS_SQL = "SELECT offer_id, ord1, ord2, ord3, CASE WHEN provenance = 'reported' THEN 'stale' ELSE 'kept' END AS pin FROM obs WHERE ord4 = 50"


@query("j15_stale_pins", PINS_SQL)
def _(v):
    keys = ["offer_id", "ord1", "ord2", "ord3"]
    pins = v.facts.where("ord4 = 50").select(*keys)
    return retention.pinned(pins, v.facts.where("provenance <> 'reported'"), keys)


FLAGS_SQL = """
SELECT s_suppkey, change FROM (
 SELECT s_suppkey, CASE WHEN l.l_suppkey IS NULL THEN 'never collected' WHEN last >= TIMESTAMP '2001-06-01' AND s_acctbal < 0 THEN 'deactivate' WHEN last < TIMESTAMP '2001-06-01' AND s_acctbal >= 0 THEN 'activate' END AS change
 FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_suppkey) AS l ON l_suppkey = s_suppkey
 UNION ALL SELECT DISTINCT l_suppkey, 'undeclared' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)) AS f WHERE change IS NOT NULL
"""


@query("j18_active_flags", FLAGS_SQL)
def _(v):
    # Stored sources are active while they deliver; the registry declares those in credit active. Only what differs comes back.
    stored = v.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.max("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz")).alias("active"))
    declared = v.supplier.select("s_suppkey", (F.col("s_acctbal") >= 0).alias("declared"))
    return lookups.reconciled(stored, declared, "s_suppkey")


STATES_SQL = f"""
SELECT r.record_id, r.rev, CASE WHEN l.last_seen_at IS NULL THEN 'unsighted' WHEN r.gone AND l.last_seen_at > TIMESTAMP '2024-01-15' THEN 'returned' WHEN r.gone AND l.last_seen_at < TIMESTAMP '2024-01-15' THEN 'absent'
 WHEN l.first_seen_at >= TIMESTAMP '2024-01-25' THEN 'new' WHEN r.changed THEN 'changed' WHEN l.last_seen_at < TIMESTAMP '2024-01-25' THEN 'stale' ELSE 'current' END AS state
FROM (SELECT a.record_id, max(b.rev) AS rev, bool_or(a.segment <> b.segment) AS changed, bool_or(a.segment LIKE 'AUTO%') AS gone
 FROM record_rev a JOIN record_rev b ON b.record_id = a.record_id AND a.rev = 1 AND b.rev = 2
 GROUP BY a.record_id) AS r
LEFT JOIN (SELECT external_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at
 FROM {LEDGER} AS g
 GROUP BY external_id) AS l ON l.external_id = CAST(r.record_id AS VARCHAR)
"""


@query("j20_record_states", STATES_SQL)
def _(v):
    # Records with their revisions and sightings: what changed is known from the revisions, what was absent from a run over one segment.
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    changed = ingest.field_changes(v.record_rev, "record_id", "rev", ["segment"]).select("record_id", at("2024-01-26").alias("changed_at"))
    last = v.record_rev.groupBy("record_id").agg(F.max("rev").alias("rev"), F.min_by("segment", "rev").alias("segment"))
    seen = audits.ledger(v.sighting).groupBy(F.col("external_id").cast("long").alias("record_id")).agg(F.min("first_seen_at").alias("first"), F.max("last_seen_at").alias("last"))
    rows = last.join(changed, "record_id", "left").join(seen, "record_id", "left")
    absent = F.when(F.col("segment").startswith("AUTO"), at("2024-01-15"))
    word = audits.row_state(F.lit("active"), F.col("first"), F.col("last"), absent, F.col("changed_at"), at("2024-01-25"))
    return rows.select("record_id", "rev", word.alias("state"))


WATCH_SQL = f"""
SELECT s.source_key, count(*) AS total, count(*) FILTER (WHERE l.provenance = 'reported') AS state_not_derived, count(*) FILTER (WHERE p.curation = 'inventoried') AS needs_curation,
       count(m.offer_id) AS moved, count(*) FILTER (WHERE z.last_day < DATE '2001-01-01') AS missing
FROM {LATEST} AS l JOIN site s ON s.source_id = l.source_id JOIN product p ON p.source_id = l.source_id AND p.product_id = l.product_id
JOIN (SELECT offer_id, max(business_date) AS last_day FROM obs GROUP BY offer_id) AS z ON z.offer_id = l.offer_id
LEFT JOIN (SELECT DISTINCT offer_id FROM {PERIODS} AS p
 WHERE opened_because = 'price_change' AND first_detected_at >= TIMESTAMP '2001-06-01') AS m ON m.offer_id = l.offer_id
GROUP BY s.source_key
"""


@query("a4_watch_strip", WATCH_SQL)
def _(v):
    # Latest row, last day and whether the price moved all come from windows over the offer: one scan and one shuffle of the facts.
    own = Window.partitionBy("offer_id")
    before = F.lag(F.struct("price", "currency")).over(own.orderBy(*history.ORDER))
    moves = (F.col("before.currency") == F.col("currency")) & (F.col("before.price") != F.col("price")) & F.expr("observed_at >= timestamp_ntz'2001-06-01'")
    rows = v.obs.withColumn("before", before).withColumn("moved", F.max(F.when(moves, 1)).over(own)).withColumn("last_day", F.max("business_date").over(own))
    rows = v.flat(history.latest_per_offer(rows.drop("before")), priced=True)
    many = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("source_key").agg(
        F.count("*").alias("total"),
        many(F.col("provenance") == "reported").alias("state_not_derived"),
        many(F.col("curation") == "inventoried").alias("needs_curation"),
        F.count("moved").alias("moved"),
        many(F.col("last_day") < F.lit("2001-01-01").cast("date")).alias("missing"),
    )


PROMOTABLE_SQL = """
SELECT kind, code, products FROM (
 SELECT 'attribute' AS kind, concat('only_', p_partkey) AS code, count(DISTINCT p_partkey) AS products FROM part WHERE p_size = 1 GROUP BY p_partkey

 UNION ALL SELECT 'attribute', code, count(DISTINCT p_partkey)
 FROM (SELECT p_partkey, concat('finish_', lower(p_type)) AS code
 FROM part
 UNION ALL SELECT p_partkey, 'brand' FROM part) AS a
 GROUP BY code

 UNION ALL SELECT 'axis', 'size', count(DISTINCT p_partkey)
 FROM part
 UNION ALL SELECT 'axis', 'colour', count(DISTINCT p_partkey)
 FROM part WHERE p_size > 25) AS c WHERE products > 1
"""


@query("a12_promotable_codes", PROMOTABLE_SQL)
def _(v):
    # Attribute codes of more than one product, and axes by the keys of the variants' options.
    codes = F.array(F.lit("brand"), F.concat(F.lit("finish_"), F.lower("p_type")), F.when(F.col("p_size") == 1, F.concat(F.lit("only_"), F.col("p_partkey").cast("string"))))
    axes = F.to_json(F.struct(F.col("p_size").alias("size"), F.when(F.col("p_size") > 25, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("colour")))
    return audits.promotable(v.part.select(F.col("p_partkey").alias("product_id"), codes.alias("codes"), axes.alias("axes")))


KEPT_SQL = "(SELECT offer_id, min(business_date) AS f, max(business_date) AS l, min(price) AS mi, max(price) AS ma FROM obs GROUP BY offer_id)"
REASON_SQL = f"""
SELECT reason, count(*) AS n, count(*) FILTER (WHERE business_date < DATE '1998-01-01') AS before_cut FROM (
 SELECT unnest(list_filter([CASE WHEN o.business_date = b.f THEN 'first' END, CASE WHEN o.business_date = b.l THEN 'latest' END, CASE WHEN o.price = b.mi THEN 'minimum' END,
 CASE WHEN o.price = b.ma THEN 'maximum' END,
   CASE WHEN o.business_date <> b.f AND o.business_date <> b.l AND o.price <> b.mi AND o.price <> b.ma THEN 'prunable' END], lambda r: r IS NOT NULL)) AS reason,
   o.business_date
 FROM obs o JOIN {KEPT_SQL} AS b ON b.offer_id = o.offer_id) AS x GROUP BY reason
"""


@query("a15_protected_reasons", REASON_SQL)
def _(v):
    old = F.count(F.when(F.col("business_date") < F.lit("1998-01-01").cast("date"), 1))
    return history.protected(v.obs, "prunable").groupBy("reason").agg(F.count("*").alias("n"), old.alias("before_cut"))


PIVOT_SQL = f"""
SELECT product_id, last(availability ORDER BY {ORD}) FILTER (WHERE availability <> 'unknown') AS "Availability", last(currency ORDER BY {ORD}) AS "Currency"
 FROM (SELECT product_id, availability, currency, {ORD}
 FROM obs) AS o
 GROUP BY product_id
"""


@query("a16_attribute_pivot", PIVOT_SQL)
def _(v):
    # Attributes as they were stated over time; the site filters by two of the three, and the last value of each stands.
    stated = "stack(3, 'availability', 'Availability', nullif(availability, 'unknown'), 'currency', 'Currency', currency, 'stock', 'Stock', cast(stock_quantity as string))"
    long = v.facts.select("product_id", history.in_order().alias("at"), F.expr(stated).alias("code", "label", "raw_value")).where("raw_value is not null")
    return audits.pivoted(long, ["availability", "currency"], "product_id")


CHARTER_SQL = """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'kg' WHEN p_size % 4 = 1 THEN 'm' WHEN p_size % 4 = 2 AND p_size % 3 <> 0 THEN 'kg' END AS unit,
       CASE WHEN p_size % 4 IN (0, 1) OR p_size % 4 = 2 AND p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS quantity,
       CASE p_size % 4 WHEN 0 THEN 'name:container' WHEN 1 THEN 'detail:quantity' WHEN 2 THEN CASE WHEN p_size % 3 <> 0 THEN 'name:quantity' END END AS witness
FROM part
"""


@query("f12_unit_charter", CHARTER_SQL)
def _(v):
    # A container, a detail and a quantity in the name bear witness; the weight field vetoes a quantity that it contradicts.
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    name = F.when(kind == 0, F.concat("p_name", F.lit(" bag of "), size, F.lit(" kg"))).when(kind == 2, F.concat("p_name", F.lit(" "), size, F.lit(" KG"))).otherwise(F.col("p_name"))
    detail = F.when(kind == 1, F.concat(size, F.lit(" m"))).when(kind == 3, "as shown")
    weight = F.when(kind == 2, F.concat((F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(" kg")))
    found = charter.resolved([("name", "container"), ("name", "quantity"), ("detail", "quantity")], ["kg", "m"], "weight")
    rows = v.part.select("p_partkey", name.alias("name"), detail.alias("detail"), weight.alias("weight"))
    return rows.select("p_partkey", *[found[k].alias(k) for k in ("unit", "quantity", "witness")])


CODES = list(x.COUNTRIES)
LIST = ", ".join(f"'{c}'" for c in CODES)
NAMES = ", ".join(f"'{n}'" for n in x.COUNTRIES.values())
REGIONS_SQL = f"""
SELECT c_custkey, CASE WHEN c_nationkey < {len(CODES)} THEN [{NAMES}][c_nationkey + 1] WHEN c_nationkey = {len(CODES)} THEN '' ELSE n_name END AS country,
       CASE WHEN c_nationkey < {len(CODES)} THEN [{LIST}][c_nationkey + 1] ELSE '' END AS code
FROM customer JOIN nation ON n_nationkey = c_nationkey
"""


@query("f18_region_names", REGIONS_SQL)
def _(v):
    key = F.col("c_nationkey").cast("int")
    code = F.when(key < len(CODES), F.lower(F.try_element_at(F.array(*map(F.lit, CODES)), key + 1))).when(key == len(CODES), "*").otherwise(F.col("n_name"))
    names = x.country_names(v.spark)
    rows = v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("country", x.region_name(code, names))
    return rows.select("c_custkey", "country", x.region_code(F.upper("country"), names).alias("code"))


@query("f19_tax_labels", f"SELECT l.offer_id, {LABEL} AS label, {SHORT} AS short_label FROM {FLAT} AS l {RULED}")
def _(v):
    # The rule says what is known, the row says whether its own figure holds the tax.
    rows = lookups.most_specific(v.flat(history.latest_per_offer(v.facts)), v.tax_rule, ["region", "material_key"], ["source_key"])
    said = (F.when(F.col("tax_included") == 1, "incl").otherwise("excl"), F.col("tax_rate_pct"), F.coalesce("tax_evidence", F.lit("unknown")))
    return rows.select("offer_id", x.tax_label(*said).alias("label"), x.tax_short_label(*said).alias("short_label"))


STORE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN flash > 0 THEN flash ELSE usual END / 100.0 AS price, CASE WHEN flash > 0 THEN usual / 100.0 END AS price_before,
       CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS BIGINT) / 100.0 END AS price_trade, flash > 0 AND usual > flash AS ranged
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS usual, CASE WHEN l_discount > 0.05 THEN CAST(round(l_extendedprice * 90) AS BIGINT) ELSE 0 END AS flash
 FROM lineitem) AS l
"""


@query("f20_storefront_price", STORE_SQL)
def _(v):
    usual = F.round(F.col("l_extendedprice") * 100).cast("long")
    flash = F.when(F.col("l_discount") > 0.05, F.round(F.col("l_extendedprice") * 90).cast("long")).otherwise(0)
    trade = F.when(F.col("l_quantity") > 40, F.col("l_quantity").cast("long"))
    tiers = x.storefront_price(usual, flash, trade, F.lit(2))
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(k) for k, c in tiers.items()], x.is_range(flash, usual).alias("ranged"))


DISCOVERED_SQL = """
SELECT CAST(c_custkey AS BIGINT) AS record_id, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS error, CASE WHEN c_custkey % 7 = 0 THEN 'revised' WHEN c_custkey % 2 = 0 THEN 'unchanged' ELSE 'new' END AS outcome,
 CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS rev
FROM customer WHERE c_custkey // 100 % 3 <> 2 AND c_nationkey <> 3
UNION ALL SELECT NULL, c_mktsegment, concat('n/a ', c_custkey), NULL, NULL FROM customer WHERE c_custkey // 100 % 3 <> 2 AND c_nationkey = 3
"""


@query("h8_discovered_records", DISCOVERED_SQL)
def _(v):
    # Tables are discovered; those with a header are approved; typed rows become revisions of records, and what has no id is told as an error.
    names, row = "<tr><th>id</th><th>segment</th></tr>", F.when(F.col("c_nationkey") == 3, F.concat(F.lit("n/a "), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    line = F.concat(F.lit("<tr><td>"), row, F.lit("</td><td>"), "c_mktsegment", F.lit("</td></tr>"))
    page = F.expr("c_custkey div 100").alias("page_id")
    body = v.customer.groupBy(page).agg(F.array_join(F.collect_list(line), "").alias("rows"))
    html = body.select("page_id", F.concat(F.when(F.col("page_id") % 3 == 2, "<table>").otherwise(f"<table>{names}"), F.col("rows"), F.lit("</table>")).alias("html"))
    approved = H.approved(H.html_tables(html), ["id", "segment"], 0.88)
    cells = approved.select("header", F.explode("rows").alias("cells")).select(F.map_from_arrays("header", "cells").alias("m"))
    typed = cells.select(x.converted(F.col("m")["id"], "integer").alias("record_id"), F.col("m")["segment"].alias("segment"), F.col("m")["id"].alias("said"))
    found = typed.where("record_id is not null").drop("said")
    held = v.customer.where("c_custkey % 7 = 0 or c_custkey % 2 = 0")
    old = F.when(F.col("c_custkey") % 7 == 0, "OLD").otherwise(F.col("c_mktsegment"))
    stored = held.select(F.col("c_custkey").alias("record_id"), old.alias("segment"), F.lit(1).alias("rev"))
    good = ingest.revised(stored, found, "record_id", ["segment"]).join(found, "record_id").withColumn("error", F.lit(None).cast("string"))
    bad = typed.where("record_id is null").select("record_id", "segment", F.col("said").alias("error"))
    return good.select("record_id", "segment", "error", "outcome", "rev").unionByName(bad, allowMissingColumns=True)

