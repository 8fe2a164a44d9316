"""Queries over the directory: sightings against stored records, matching, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import audits, matching
from tallyhouse.plans.register import query
from tallyhouse.streaming import jobs

LEDGER = "(SELECT dataset_key, external_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, count(DISTINCT run_date) AS seen_count FROM sighting WHERE trim(external_id) <> '' GROUP BY dataset_key, external_id)"


@query("t16_sighting_ledger", f"SELECT dataset_key, external_id, first_seen_at, last_seen_at, seen_count FROM {LEDGER} AS l")
def _(v):
    return audits.ledger(v.sighting)


@query(
    "u5_merged_ledgers",
    f"""SELECT dataset_key, external_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, max(seen_count) AS seen_count
    FROM ({' UNION ALL '.join(f'SELECT * FROM {LEDGER.replace("WHERE", f"WHERE event_id % 2 = {k} AND")} AS l{k}' for k in (0, 1))}) AS m
    GROUP BY dataset_key, external_id""",
)
def _(v):
    return audits.merged_ledgers(audits.ledger(v.sighting.where("event_id % 2 = 0")), audits.ledger(v.sighting.where("event_id % 2 = 1")))


@query("a8_frequency_of_frequencies", f"SELECT dataset_key, seen_count, count(*) AS ids FROM {LEDGER} AS l GROUP BY dataset_key, seen_count")
def _(v):
    return audits.ledger(v.sighting).groupBy("dataset_key", "seen_count").agg(F.count("*").alias("ids"))


@query(
    "j10_missing_ids",
    f"""SELECT l.dataset_key, l.external_id, l.seen_count
    FROM {LEDGER} AS l WHERE NOT EXISTS (SELECT 1
    FROM stored_record s WHERE s.dataset_key = l.dataset_key AND s.external_id = l.external_id)""",
)
def _(v):
    return audits.missing(audits.ledger(v.sighting), v.stored_record).select("dataset_key", "external_id", "seen_count").orderBy(F.col("seen_count").desc(), F.col("external_id").cast("long"))


@query(
    "o6_strongest_missing",
    f"""SELECT l.external_id, l.seen_count FROM {LEDGER} AS l
    WHERE l.dataset_key = 'click' AND NOT EXISTS (SELECT 1
    FROM stored_record s WHERE s.dataset_key = l.dataset_key AND s.external_id = l.external_id)
    ORDER BY l.seen_count DESC, CAST(l.external_id AS BIGINT) LIMIT 20""",
)
def _(v):
    rows = audits.missing(audits.ledger(v.sighting).where("dataset_key = 'click'"), v.stored_record)
    return rows.orderBy(F.col("seen_count").desc(), F.col("external_id").cast("long")).limit(20).select("external_id", "seen_count")


@query(
    "j11_departures",
    f"""SELECT s.external_id, CASE WHEN l.last_seen_at IS NULL THEN 'unsighted' ELSE 'gone' END AS departure
    FROM stored_record s
    LEFT JOIN {LEDGER} AS l ON l.dataset_key = s.dataset_key AND l.external_id = s.external_id
    WHERE s.status = 'active' AND (l.last_seen_at IS NULL OR l.last_seen_at < TIMESTAMP '2024-01-20')""",
)
def _(v):
    return audits.departures(v.stored_record, audits.ledger(v.sighting), "2024-01-20").select("external_id", "departure")


@query(
    "j12_coverage",
    f"""SELECT l.dataset_key, count(*) AS seen, count(s.external_id) AS stored, count(s.external_id) / count(*) AS share
    FROM {LEDGER} AS l
    LEFT JOIN (SELECT DISTINCT dataset_key, external_id
    FROM stored_record) AS s ON s.dataset_key = l.dataset_key AND s.external_id = l.external_id
    GROUP BY l.dataset_key""",
)
def _(v):
    return audits.coverage(audits.ledger(v.sighting), v.stored_record)


@query(
    "a10_pagination_drift",
    """SELECT dataset_key, run_date, CAST(sum(CASE WHEN pages > 1 THEN 1 ELSE 0 END) AS BIGINT) AS drifting, CAST(sum(slots - 1) AS BIGINT) AS shown_again, count(*) AS ids
    FROM (SELECT dataset_key, run_date, external_id, count(DISTINCT page_no) AS pages, count(*) AS slots
    FROM sighting
    GROUP BY dataset_key, run_date, external_id) AS p
    GROUP BY dataset_key, run_date""",
)
def _(v):
    return audits.drift(v.sighting, ["dataset_key", "run_date"])


@query(
    "a9_uniqueness",
    """SELECT trim(c_name) AS value, count(DISTINCT c_custkey) AS identities
    FROM (SELECT c_custkey, concat(c_mktsegment, ' ', CAST(c_nationkey AS VARCHAR)) AS c_name
    FROM customer) AS c
    GROUP BY trim(c_name)
    HAVING count(DISTINCT c_custkey) > 1""",
)
def _(v):
    rows = v.customer.select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("c_name"))
    return audits.shared_values(rows, "c_name", "c_custkey")


@query("a11_column_profile", """SELECT 'p_partkey' AS "column", count(p_partkey) AS filled, count(DISTINCT p_partkey) AS "values", 'integer' AS kind, TRUE AS identifies
 FROM part
 UNION ALL SELECT 'p_name', count(p_name), count(DISTINCT p_name), 'text', count(DISTINCT p_name) = count(*)
 FROM part
 UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size), 'integer', count(DISTINCT p_size) = count(*)
 FROM part
 UNION ALL SELECT 'p_retailprice', count(p_retailprice), count(DISTINCT p_retailprice), 'decimal', count(DISTINCT p_retailprice) = count(*)
 FROM part""")
def _(v):
    return audits.profile(v.part.select("p_partkey", "p_name", "p_size", "p_retailprice"))


@query(
    "a21_fill_report",
    """SELECT source_id, 'region' AS \"column\", count(region) AS filled
    FROM offer
    GROUP BY source_id
    UNION ALL SELECT source_id, 'unit_code', count(unit_code)
    FROM offer
    GROUP BY source_id
    UNION ALL SELECT source_id, 'status', count(status)
    FROM offer
    GROUP BY source_id""",
)
def _(v):
    return audits.presence(v.offer.select("source_id", "region", "unit_code", "status"), "source_id")


@query("p8_filled_columns", "SELECT region, unit_code FROM offer")
def _(v):
    rows = v.offer.select("region", "unit_code", F.lit("").alias("never_filled"))
    filled = rows.agg(*[F.count(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in rows.columns]).first().asDict()
    return rows.select(*[c for c in rows.columns if filled[c]])


CELLS = "(SELECT d.dataset_key, d.declared, count(DISTINCT s.external_id) AS seen FROM (VALUES ('click', 150), ('view', 151), ('error', 150), ('buy', NULL)) AS d(dataset_key, declared) LEFT JOIN sighting s ON s.dataset_key = d.dataset_key GROUP BY d.dataset_key, d.declared)"
DECLARED = [("click", 150), ("view", 151), ("error", 150), ("buy", None)]


def cells(v):
    return audits.completeness(v.sighting, v.spark.createDataFrame(DECLARED, "dataset_key string, declared int"), "dataset_key")


@query(
    "a19_partition_completeness",
    f"""SELECT dataset_key, declared, seen, declared - seen AS deficit, CASE WHEN declared IS NULL THEN 'unsized' WHEN declared <= seen THEN 'complete' ELSE 'short' END AS verdict
    FROM {CELLS} AS c""",
)
def _(v):
    return cells(v)


@query(
    "a20_exhaustiveness",
    f"""SELECT CAST(sum(declared) AS BIGINT) AS declared, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(CASE WHEN declared > seen THEN declared - seen ELSE 0 END) AS BIGINT) AS deficit,
    bool_and(coalesce(declared <= seen, FALSE)) AS complete
    FROM {CELLS} AS c""",
)
def _(v):
    return audits.exhaustiveness(cells(v))


@query("w11_convergence", """SELECT dataset_key, run_date, fresh, so_far, CAST(sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_key,
 island
 ORDER BY run_date) AS BIGINT) AS dry, sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_key, island
 ORDER BY run_date) >= 2 AS converged FROM (
 SELECT *, CAST(sum(fresh) OVER (PARTITION BY dataset_key ORDER BY run_date) AS BIGINT) AS so_far, sum(CASE WHEN fresh > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_key
 ORDER BY run_date) AS island FROM (
  SELECT r.dataset_key, r.run_date, count(f.external_id) AS fresh
  FROM (SELECT DISTINCT dataset_key, run_date
  FROM sighting) AS r
  LEFT JOIN (SELECT dataset_key, external_id, min(run_date) AS first
  FROM sighting
  GROUP BY dataset_key, external_id) AS f ON f.dataset_key = r.dataset_key AND f.first = r.run_date
  GROUP BY r.dataset_key, r.run_date) AS a) AS b""")
def _(v):
    return audits.convergence(v.sighting, "dataset_key")


@query(
    "t17_proved_absences",
    """SELECT s.dataset_key, s.external_id FROM stored_record s
    WHERE NOT EXISTS (SELECT 1 FROM sighting g
    WHERE g.dataset_key = s.dataset_key AND g.external_id = s.external_id AND g.run_date = DATE '2024-01-15')""",
)
def _(v):
    run = v.sighting.where("run_date = date'2024-01-15'").select("dataset_key", "external_id").distinct()
    return v.stored_record.join(run, ["dataset_key", "external_id"], "left_anti").select("dataset_key", "external_id")


@query("t18_availability_marks", f"""SELECT s.external_id, CASE WHEN s.status = 'active' THEN 'unavailable' ELSE 'restored' END AS mark
 FROM stored_record s
 LEFT JOIN {LEDGER} AS l ON l.dataset_key = s.dataset_key AND l.external_id = s.external_id
 WHERE (s.status = 'active' AND CAST(s.external_id AS BIGINT) % 2 = 0 AND coalesce(l.last_seen_at < TIMESTAMP '2024-01-28', TRUE)) OR (s.status = 'unavailable' AND CASE WHEN CAST(s.external_id AS BIGINT) % 2 = 0 THEN coalesce(l.last_seen_at > TIMESTAMP '2024-01-28',
 FALSE) ELSE l.last_seen_at IS NOT NULL END)""")
def _(v):
    absent = v.stored_record.where("cast(external_id as bigint) % 2 = 0").select("dataset_key", "external_id", F.lit("2024-01-28").cast("timestamp_ntz").alias("last_absent_at"))
    return audits.availability_marks(v.stored_record, audits.ledger(v.sighting), absent).select("external_id", "mark")


@query("t19_row_states", f"""SELECT s.external_id, CASE
 WHEN s.status = 'unavailable' THEN CASE WHEN l.last_seen_at > a THEN 'returned' ELSE 'unavailable' END
 WHEN l.last_seen_at IS NULL THEN 'unsighted' WHEN a IS NOT NULL AND l.last_seen_at > a THEN 'returned' WHEN a IS NOT NULL AND l.last_seen_at < a THEN 'absent'
 WHEN l.first_seen_at >= TIMESTAMP '2024-01-25' THEN 'new' WHEN c >= TIMESTAMP '2024-01-25' THEN 'changed' WHEN l.last_seen_at < TIMESTAMP '2024-01-25' THEN 'stale' ELSE 'current' END AS state
 FROM (SELECT *, CASE WHEN CAST(external_id AS BIGINT) % 5 = 0 THEN TIMESTAMP '2024-01-20' END AS a, CASE WHEN CAST(external_id AS BIGINT) % 7 = 0 THEN TIMESTAMP '2024-01-26' END AS c
 FROM stored_record) AS s
 LEFT JOIN {LEDGER} AS l ON l.dataset_key = s.dataset_key AND l.external_id = s.external_id""")
def _(v):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    number = F.col("external_id").cast("long")
    rows = v.stored_record.join(audits.ledger(v.sighting), ["dataset_key", "external_id"], "left")
    state = audits.row_state(F.col("status"), F.col("first_seen_at"), F.col("last_seen_at"), F.when(number % 5 == 0, at("2024-01-20")), F.when(number % 7 == 0, at("2024-01-26")), at("2024-01-25"))
    return rows.select("external_id", state.alias("state"))


LIKE = "max(len(list_intersect(p.t, m.t)) / len(list_distinct(list_concat(p.t, m.t))))"
PAIRS = f"""(SELECT p.product_id, m.material_id, {LIKE} AS confidence
 FROM (SELECT DISTINCT product_id, string_split(lower(product_name), ' ') AS t FROM product) AS p
 CROSS JOIN (SELECT material_id, string_split(lower(material_name), ' ') AS t FROM material
 UNION ALL SELECT material_id, string_split(lower(material_name_alt), ' ') FROM material) AS m
 GROUP BY p.product_id, m.material_id HAVING {LIKE} >= 0.55)"""


def _products(v):
    return v.product.select("product_id", "product_name").distinct().withColumn("sku", (F.col("product_id") * 7).cast("string"))


def _fuzzy(v):
    return matching.by_name(_products(v), v.material, ["product_name"], ["material_name", "material_name_alt"])


@query("j8_fuzzy_names", f"SELECT product_id, material_id, round(confidence, 6) AS confidence FROM {PAIRS} AS p")
def _(v):
    return _fuzzy(v).select("product_id", "material_id", F.round("confidence", 6).alias("confidence"))


@query(
    "j6_identifier_match",
    """SELECT DISTINCT p.product_id, m.material_id, 'gtin' AS method, 0.99 AS confidence
    FROM product p JOIN material m ON CAST(p.product_id * 7 AS VARCHAR) = m.gtin""",
)
def _(v):
    return matching.by_key(_products(v), v.material, "sku", "gtin", "gtin")


@query(
    "j7_alias_match",
    """SELECT DISTINCT p.product_id, m.material_id, 'alias' AS method, 0.85 AS confidence
    FROM product p JOIN material m ON p.product_name = m.material_name
    WHERE m.material_id % 2 = 0""",
)
def _(v):
    approved = v.material.where("material_id % 2 = 0").select("material_id", F.col("material_name").alias("alias"))
    return matching.by_key(_products(v), approved, "product_name", "alias", "alias")


CANDIDATES = f"(SELECT product_id, material_id, 'fuzzy' AS method, confidence FROM {PAIRS} AS f UNION ALL SELECT DISTINCT p.product_id, m.material_id, 'gtin', 0.99 FROM product p JOIN material m ON CAST(p.product_id * 7 AS VARCHAR) = m.gtin)"


@query(
    "w12_best_candidate",
    f"""SELECT product_id, material_id, method
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE method WHEN 'gtin' THEN 0 ELSE 1 END, confidence DESC,
    material_id) AS rn FROM {CANDIDATES} AS c) AS x
    WHERE rn = 1""",
)
def _(v):
    exact = matching.by_key(_products(v), v.material, "sku", "gtin", "gtin")
    return matching.best(_fuzzy(v).unionByName(exact)).select("product_id", "material_id", "method")


@query(
    "j9_undecided_products",
    f"""SELECT product_id, material_id, method FROM {CANDIDATES} AS c
    WHERE product_id % 5 <> 0 AND NOT (product_id % 3 = 0 AND material_id % 2 = 0)""",
)
def _(v):
    # Products and candidates are made once and read from there: decided products and blocked pairs name some of them.
    write = jobs.table_writer(v.spark, "candidates")
    products, materials = write(_products(v), "products"), write(v.material, "materials")
    fuzzy = matching.by_name(products, materials, ["product_name"], ["material_name", "material_name_alt"])
    rows = write(fuzzy.unionByName(matching.by_key(products, materials, "sku", "gtin", "gtin")), "candidates")
    blocked = rows.where("product_id % 3 = 0 and material_id % 2 = 0")
    return matching.undecided(rows, products.where("product_id % 5 = 0"), blocked).select("product_id", "material_id", "method")


@query(
    "j21_review_queue",
    f"""SELECT c.product_id, c.material_id, p.product_name, m.material_name, concat_ws(',', CASE WHEN p.product_name = m.material_name THEN 'name' END, CASE WHEN CAST(p.product_id * 7 AS VARCHAR) = m.gtin THEN 'gtin' END) AS matched
    FROM {PAIRS} AS c JOIN (SELECT DISTINCT product_id, product_name
    FROM product) AS p ON p.product_id = c.product_id
    JOIN material m ON m.material_id = c.material_id""",
)
def _(v):
    rows = _fuzzy(v).join(_products(v), "product_id").join(v.material, "material_id")
    matched = F.array_join(F.array_compact(F.array(F.when(F.col("product_name") == F.col("material_name"), F.lit("name")), F.when(F.col("sku") == F.col("gtin"), F.lit("gtin")))), ",")
    return rows.select("product_id", "material_id", "product_name", "material_name", matched.alias("matched"))


@query("t22_decisions", """SELECT product_id, material_id, CASE WHEN product_id % 3 = 0 THEN 'pending' WHEN product_id % 3 = 1 THEN 'approved' ELSE 'separate' END AS state,
 CASE WHEN product_id % 3 = 2 THEN 1 ELSE 0 END AS conflicts
 FROM (SELECT p_partkey AS product_id, p_size AS material_id
 FROM part) AS p""")
def _(v):
    one = v.part.select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("material_id"))
    third = F.col("product_id") % 3
    said = F.array(F.when(third == 2, F.lit("separate")).otherwise("approve"), F.when(third == 0, F.lit("undo")).when(third == 2, "approve"))
    events = one.select("product_id", "material_id", F.posexplode(said).alias("at", "decision")).where("decision is not null")
    return matching.decisions(events)
