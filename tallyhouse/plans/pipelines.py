"""Queries over batches, catalogues, pages and stateful jobs; each builds its input from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import history, ingest
from tallyhouse.plans.register import query
from tallyhouse.sources import payloads as P
from tallyhouse.streaming import jobs

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


#: Batches are runs of a hundred orders; of every forty runs one is ragged, one too old, and one has no UTC stamp.
BAD_RUNS = {7: "ragged rows", 9: "too old", 11: "no UTC stamp"}
BAD = ", ".join(map(str, BAD_RUNS))
REASONS = " ".join(f"WHEN {k} THEN '{why}'" for k, why in BAD_RUNS.items())


def batches(v, unreadable: int | None = None, in_order: bool = False):
    """Line items as batches of a source: a header and rows of strings. There are as many batches as the orders ask for, each of a few hundred rows.

    Quantities equal to ``unreadable`` are written as words. ``in_order`` keeps runs of near numbers together, as they come from a source.
    """
    cells = F.array(*[F.when(F.col("l_quantity") == unreadable, "n/a").otherwise(F.col(c).cast("string")) if c == "l_quantity" and unreadable else F.col(c).cast("string") for c in LINE])
    lines = v.lineitem.withColumn("run", F.expr("l_orderkey div 100"))
    if in_order:
        lines = lines.select("run", *LINE).repartitionByRange("run")
    out = lines.groupBy("run").agg(F.collect_list(cells).alias("rows"))
    of = lambda k: F.col("run") % 40 == k
    return out.select(
        F.when(of(9), 1).otherwise(3).alias("payload_version"),
        F.lit("ASIA").alias("source_key"),
        F.lit("product_prices").alias("kind"),
        F.when(of(11), "yesterday").otherwise("2024-01-01T00:00:00Z").alias("scraped_at"),
        F.lit("").alias("source_url"),
        F.array(*map(F.lit, LINE)).alias("header"),
        F.when(of(7), F.concat(F.col("rows"), F.array(F.array(F.lit("x"))))).otherwise(F.col("rows")).alias("rows"),
        F.struct(F.lit(0).alias("index"), F.lit(1).alias("total")).alias("chunk"),
        F.col("run").cast("string").alias("run_ref"),
        F.lit(None).cast("string").alias("bad"),
    )


REJECTED_SQL = f"""
SELECT CAST(run AS VARCHAR) AS run_ref, CASE run % 40 {REASONS} END AS reason
FROM (SELECT DISTINCT l_orderkey // 100 AS run FROM lineitem) AS r WHERE run % 40 IN ({BAD})
"""


@query("s2_rejected_batches", REJECTED_SQL)
def _(v):
    return P.checked(batches(v), LINE)[1].select("run_ref", "reason")


NAMED_SQL = f"""
SELECT CAST(l_orderkey // 100 AS VARCHAR) AS run_ref, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, '' AS price_trade
FROM lineitem WHERE l_orderkey // 100 % 40 NOT IN ({BAD})
"""


@query("s3_named_rows", NAMED_SQL)
def _(v):
    return P.named_rows(P.checked(batches(v), LINE)[0], [*LINE, "price_trade"]).select("run_ref", "l_orderkey", "l_partkey", "price_trade")


WHOLE_SQL = """
SELECT CAST(l_orderkey // 100 AS VARCHAR) AS run_ref, count(*) AS n FROM lineitem
GROUP BY l_orderkey // 100 HAVING l_orderkey // 100 % 40 <> 5 AND count(DISTINCT l_partkey % 3) = 3
"""


@query("s4_whole_batches", WHOLE_SQL)
def _(v):
    # Runs in three chunks; of every forty runs one has lost its fourth.
    cells = F.array(*[F.col(c).cast("string") for c in LINE])
    keys = [F.expr("l_orderkey div 100").alias("run"), (F.col("l_partkey") % 3).cast("int").alias("part")]
    parts = v.lineitem.groupBy(*keys).agg(F.collect_list(cells).alias("rows"))
    total = F.when(F.col("run") % 40 == 5, 4).otherwise(3)
    chunk = F.struct(F.col("part").alias("index"), total.alias("total")).alias("chunk")
    said = [F.lit(x).alias(k) for k, x in (("source_key", "ASIA"), ("kind", "k"), ("scraped_at", "2024"))]
    chunked = parts.select(F.col("run").cast("string").alias("run_ref"), "rows", *said, F.array(*map(F.lit, LINE)).alias("header"), chunk)
    return P.whole(chunked).select("run_ref", F.size("rows").cast("long").alias("n"))


VARIANT = "struct<id:bigint,sku:string,price:string,compare_at_price:string,available:boolean>"


def catalogues(v):
    """Parts as JSON catalogues: one for each two hundred parts, in it a product for each brand and size, with its parts as variants."""
    variant = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("sku"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.lit(None).cast("string").alias("compare_at_price"),
        (F.col("p_size") > 10).alias("available"),
    )
    shelf = F.expr("p_partkey div 200").alias("shelf")
    product = v.part.groupBy(shelf, "p_brand", "p_size").agg(F.collect_list(variant).alias("variants"), F.min("p_partkey").alias("id"))
    row = F.struct(
        (F.col("id") + 1_000_000_000).alias("id"),
        F.col("p_brand").alias("title"),
        F.lit("v").alias("vendor"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("note"), F.lit(" ")).alias("attributes"),
        F.array(F.lit("a.jpg"), F.lit("b.jpg")).alias("images"),
        F.when(F.col("p_size") > 1, F.col("variants")).otherwise(F.array().cast(f"array<{VARIANT}>")).alias("variants"),
    )
    return product.groupBy("shelf").agg(F.to_json(F.struct(F.collect_list(row).alias("products"))).alias("body"))


VARIANTS_SQL = """
SELECT p_partkey AS variant_id, p_brand AS title, p_name AS sku, CAST(p_size > 10 AS BOOLEAN) AS available, FALSE AS stands_in FROM part WHERE p_size > 1
UNION ALL
SELECT min(p_partkey) + 1000000000, p_brand, NULL, NULL, TRUE FROM part WHERE p_size <= 1 GROUP BY p_partkey // 200, p_brand, p_size
"""


@query("s5_catalogue_variants", VARIANTS_SQL)
def _(v):
    return P.catalogue_variants(catalogues(v), "body").select("variant_id", "title", "sku", "available", "stands_in")


DETAILS_SQL = """
SELECT x.product_id, d.code, CASE d.code WHEN 'size' THEN CAST(x.p_size AS VARCHAR) WHEN 'image' THEN 'a.jpg' ELSE 'b.jpg' END AS raw_value
FROM (SELECT min(p_partkey) + 1000000000 AS product_id, p_size FROM part GROUP BY p_partkey // 200, p_brand, p_size) AS x
CROSS JOIN (VALUES ('size'), ('image'), ('image_1')) AS d(code)
"""


@query("s6_catalogue_details", DETAILS_SQL)
def _(v):
    return P.catalogue_details(catalogues(v), "body")


@query("s7_sitemap_urls", "SELECT DISTINCT url FROM pages")
def _(v):
    entry = F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("</loc></url>")))
    body = F.concat(F.lit("<urlset>"), F.array_join(entry, "\n"), F.lit("</urlset>"))
    return P.sitemap_urls(v.pages.groupBy(F.expr("page_id div 500").alias("file")).agg(body.alias("xml")), "xml")


@query("s8_snapshots", "SELECT page_id, url, sha256(html) AS content_hash FROM pages WHERE strlen(html) <= 2000000")
def _(v):
    return P.snapshots(v.pages, P.MOST_BYTES).select("page_id", "url", "content_hash")


@query("u4_merged_snapshots", "SELECT DISTINCT url, sha256(html) AS content_hash FROM pages")
def _(v):
    rows = P.snapshots(v.pages, 1 << 30).select("page_id", "url", "content_hash")
    return P.merged_snapshots(rows.where("page_id % 3 <> 0"), rows.where("page_id % 2 = 0").unionByName(rows.where("page_id % 3 = 0"))).select("url", "content_hash")


@query("s14_frontier", "SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 3 = 0)")
def _(v):
    return v.pages.select("page_id", "url").join(v.pages.where("page_id % 3 = 0").select("url"), "url", "left_anti")


@query(
    "s15_validators",
    """SELECT external_id AS url, validator, seen_at
    FROM (SELECT external_id, CAST(page_no AS VARCHAR) AS validator, seen_at, row_number() OVER (PARTITION BY external_id ORDER BY seen_at DESC, CAST(page_no AS VARCHAR) DESC) AS rn
    FROM sighting WHERE page_no <> 0 AND seen_at >= TIMESTAMP '2024-01-10') AS x
    WHERE rn = 1""",
)
def _(v):
    seen = v.sighting.select(F.col("external_id").alias("url"), F.when(F.col("page_no") != 0, F.col("page_no").cast("string")).alias("validator"), "seen_at")
    return P.latest_validators(seen, "2024-01-10")


@query(
    "j13_locale_pairs",
    """SELECT locale_free_url, max(CASE WHEN locale = 'en' THEN page_id END) AS en, max(CASE WHEN locale = 'fr' THEN page_id END) AS fr, max(CASE WHEN locale = 'de' THEN page_id END) AS de,
    max(CASE WHEN locale = 'es' THEN page_id END) AS es
    FROM page_key
    GROUP BY locale_free_url""",
)
def _(v):
    return v.page_key.groupBy("locale_free_url").pivot("locale", ["en", "fr", "de", "es"]).agg(F.max("page_id"))


@query(
    "w9_first_url",
    """SELECT host, url, page_id FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, page_id, row_number() OVER (PARTITION BY regexp_extract(url,
    '^https?://([^/]+)', 1)
    ORDER BY page_id) AS rn FROM pages) AS x
    WHERE rn = 1""",
)
def _(v):
    rows = v.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", "page_id")
    return P.newest_by(rows, ["host"], F.col("page_id"))


STATE = "(SELECT c_custkey, c_name, c_mktsegment, c_custkey % 13 <> 0 AS active FROM customer WHERE c_custkey % 3 <> 0)"
BATCH = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"


def _upsert(v):
    state = v.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") % 13 != 0).alias("active"))
    batch = v.customer.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return ingest.upserted(state, batch, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "t2_upserted_state",
    f"""SELECT coalesce(s.c_custkey, b.c_custkey) AS c_custkey, coalesce(nullif(b.c_name, ''), s.c_name) AS c_name, coalesce(b.c_mktsegment, s.c_mktsegment) AS c_mktsegment,
    CASE WHEN b.c_custkey IS NOT NULL THEN TRUE ELSE s.active END AS active
    FROM {STATE} AS s
    FULL OUTER JOIN {BATCH} AS b ON b.c_custkey = s.c_custkey""",
)
def _(v):
    return _upsert(v)[0]


@query(
    "t2_product_changes",
    f"""SELECT b.c_custkey, 'c_mktsegment' AS field, s.c_mktsegment AS old, b.c_mktsegment AS new, 'changed' AS change_type
    FROM {STATE} AS s JOIN {BATCH} AS b ON b.c_custkey = s.c_custkey
    WHERE s.c_mktsegment <> b.c_mktsegment
    UNION ALL SELECT b.c_custkey, '', NULL, NULL, 'new'
    FROM {BATCH} AS b WHERE b.c_custkey % 3 = 0
    UNION ALL SELECT b.c_custkey, '', NULL, NULL, 'returned'
    FROM {STATE} AS s JOIN {BATCH} AS b ON b.c_custkey = s.c_custkey
    WHERE NOT s.active""",
)
def _(v):
    return _upsert(v)[1]


@query("t5_classified_observations", """SELECT outcome, count(*) AS n
 FROM (SELECT CASE WHEN o.ord1 % 10 = 3 THEN 'duplicate' WHEN o.provenance = 'observed' AND o.price = l.price THEN 'confirmed' ELSE 'new' END AS outcome
 FROM obs o
 LEFT JOIN (SELECT offer_id, max(price) AS price
 FROM obs
 GROUP BY offer_id) AS l ON l.offer_id = o.offer_id) AS x
 GROUP BY outcome""")
def _(v):
    keyed = v.obs.withColumn("record_hash", F.sha2(F.concat_ws("|", "ord1", "ord2", "ord3", "ord4"), 256)).withColumn("price_key", F.col("price").cast("string"))
    open_ = v.obs.groupBy("offer_id").agg(F.max("price").cast("string").alias("price_key"))
    return ingest.classified(keyed, open_, keyed.where("ord1 % 10 = 3")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "t7_retired_stand_ins",
    """SELECT DISTINCT p_size AS product_id FROM part
    WHERE p_size % 2 = 0 AND EXISTS (SELECT 1
    FROM part q WHERE q.p_size = part.p_size AND q.p_partkey <> q.p_size)""",
)
def _(v):
    real = v.part.where("p_partkey <> p_size").select(F.col("p_size").alias("product_id"), F.col("p_partkey").cast("int").alias("variant_id"))
    own = v.part.where("p_size % 2 = 0").select(F.col("p_size").alias("product_id"), F.col("p_size").alias("variant_id")).distinct()
    return ingest.retired_stand_ins(real.unionByName(own)).select("product_id").distinct()


@query(
    "t9_restated_details",
    """SELECT p_partkey AS product_id, 'brand' AS code, CASE WHEN p_partkey % 4 = 0 THEN 'NEW' ELSE p_brand END AS raw_value
    FROM part
    UNION ALL SELECT p_partkey, 'type', p_type
    FROM part""",
)
def _(v):
    old = v.part.select(F.col("p_partkey").alias("product_id"), F.expr("stack(2, 'brand', p_brand, 'type', p_type)").alias("code", "raw_value"))
    new = v.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("product_id"), F.lit("brand").alias("code"), F.lit("NEW").alias("raw_value"))
    return ingest.restated(old, new.unionByName(new))


@query(
    "t13_record_revisions",
    """SELECT a.record_id, CASE WHEN a.record_id % 7 = 0 THEN 'revised' ELSE 'unchanged' END AS outcome, CASE WHEN a.record_id % 7 = 0 THEN 2 ELSE 1 END AS rev
    FROM record_rev a WHERE a.rev = 2""",
)
def _(v):
    rows = v.record_rev
    return ingest.revised(rows.where("rev = 1"), rows.where("rev = 2").drop("rev"), "record_id", ["c_name", "segment"])


@query(
    "t14_field_changes",
    """SELECT b.record_id, b.rev, 'segment' AS field, a.segment AS old, b.segment AS new
    FROM record_rev a JOIN record_rev b ON b.record_id = a.record_id AND a.rev = 1 AND b.rev = 2
    WHERE a.segment <> b.segment""",
)
def _(v):
    return ingest.field_changes(v.record_rev, "record_id", "rev", ["c_name", "segment"])


LEVELS = "(SELECT p_type AS node, '' AS parent, p_type AS name, 1 AS level FROM part UNION ALL SELECT concat(p_type, ' > ', p_brand), p_type, p_brand, 2 FROM part UNION ALL SELECT concat(p_type, ' > ', p_brand, ' > ', p_name), concat(p_type, ' > ', p_brand), p_name, 3 FROM part)"


def _nodes(v):
    return ingest.taxonomy(v.part.select(F.concat_ws(" > ", "p_type", "p_brand", "p_name").alias("path")), "path")


@query("t20_taxonomy", f"SELECT node, parent, name, level, count(*) AS paths FROM {LEVELS} AS n GROUP BY node, parent, name, level")
def _(v):
    return _nodes(v)


@query("t21_memberships", "SELECT source_id AS record, category_path AS node, count(*) AS seen_count FROM product GROUP BY source_id, category_path")
def _(v):
    return ingest.memberships(v.product.withColumnRenamed("source_id", "record"), "record", "category_path")


@query(
    "j24_ancestors",
    f"""SELECT DISTINCT node, node AS ancestor, 0 AS distance
    FROM {LEVELS} AS n
    UNION ALL SELECT DISTINCT node, parent, 1
    FROM {LEVELS} AS n WHERE level > 1
    UNION ALL SELECT DISTINCT node, split_part(node, ' > ', 1), 2
    FROM {LEVELS} AS n WHERE level = 3""",
)
def _(v):
    return ingest.ancestors(_nodes(v).select("node", "parent"), jobs.table_writer(v.spark, "ancestors"))[0]


@query(
    "t26_detail_frontier",
    """SELECT DISTINCT external_id FROM sighting s
    WHERE NOT EXISTS (SELECT 1 FROM stored_record r
    WHERE r.external_id = s.external_id)""",
)
def _(v):
    return v.sighting.select("external_id").join(v.stored_record.select("external_id"), "external_id", "left_anti").distinct()


@query(
    "t27_registrations",
    """SELECT n_name AS field_key, CASE WHEN n_nationkey % 5 = 0 THEN 'retired' WHEN n_nationkey % 2 = 0 THEN 'accepted' WHEN n_nationkey % 3 = 0 THEN 'conflict' ELSE 'already' END AS verdict
    FROM nation""",
)
def _(v):
    known = v.nation.where("n_nationkey % 5 = 0 or n_nationkey % 2 = 1").select(F.col("n_name").alias("field_key"), F.when(F.col("n_nationkey") % 3 == 0, "text").otherwise("integer").alias("definition"), (F.col("n_nationkey") % 5 == 0).alias("retired"))
    return ingest.registered(known, v.nation.select(F.col("n_name").alias("field_key"), F.lit("integer").alias("definition")), "field_key", "definition")


@query(
    "j22_change_feed",
    """SELECT entity, product_id, run_id, change_type
    FROM (SELECT 'product' AS entity, p_partkey AS product_id, p_size AS run_id, 'new' AS change_type
    FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'variant', p_partkey, p_size, 'new'
    FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT 'variant', p_partkey, p_size, 'changed'
    FROM part) AS c""",
)
def _(v):
    row = lambda df, entity, kind: df.select(F.lit(entity).alias("entity"), F.col("p_partkey").alias("product_id"), F.col("p_size").alias("run_id"), F.lit(kind).alias("change_type"))
    return ingest.collapsed_new(row(v.part.where("p_partkey % 2 = 0"), "product", "new").unionByName(row(v.part, "variant", "new")).unionByName(row(v.part, "variant", "changed")))


@query(
    "j19_relationship_profile",
    """SELECT count(*) AS orders, count(c_custkey) AS matched, count(*) - count(c_custkey) AS orphans, count(DISTINCT o_custkey) AS parents
    FROM orders
    LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0""",
)
def _(v):
    parents = v.customer.where("c_custkey % 4 <> 0").select("c_custkey")
    rows = v.orders.select("o_custkey").join(parents, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.agg(F.count("*").alias("orders"), F.count("c_custkey").alias("matched"), (F.count("*") - F.count("c_custkey")).alias("orphans"), F.count_distinct("o_custkey").alias("parents"))


@query(
    "a1_source_summary",
    """SELECT s.source_key, count(DISTINCT o.product_id) AS products, count(DISTINCT o.offer_id) AS offers, count(*) AS observations, max(o.observed_at) AS last_seen
    FROM obs o JOIN site s ON s.source_id = o.source_id
    GROUP BY s.source_key""",
)
def _(v):
    offers = v.obs.groupBy("source_id", "product_id", "offer_id").agg(F.count("*").alias("n"), F.max("observed_at").alias("last"))
    products = offers.groupBy("source_id", "product_id").agg(F.count("*").alias("offers"), F.sum("n").alias("n"), F.max("last").alias("last"))
    rows = products.groupBy("source_id").agg(F.count("*").alias("products"), F.sum("offers").alias("offers"), F.sum("n").alias("observations"), F.max("last").alias("last_seen"))
    return rows.join(v.site, "source_id").select("source_key", "products", "offers", "observations", "last_seen")


@query("a6_facet_values", "SELECT DISTINCT region FROM offer ORDER BY region LIMIT 20")
def _(v):
    return v.offer.select("region").distinct().orderBy("region").limit(20)


@query(
    "a13_footprint",
    """SELECT 'obs' AS entity, count(*) AS n FROM obs
    UNION ALL SELECT 'offer', count(*) FROM offer
    UNION ALL SELECT 'product', count(*) FROM product""",
)
def _(v):
    count = lambda name: getattr(v, name).agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
    return count("obs").unionByName(count("offer")).unionByName(count("product"))


@query(
    "a17_joined_categories",
    """SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_type) AS types
    FROM (SELECT DISTINCT p_brand, p_type FROM part) AS p
    GROUP BY p_brand""",
)
def _(v):
    return v.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("types"))


@query(
    "a22_recent_observations",
    """SELECT offer_id, observed_at, ord1, ord2, ord3
    FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, ord1 DESC, ord2 DESC, ord3 DESC, ord4 DESC) AS rn
    FROM obs) AS x WHERE rn <= 3""",
)
def _(v):
    from pyspark.sql import Window

    own = Window.partitionBy("offer_id").orderBy(history.in_order().desc())
    return v.obs.withColumn("rn", F.row_number().over(own)).where("rn <= 3").select("offer_id", "observed_at", "ord1", "ord2", "ord3")


@query(
    "a24_freshness",
    """SELECT s.source_key, max(o.observed_at) AS last_run
    FROM site s
    LEFT JOIN obs o ON o.source_id = s.source_id AND o.source_id <> 2
    GROUP BY s.source_key""",
)
def _(v):
    last = v.obs.where("source_id <> 2").groupBy("source_id").agg(F.max("observed_at").alias("last_run"))
    return v.site.join(last, "source_id", "left").select("source_key", "last_run")


@query(
    "a26_dataset_catalogue",
    """SELECT d.dataset_key, count(CASE WHEN r.status = 'active' THEN 1 END) AS active, max(d.newest) AS newest
    FROM (SELECT dataset_key, max(seen_at) AS newest
    FROM sighting
    GROUP BY dataset_key) AS d
    LEFT JOIN stored_record r ON r.dataset_key = d.dataset_key
    GROUP BY d.dataset_key""",
)
def _(v):
    newest = v.sighting.groupBy("dataset_key").agg(F.max("seen_at").alias("newest"))
    active = v.stored_record.groupBy("dataset_key").agg(F.count(F.when(F.col("status") == "active", 1)).alias("active"))
    return newest.join(active, "dataset_key", "left").select("dataset_key", F.coalesce("active", F.lit(0)).alias("active"), "newest")


@query(
    "p4_free_search",
    """SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey
    WHERE lower(c_name) LIKE '%00007%' OR lower(n_name) = 'nation_7'""",
)
def _(v):
    rows = v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.where(F.col("c_name").ilike("%00007%") | (F.lower("n_name") == "nation_7")).select("c_custkey")


@query("p14_value_sets", "SELECT offer_id FROM offer WHERE coalesce(trim(unit_code), '') IN ('', 'kg') AND region IN ('NATION_1', 'NATION_2')")
def _(v):
    return v.offer.where(F.coalesce(F.trim("unit_code"), F.lit("")).isin("", "kg") & F.col("region").isin("NATION_1", "NATION_2")).select("offer_id")
