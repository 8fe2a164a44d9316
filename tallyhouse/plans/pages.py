"""Queries over page corpora, locales, layouts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import directory, history
from tallyhouse.plans.prices import LATEST, double
from tallyhouse.plans.register import query
from tallyhouse.sources import pages as H
from tallyhouse.streaming import jobs


TABLES_SQL = """
SELECT c_custkey // 100 AS page_id, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment,
       CASE c_custkey // 100 % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.88 ELSE 0.7 END AS confidence
FROM customer
"""


def customer_pages(v, columns: list[str], head):
    """A page for each hundred customers, with a table of them."""
    cells = F.concat(*[F.concat(F.lit("<td> "), F.col(c).cast("string"), F.lit("</td>")) for c in columns])
    page = F.expr("c_custkey div 100").alias("page_id")
    rows = v.customer.groupBy(page).agg(F.array_join(F.collect_list(F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))), "").alias("rows"))
    return rows.select("page_id", F.concat(head, F.col("rows"), F.lit("</table>")).alias("html"))


@query("h1_html_tables", TABLES_SQL)
def _(v):
    # By turns a head with a caption, a first row of header cells, and no header at all.
    names = "<tr><th>id</th><th>name</th><th>segment</th></tr>"
    kind = F.col("page_id") % 3
    head = F.when(kind == 0, f"<p>x</p><table><caption>C</caption><thead>{names}</thead>").when(kind == 1, f"<table>{names}").otherwise("<table>")
    pages = customer_pages(v, ["c_custkey", "c_name", "c_mktsegment"], head)
    rows = H.html_tables(pages).select("page_id", "header", "confidence", F.explode("rows").alias("cells"))
    cell = lambda k, name: F.when(F.col("header")[k].isin(name, f"Column {k + 1}"), F.col("cells")[k]).alias(name)
    return rows.select("page_id", cell(0, "id"), cell(1, "name"), cell(2, "segment"), "confidence")


@query(
    "h2_jsonld_products",
    """SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, CAST(p_retailprice AS DECIMAL(12,2)) AS price, CASE WHEN p_size % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability
    FROM part""",
)
def _(v):
    money = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    offers = F.struct(
        F.when(F.col("p_size") % 3 == 0, "0").otherwise(money).alias("price"),
        money.alias("lowPrice"),
        F.lit("SAR").alias("priceCurrency"),
        F.when(F.col("p_size") % 2 == 0, "https://schema.org/InStock").otherwise("https://schema.org/OutOfStock").alias("availability"),
    )
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), offers.alias("offers")))
    body = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("["), node, F.lit("]"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(node)
    html = v.part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("html"))
    return H.jsonld_products(html).select("page_id", "name", "brand", "price", "availability")


@query(
    "h3_english_alternates",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(url, '/en-sa') ELSE concat(url, '/en') END AS href
    FROM pages WHERE page_id % 5 <> 0""",
)
def _(v):
    link = lambda lang, path: F.concat(F.lit(f'<link rel="alternate" hreflang="{lang}" href="'), "url", F.lit(f'{path}"/>'))
    html = F.concat(link("ar", "/ar"), F.when(F.col("page_id") % 5 != 0, link("en", "/en")).otherwise(""), F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 5 != 0), link("en-SA", "/en-sa")).otherwise(""))
    return H.english_alternate(H.alternates(v.pages.select("page_id", html.alias("html"))), "sa")


VARIATIONS_SQL = "SELECT p_partkey // 50 AS page_id, p_partkey AS variation_id, p_retailprice AS display_price, p_name AS sku FROM part"


@query("h4_embedded_variations", VARIATIONS_SQL)
def _(v):
    one = F.struct(F.col("p_partkey").alias("variation_id"), F.col("p_retailprice").alias("display_price"), F.col("p_name").alias("sku"))
    rows = v.part.groupBy(F.expr("p_partkey div 50").alias("page_id")).agg(F.to_json(F.collect_list(one)).alias("j"))
    escaped = F.replace("j", F.lit('"'), F.lit("&quot;"))
    html = rows.select("page_id", F.concat(F.lit('<form data-product_variations="'), escaped, F.lit('"></form>')).alias("html"))
    return H.embedded_variations(html).select("page_id", "variation_id", "display_price", "sku")


ZIPPED_SQL = "SELECT p_partkey // 20 AS page, count(*) AS n FROM part WHERE p_partkey // 20 % 10 <> 0 GROUP BY 1"


@query("h5_zipped_columns", ZIPPED_SQL)
def _(v):
    # Columns of twenty products a page; every tenth page has lost a name, and a page that drifts is refused.
    rows = v.part.groupBy(F.expr("p_partkey div 20").alias("page")).agg(F.collect_list("p_name").alias("names"), F.collect_list("p_retailprice").alias("prices"))
    lost = F.when(F.col("page") % 10 == 0, F.slice("names", 2, 20)).otherwise(F.col("names"))
    return H.zipped(rows.withColumn("names", lost), "names", "prices")[0].groupBy("page").agg(F.count("*").alias("n"))


@query("h6_boxes_and_coordinates", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_nationkey + 0.25 AS lat, 30.5 AS lon FROM customer")
def _(v):
    html = F.concat(F.lit("<ul><li><b>Name</b>: "), "c_name", F.lit("</li><li>Segment: "), "c_mktsegment", F.lit("</li><li>Map: "), (F.col("c_nationkey") + F.lit(0.25)).cast("string"), F.lit(", 30.5</li></ul>"))
    rows = v.customer.select("c_custkey", H.boxes(html).alias("box"))
    lat, lon = H.coordinates(F.col("box")["Map"])
    return rows.select("c_custkey", F.col("box")["Name"].alias("name"), F.col("box")["Segment"].alias("segment"), lat.alias("lat"), lon.alias("lon"))


@query("h7_galleries", "SELECT p_partkey, concat_ws(',', p_brand, p_type, p_name) AS pictures FROM part")
def _(v):
    return v.part.select("p_partkey", F.array_join(H.gallery(F.array("p_brand", "p_type"), F.array("p_type", "p_name", "p_brand")), ",").alias("pictures"))


@query(
    "j14_merged_locales",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment || 'x') END AS c_mktsegment_ar
    FROM customer""",
)
def _(v):
    arabic = v.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.upper(F.concat("c_mktsegment", F.lit("x")))).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return directory.locales_merged(v.customer.select("c_custkey", "c_name", "c_mktsegment"), arabic, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment_ar")


@query(
    "j25_details_by_language",
    """SELECT p_partkey, 'brand' AS code, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS raw_value
    FROM part""",
)
def _(v):
    rows = v.part.select("p_partkey", F.expr("stack(2, 'brand', case when p_partkey % 3 <> 0 then p_brand end, 'brand_ar', upper(p_brand))").alias("code", "raw_value"))
    return directory.details_by_language(rows.where("raw_value is not null"), ["p_partkey"], "code", "raw_value")


@query(
    "j23_field_assignments",
    """SELECT product_id, source_id, priority FROM (SELECT product_id, source_id, source_id % 3 AS priority, row_number() OVER (PARTITION BY product_id ORDER BY source_id % 3,
    source_id) AS rn FROM (SELECT product_id, source_id, max(business_date) AS d
    FROM obs
    GROUP BY product_id, source_id) AS f WHERE d >= DATE '1997-01-01') AS x
    WHERE rn = 1""",
)
def _(v):
    feeds = v.obs.groupBy("product_id", "source_id").agg(F.max("business_date").alias("last_seen"))
    feeds = feeds.select("product_id", "source_id", "last_seen", (F.col("source_id") % 3).alias("priority"), F.lit(None).cast("long").alias("variant_id"), F.lit("*").alias("region"))
    return directory.assigned(feeds, ["product_id"], 365, "1998-01-01").select("product_id", "source_id", "priority")


@query("p6_saved_view", "SELECT region AS \"Country\", offer_id AS \"Offer\", source_id, product_id, basis_quantity, status FROM offer")
def _(v):
    return directory.laid_out(v.offer, [("region", "Country", True), ("offer_id", "Offer", True), ("unit_code", "Unit", False)])


@query("p9_bilingual_columns", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer")
def _(v):
    rows = v.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("name"), F.col("c_name").alias("name_ar"))
    return directory.bilingual(rows).select("c_custkey", "name")


@query("p11_page_with_total", "SELECT offer_id, count(*) OVER () AS total FROM offer WHERE status = 'active' ORDER BY offer_id LIMIT 25")
def _(v):
    rows = v.offer.where("status = 'active'").select("offer_id")
    return rows.orderBy("offer_id").limit(25).crossJoin(rows.agg(F.count("*").alias("total")))  # 25 rows and one


@query(
    "p12_tree_shape",
    """SELECT count(DISTINCT region) AS regions, count(DISTINCT product_name) AS names, count(*) AS n, count(DISTINCT region) > 1 AND count(DISTINCT product_name) < count(*) AS grouped
    FROM offer f JOIN product p ON p.product_id = f.product_id AND p.source_id = f.source_id""",
)
def _(v):
    return directory.tree_shape(v.offer.join(v.product.select("source_id", "product_id", "product_name"), ["source_id", "product_id"]))


@query(
    "t4_adopted_units",
    """SELECT how, count(*) AS n FROM (SELECT CASE WHEN unit_code IS NULL THEN 'adopts' ELSE 'exact' END AS how
    FROM offer WHERE product_id % 2 = 0
    UNION ALL SELECT 'new' FROM offer WHERE product_id % 2 = 1) AS x
    GROUP BY how""",
)
def _(v):
    rows = v.offer.select("offer_id", F.col("offer_id").alias("product_id"), "region", "unit_code", F.col("product_id").alias("p"))
    batch = rows.select("product_id", "region", F.coalesce("unit_code", F.lit("kg")).alias("unit_code"))
    return directory.adopted_offers(rows.where("p % 2 = 0").drop("p"), batch).groupBy("how").agg(F.count("*").alias("n"))


@query(
    "f13_price_keys",
    """SELECT offer_id, ord1, ord2, ord3, sha256(concat('v2|currency=', currency, '|price=', CAST(price AS VARCHAR), '|tax=', CAST(tax_included AS VARCHAR))) AS price_key,
    'currency,price,tax' AS fields FROM obs""",
)
def _(v):
    key, fields = directory.price_key(price=F.col("price"), currency=F.col("currency"), tax=F.col("tax_included"), region=F.lit("*"))
    return v.obs.select("offer_id", "ord1", "ord2", "ord3", key.alias("price_key"), F.array_join(fields, ",").alias("fields"))


@query(
    "f24_detail_groups",
    """SELECT p_brand, CASE WHEN p_brand = 'Brand#11' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' WHEN p_brand LIKE '%5' THEN 'fifth' ELSE 'other' END AS detail_group
    FROM (SELECT DISTINCT p_brand FROM part) AS b""",
)
def _(v):
    rules = v.spark.createDataFrame([("exact", "brand#11", "first"), ("prefix", "brand#2", "second"), ("suffix", "5", "fifth")], "kind string, pattern string, group string")
    codes = v.part.select("p_brand").distinct().withColumn("code", F.concat("p_brand", F.lit("_ar")))
    return directory.group_of_code(codes, rules, "code").select("p_brand", "detail_group")


def _stream(v, df, name: str):
    """A derived table as files that a stream reads one by one, in the folder that all machines share."""
    folder = jobs.work_folder(v.spark, name)
    df.write.parquet(f"{folder}/in")
    return jobs.file_stream(v.spark, f"{folder}/in", df.schema, per_trigger=8), folder


LEDGER_SQL = """
SELECT dataset_key, external_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, count(*) AS sightings
FROM sighting GROUP BY dataset_key, external_id
"""


@query("r3_streaming_ledger", LEDGER_SQL)
def _(v):
    stream, folder = _stream(v, v.sighting.select("dataset_key", "external_id", "seen_at").repartition(12), "ledger")
    return jobs.newest(jobs.stored(jobs.sightings_ledger(stream), folder, "update"), ["dataset_key", "external_id"])


@query("r4_streaming_once_each", "SELECT DISTINCT event_id, seen_at FROM sighting")
def _(v):
    rows = v.sighting.select("event_id", F.col("seen_at").cast("timestamp").alias("seen_at"))
    stream, folder = _stream(v, rows.unionByName(rows), "once")
    out = jobs.stored(jobs.once_each(stream, ["event_id"], "seen_at", "60 days"), folder)
    return out.select("event_id", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))


CHANGES_SQL = """
SELECT offer_id, count(*) AS n FROM (
 SELECT offer_id, CASE WHEN lag(price) OVER w IS NULL OR lag(price) OVER w <> price OR lag(currency) OVER w <> currency THEN 1 END AS c
 FROM (SELECT offer_id, observed_at, min(price) AS price, min(currency) AS currency FROM obs GROUP BY offer_id, observed_at) AS d
 WINDOW w AS (PARTITION BY offer_id ORDER BY observed_at)) AS x
WHERE c = 1 GROUP BY offer_id
"""


@query("r2_streaming_price_changes", CHANGES_SQL)
def _(v):
    # Three deliveries, one after another: each run goes on from the open prices that the one before has left.
    moment = F.col("observed_at").cast("timestamp").alias("observed_at")
    one = v.obs.groupBy("offer_id", moment).agg(F.min("price").cast("double").alias("price"), F.min("currency").alias("currency"))
    delivery = F.when(F.col("observed_at") < "1995-01-01", 0).when(F.col("observed_at") < "1999-01-01", 1).otherwise(2)
    folder = jobs.work_folder(v.spark, "changes")
    one.repartition("offer_id").withColumn("delivery", delivery).write.partitionBy("delivery").parquet(f"{folder}/all")
    every = v.spark.read.parquet(f"{folder}/all")
    for k in range(3):
        every.where(F.col("delivery") == k).drop("delivery").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.file_stream(v.spark, f"{folder}/in", one.schema, per_trigger=64)
        out = jobs.stored(jobs.price_changes(stream), folder)
    return out.where("reason <> 'late'").groupBy("offer_id").agg(F.count("*").alias("n"))
