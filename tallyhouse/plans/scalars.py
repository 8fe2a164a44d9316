"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import text as x
from tallyhouse.plans.register import query

FOLD = lambda c: f"translate({c}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬', '01234567890123456789.,')"


@query(
    "f1_fold_digits",
    f"""SELECT doc_id, md5({FOLD(chr(39).join(['translate(text, ', '0123456789', ', ', '٠١٢٣٤٥٦٧٨٩', ')']))}) AS folded
    FROM documents""",
)
def _(v):
    return v.documents.select("doc_id", F.md5(x.fold_digits(F.translate("text", "0123456789", "٠١٢٣٤٥٦٧٨٩")).cast("binary")).alias("folded"))


#: Price texts by the part of the cents, as sites write them: marks with points, either side, both decimal styles, Arabic digits, and one without a number.
MONEY_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN cents % 9 = 8 THEN NULL WHEN cents % 9 = 7 THEN CAST(cents // 100 AS DOUBLE) ELSE cents / 100.0 END AS amount,
       cents % 9 = 8 AS wrong
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) AS l
"""


@query("f2_parse_money", MONEY_SQL)
def _(v):
    rows = v.lineitem.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    amount = F.format_number(F.col("cents") / 100, 2)
    other = F.translate(amount, ",.", ".,")
    whole = F.format_number(F.expr("cents div 100"), 0)
    ways = [
        F.concat(amount, F.lit(" ر.س")),
        F.concat(F.lit("ر.س "), amount),
        F.concat(F.lit("L.E. "), amount),
        F.concat(other, F.lit(" L.E.")),
        F.concat(F.lit("ج.م "), F.translate(amount, "0123456789.,", x.DIGITS[:10] + x.DIGITS[20:])),
        F.concat(F.lit("SAR "), other),
        F.concat(F.lit("$"), F.replace(amount, F.lit(","), F.lit(""))),
        F.concat(whole, F.lit(" جنيه")),
        F.lit("call us"),
    ]
    written = F.element_at(F.array(*ways), (F.col("cents") % len(ways) + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.parse_money(written).cast("double").alias("amount"), x.money_error(written).alias("wrong"))


@query(
    "f3_canonical_amount",
    """SELECT offer_id, ord1, ord2, ord3, regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS amount
    FROM obs""",
)
def _(v):
    return v.obs.select("offer_id", "ord1", "ord2", "ord3", x.canonical_amount("price").alias("amount"))


@query("f4_canonical_hash", """SELECT offer_id, sha256(concat('{"currency":"', currency, '","offer_id":', CAST(offer_id AS VARCHAR), ',"stock":', CAST(stock_quantity AS VARCHAR), '}')) AS record_hash,
 ord1, ord2, ord3 FROM obs""")
def _(v):
    return v.obs.select("offer_id", x.canonical_hash(offer_id=F.col("offer_id"), currency=F.col("currency"), stock=F.col("stock_quantity")).alias("record_hash"), "ord1", "ord2", "ord3")


@query("f5_option_fingerprint", "SELECT p_partkey, concat('Brand=', lower(p_brand), '|size=', CAST(p_size AS VARCHAR), '|type=', lower(p_type)) AS fingerprint FROM (SELECT * FROM part) AS p".replace("'Brand=", "'brand="))
def _(v):
    options = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("Brand"), F.concat(F.lit(" "), "p_brand"), F.lit("type"), F.col("p_type"))
    return v.part.select("p_partkey", x.option_fingerprint(options).alias("fingerprint"))


@query("f6_option_axes", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{"k":"', json_extract_string(props, '$.k'), '"}') AS axes
 FROM events""")
def _(v):
    axes = F.from_json("props", "map<string,string>")
    return v.events.select("event_id", axes["k"].cast("long").alias("k"), x.option_axes(axes).alias("axes"))


NAMES_SQL = """
SELECT material_id, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS similarity
FROM (SELECT material_id, lower(material_name) AS a, lower(material_name_alt) AS b FROM material) AS m
"""


@query("f7_name_similarity", NAMES_SQL)
def _(v):
    return v.material.select("material_id", x.name_similarity("material_name", "material_name_alt").alias("similarity"))


@query("f8_strip_markup", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&lt;',
 '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\\s\\x{00a0}]+', ' ', 'g'))) AS text_md5
 FROM pages""")
def _(v):
    return v.pages.select("page_id", F.md5(x.strip_markup("html").cast("binary")).alias("text_md5"))


@query("f9_split_brand", "SELECT p_partkey, 'صناعة' AS arabic, p_brand AS latin, concat('صناعة ', p_brand) AS joined FROM part")
def _(v):
    arabic, latin = x.split_brand(F.concat("p_brand", F.lit(" صناعة")))
    return v.part.select("p_partkey", arabic.alias("arabic"), latin.alias("latin"), x.joined_brand(arabic, latin).alias("joined"))


@query("f10_selling_unit", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'kg' END AS unit FROM part")
def _(v):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" KG bag"))
    return v.part.select("p_partkey", x.selling_unit(name, F.col("p_size") + F.col("p_size") % 2).alias("unit"))


#: What a site says, with its currency, and the code of it.
UNITS = (
    ("SAR/Kilogram", "SAR", "kg"), (" Mtr ", "SAR", "m"), ("kg/m2", "SAR", "kg/m2"), ("egp/liters", "EGP", "liter"), ("Pcs.", "SAR", "piece"),
    ("SQM", "EGP", "m2"), ("متر", "EGP", "m"), ("kW/h", "SAR", "kWh"), ("Bag", "SAR", "bag"), ("USD/M³", "EGP", "m3"),
)
UNITS_SQL = "SELECT offer_id, ord1, ord2, ord3, CASE ord4 % 11 %s END AS unit FROM obs"


@query("f11_canonical_unit", UNITS_SQL.replace("%s", " ".join(f"WHEN {k} THEN '{u}'" for k, (_, _, u) in enumerate(UNITS))))
def _(v):
    said = F.array(*[F.struct(F.lit(a).alias("raw"), F.lit(b).alias("currency")) for a, b, _ in UNITS], F.struct(F.lit(" ").alias("raw"), F.lit("SAR").alias("currency")))
    rows = v.obs.withColumn("said", F.element_at(said, (F.col("ord4") % 11 + 1).cast("int")))
    return rows.select("offer_id", "ord1", "ord2", "ord3", x.canonical_unit(F.col("said.raw"), F.col("said.currency")).alias("unit"))


@query(
    "f14_price_unit",
    """SELECT offer_id, CASE WHEN unit_code IS NULL THEN '' WHEN basis_quantity = 1 THEN concat('per ', unit_code) ELSE concat('per ', CAST(basis_quantity AS VARCHAR),
    ' ', unit_code) END AS unit_text FROM offer""",
)
def _(v):
    return v.offer.select("offer_id", x.price_unit("unit_code", "basis_quantity").alias("unit_text"))


@query(
    "f15_discount",
    """SELECT offer_id, ord1, ord2, ord3, CASE WHEN price_before > price THEN CAST(round(price_before - price, 2) AS DOUBLE) END AS amount, CASE WHEN price_before > price THEN round(CAST(price_before - price AS DOUBLE) / CAST(price_before AS DOUBLE) * 100,
    1) END AS pct FROM obs""",
)
def _(v):
    d = x.discount(F.col("price_before"), F.col("price"))
    return v.obs.select("offer_id", "ord1", "ord2", "ord3", d["amount"].alias("amount"), d["pct"].alias("pct"))


@query(
    "f16_change_text",
    """SELECT offer_id, ord1, ord2, ord3, CASE WHEN price = price_before THEN '' ELSE printf('%+.2f (%+.1f%%)', CAST(round(price - price_before, 2) AS DOUBLE),
    CAST(price - price_before AS DOUBLE) / CAST(price_before AS DOUBLE) * 100) END AS moved
    FROM obs""",
)
def _(v):
    return v.obs.select("offer_id", "ord1", "ord2", "ord3", x.change_text(F.col("price_before"), F.col("price")).alias("moved"))


@query(
    "f17_category_levels",
    """SELECT source_id, product_id, split_part(category_path, ' > ', 1) AS level_1, split_part(category_path, ' > ', 2) AS level_2, split_part(category_path, ' > ',
    3) AS level_3, CAST(NULL AS VARCHAR) AS level_4, split_part(category_path, ' > ', 3) AS leaf
    FROM product""",
)
def _(v):
    return v.product.select("source_id", "product_id", *x.category_levels("category_path", 4), x.category_leaf("category_path").alias("leaf"))


@query("f21_availability", "SELECT offer_id, ord1, ord2, ord3, availability FROM obs")
def _(v):
    said = F.when(F.col("availability") == "in_stock", "https://schema.org/InStock").when(F.col("availability") == "out_of_stock", "Out of stock").otherwise("call us")
    return v.obs.select("offer_id", "ord1", "ord2", "ord3", x.availability(said).alias("availability"))


@query(
    "f22_typed_conversion",
    """SELECT c_custkey, TRY_CAST(c_name AS BIGINT) AS as_integer, TRY_CAST(CAST(c_nationkey AS VARCHAR) AS BIGINT) AS nation, CAST(c_custkey % 2 = 0 AS BOOLEAN) AS even,
    TRUE AS name_is_wrong FROM customer""",
)
def _(v):
    text = lambda c: F.col(c).cast("string")
    even = F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("no")
    return v.customer.select(
        "c_custkey",
        x.converted(text("c_name"), "integer").alias("as_integer"),
        x.converted(text("c_nationkey"), "integer").alias("nation"),
        x.converted(even, "boolean").alias("even"),
        (F.col("c_name").isNotNull() & x.converted(text("c_name"), "integer").isNull()).alias("name_is_wrong"),
    )


@query("f23_field_keys", "SELECT DISTINCT p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS field_key FROM part")
def _(v):
    return v.part.select("p_brand").distinct().select("p_brand", x.field_key("p_brand").alias("field_key"))


@query(
    "f25_plausible_rates",
    """SELECT o_orderkey, CASE WHEN o_totalprice * 10 > 0 AND round(o_totalprice * 10, 2) <= 1000000 THEN round(o_totalprice * 10, 2) END AS rate
    FROM orders""",
)
def _(v):
    said = F.concat(F.lit("rate "), F.format_number(F.col("o_totalprice") * 10, 2))
    return v.orders.select("o_orderkey", x.rate_of(said).alias("rate"))


@query("f26_city_and_region", "SELECT c_custkey, n_name AS city, c_mktsegment AS region FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(v):
    both = F.concat("n_name", F.lit(" - "), "c_mktsegment")
    city, region = x.city_and_region(both)
    return v.customer.join(v.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", city.alias("city"), region.alias("region"))


@query(
    "o4_numbered_codes",
    """SELECT p_brand, CAST(row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+$', ''), coalesce(TRY_CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT),
    0)) AS INT) AS place FROM (SELECT DISTINCT p_brand
    FROM part) AS b""",
)
def _(v):
    from pyspark.sql import Window

    brands = v.part.select("p_brand").distinct()  # a bounded vocabulary
    return brands.withColumn("place", F.row_number().over(Window.orderBy(*x.numbered_order("p_brand"))))


@query(
    "o5_length_order",
    """SELECT external_id FROM (SELECT DISTINCT external_id
    FROM sighting) AS s
    ORDER BY length(external_id), external_id LIMIT 500""",
)
def _(v):
    return v.sighting.select("external_id").distinct().orderBy(F.length("external_id"), "external_id").limit(500)


@query("o8_measure_order", "SELECT p_partkey FROM part ORDER BY p_size, CAST(p_size AS VARCHAR), p_partkey LIMIT 200")
def _(v):
    said = F.concat(F.col("p_size").cast("string"), F.lit(" mm"))
    return v.part.withColumn("said", said).orderBy(*x.measure_order("said"), "p_partkey").limit(200).select("p_partkey")
