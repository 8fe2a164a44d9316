"""Queries over prices: what an offer costs, cost, and by which rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators import history, lookups
from tallyhouse.plans.register import query

ORD = "observed_at, ord1, ord2, ord3, ord4"
DESC = "observed_at DESC, ord1 DESC, ord2 DESC, ord3 DESC, ord4 DESC"
#: One row for each offer, observed before reported.
LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY CASE WHEN provenance = 'observed' THEN 0 ELSE 1 END, business_date DESC, {DESC}) AS rn FROM obs) AS x WHERE rn = 1)"
PERIODS = f"""(SELECT offer_id, period_no, max(why) AS opened_because, min(observed_at) AS first_detected_at, max(observed_at) AS last_confirmed_at, count(*) AS n_observations,
 min(price) AS price, min(currency) AS currency, min(tax_included) AS tax_included
 FROM (SELECT *, count(why) OVER (PARTITION BY offer_id ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS period_no FROM (
   SELECT *, CASE WHEN lag(observed_at) OVER w IS NULL THEN 'first_seen' WHEN lag(currency) OVER w <> currency THEN 'currency_change' WHEN lag(price) OVER w <> price THEN 'price_change' WHEN lag(tax_included) OVER w <> tax_included THEN 'fields_changed' END AS why
   FROM obs WINDOW w AS (PARTITION BY offer_id ORDER BY {ORD})) AS m) AS p GROUP BY offer_id, period_no)"""


def double(*names: str) -> list:
    return [F.col(c).cast("double").alias(c) for c in names]


@query(
    "w1_latest_per_offer",
    f"""SELECT offer_id, business_date, CAST(price AS DOUBLE) AS price, currency, availability, provenance
    FROM {LATEST} AS l""",
)
def _(v):
    return v.latest.select("offer_id", "business_date", *double("price"), "currency", "availability", "provenance")


@query(
    "w2_newest_per_offer",
    f"""SELECT offer_id, business_date, CAST(price AS DOUBLE) AS price, currency
    FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY {DESC}) AS rn
    FROM obs) AS x WHERE rn = 1""",
)
def _(v):
    return v.priced(history.newest_per_offer(v.facts)).select("offer_id", "business_date", *double("price"), "currency")


@query(
    "w3_previous_different_price",
    f"""SELECT offer_id, CAST(price AS DOUBLE) AS previous
    FROM (SELECT o.*, row_number() OVER (PARTITION BY o.offer_id ORDER BY {DESC.replace('observed_at', 'o.observed_at').replace('ord', 'o.ord')}) AS rk
    FROM obs o JOIN {LATEST} AS l ON l.offer_id = o.offer_id AND l.currency = o.currency AND l.price <> o.price) AS x
    WHERE rk = 1""",
)
def _(v):
    return history.previous_different(v.obs, v.latest).select("offer_id", *double("previous"))


@query(
    "w4_price_timeline",
    f"""SELECT offer_id, period_no, opened_because, first_detected_at, last_confirmed_at, n_observations, CAST(price AS DOUBLE) AS price, currency, tax_included,
    lead(first_detected_at) OVER (PARTITION BY offer_id ORDER BY period_no) AS closed_at
    FROM {PERIODS} AS p""",
)
def _(v):
    return history.timeline(v.obs).select("offer_id", "period_no", "opened_because", "first_detected_at", "last_confirmed_at", "n_observations", *double("price"), "currency", "tax_included", "closed_at")


@query(
    "w5_current_state",
    f"""SELECT offer_id, CAST(price AS DOUBLE) AS price, currency, availability, stock_quantity, first_seen_at, confirmed_at, n
    FROM (SELECT *, min(observed_at) OVER (PARTITION BY offer_id) AS first_seen_at, max(observed_at) OVER (PARTITION BY offer_id) AS confirmed_at, count(*) OVER (PARTITION BY offer_id) AS n,
    row_number() OVER (PARTITION BY offer_id ORDER BY {DESC}) AS rn
    FROM obs) AS x WHERE rn = 1""",
)
def _(v):
    return history.current_state(v.obs).select("offer_id", *double("price"), "currency", "availability", "stock_quantity", "first_seen_at", "confirmed_at", "n")


MOVES = f"""(SELECT * FROM (SELECT *, CASE WHEN lag(offer_id) OVER w IS NULL THEN NULL WHEN lag(currency) OVER w <> currency THEN 'currency_change'
 WHEN price > lag(price) OVER w THEN 'price_up' WHEN price < lag(price) OVER w THEN 'price_down' WHEN lag(availability) OVER w <> availability THEN 'availability_change' END AS change_type
 FROM obs WHERE provenance = 'observed'
 WINDOW w AS (PARTITION BY offer_id ORDER BY {ORD})) AS m
 WHERE change_type IS NOT NULL)"""


@query("w6_price_moves", f"SELECT offer_id, observed_at, ord1, ord2, ord3, change_type, CAST(price AS DOUBLE) AS price FROM {MOVES} AS m")
def _(v):
    return history.moves(v.obs).select("offer_id", "observed_at", "ord1", "ord2", "ord3", "change_type", *double("price"))


for bucket, part in (("day", "business_date"), ("week", "year(business_date), strftime(business_date, '%W')")):

    @query(f"w7_survivors_by_{bucket}", f"SELECT offer_id, business_date, ord1, ord2, ord3 FROM (SELECT *, row_number() OVER (PARTITION BY offer_id, {part} ORDER BY {DESC}) AS rn FROM obs WHERE business_date < DATE '1998-01-01') AS x WHERE rn = 1")
    def _(v, bucket=bucket):
        return history.survivors(v.obs, bucket, "1998-01-01").select("offer_id", "business_date", "ord1", "ord2", "ord3")


BOUNDS = "(SELECT offer_id, min(business_date) AS f, max(business_date) AS l, min(price) AS mi, max(price) AS ma FROM obs GROUP BY offer_id)"
PROTECTED = " UNION ALL ".join(
    f"SELECT o.offer_id, o.business_date, o.ord1, o.ord2, o.ord3, '{r}' AS reason FROM obs o JOIN {BOUNDS} AS b ON b.offer_id = o.offer_id WHERE o.{c} = b.{k}"
    for r, c, k in (("first", "business_date", "f"), ("latest", "business_date", "l"), ("minimum", "price", "mi"), ("maximum", "price", "ma"))
)


@query("w8_protected_rows", PROTECTED)
def _(v):
    return history.protected(v.obs).select("offer_id", "business_date", "ord1", "ord2", "ord3", "reason")


@query(
    "u1_protected_set",
    f"""SELECT DISTINCT offer_id, business_date, ord1, ord2, ord3
    FROM ({PROTECTED}
    UNION ALL SELECT offer_id, business_date, ord1, ord2, ord3, 'pinned'
    FROM obs WHERE ord1 % 97 = 0) AS p""",
)
def _(v):
    keys = ["offer_id", "business_date", "ord1", "ord2", "ord3"]
    return v.obs.withColumn("held", history.is_protected() | (F.col("ord1") % 97 == 0)).where("held").select(*keys).distinct()


RETAINED = f"""SELECT DISTINCT offer_id, business_date, ord1, ord2, ord3 FROM (SELECT offer_id, business_date, ord1, ord2, ord3 FROM ({PROTECTED}) AS p
 UNION ALL SELECT offer_id, business_date, ord1, ord2, ord3 FROM obs WHERE business_date >= DATE '1998-01-01' OR source_id = 0

 UNION ALL SELECT offer_id, business_date, ord1, ord2, ord3
 FROM (SELECT *, row_number() OVER (PARTITION BY offer_id, CASE WHEN source_id = 1 THEN CAST(business_date AS VARCHAR) ELSE strftime(business_date, '%Y-%W') END
 ORDER BY {DESC}) AS rn FROM obs WHERE business_date < DATE '1998-01-01' AND source_id <> 0) AS x
 WHERE rn = 1) AS r"""


@query("u2_retained_rows", RETAINED)
def _(v):
    from tallyhouse.operators import retention

    return retention.retained(v.obs, {0: "keep_all", 1: "daily"}, "weekly", "1998-01-01").select("offer_id", "business_date", "ord1", "ord2", "ord3")


@query(
    "t23_retention_run",
    f"""SELECT source_id, count(*) AS before, count(k.ord1) AS kept, count(*) - count(k.ord1) AS dropped
    FROM obs o
    LEFT JOIN ({RETAINED}) AS k ON k.offer_id = o.offer_id AND k.business_date = o.business_date AND k.ord1 = o.ord1 AND k.ord2 = o.ord2 AND k.ord3 = o.ord3
    GROUP BY source_id""",
)
def _(v):
    from tallyhouse.operators import retention

    return retention.report(v.obs, retention.retained(v.obs, {0: "keep_all", 1: "daily"}, "weekly", "1998-01-01"))


@query(
    "u3_protected_minus_kept",
    f"""SELECT count(*) AS missing FROM (SELECT DISTINCT offer_id, business_date, ord1, ord2, ord3
    FROM ({PROTECTED}) AS p EXCEPT {RETAINED}) AS m""",
)
def _(v):
    from tallyhouse.operators import retention

    keys = ["offer_id", "business_date", "ord1", "ord2", "ord3"]
    kept = retention.retained(v.obs, {0: "keep_all", 1: "daily"}, "weekly", "1998-01-01")
    return history.protected(v.obs).select(*keys).distinct().join(kept.select(*keys), keys, "left_anti").agg(F.count("*").alias("missing"))


@query("a3_periods_per_offer", f"SELECT offer_id, count(*) AS periods FROM {PERIODS} AS p GROUP BY offer_id")
def _(v):
    return history.timeline(v.obs).groupBy("offer_id").agg(F.count("*").alias("periods"))


@query(
    "a23_movers",
    f"""SELECT offer_id, count(*) AS periods, max(first_detected_at) AS moved_at
    FROM {PERIODS} AS p
    GROUP BY offer_id
    HAVING count(*) > 1
    ORDER BY periods DESC, offer_id LIMIT 50""",
)
def _(v):
    rows = history.timeline(v.obs).groupBy("offer_id").agg(F.count("*").alias("periods"), F.max("first_detected_at").alias("moved_at"))
    return rows.where("periods > 1").orderBy(F.col("periods").desc(), "offer_id").limit(50)


@query("a2_change_counts", f"SELECT change_type, count(*) AS n FROM {MOVES} AS m GROUP BY change_type")
def _(v):
    return history.moves(v.obs).groupBy("change_type").agg(F.count("*").alias("n"))


@query(
    "a5_price_extremes",
    f"""SELECT l.offer_id, l.currency, CAST(l.price AS DOUBLE) AS current, CAST(min(o.price) AS DOUBLE) AS lowest, CAST(max(o.price) AS DOUBLE) AS highest, count(*) AS n,
 CAST(first(o.price ORDER BY {', '.join('o.' + x for x in ORD.split(', '))}) AS DOUBLE) AS first, CAST(last(o.price ORDER BY {', '.join('o.' + x for x in ORD.split(', '))}) FILTER (WHERE o.price <> l.price) AS DOUBLE) AS previous,
 CAST(l.price - last(o.price ORDER BY {', '.join('o.' + x for x in ORD.split(', '))}) FILTER (WHERE o.price <> l.price) AS DOUBLE) AS change
 FROM {LATEST} AS l JOIN obs o ON o.offer_id = l.offer_id AND o.currency = l.currency GROUP BY l.offer_id, l.currency, l.price""",
)
def _(v):
    return history.extremes(v.obs).select("offer_id", "currency", *double("current", "lowest", "highest"), "n", *double("first", "previous", "change"))


ASKED = "(SELECT offer_id, DATE '1996-06-15' AS day FROM offer WHERE offer_id % 3 = 0 UNION ALL SELECT offer_id, DATE '1999-12-31' FROM offer UNION ALL SELECT 0 - offer_id, DATE '1996-06-15' FROM offer WHERE offer_id % 50 = 0)"


@query(
    "j5_price_on_date",
    f"""SELECT offer_id, day, CASE WHEN n = 0 THEN 'no_history' WHEN last_day IS NULL THEN 'before_tracking' WHEN last_day >= day THEN 'confirmed' ELSE 'last_known' END AS status,
    price, currency FROM (
 SELECT a.offer_id, a.day, count(p.period_no) OVER (PARTITION BY a.offer_id, a.day) AS n, CAST(CASE WHEN CAST(p.first_detected_at AS DATE) <= a.day THEN p.last_confirmed_at END AS DATE) AS last_day,
 CASE WHEN CAST(p.first_detected_at AS DATE) <= a.day THEN CAST(p.price AS DOUBLE) END AS price, CASE WHEN CAST(p.first_detected_at AS DATE) <= a.day THEN p.currency END AS currency,
 row_number() OVER (PARTITION BY a.offer_id, a.day ORDER BY CASE WHEN CAST(p.first_detected_at AS DATE) <= a.day THEN 0 ELSE 1 END, p.period_no DESC) AS rn
 FROM {ASKED} AS a LEFT JOIN {PERIODS} AS p ON p.offer_id = a.offer_id) AS x WHERE rn = 1""",
)
def _(v):
    day = lambda d: F.lit(d).cast("date").alias("day")
    # Every third offer on an early day, all on a late one, and ids that no offer has; the offers are gathered once.
    known, other = F.col("offer_id"), (-F.col("offer_id")).alias("offer_id")
    asks = [F.when(known % 3 == 0, F.struct(known, day("1996-06-15"))), F.struct(known, day("1999-12-31")), F.when(known % 50 == 0, F.struct(other, day("1996-06-15")))]
    asked = v.facts.select("offer_id").distinct().select(F.inline(F.array_compact(F.array(*asks))).alias("offer_id", "day"))
    return history.price_on(asked, history.timeline(v.obs)).select("offer_id", "day", "status", *double("price"), "currency")


STAR = "obs o JOIN offer f ON f.offer_id = o.offer_id JOIN product p ON p.source_id = o.source_id AND p.product_id = o.product_id JOIN site s ON s.source_id = o.source_id"


@query(
    "j1_star_latest",
    f"""SELECT o.offer_id, s.source_key, p.product_name, p.brand, f.region, f.unit_code, CAST(o.price AS DOUBLE) AS price, o.currency
    FROM {LATEST} AS o JOIN offer f ON f.offer_id = o.offer_id
    JOIN product p ON p.source_id = o.source_id AND p.product_id = o.product_id
    JOIN site s ON s.source_id = o.source_id""",
)
def _(v):
    return v.flat(history.latest_per_offer(v.facts)).select("offer_id", "source_key", "product_name", "brand", "region", "unit_code", *double("price"), "currency")


@query(
    "j17_history_export",
    f"""SELECT o.offer_id, s.source_key, p.product_name, f.region, o.observed_at, o.ord1, o.ord2, CAST(o.price AS DOUBLE) AS price, o.currency, o.provenance
    FROM {STAR} WHERE f.status = 'active'""",
)
def _(v):
    rows = lookups.star(v.obs, v.offer, v.product, v.site).where("status = 'active'")
    return rows.select("offer_id", "source_key", "product_name", "region", "observed_at", "ord1", "ord2", *double("price"), "currency", "provenance").orderBy("source_key", "offer_id", "observed_at", "ord1")


@query("p5_active_offers", "SELECT source_id, region, count(*) AS offers FROM offer WHERE status = 'active' GROUP BY source_id, region")
def _(v):
    return v.offer.where("status = 'active'").groupBy("source_id", "region").agg(F.count("*").alias("offers"))


@query(
    "j3_tax_by_most_specific_rule",
    """SELECT offer_id, source_key, region, material_key, coalesce(tax_mode, 'UNVERIFIED') AS tax_mode, tax_rate_pct FROM (SELECT f.offer_id, s.source_key, f.region, p.material_key, t.tax_mode, t.tax_rate_pct,
 row_number() OVER (PARTITION BY f.offer_id ORDER BY CASE WHEN t.region <> '*' THEN 2 ELSE 0 END + CASE WHEN t.material_key <> '*' THEN 1 ELSE 0 END DESC) AS rn
 FROM offer f JOIN site s ON s.source_id = f.source_id JOIN product p ON p.source_id = f.source_id AND p.product_id = f.product_id
 LEFT JOIN tax_rule t ON t.source_key = s.source_key AND t.region IN (f.region, '*') AND t.material_key IN (p.material_key, '*')) AS x WHERE rn = 1""",
)
def _(v):
    facts = v.offer.join(v.site, "source_id").join(v.product.select("source_id", "product_id", "material_key"), ["source_id", "product_id"]).select("offer_id", "source_key", "region", "material_key")
    rows = lookups.most_specific(facts, v.tax_rule, ["region", "material_key"], ["source_key"])
    return rows.select("offer_id", "source_key", "region", "material_key", F.coalesce("tax_mode", F.lit("UNVERIFIED")).alias("tax_mode"), "tax_rate_pct")


RATE = "(SELECT currency, per_usd FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY CASE WHEN source_kind = 'provider' THEN 0 ELSE 1 END, as_of DESC) AS rn FROM currency_rate WHERE per_usd > 0) AS r WHERE rn = 1)"


@query(
    "j4_prices_in_usd",
    f"""SELECT l.offer_id, l.currency, CAST(l.price AS DOUBLE) AS price, round(CAST(l.price AS DOUBLE) / CAST(r.per_usd AS DOUBLE), 4) AS usd
    FROM {LATEST} AS l
    LEFT JOIN {RATE} AS r ON r.currency = l.currency""",
)
def _(v):
    rates = lookups.rate_by_authority(v.currency_rate).select("currency", "per_usd")
    rows = v.latest.join(rates, "currency", "left")
    return rows.select("offer_id", "currency", *double("price"), F.round(F.col("price").cast("double") / F.col("per_usd"), 4).alias("usd"))


@query(
    "a14_rate_status",
    f"""SELECT c.currency, count(*) AS n, max(c.as_of) AS newest, max(CAST(r.per_usd AS DOUBLE)) AS per_usd
    FROM currency_rate c JOIN {RATE} AS r ON r.currency = c.currency
    JOIN (SELECT DISTINCT currency FROM obs) AS u ON u.currency = c.currency
    GROUP BY c.currency""",
)
def _(v):
    best = lookups.rate_by_authority(v.currency_rate).select("currency", "per_usd")
    used = v.obs.select("currency").distinct()
    return v.currency_rate.groupBy("currency").agg(F.count("*").alias("n"), F.max("as_of").alias("newest")).join(best, "currency").join(used, "currency", "left_semi").select("currency", "n", "newest", "per_usd")


@query("p1_scope_reasons", """SELECT offer_id, CASE WHEN source_key NOT IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'source not declared' WHEN source_key = 'EUROPE' AND region NOT IN ('NATION_7',
 'NATION_8') THEN 'region out of scope' WHEN source_key = 'AFRICA' AND material_key NOT IN ('ECONOMY', 'PROMO') THEN 'material out of scope' END AS reject_reason
 FROM offer f JOIN site s ON s.source_id = f.source_id JOIN product p ON p.source_id = f.source_id AND p.product_id = f.product_id""")
def _(v):
    scopes = v.spark.createDataFrame([("ASIA", ["*"], []), ("EUROPE", ["NATION_7", "NATION_8"], []), ("AFRICA", ["*"], ["ECONOMY", "PROMO"])], "source_key string, regions array<string>, materials array<string>")
    facts = v.offer.join(v.site, "source_id").join(v.product.select("source_id", "product_id", "material_key"), ["source_id", "product_id"])
    return lookups.scope_reasons(facts, scopes).select("offer_id", "reject_reason")


@query("p2_volume_canary", """SELECT source_id, run, rows, previous, CASE WHEN rows < 40 THEN 'below minimum' WHEN 1 - rows / previous > 0.2 THEN 'drop' END AS breach
 FROM (SELECT source_id, run, rows, lag(rows) OVER (PARTITION BY source_id ORDER BY run) AS previous
 FROM (SELECT source_id, run_id AS run, count(*) AS rows
 FROM obs
 GROUP BY source_id, run_id) AS r) AS x""")
def _(v):
    runs = v.obs.groupBy("source_id", F.col("run_id").alias("run")).agg(F.count("*").alias("rows"))
    return lookups.volume_breaches(runs, 40, 0.2).select("source_id", "run", "rows", "previous", "breach")


@query(
    "p3_filter_language",
    f"""SELECT offer_id, business_date, CAST(price AS DOUBLE) AS price
    FROM {LATEST} AS l WHERE availability = 'in_stock' AND price >= 950 AND business_date > DATE '1996-01-01' AND lower(currency) LIKE '%sa%'""",
)
def _(v):
    asked = {"f.availability": "is:in_stock", "f.price": "gte:950", "f.business_date": "after:1996-01-01", "f.currency": "has:SA", "f.secret": "is:1"}
    rows, ignored = lookups.filtered(v.latest, asked, {"availability": ["is"], "price": ["gte", "lte"], "business_date": ["after", "before"], "currency": ["has", "is"]})
    assert ignored == ["f.secret"]
    return rows.select("offer_id", "business_date", *double("price"))


OWNED = """
SELECT c.offer_id, c.source_id, CASE WHEN f.source_id IS NULL THEN 'no such offer' WHEN f.source_id = c.source_id THEN 'owned' ELSE 'of another source' END AS verdict
FROM (SELECT DISTINCT CASE WHEN ord4 = 50 THEN 0 - offer_id ELSE offer_id END AS offer_id, CAST(ord4 % 5 AS INT) AS source_id FROM obs) AS c
LEFT JOIN offer f ON f.offer_id = c.offer_id
"""


@query("p13_offer_identity", OWNED)
def _(v):
    # Claims that an offer is a source's, as requests would make them: right ones, wrong ones, and ids that don't exist.
    claimed = F.when(F.col("ord4") == 50, -F.col("offer_id")).otherwise(F.col("offer_id"))
    claims = v.facts.select(claimed.alias("offer_id"), (F.col("ord4") % 5).cast("int").alias("source_id")).distinct()
    owners = v.facts.select("offer_id", F.col("source_id").alias("owner")).distinct()
    return lookups.ownership(claims, owners).select("offer_id", "source_id", "verdict")


@query(
    "w13_changes_only",
    f"""SELECT offer_id, observed_at, ord1, ord2, ord3, CAST(price AS DOUBLE) AS price
    FROM (SELECT *, lag(price) OVER (PARTITION BY offer_id ORDER BY {ORD}) AS b
    FROM obs WHERE provenance = 'reported') AS x
    WHERE b IS NULL OR b <> price""",
)
def _(v):
    return history.changes_only(v.obs.where("provenance = 'reported'"), "offer_id", list(history.ORDER), "price").select("offer_id", "observed_at", "ord1", "ord2", "ord3", *double("price"))


@query(
    "w14_moved_since",
    f"""SELECT year(first_detected_at) AS year, month(first_detected_at) AS month, count(DISTINCT offer_id) AS moved
    FROM {PERIODS} AS p WHERE opened_because = 'price_change' AND first_detected_at >= TIMESTAMP '1998-01-01'
    GROUP BY year(first_detected_at), month(first_detected_at)""",
)
def _(v):
    rows = history.timeline(v.obs).where("opened_because = 'price_change' and first_detected_at >= timestamp_ntz'1998-01-01'")
    return rows.groupBy(F.year("first_detected_at").alias("year"), F.month("first_detected_at").alias("month")).agg(F.count_distinct("offer_id").alias("moved"))


@query(
    "o1_allowed_sort",
    f"""SELECT l.offer_id, p.product_name, CAST(l.price AS DOUBLE) AS price
    FROM {LATEST} AS l JOIN product p ON p.source_id = l.source_id AND p.product_id = l.product_id
    ORDER BY l.price DESC, p.product_name, l.offer_id LIMIT 100""",
)
def _(v):
    rows = v.flat(history.latest_per_offer(v.facts))
    return lookups.page(rows, [F.col("price").desc(), F.col("product_name"), F.col("offer_id")], 0, 100).select("offer_id", "product_name", *double("price"))


@query("o2_page", "SELECT offer_id, region FROM offer ORDER BY region, offer_id LIMIT 50 OFFSET 100")
def _(v):
    return lookups.page(v.offer, [F.col("region"), F.col("offer_id")], 100, 50).select("offer_id", "region")


@query(
    "o3_keyset_page",
    """SELECT offer_id, count(*) OVER () > 40 AS has_more
    FROM (SELECT offer_id FROM offer WHERE offer_id > 1000 ORDER BY offer_id LIMIT 41) AS x
    ORDER BY offer_id LIMIT 40""",
)
def _(v):
    return lookups.after_key(v.offer.select("offer_id"), "offer_id", 1000, 40)
