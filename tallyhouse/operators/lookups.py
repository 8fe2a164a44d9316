"""Joins of facts with dimensions: rules with wildcards, rates by authority, saved filters, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def star(obs: DataFrame, offer: DataFrame, product: DataFrame, site: DataFrame) -> DataFrame:
    """Observations with their offer, product and site. Facts meet offers on the offer's key; the site dimension is a row for each site."""
    o = offer.select("offer_id", "region", "unit_code", "basis_quantity", "status")
    p = product.select("source_id", "product_id", "product_name", "brand", "category_path", "material_key", "curation")
    return obs.join(o, "offer_id").join(p, ["source_id", "product_id"]).join(site, "source_id")


def most_specific(facts: DataFrame, rules: DataFrame, facets: list[str], on: list[str], wildcard: str = "*") -> DataFrame:
    """Each fact with its most specific rule; facets named first weigh more. Facts without a rule keep nulls.

    Rules are grouped into one row for each ``on``, and each fact picks from its row's array, so facts are never multiplied;
    while that table is below Spark's own threshold in bytes, they aren't shuffled either.
    """
    values = [c for c in rules.columns if c not in (*on, *facets)]
    table = rules.groupBy(*on).agg(F.collect_list(F.struct(*[F.col(c).alias(f"rule_{c}") for c in facets], *values)).alias("_rules"))
    weight = {c: 1 << (len(facets) - 1 - k) for k, c in enumerate(facets)}

    def fits(r: Column) -> Column:
        out = F.lit(True)
        for c in facets:
            out = out & ((r[f"rule_{c}"] == F.col(c)) | (r[f"rule_{c}"] == wildcard))
        return out

    def rank(r: Column) -> Column:
        return sum((F.when(r[f"rule_{c}"] != wildcard, w).otherwise(0) for c, w in weight.items()), F.lit(0))

    picked = F.array_max(F.transform(F.filter("_rules", fits), lambda r: F.struct(rank(r).alias("rank"), r.alias("rule"))))["rule"]
    return facts.join(table, on, "left").withColumn("_rule", picked).select(*facts.columns, *[F.col(f"_rule.{c}").alias(c) for c in values])


def rate_by_authority(rates: DataFrame) -> DataFrame:
    """One rate for each currency: a provider's before a shop's, then the newest."""
    best = F.max(F.struct((F.col("source_kind") == "provider").alias("authority"), "as_of", "source_key", "per_usd")).alias("r")
    return rates.where("per_usd > 0").groupBy("currency").agg(best).select("currency", "r.per_usd", "r.as_of", "r.source_key")


OPERATORS = {
    "has": lambda c, v: F.lower(c.cast("string")).contains(str(v).lower()),
    "is": lambda c, v: c == v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "after": lambda c, v: c > F.lit(v).cast("date"),
    "before": lambda c, v: c < F.lit(v).cast("date"),
}


def filtered(df: DataFrame, asked: dict[str, str], allowed: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Rows that meet filters of the form ``f.<column> = <operator>:<value>``; what isn't allowed is returned, not guessed at."""
    ignored = []
    for key, said in asked.items():
        column, (operator, _, value) = key.removeprefix("f."), said.partition(":")
        if not key.startswith("f.") or operator not in allowed.get(column, ()) or not value:
            ignored.append(key)
        else:
            df = df.where(OPERATORS[operator](F.col(column), value))
    return df, ignored


def scope_reasons(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """``reject_reason`` for each row: null where some scope of its source accepts region and material ('*' or an empty list accepts all)."""
    table = scopes.groupBy("source_key").agg(F.collect_list(F.struct("regions", "materials")).alias("_scopes"))
    region = lambda s: F.array_contains(s["regions"], F.col("region")) | F.array_contains(s["regions"], "*")
    material = lambda s: (F.size(s["materials"]) == 0) | F.array_contains(s["materials"], F.col("material_key"))
    why = F.when(F.col("_scopes").isNull(), "source not declared").when(~F.exists("_scopes", region), "region out of scope").when(~F.exists("_scopes", lambda s: region(s) & material(s)), "material out of scope")
    return rows.join(table, "source_key", "left").withColumn("reject_reason", why).drop("_scopes")


def ownership(claims: DataFrame, owners: DataFrame) -> DataFrame:
    """``verdict`` on claims (offer_id, source_id) by the offers' owners (offer_id, owner): an offer counts only under its own source."""
    rows = claims.join(owners, "offer_id", "left")
    own = F.when(F.col("owner") == F.col("source_id"), "owned").otherwise("of another source")
    return rows.withColumn("verdict", F.when(F.col("owner").isNull(), "no such offer").otherwise(own))


def reconciled(stored: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """What the declared sources (key, declared) change in the stored ones (key, active): only rows that differ, sources that nobody declares, and declared ones that were never collected."""
    both = stored.join(declared, key, "full_outer")
    change = F.when(F.col("declared").isNull(), "undeclared").when(F.col("active").isNull(), "never collected")
    change = change.when(F.col("declared") & ~F.col("active"), "activate").when(~F.col("declared") & F.col("active"), "deactivate")
    return both.select(key, change.alias("change")).where("change is not null")


def volume_breaches(runs: DataFrame, minimum: int, most_drop: float) -> DataFrame:
    """``breach`` for each (source, run, rows): no rows, fewer than the minimum, or too large a drop from the last run that had any."""
    before = F.last(F.when(F.col("rows") > 0, F.col("rows")), ignorenulls=True).over(Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("previous", before)
    drop = 1 - F.col("rows") / F.col("previous")
    return rows.withColumn("breach", F.when(F.col("rows") == 0, "no rows").when(F.col("rows") < minimum, "below minimum").when(drop > most_drop, "drop"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """A page of 1 to ``most`` rows."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def after_key(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset pagination: the next ``limit`` rows after a key, and whether there are more."""
    rows = df.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(key))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n")
