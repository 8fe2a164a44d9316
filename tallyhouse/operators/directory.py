"""Locale pairs, details by language, assignments, layouts, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def locales_merged(english: DataFrame, arabic: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records of one locale with the other's values as ``<column>_ar``, where they differ."""
    other = arabic.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return english.join(other, key, "left").select(*english.columns, *[F.when(~F.col(f"_{c}").eqNullSafe(F.col(c)), F.col(f"_{c}")).alias(f"{c}_ar") for c in columns])


def details_by_language(details: DataFrame, keys: list[str], code: str, value: str, prefer_arabic: bool = False) -> DataFrame:
    """A detail for each code without its language mark: the preferred language's value, else the other's. Both languages meet in one aggregation."""
    arabic = F.col(code).endswith("_ar")
    plain = F.regexp_replace(code, "_ar$", "")
    pair = details.groupBy(*keys, plain.alias(code)).agg(F.max(F.when(~arabic, F.col(value))).alias("en"), F.max(F.when(arabic, F.col(value))).alias("ar"))
    return pair.select(*keys, code, (F.coalesce("ar", "en") if prefer_arabic else F.coalesce("en", "ar")).alias(value))


def assigned(feeds: DataFrame, key: list[str], freshness: int | Column, today) -> DataFrame:
    """The feeder of each field: of those that are fresh, the lowest priority; at one priority, a stated variant goes before any, then a stated region before all.

    ``freshness`` is the days after which a feeder is stale, a number or a column of ``feeds``.
    """
    rows = feeds.where(F.date_diff(F.lit(today).cast("date"), "last_seen") <= freshness)
    order = [F.col("priority"), F.col("variant_id").isNull(), F.col("region") == "*", F.col("source_id")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def assignments(feeds: DataFrame, fields: DataFrame, freshness: int | Column, today) -> DataFrame:
    """The feeder of each of ``fields`` (product_id, variant_id, region): declarations for its variant or for all (null), and for its region or for all ('*'), compete by ``assigned``'s order. Fields that no fresh feeder serves are left out."""
    asked = fields.select("product_id", F.col("variant_id").alias("of_variant"), F.col("region").alias("of_region"))
    fits = (F.col("variant_id").isNull() | (F.col("variant_id") == F.col("of_variant"))) & F.col("region").isin("*", F.col("of_region"))
    return assigned(feeds.join(asked, "product_id").where(fits), ["product_id", "of_variant", "of_region"], freshness, today)


def laid_out(df: DataFrame, layout: list[tuple[str, str, bool]]) -> DataFrame:
    """Columns by a saved view: (column, label, shown), in order; columns it doesn't name follow as they are."""
    named = [c for c, _, _ in layout]
    return df.select(*[F.col(c).alias(label) for c, label, shown in layout if shown and c in df.columns], *[c for c in df.columns if c not in named])


def bilingual(df: DataFrame) -> DataFrame:
    """Each pair ``x``, ``x_ar`` with ``x`` filled from the other where it is blank."""
    pairs = [c for c in df.columns if f"{c}_ar" in df.columns]
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"{c}_ar")) for c in pairs})


def adopted_offers(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored offer of each batch row: the exact one, else the same variant's and region's without a unit, which adopts the unit; else none."""
    keys = ["product_id", "region"]
    exact = stored.where("unit_code is not null").select(*keys, "unit_code", F.col("offer_id").alias("exact"))
    blank = stored.where("unit_code is null").groupBy(*keys).agg(F.min("offer_id").alias("blank"))
    rows = batch.join(exact, [*keys, "unit_code"], "left").join(blank, keys, "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("blank").isNotNull(), "adopts").otherwise("new")
    return rows.select(*batch.columns, F.coalesce("exact", "blank").alias("offer_id"), how.alias("how"))


def tree_shape(df: DataFrame) -> DataFrame:
    """Whether rows should be grouped by product: several regions, and names that repeat."""
    facts = df.agg(F.count_distinct("region").alias("regions"), F.count_distinct("product_name").alias("names"), F.count("*").alias("n"))
    return facts.withColumn("grouped", (F.col("regions") > 1) & (F.col("names") < F.col("n")))


def implied_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates that rows with a local price and one in dollars imply: of each currency and ``by`` the last row's (``at``), and how many rows there were."""
    fit = rows.where("local > 0 and usd > 0 and upper(currency) <> 'USD'")
    last = F.max_by(F.col("local") / F.col("usd"), "at").alias("per_usd")
    return fit.groupBy("currency", *by).agg(last, F.count("*").alias("n"))


def commodity_products(rows: DataFrame, crawled: str) -> DataFrame:
    """Commodity rows as product rows: the material is the product, by the site's own name where it gives one.

    A row that the source dates ('reported', with as_of_date) is dated so; all others by the day on which they were collected,
    whatever label the source shows. The row is its country's.
    """
    text = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(""))
    stated = (F.col("provenance") == "reported") & F.col("as_of_date").isNotNull()
    return rows.select(
        F.col("material_key").alias("external_product_id"),
        F.coalesce(F.nullif(F.trim("material_label"), F.lit("")), F.col("material_key")).alias("product_name"),
        text("material_label_ar").alias("product_name_ar"),
        F.col("country_code_alpha2").alias("region"),
        "currency",
        "price",
        text("unit").alias("unit"),
        F.when(stated, "reported").otherwise("observed").alias("provenance"),
        F.when(stated, F.col("as_of_date")).otherwise(F.to_date(crawled)).alias("business_date"),
    )


def price_key(**parts):
    """A versioned hash of what makes a price that price, and the names of the parts that are there; a region of '*' counts as absent."""
    present = {k: F.when(c.cast("string") != "*", F.nullif(F.trim(c.cast("string")), F.lit(""))) for k, c in sorted(parts.items())}
    text = F.concat_ws("|", F.lit("v2"), *[F.concat(F.lit(f"{k}="), c) for k, c in present.items()])
    return F.sha2(text, 256), F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(k)) for k, c in present.items()]))


def group_of_code(codes: DataFrame, rules: DataFrame, code: str) -> DataFrame:
    """The detail group of each code by exact, prefix, then suffix rules (kind, pattern, group); ``_ar`` is no part of a code. Rules are a declared dimension."""
    table = rules.groupBy().agg(F.collect_list(F.struct("kind", "pattern", "group")).alias("_rules"))
    bare = F.regexp_replace(F.lower(code), "_ar$", "")
    fits = lambda r: ((r["kind"] == "exact") & (r["pattern"] == bare)) | ((r["kind"] == "prefix") & F.startswith(bare, r["pattern"])) | ((r["kind"] == "suffix") & F.endswith(bare, r["pattern"]))
    order = lambda r: F.struct(F.array_position(F.array(F.lit("exact"), F.lit("prefix"), F.lit("suffix")), r["kind"]).alias("o"), (-F.length(r["pattern"])).alias("l"), r["group"].alias("group"))
    best = F.array_min(F.transform(F.filter("_rules", fits), order))["group"]
    rules_of = table.withColumn("_one", F.lit(1))  # one row
    return codes.withColumn("_one", F.lit(1)).join(rules_of, "_one").withColumn("detail_group", F.coalesce(best, F.lit("other"))).withColumn("recognised", best.isNotNull()).drop("_rules", "_one")
