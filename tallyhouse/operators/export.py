"""Rows as they leave the warehouse: the full export row, details, folds, headings, capped tables, bundles and what is in them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyhouse.functions import text as x
from tallyhouse.sources.payloads import delete_folder

#: Fixed value: levels into which an exported category path is split.
LEVELS = 10
#: What an export row is made from; columns that a source doesn't have are null.
NEEDED = {
    "string": "product_name product_name_ar region country brand brand_ar category_path category_path_ar category_flat variant variant_ar sku unit_code weight_unit currency "
    "availability tax_mode tax_evidence tax_statement official_source official_source_link variant_url product_link curation",
    "decimal(18,4)": "price price_before price_sale price_trade price_previous price_min price_max",
    "decimal(12,6)": "per_usd",
    "double": "basis_quantity weight tax_rate_pct",
    "long": "product_id observations",
    "int": "tax_included",
    "boolean": "quantity_is_decimal",
    "date": "business_date confirmed_at",
}


def filled(rows: DataFrame) -> DataFrame:
    """``rows`` with a null column for each needed one that is missing, and all of them of the needed type."""
    kinds = {c: kind for kind, names in NEEDED.items() for c in names.split()}
    return rows.withColumns({c: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind) for c, kind in kinds.items()})


def weight_basis(unit: Column, weight: Column, weight_unit: Column, divisible: Column) -> Column:
    """The weight that a price is quoted against, where the source sells by weight and names no unit."""
    said = F.when(weight == F.floor(weight), F.format_number(weight, 0)).otherwise(F.format_number(weight, 2))
    states = (F.coalesce(unit, F.lit("")) == "") & F.coalesce(divisible, F.lit(False)) & (weight > 0) & (F.coalesce(weight_unit, F.lit("")) != "")
    return F.when(states, F.concat(said, F.lit(" "), weight_unit)).otherwise("")


def export_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The full export row of current prices, one name for each column whatever the source fills. Texts are blank, numbers null, where nothing is said."""
    c = F.col
    text = lambda name: F.coalesce(c(name), F.lit(""))
    off = x.discount(c("price_before"), c("price"))
    levels, levels_ar = x.category_levels("category_path", LEVELS), x.category_levels("category_path_ar", LEVELS)
    usd = F.when(F.upper("currency") == "USD", c("price")).when(c("per_usd") > 0, c("price") / c("per_usd"))
    columns = {
        "product_name": text("product_name"),
        "product_name_ar": text("product_name_ar"),
        "country_code_alpha2": F.when(c("region") != "*", c("region")).otherwise(""),
        "country": F.when(c("region") != "*", F.coalesce("country", "region")).otherwise(""),
        "brand": text("brand"),
        "brand_ar": text("brand_ar"),
        "category": text("category_path"),
        "category_ar": F.coalesce(F.nullif(c("category_path_ar"), F.lit("")), c("category_flat"), F.lit("")),
        "product_id": c("product_id"),
        "variant": text("variant"),
        "variant_ar": text("variant_ar"),
        "sku": text("sku"),
        "price": c("price"),
        "unit": x.price_unit("unit_code", F.floor("basis_quantity")),
        "price_basis": weight_basis(c("unit_code"), c("weight"), c("weight_unit"), c("quantity_is_decimal")),
        "price_before": c("price_before"),
        "price_sale": c("price_sale"),
        "price_trade": c("price_trade"),
        "discount": off["amount"],
        "discount_pct": off["pct"],
        "currency": text("currency"),
        "availability": text("availability"),
        "tax_included": F.when(c("tax_included") == 1, "yes").otherwise("no"),
        "tax_evidence": F.coalesce("tax_evidence", F.lit("unknown")),
        "tax_rate_pct": c("tax_rate_pct"),
        "tax_statement": text("tax_statement"),
        "price_changed_on": c("business_date"),
        "last_confirmed_on": c("confirmed_at"),
        "official_source": text("official_source"),
        "official_source_link": text("official_source_link"),
        "product_link": F.coalesce(F.nullif(c("variant_url"), F.lit("")), c("product_link"), F.lit("")),
        "tax": x.tax_label(F.when(c("tax_included") == 1, "incl").otherwise("excl"), c("tax_rate_pct"), c("tax_evidence")),
        "curation": text("curation"),
        "price_previous": c("price_previous"),
        "price_change": x.change_text(c("price_previous"), c("price")),
        "price_min": c("price_min"),
        "price_max": c("price_max"),
        "observations": F.coalesce("observations", F.lit(0)),
        "price_usd": F.coalesce(F.round(usd, 2).cast("decimal(18,2)").cast("string"), F.lit("")),
        "category_leaf": F.coalesce(x.category_leaf("category_path"), F.lit("")),
        "category_leaf_ar": F.coalesce(x.category_leaf("category_path_ar"), F.lit("")),
    }
    for k in range(LEVELS):
        columns |= {f"category_l{k + 1}": F.coalesce(levels[k], F.lit("")), f"category_l{k + 1}_ar": F.coalesce(levels_ar[k], F.lit(""))}
    money = NEEDED["decimal(18,4)"].split()
    return filled(rows).select(*keys, *[(e.cast("double") if name in money else e).alias(name) for name, e in columns.items()])


def details(attributes: DataFrame, offers: DataFrame) -> DataFrame:
    """A row for each stated attribute of products with active offers, with region and SKU of the smallest offer: many offers don't repeat it."""
    first = offers.where("status = 'active'").groupBy("product_id").agg(F.min_by(F.struct("region", "sku"), "offer_id").alias("o"))
    rows = attributes.join(first, "product_id")
    group = F.coalesce(F.nullif(F.col("attribute_group"), F.lit("")), F.lit("Details"))
    return rows.select("product_id", F.when(F.col("o.region") != "*", F.col("o.region")).otherwise("").alias("region"), "o.sku", group.alias("attribute_group"), F.coalesce("label", "code").alias("label"), "raw_value")


def folded(rows: DataFrame, joined: list[str], agreed: list[str]) -> DataFrame:
    """Variants of one product, price, currency and region as one row.

    ``joined`` texts are listed once each, ``agreed`` columns are blank where members disagree, and price_min and price_max are
    the least and the largest. ``offer_id`` is the first's; ``offer_ids`` are all, and ``variants`` says how many.
    """
    keys = ["product_id", "price", "currency", "region"]
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.collect_list(F.trim(c)), lambda t: t != ""))), ", ")
    same = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == 1, F.min(c))
    return rows.groupBy(*keys).agg(
        F.min("offer_id").alias("offer_id"),
        F.array_sort(F.collect_list("offer_id")).alias("offer_ids"),
        F.count("*").alias("variants"),
        F.min("price_min").alias("price_min"),
        F.max("price_max").alias("price_max"),
        *[listed(c).alias(c) for c in joined],
        *[same(c).alias(c) for c in agreed],
    )


def ranked_labels(attributes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """label, group, place: the labels of ``attributes`` (label, attribute_group) as columns would stand: by their best group's rank in ``order``, groups outside it last, then by label."""
    ranks = F.array(*map(F.lit, order))
    rank = F.when(F.array_contains(ranks, F.col("attribute_group")), F.array_position(ranks, F.col("attribute_group"))).otherwise(len(order) + 1)
    best = attributes.groupBy("label").agg(F.min(F.struct(rank.alias("rank"), F.coalesce("attribute_group", F.lit("")).alias("group"))).alias("b"))
    # A row for each label, after the aggregation: what one task numbers grows with the columns, not with the rows.
    return best.select("label", F.col("b.group").alias("group"), F.row_number().over(Window.orderBy("b.rank", "label")).alias("place"))


def cells(attributes: DataFrame, key: str) -> DataFrame:
    """key, cells: the last value stated (``at``) for each label of a key, as a map. Rows are carried so until the columns are known."""
    last = attributes.where("label <> '' and raw_value <> ''").groupBy(key, "label").agg(F.max_by("raw_value", F.struct("at", "raw_value")).alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("cells"))


def widened(rows: DataFrame, maps: list[str], labels: list[str]) -> DataFrame:
    """A column for each label, from the first of the maps that has it; blank where none has. A label that ``rows`` has as a column already gives none."""
    fresh = [x for x in labels if x not in rows.columns]
    said = lambda x: F.coalesce(*[F.try_element_at(m, F.lit(x)) for m in maps], F.lit(""))
    return rows.select(*[c for c in rows.columns if c not in maps], *[said(x).alias(x) for x in fresh])


#: Columns that a pivot may add; beyond, the caller reads the maps.
MOST_COLUMNS = 500


def columns_of(labels: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The labels in place order. A table of more than ``most`` columns isn't made."""
    found = [r["label"] for r in labels.orderBy("place").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} labels: read them as maps")
    return found


def grid(rows: DataFrame, attributes: DataFrame, order: tuple[str, ...], fold: bool, most: int, axes: list[str] = [], joined: tuple[str, ...] = (), whole: bool = False) -> DataFrame:  # noqa: B006
    """One source's grid: capped rows, folded if asked for, with a column for each axis of its variants and each attribute its site filters by.

    ``rows`` has offer_id, product_id, price, currency, region, ``sort`` (the order in which the cap cuts), price_min, price_max,
    tax and whatever else is shown; ``axes`` names columns that stand for a variant's axes, which come before the attributes.
    ``truncated`` says whether the cap cut rows off, before any fold; ``whole`` keeps them all, and it only says whether there are
    more than a page of ``most`` holds. A fold puts variants of one product, price, currency and
    region on a row: ``joined`` texts are listed once each, all else is blank where they disagree. ``tax_id`` numbers the
    distinct tax states of the rows shown.
    """
    if whole:
        shown = rows.drop("sort").withColumn("truncated", F.lit(not rows.offset(most).isEmpty()))
    else:
        shown = capped(rows, ["sort", "offer_id"], most).drop("sort")
    own = shown.select("product_id").distinct()
    told = attributes.join(own, "product_id", "left_semi")
    labels = columns_of(ranked_labels(told, order))
    if fold:
        keys = ["product_id", "price", "currency", "region"]
        agreed = [c for c in shown.columns if c not in (*keys, "offer_id", "price_min", "price_max", "truncated", *joined)]
        shown = folded(shown, list(joined), agreed).join(shown.select("truncated").limit(1))  # one value
    states = shown.select("tax").distinct().select("tax", F.row_number().over(Window.orderBy("tax")).alias("tax_id"))
    rows = shown.join(states, shown["tax"].eqNullSafe(states["tax"])).drop(states["tax"])
    wide = widened(rows.join(cells(told, "product_id"), "product_id", "left"), ["cells"], labels)
    at = [c for c in wide.columns if c not in (*axes, *labels)]
    return wide.select(*at, *axes, *[x for x in labels if x in wide.columns and x not in axes])


def headed(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Rows nested under the values of a column: a heading with its count and rows where a value repeats; singletons stay flat, without rows."""
    nested = rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("rows"))
    return nested.withColumn("nested", F.col("n") > 1).withColumn("rows", F.when(F.col("n") > 1, F.col("rows")))


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in an order, and whether there were more (``truncated``)."""
    top = rows.orderBy(*order).limit(most + 1)  # what follows holds so many rows at most
    numbered = top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return numbered.where(F.col("_n") <= most).drop("_n")


#: Rows of an exported file: a few dozen MB at most.
FILE_ROWS = 100_000


def write_bundle(tables: dict[str, DataFrame], folder: str, by: str = "source_key") -> None:
    """An export: each table twice, as JSON lines (gzipped) for a reader and as CSV for a spreadsheet, a folder for each source, in files of a bounded number of rows. Tables without rows are left out, but for the first.

    A table is computed once, into a folder beside the export, and both formats are made from it.
    """
    for k, (name, df) in enumerate(tables.items()):
        beside = f"{folder.rstrip('/')}_staged_{uuid.uuid4().hex}"
        df.write.parquet(beside, compression="zstd")
        rows = df.sparkSession.read.schema(df.schema).parquet(beside)
        if not k or not rows.isEmpty():
            writer = rows.write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", FILE_ROWS)
            writer.json(f"{folder}/json/{name}", compression="gzip")
            writer.csv(f"{folder}/csv/{name}", header=True, compression="none")
        delete_folder(df.sparkSession, beside)


def contents(spark: SparkSession, folder: str, tables: dict[str, str], kind: str = "json", by: str = "source_key") -> DataFrame:
    """What an export holds, read back: for each table and source its rows, columns and a digest that doesn't depend on their order."""
    out = None
    for name, schema in tables.items():
        reader = spark.read.schema(schema).option("header", True) if kind == "csv" else spark.read.schema(schema)
        df = reader.format(kind).load(f"{folder}/{kind}/{name}")
        columns = [c for c in df.columns if c != by]
        digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
        found = df.groupBy(F.lit(name).alias("table"), by).agg(F.count("*").alias("rows"), F.lit(len(columns)).alias("columns"), digest.alias("digest"))
        out = found if out is None else out.unionByName(found)
    return out


def faults(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """All faults of an export against what it should hold: missing, unexpected and changed parts."""
    a, b = (df.select(*keys, F.struct("rows", "columns", "digest").alias(side)) for df, side in ((expected, "_a"), (found, "_b")))
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, fault.alias("fault")).where("fault is not null")
