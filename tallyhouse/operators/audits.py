"""Directory audits: sightings, coverage, departures, drift, uniqueness, profiles, completeness, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ledger(sightings: DataFrame) -> DataFrame:
    """One row for each (dataset, id): first and last sight and in how many runs. Blank ids are left out."""
    rows = sightings.where(F.trim("external_id") != "")
    return rows.groupBy("dataset_key", "external_id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count_distinct("run_date").alias("seen_count"))


def merged_ledgers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ledgers as one: least first, largest last, largest count; the order of merging, and merging again, don't matter."""
    return a.unionByName(b).groupBy("dataset_key", "external_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("seen_count").alias("seen_count"))


def missing(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Ledger rows that no stored record answers."""
    return seen.join(stored.select("dataset_key", "external_id"), ["dataset_key", "external_id"], "left_anti")


def departures(stored: DataFrame, seen: DataFrame, not_seen_since) -> DataFrame:
    """Active stored records that were last seen before a moment (gone) or never (unsighted)."""
    rows = stored.where("status = 'active'").join(seen, ["dataset_key", "external_id"], "left")
    why = F.when(F.col("last_seen_at").isNull(), "unsighted").when(F.col("last_seen_at") < F.lit(not_seen_since).cast("timestamp_ntz"), "gone")
    return rows.withColumn("departure", why).where("departure is not null")


def coverage(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """For each dataset: ids seen, of them stored, and the share; counts instead of 1 where nothing was seen."""
    both = seen.select("dataset_key", "external_id").join(stored.select("dataset_key", "external_id", F.lit(1).alias("kept")).distinct(), ["dataset_key", "external_id"], "left")
    return both.groupBy("dataset_key").agg(F.count("*").alias("seen"), F.count("kept").alias("stored"), (F.count("kept") / F.count("*")).alias("share"))


def drift(sightings: DataFrame, key: list[str]) -> DataFrame:
    """Ids shown on more than one page of a run: how many, and how many slots they took again."""
    per = sightings.groupBy(*key, "external_id").agg(F.count_distinct("page_no").alias("pages"), F.count("*").alias("slots"))
    return per.groupBy(*key).agg(F.sum(F.when(F.col("pages") > 1, 1).otherwise(0)).alias("drifting"), F.sum(F.col("slots") - 1).alias("shown_again"), F.count("*").alias("ids"))


def shared_values(rows: DataFrame, field: str, identity: str) -> DataFrame:
    """Values of a field that several identities have; blank ones count as a value."""
    value = F.coalesce(F.trim(F.col(field).cast("string")), F.lit(""))
    return rows.groupBy(value.alias("value")).agg(F.count_distinct(identity).alias("identities")).where("identities > 1")


def profile(rows: DataFrame) -> DataFrame:
    """For each column: filled, distinct, the narrowest type that fits every value, and whether it could identify a row.

    One pass: all columns are aggregated side by side, then turned into rows.
    """
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in rows.columns}
    every = lambda c, pattern: F.coalesce(F.every(text[c].rlike(pattern)), F.lit(False))
    shapes = {"integer": "^-?[0-9]+$", "decimal": "^-?[0-9]+(\\.[0-9]+)?$", "boolean": "(?i)^(true|false)$", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "url": "^https?://"}
    fits = lambda c: [every(c, pattern).alias(kind) for kind, pattern in shapes.items()]
    facts = rows.agg(F.count("*").alias("n"), *[F.struct(F.count(text[c]).alias("filled"), F.count_distinct(text[c]).alias("values"), *fits(c)).alias(c) for c in rows.columns])
    order = ("boolean", "integer", "decimal", "date", "url")
    kind = lambda c: F.coalesce(*[F.when(F.col(f"{c}.{k}"), k) for k in order], F.lit("text"))
    filled, values = (lambda c, k=k: F.col(f"{c}.{k}") for k in ("filled", "values"))
    identifies = lambda c: (filled(c) == F.col("n")) & (values(c) == F.col("n"))
    one = lambda c: F.struct(F.lit(c).alias("column"), filled(c).alias("filled"), values(c).alias("values"), kind(c).alias("kind"), identifies(c).alias("identifies"))
    return facts.select(F.explode(F.array(*map(one, rows.columns))).alias("c")).select("c.*")


def presence(rows: DataFrame, by: str) -> DataFrame:
    """How many values each source fills of each column."""
    others = [c for c in rows.columns if c != by]
    counts = rows.groupBy(by).agg(*[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in others])
    return counts.unpivot(by, others, "column", "filled")


def completeness(sightings: DataFrame, declared: DataFrame, cell: str) -> DataFrame:
    """For each cell what was declared, what was seen, the deficit and a verdict."""
    seen = sightings.groupBy(cell).agg(F.count_distinct("external_id").alias("seen"))
    out = declared.join(seen, cell, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    deficit = F.col("declared") - F.col("seen")
    return out.withColumn("deficit", deficit).withColumn("verdict", F.when(F.col("declared").isNull(), "unsized").when(deficit <= 0, "complete").otherwise("short"))


def exhaustiveness(cells: DataFrame) -> DataFrame:
    """Whether all cells together are provably complete."""
    return cells.agg(F.sum("declared").alias("declared"), F.sum("seen").alias("seen"), F.sum(F.when(F.col("deficit") > 0, F.col("deficit")).otherwise(0)).alias("deficit"), F.every(F.coalesce(F.col("verdict") == "complete", F.lit(False))).alias("complete"))


def convergence(sightings: DataFrame, key: str, dry: int = 2) -> DataFrame:
    """For each pass over a dataset: new ids, all so far, passes without new ones in a row, and whether that is enough."""
    first = sightings.groupBy(key, "external_id").agg(F.min("run_date").alias("run_date"))
    fresh = first.groupBy(key, "run_date").agg(F.count("*").alias("fresh"))
    passes = sightings.select(key, "run_date").distinct().join(fresh, [key, "run_date"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    own = Window.partitionBy(key).orderBy("run_date")
    island = F.sum(F.when(F.col("fresh") > 0, 1).otherwise(0)).over(own)
    rows = passes.withColumn("so_far", F.sum("fresh").over(own)).withColumn("_island", island)
    streak = F.sum(F.when(F.col("fresh") == 0, 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy("run_date"))
    return rows.withColumn("dry", streak).withColumn("converged", F.col("dry") >= dry).drop("_island")


def row_state(status: Column, first_seen: Column, last_seen: Column, last_absent: Column, changed: Column, newest: Column) -> Column:
    """One word for a record, by fixed precedence."""
    return (
        F.when(status == "unavailable", F.when(last_seen > last_absent, "returned").otherwise("unavailable"))
        .when(last_seen.isNull(), "unsighted")
        .when(last_absent.isNotNull() & (last_seen > last_absent), "returned")
        .when(last_absent.isNotNull() & (last_seen < last_absent), "absent")
        .when(first_seen >= newest, "new")
        .when(changed >= newest, "changed")
        .when(last_seen < newest, "stale")
        .otherwise("current")
    )


def availability_marks(stored: DataFrame, seen: DataFrame, absent: DataFrame) -> DataFrame:
    """What a proved absence changes: active records seen strictly before it become unavailable, unavailable ones seen after it are restored."""
    rows = stored.join(seen.select("dataset_key", "external_id", "last_seen_at"), ["dataset_key", "external_id"], "left").join(absent, ["dataset_key", "external_id"], "left")
    gone = (F.col("status") == "active") & F.col("last_absent_at").isNotNull() & (F.coalesce(F.col("last_seen_at") < F.col("last_absent_at"), F.lit(True)))
    back = (F.col("status") == "unavailable") & F.coalesce(F.col("last_seen_at") > F.col("last_absent_at"), F.col("last_seen_at").isNotNull())
    return rows.withColumn("mark", F.when(gone, "unavailable").when(back, "restored")).where("mark is not null")


def promotable(products: DataFrame) -> DataFrame:
    """kind, code, products: attribute codes (array ``codes``) and option axes (keys of the JSON ``axes``) of more than one product."""
    codes = products.select("product_id", F.lit("attribute").alias("kind"), F.explode(F.array_compact("codes")).alias("code"))
    axes = products.select("product_id", F.lit("axis").alias("kind"), F.explode(F.json_object_keys("axes")).alias("code"))
    counts = codes.unionByName(axes).groupBy("kind", "code").agg(F.count_distinct("product_id").alias("products"))
    return counts.where("products > 1")


def pivoted(stated: DataFrame, codes: list[str], key: str) -> DataFrame:
    """A column for each label of the allowed codes, with the last value stated for it (``at``). Labels are few: there is one for each code and language."""
    rows = stated.where(F.col("code").isin(codes))
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    return rows.groupBy(key).pivot("label", labels).agg(F.max_by("raw_value", "at"))
