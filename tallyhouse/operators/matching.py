"""Products against materials: identifiers, aliases, names, and the best candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.functions.text import name_tokens

#: How much a method's candidates are trusted, strongest first.
RANK = ("gtin", "sku", "alias", "fuzzy")
CONFIDENCE = {"gtin": 0.99, "sku": 0.90, "alias": 0.85}


def by_key(products: DataFrame, materials: DataFrame, product_key: str, material_key: str, method: str) -> DataFrame:
    """Candidates whose identifiers are equal; blanks match nothing."""
    m = materials.where(F.col(material_key) != "").select("material_id", F.col(material_key).alias("_key"))
    rows = products.where(F.col(product_key) != "").join(m, F.col(product_key) == F.col("_key"))
    return rows.select("product_id", "material_id", F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence"))


def by_name(products: DataFrame, materials: DataFrame, product_names: list[str], material_names: list[str], at_least: float = 0.55) -> DataFrame:
    """Candidates of which some pair of names has a token-set Jaccard similarity of at least ``at_least``.

    Distinct names meet by the tokens they share, and only by rare enough ones: of a name's tokens, ordered from rarest to
    commonest, the first n - ceil(n * at_least) + 1 hold one in common with any name that similar (prefix filter), so common
    words give no candidates. Equal names are one.
    """
    def named(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        rows = df.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("name"))
        return rows.select(key, F.array_sort(name_tokens("name")).alias("tokens")).where(F.size("tokens") > 0).distinct()

    p, m = named(products, "product_id", product_names), named(materials, "material_id", material_names)
    pn, mn = p.select("tokens").distinct(), m.select("tokens").distinct()
    common = pn.unionByName(mn).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))

    def prefixed(names: DataFrame) -> DataFrame:
        ranked = names.select("tokens", F.explode("tokens").alias("token")).join(common, "token")
        place = F.row_number().over(Window.partitionBy("tokens").orderBy("df", "token"))
        n = F.size("tokens")
        return ranked.withColumn("_p", place).where(F.col("_p") <= n - F.ceil(n * F.lit(at_least)) + 1).select("tokens", "token")

    met = prefixed(pn).withColumnRenamed("tokens", "a").join(prefixed(mn).withColumnRenamed("tokens", "b"), "token").select("a", "b").distinct()
    like = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    close = met.withColumn("confidence", like).where(F.col("confidence") >= at_least)
    rows = close.join(p.withColumnRenamed("tokens", "a"), "a").join(m.withColumnRenamed("tokens", "b"), "b")
    return rows.groupBy("product_id", "material_id").agg(F.max("confidence").alias("confidence")).select("product_id", "material_id", F.lit("fuzzy").alias("method"), "confidence")


def best(candidates: DataFrame) -> DataFrame:
    """The strongest candidate of each product: method, then confidence, then the smaller material."""
    order = F.array_position(F.array(*map(F.lit, RANK)), F.col("method"))
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("product_id").orderBy(order, F.col("confidence").desc(), "material_id"))).where("_n = 1").drop("_n")


def undecided(candidates: DataFrame, decided: DataFrame, blocked: DataFrame) -> DataFrame:
    """Candidates of products without a decision, without blocked pairs."""
    return candidates.join(decided.select("product_id"), "product_id", "left_anti").join(blocked.select("product_id", "material_id"), ["product_id", "material_id"], "left_anti")


def decisions(events: DataFrame) -> DataFrame:
    """The state of each (product, material) after its decisions in order; 'undo' goes back to pending. A second verdict without an undo is a conflict."""
    own = Window.partitionBy("product_id", "material_id").orderBy("at")
    rows = events.withColumn("before", F.lag("decision").over(own))
    conflict = (F.col("decision") != "undo") & F.col("before").isin("approve", "separate", "new")
    rows = rows.withColumn("conflict", F.coalesce(conflict, F.lit(False)))
    state = F.when(F.col("last") == "undo", "pending").when(F.col("last") == "approve", "approved").when(F.col("last") == "later", "pending").otherwise(F.col("last"))
    return rows.groupBy("product_id", "material_id").agg(F.max_by(F.when(~F.col("conflict"), F.col("decision")), F.when(~F.col("conflict"), F.col("at"))).alias("last"), F.sum(F.col("conflict").cast("int")).alias("conflicts")).select("product_id", "material_id", state.alias("state"), "conflicts")
