"""The warehouse's tables, derived from the given ones, as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.operators import history

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Each derived table: columns (name -> SQL expression), read from what. The expressions mean the same in Spark and in other SQL engines.
OBS = {
    "offer_id": "CAST(l_partkey * 5 + l_suppkey % 5 AS BIGINT)",
    "source_id": "CAST(l_suppkey % 5 AS INT)",
    "product_id": "l_partkey",
    "observed_at": "l_shipdate",
    "business_date": "CAST(l_shipdate AS DATE)",
    "ord1": "CAST(l_orderkey * 10 + l_linenumber AS BIGINT)",
    "ord2": "l_suppkey",
    "ord3": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "ord4": "CAST(l_quantity AS BIGINT)",
    "price_before": "CAST(p_retailprice AS DECIMAL(12,2))",
    "price": "CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))",
    "currency": "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'EGP' ELSE 'SAR' END",
    "tax_included": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
    "availability": "CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'R' THEN 'out_of_stock' ELSE 'unknown' END",
    "stock_quantity": "CAST(l_quantity AS BIGINT)",
    "provenance": "CASE WHEN l_linenumber = 7 THEN 'reported' ELSE 'observed' END",
    "run_id": "year(l_shipdate) * 100 + month(l_shipdate)",
}
OFFER = {
    "region": "n_name",
    "unit_code": "CASE WHEN p_size % 3 = 0 THEN 'kg' WHEN p_size % 3 = 1 THEN 'm' END",
    "basis_quantity": "p_size",
    "status": "CASE WHEN p_size % 17 = 0 THEN 'superseded' ELSE 'active' END",
}
PRODUCT = {
    "product_name": "p_name",
    "brand": "p_brand",
    "category_path": "concat(p_type, ' > ', p_brand, ' > ', p_name)",
    "material_key": "p_type",
    "curation": "CASE WHEN p_partkey % 10 = 0 THEN 'ignored' WHEN p_partkey % 10 < 4 THEN 'selected' ELSE 'inventoried' END",
}
#: Columns of an observation that come from its product.
PRICED = ("price_before", "price")
#: Customers of this segment are never stored as records.
UNSTORED = "c_mktsegment <> 'MACHINERY'"
SIGHTING = {"dataset_key": "event_type", "external_id": "CAST(user_id AS STRING)", "run_date": "CAST(ts AS DATE)", "seen_at": "ts", "page_no": "event_id % 40", "event_id": "event_id"}
STORED = {"dataset_key": "'click'", "external_id": "CAST(c_custkey AS STRING)", "status": "CASE WHEN c_custkey % 11 = 0 THEN 'unavailable' ELSE 'active' END", "c_name": "c_name", "c_nationkey": "c_nationkey", "c_mktsegment": "c_mktsegment"}
PAGE = {"page_id": "page_id", "url": "url", "locale": "regexp_extract(url, '^https?://[^/]+/([a-z][a-z])/', 1)", "locale_free_url": "regexp_replace(url, '/[a-z][a-z]/', '/')", "html": "html"}

#: Small dimensions, as rows.
TAX_RULES = [("ASIA", "*", "*", "incl", 15.0, "stated"), ("ASIA", "NATION_3", "*", "excl", 5.0, "stated"), ("ASIA", "*", "ECONOMY", "incl", None, "general"), ("EUROPE", "NATION_7", "PROMO", "excl", 14.0, "stated"), ("AFRICA", "*", "*", "incl", None, "general")]
RATES = [("SAR", 3.75, "1996-01-01", "provider_x", "provider"), ("SAR", 3.76, "1998-01-01", "provider_x", "provider"), ("SAR", 3.90, "2001-01-01", "shop_a", "shop"), ("EGP", 51.25, "2000-01-01", "shop_a", "shop")]


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join(f'({", ".join(map(text, r))})' for r in rows)}) AS t({names})"


VIEWS = {
    "obs": f"SELECT {_select(OBS)} FROM lineitem JOIN part ON l_partkey = p_partkey",
    "site": "SELECT r_regionkey AS source_id, r_name AS source_key FROM region",
    "product": f"SELECT DISTINCT o.source_id, o.product_id, {_select(PRODUCT)} FROM obs o JOIN part ON p_partkey = o.product_id",
    "offer": f"SELECT DISTINCT o.offer_id, o.source_id, o.product_id, {_select(OFFER)} FROM obs o JOIN part ON p_partkey = o.product_id JOIN nation ON n_nationkey = o.product_id % 25",
    "tax_rule": _values(TAX_RULES, "source_key, region, material_key, tax_mode, tax_rate_pct, tax_evidence"),
    "currency_rate": _values(RATES, "currency, per_usd, as_of, source_key, source_kind"),
    "sighting": f"SELECT {_select(SIGHTING)} FROM events",
    "stored_record": f"SELECT {_select(STORED)} FROM customer WHERE {UNSTORED}",
    "record_rev": "SELECT c_custkey AS record_id, 1 AS rev, c_name, c_mktsegment AS segment FROM customer UNION ALL SELECT c_custkey, 2, c_name, CASE WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, '_X') ELSE c_mktsegment END FROM customer",
    "material": "SELECT min(p_partkey) AS material_id, p_name AS material_name, concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', min(p_type)) AS material_name_alt, CAST(min(p_partkey) * 7 AS STRING) AS gtin FROM part GROUP BY p_name",
    "page_key": f"SELECT {_select(PAGE)} FROM pages",
}


def twin(statement: str) -> str:
    """A statement over the derived tables as one over the given tables."""
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in VIEWS.items())} SELECT * FROM ({statement}) AS answer"


class Warehouse:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _of(df: DataFrame, columns: dict[str, str], *more: str) -> DataFrame:
        return df.select(*more, *[F.expr(x).alias(name) for name, x in columns.items()])

    @cached_property
    def facts(self) -> DataFrame:
        """Observations without their prices: no join, so rows can be chosen before they meet anything."""
        return self._of(self.lineitem, {k: x for k, x in OBS.items() if k not in PRICED}, "l_discount")

    def priced(self, facts: DataFrame) -> DataFrame:
        """Facts with their prices."""
        part = self.part.select("p_partkey", "p_retailprice")
        return self._of(facts.join(part, F.col("product_id") == F.col("p_partkey")), {k: OBS[k] for k in PRICED}, *facts.columns).drop("l_discount")

    @cached_property
    def obs(self) -> DataFrame:
        return self.priced(self.facts)

    @cached_property
    def latest(self) -> DataFrame:
        """The latest observation of each offer; only those meet their prices."""
        return self.priced(history.latest_per_offer(self.facts))

    def flat(self, facts: DataFrame, priced: bool = False) -> DataFrame:
        """Facts with their prices, unless they have them, and all that their offers, products and sites say: each dimension is joined once."""
        rows = facts.join(self.part, F.col("product_id") == F.col("p_partkey"))
        rows = rows.join(self.nation.select("n_nationkey", "n_name"), F.expr("n_nationkey = product_id % 25")).join(self.site, "source_id")
        more = {} if priced else {k: OBS[k] for k in PRICED}
        return self._of(rows, more | OFFER | PRODUCT, *facts.columns, "source_key").drop("l_discount")

    @cached_property
    def site(self) -> DataFrame:
        return self.region.select(F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_key"))

    def _offered(self) -> DataFrame:
        """Product and source of every offer ever observed; the line items are aggregated before they meet any dimension."""
        return self.lineitem.select(F.expr(OBS["offer_id"]).alias("offer_id"), F.expr(OBS["source_id"]).alias("source_id"), F.col("l_partkey").alias("product_id")).distinct()

    @cached_property
    def product(self) -> DataFrame:
        return self._of(self._offered().select("source_id", "product_id").distinct().join(self.part, F.col("product_id") == F.col("p_partkey")), PRODUCT, "source_id", "product_id")

    @cached_property
    def offer(self) -> DataFrame:
        nation = self.nation.select("n_nationkey", "n_name")
        rows = self._offered().join(self.part, F.col("product_id") == F.col("p_partkey")).join(nation, F.expr("n_nationkey = product_id % 25"))
        return self._of(rows, OFFER, "offer_id", "source_id", "product_id")

    @cached_property
    def tax_rule(self) -> DataFrame:
        return self.spark.createDataFrame(TAX_RULES, "source_key string, region string, material_key string, tax_mode string, tax_rate_pct double, tax_evidence string")

    @cached_property
    def currency_rate(self) -> DataFrame:
        return self.spark.createDataFrame(RATES, "currency string, per_usd double, as_of string, source_key string, source_kind string")

    @cached_property
    def sighting(self) -> DataFrame:
        return self._of(self.events, SIGHTING)

    @cached_property
    def stored_record(self) -> DataFrame:
        return self._of(self.customer.where(UNSTORED), STORED)

    @cached_property
    def record_rev(self) -> DataFrame:
        rows = self.customer.select(F.col("c_custkey").alias("record_id"), "c_name", F.col("c_mktsegment").alias("segment"))
        later = F.when(F.col("record_id") % 7 == 0, F.concat("segment", F.lit("_X"))).otherwise(F.col("segment"))
        return rows.select("record_id", F.lit(1).alias("rev"), "c_name", "segment").unionByName(rows.select("record_id", F.lit(2).alias("rev"), "c_name", later.alias("segment")))

    @cached_property
    def material(self) -> DataFrame:
        word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
        rows = self.part.groupBy("p_name").agg(F.min("p_partkey").alias("material_id"), F.min("p_type").alias("kind"))
        return rows.select("material_id", F.col("p_name").alias("material_name"), F.concat(word(2), F.lit(" "), word(1), F.lit(" "), "kind").alias("material_name_alt"), (F.col("material_id") * 7).cast("string").alias("gtin"))

    @cached_property
    def page_key(self) -> DataFrame:
        return self._of(self.pages, PAGE)
