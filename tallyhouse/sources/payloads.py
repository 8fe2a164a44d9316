"""Collected batches: reading, checking, naming their columns, joining chunks; nested catalogues and sitemaps as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PAYLOAD = "payload_version int, source_key string, kind string, scraped_at string, source_url string, header array<string>, rows array<array<string>>, chunk struct<index:int,total:int>, run_ref string"

#: Generations of the format that are understood.
OLDEST, NEWEST = 2, 4
#: Fixed value: the largest page that is kept, in bytes.
MOST_BYTES = 2_000_000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Batches as JSON files, one object each; a file that isn't one stays as a row with its text in ``bad``."""
    return spark.read.schema(f"{PAYLOAD}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def reject_reason(required: list[str]) -> Column:
    """Why a batch can't be used; null if it can."""
    ragged = ~F.forall("rows", lambda r: F.size(r) == F.size("header"))
    return (
        F.when(F.col("bad").isNotNull(), "unreadable")
        .when(F.col("payload_version").isNull() | (F.col("payload_version") < OLDEST), "too old")
        .when(F.col("payload_version") > NEWEST, "too new")
        .when(~F.coalesce(F.col("scraped_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?Z$"), F.lit(False)), "no UTC stamp")
        .when(F.size(F.array_except(F.array(*map(F.lit, required)), "header")) > 0, "header drift")
        .when(F.coalesce(ragged, F.lit(True)), "ragged rows")
    )


def checked(payloads: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usable batches, and the others with their reason."""
    rows = payloads.withColumn("reason", reject_reason(required))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def whole(payloads: DataFrame) -> DataFrame:
    """Chunked batches put together in order; a batch that lacks chunks is left out. One without chunk is whole."""
    one = F.coalesce("chunk", F.struct(F.lit(0).alias("index"), F.lit(1).alias("total")))
    part = F.struct(F.col("_c.index").alias("index"), F.col("rows"))
    parts = payloads.withColumn("_c", one).groupBy("source_key", "kind", "run_ref").agg(
        F.array_sort(F.collect_set(part)).alias("_parts"),
        F.max("_c.total").alias("_total"),
        F.first("header").alias("header"),
        F.max("scraped_at").alias("scraped_at"),
    )
    return parts.where("size(_parts) = _total").withColumn("rows", F.flatten(F.transform("_parts", lambda p: p["rows"]))).drop("_parts", "_total")


def named_rows(payloads: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each row of each batch, its cells by name; columns a batch doesn't have are empty. Where a column stands is found once for each batch."""
    at = payloads.select("source_key", "run_ref", "scraped_at", "rows", *[(F.array_position("header", F.lit(c)) - 1).cast("int").alias(f"_at_{k}") for k, c in enumerate(columns)])
    cells = at.select("*", F.posexplode("rows").alias("row_no", "cells"))
    return cells.select("source_key", "run_ref", "scraped_at", "row_no", *[F.coalesce(F.get("cells", F.col(f"_at_{k}")), F.lit("")).alias(c) for k, c in enumerate(columns)])


CATALOGUE = "struct<products:array<struct<id:bigint,title:string,vendor:string,attributes:map<string,string>,images:array<string>,variants:array<struct<id:bigint,sku:string,price:string,compare_at_price:string,available:boolean>>>>>"


def catalogue_variants(documents: DataFrame, column: str) -> DataFrame:
    """A row for each variant of each product of JSON catalogues; a product without variants gives one that stands in, under its own id."""
    p = documents.select(F.explode(F.from_json(column, CATALOGUE)["products"]).alias("p"))
    rows = p.select("p.id", "p.title", "p.vendor", F.explode_outer("p.variants").alias("v"))
    return rows.select(F.col("id").alias("product_id"), F.coalesce("v.id", "id").alias("variant_id"), "title", "vendor", "v.sku", "v.price", "v.compare_at_price", "v.available", F.col("v").isNull().alias("stands_in"))


def catalogue_details(documents: DataFrame, column: str) -> DataFrame:
    """Attributes and images of JSON catalogues in long form; repeated codes are numbered from the second on, blanks dropped."""
    p = documents.select(F.explode(F.from_json(column, CATALOGUE)["products"]).alias("p"))
    attributes = p.select(F.col("p.id").alias("product_id"), F.explode("p.attributes").alias("code", "raw_value"))
    images = p.select(F.col("p.id").alias("product_id"), F.posexplode("p.images").alias("at", "raw_value")).select("product_id", F.when(F.col("at") == 0, "image").otherwise(F.concat(F.lit("image_"), F.col("at").cast("string"))).alias("code"), "raw_value")
    return attributes.unionByName(images).where(F.trim("raw_value") != "")


def sitemap_urls(files: DataFrame, column: str, host: str | None = None) -> DataFrame:
    """The distinct addresses of sitemap files, of one host if it is named."""
    rows = files.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)<loc>\\s*(.*?)\\s*</loc>"), 1)).alias("url")).distinct()
    return rows.where(F.parse_url("url", F.lit("HOST")) == host) if host else rows


def snapshots(pages: DataFrame, max_bytes: int = MOST_BYTES) -> DataFrame:
    """Pages to keep: with the hash of their content, without those over the bound."""
    return pages.where(F.octet_length("html") <= max_bytes).withColumn("content_hash", F.sha2("html", 256))


def merged_snapshots(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Page evidence of two warehouses: each (url, content) once."""
    return ours.unionByName(theirs).dropDuplicates(["url", "content_hash"])


def latest_validators(seen: DataFrame, not_before=None) -> DataFrame:
    """The newest validator of each address; sightings without one, and those before a moment, don't count."""
    rows = seen.where("validator is not null and validator <> ''")
    if not_before is not None:
        rows = rows.where(F.col("seen_at") >= F.lit(not_before).cast("timestamp_ntz"))
    return rows.groupBy("url").agg(F.max_by("validator", F.struct("seen_at", "validator")).alias("validator"), F.max("seen_at").alias("seen_at"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an export, by their path below ``folder``, with bytes and SHA-256. Files are what an export is cut into: their rows are bounded where it is written (``export.write_bundle``), so none is large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_extract("path", f"{re.escape(folder.rstrip('/').rpartition('/')[2])}/(.*)$", 1)
    return files.select(below.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system that Spark writes to; one that isn't there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move_folder(spark: SparkSession, folder: str, to: str) -> bool:
    """Gives a folder another place on its file system; false if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, to = path(folder), path(to)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return False
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"{folder} can't be moved")
    return True


def roots(files: DataFrame, levels: int) -> DataFrame:
    """part, files, bytes, sha256: a digest for each folder ``levels`` deep, over its files' names and digests in order. Of the root alone (0 levels) it is the digest of the whole export."""
    part = F.array_join(F.slice(F.split("file", "/"), 1, levels), "/") if levels else F.lit("")
    leaves = F.array_sort(F.collect_list(F.concat_ws(" ", "file", "sha256")))
    return files.groupBy(part.alias("part")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(leaves, "\n"), 256).alias("sha256"))


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """All faults of an export against its manifest, not only the first: missing, unexpected, resized and changed files."""
    both = expected.alias("e").join(found.alias("f"), "file", "full_outer")
    fault = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected")
    fault = fault.when(F.col("e.bytes") != F.col("f.bytes"), "resized").when(F.col("e.sha256") != F.col("f.sha256"), "changed")
    return both.select("file", fault.alias("fault")).where("fault is not null")


def packed(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Tables as one stream of (dataset, table, row as JSON)."""
    out = None
    for (dataset, name), df in tables.items():
        rows = df.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_pack(stream: DataFrame, folder: str) -> None:
    """The stream as compressed JSON lines, a folder for each dataset and table."""
    stream.write.mode("overwrite").partitionBy("dataset", "table").option("compression", "gzip").json(folder)


def read_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A written stream; a filter on dataset or table reads those folders only."""
    return spark.read.schema("row string, dataset string, table string").json(folder)


def unpacked(stream: DataFrame, dataset: str, name: str, schema: str) -> DataFrame:
    """One table of such a stream."""
    return stream.where((F.col("dataset") == dataset) & (F.col("table") == name)).select(F.from_json("row", schema).alias("r")).select("r.*")


def newest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
