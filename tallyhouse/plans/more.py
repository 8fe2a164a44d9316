"""Queries that put operators together: file ingest, grids, record pages, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.functions import text as x
from tallyhouse.operators import charter, history, ingest, lookups
from tallyhouse.plans.pipelines import BAD, LINE, REASONS, batches
from tallyhouse.plans.prices import LATEST, double
from tallyhouse.plans.register import query
from tallyhouse.sources import pages as H, payloads as P
from tallyhouse.streaming import jobs


READ_SQL = f"""
SELECT CASE run % 40 {REASONS} ELSE 'good' END AS reason, count(*) AS n
FROM (SELECT DISTINCT l_orderkey // 100 AS run FROM lineitem) AS r GROUP BY 1
"""


@query("s1_files_read_and_checked", READ_SQL)
def _(v):
    folder = jobs.work_folder(v.spark, "payloads")
    batches(v).drop("bad").write.json(folder)
    read = v.spark.read.schema(f"{P.PAYLOAD}, bad string").option("columnNameOfCorruptRecord", "bad").json(folder)
    return read.withColumn("reason", F.coalesce(P.reject_reason(LINE), F.lit("good"))).groupBy("reason").agg(F.count("*").alias("n"))


INGEST_SQL = f"""
SELECT DISTINCT CAST(l_orderkey // 100 AS VARCHAR) AS run_ref, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey
FROM lineitem WHERE l_orderkey // 100 % 40 NOT IN ({BAD})
"""


@query("r1_streaming_ingest", INGEST_SQL)
def _(v):
    # Every batch is sent twice, as clients do that saw no answer: the same lines come again.
    folder, keys = jobs.work_folder(v.spark, "ingest"), ["run_ref", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    batches(v, in_order=True).drop("bad").write.json(f"{folder}/in", compression="gzip")
    v.spark.read.text(f"{folder}/in").write.mode("append").text(f"{folder}/in", compression="gzip")
    stream = jobs.file_stream(v.spark, f"{folder}/in", f"{P.PAYLOAD}, bad string", "json", per_trigger=16)
    # Facts of four thousand runs in a row lie together, so a batch meets the facts of its own runs and no others, however large the table is.
    own = F.coalesce(F.expr("try_cast(run_ref as long) div 4000"), F.lit(-1)).alias("runs")
    rows = P.named_rows(P.checked(stream, LINE)[0], LINE).select(*keys, own)
    sink = rows.writeStream.foreachBatch(jobs.append_new(keys, f"{folder}/facts", "runs")).option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(rows.schema).parquet(f"{folder}/facts").select(*keys)


@query("s13_labelled_dataset", "SELECT external_id AS \"Number\", c_name AS \"Name\", c_mktsegment AS \"Segment\" FROM stored_record")
def _(v):
    labels = {"external_id": "Number", "c_name": "Name", "c_mktsegment": "Segment"}
    return v.stored_record.select(*[F.col(k).alias(label) for k, label in labels.items()])


@query(
    "w10_best_group_per_label",
    """SELECT p_brand AS label, p_type AS grp FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_size), p_type) AS rn
    FROM part
    GROUP BY p_brand, p_type) AS x WHERE rn = 1""",
)
def _(v):
    ranked = v.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("rank"))
    return ranked.groupBy(F.col("p_brand").alias("label")).agg(F.min_by("p_type", F.struct("rank", "p_type")).alias("grp"))
