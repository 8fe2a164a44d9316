"""What the operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. Only where it is unset and there is one machine (tests) is one made; a cluster has to name it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tallyhouse-")
        sc.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables of one run of an operator, in a folder of their own below the shared one.

    ``write`` cuts the lineage, and what it has written outlives any executor. ``drop`` deletes tables once all that is made of
    them is written too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, label: str, links: bool = False) -> DataFrame:
        """``df`` as written to the shared folder and read back.

        Tables of ``links`` hold a few numbers a row; they are written by four tasks a core at most, not by one for each
        shuffle partition, so that rounds over them don't make thousands of tiny files.
        """
        if links:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        path = f"{self.folder}/{len(self.paths)}-{label}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for k, (table_, path) in self.paths.items():
            if path and any(table_ is x for x in tables):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
                self.paths[k] = (None, None)

    def tidy(self) -> None:
        """Lets shuffle files of finished jobs go: Spark removes them once the driver's JVM has collected what refers to them, so it is asked to. Otherwise they stay on the executors' disks for the whole run."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written to the shared folder and read back, for good."""
    return Scratch(df.sparkSession).write(df, label)


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``make()`` runs once a task and gives a function from a batch to the output columns, in the order of ``schema``.

    Arrow batches rather than pandas: integers keep their nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


@contextmanager
def short_batches(spark: SparkSession, rows: int):
    """Actions inside hand Python at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A null text counts as an empty one."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``rest``, a struct of all other columns: whatever names those have, none meets an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))


def unbundled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, in that order, of what ``bundled`` has made of rows with them."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns])


#: Bits of the bitmap that ``among`` broadcasts: half a megabyte, whatever the input.
BITMAP_BITS = 1 << 22


def among(scratch: Scratch, rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts by a long ``column``: those whose value may be in ``ids`` (one column), and those whose value is not.

    A bitmap of the ids' hashes, of fixed size, is broadcast; a join of the first part with ``ids`` decides the rest. What a
    small set of ids doesn't name is so kept out of shuffles. However many ids there are, the parts are right: a full bitmap
    only sends more rows into the first. Rows with a null there are in the second.
    """
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BITMAP_BITS))
    known = ids.select(at(F.col(ids.columns[0])).alias("_h"))
    bitmap = known.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits")
    )
    bitmap = F.broadcast(scratch.write(bitmap, "bitmap"))  # a row of 4 KB for each 32,768 bits
    h = at(F.col(column))
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), h.alias("h"), F.bitmap_bucket_number(h).alias("at"), F.col(column).isNotNull().alias("known"))
    place = F.bitmap_bit_position("h")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & F.col("known")
    parts = marked.join(bitmap, F.col("at") == F.col("_bucket"), "left").withColumn("hit", hit)
    return tuple(parts.where(c).select("row.*") for c in (F.col("hit"), ~F.col("hit")))
