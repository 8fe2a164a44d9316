"""Tables that change together: a commit writes new folders, and one row of a log then names all that are in force.

Every change is a generation. What it adds or replaces is written into folders of its own, which nothing reads yet; appending its
row to the log, one file that appears at once, puts all of it in force. A job that dies in between leaves the generation before
in force and some folders that no row names; run again under the same reference it starts afresh, and once its row is there,
running it again does nothing. One writer at a time is assumed, any number of readers.

Appended tables are lists of folders; a reader names the partitions it wants and only those are listed. ``compare`` tells whether
tables of two generations hold the same rows, by their number and an order-free digest, without moving a row.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyhouse.sources.payloads import delete_folder, move_folder

LOG = "generation long, run_ref string, tables map<string,array<string>>"


class Refused(RuntimeError):
    """A generation that its own check turned down; the one before stays in force."""


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas, self.beside = spark, root.rstrip("/"), schemas, []

    def log(self) -> DataFrame:
        """All generations so far: a row for each commit."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # nothing is committed yet
                raise
            return self.spark.createDataFrame([], LOG)

    def current(self) -> tuple[int, dict[str, list[str]]]:
        """Number and folders of the generation in force; 0 and none before the first."""
        rows = self.log().orderBy(F.col("generation").desc()).limit(1).collect()  # one row: a list of folders for each table
        return (rows[0]["generation"], dict(rows[0]["tables"])) if rows else (0, {})

    def staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` as written beside the tables and read back: what a commit uses several times is computed once, and survives any executor. The commit removes it."""
        folder = f"{self.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(folder, compression="zstd")
        self.beside.append(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def generation_of(self, run_ref: str) -> int | None:
        found = self.log().where(F.col("run_ref") == run_ref).agg(F.max("generation")).first()
        return found[0]

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        """A table as it stands, or stood in a generation; empty where nothing has been written."""
        if generation is None:
            folders = self.current()[1].get(name)
        else:
            found = self.log().where(F.col("generation") == generation).select("tables").first()
            folders = found["tables"].get(name) if found else None
        return self._of(name, folders or [])

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.root}/data/{name}").parquet(*folders)
        return rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns)  # without the commit that is part of the path

    def commit(self, run_ref: str, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, by: dict[str, str] | None = None, check=None, split: DataFrame | None = None) -> int:
        """The number of the generation that ``run_ref`` made, now or before.

        Tables that aren't named are carried on as they are. ``by`` names a column that a table's folder is partitioned by.
        ``split`` are rows of several tables from one computation, written once: ``kind`` names the table that each is appended to.
        ``check`` takes a reader of the new tables (a name to a DataFrame) and gives its objections; any refuses the commit.
        """
        if (done := self.generation_of(run_ref)) is not None:
            return done
        number, tables = self.current()
        commit = f"commit={uuid.uuid4().hex}"
        for name, rows, keep in [*((k, x, True) for k, x in (appended or {}).items()), *((k, x, False) for k, x in (replaced or {}).items())]:
            writer = rows.write
            if by and name in by:
                writer = writer.partitionBy(by[name])
            writer.parquet(f"{self.root}/data/{name}/{commit}", compression="zstd")
            tables[name] = [*(tables.get(name, []) if keep else []), f"{self.root}/data/{name}/{commit}"]
        if split is not None:
            folder = f"{self.root}/staged/{uuid.uuid4().hex}"
            split.write.partitionBy("kind").parquet(folder, compression="zstd")
            for name in self.schemas:
                if move_folder(self.spark, f"{folder}/kind={name}", f"{self.root}/data/{name}/{commit}"):
                    tables[name] = [*tables.get(name, []), f"{self.root}/data/{name}/{commit}"]
            self.beside.append(folder)
        if check and (problems := check(lambda name: self._of(name, tables.get(name, [])))):
            raise Refused("; ".join(problems))
        row = self.spark.createDataFrame([(number + 1, run_ref, tables)], LOG)
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")
        while self.beside:
            delete_folder(self.spark, self.beside.pop())
        return number + 1


def digest(rows: DataFrame):
    """rows, digest: the number of rows and a sum of two 64-bit hashes of each, whatever their order; columns by name."""
    columns = sorted(rows.columns)
    whole = F.struct(*columns)
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), whole).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("rows"), F.concat_ws(":", total("a").cast("string"), total("b").cast("string")).alias("digest"))


def compare(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """entity, rows_before, rows_after, same for every table of either side; a table that one side lacks has no rows there and isn't the same."""
    out = None
    for name in sorted({*before, *after}):
        sides = [digest(x[name]) if name in x else None for x in (before, after)]
        left, right = (s.select(F.col("rows").alias(f"rows_{k}"), F.col("digest").alias(f"digest_{k}")) if s is not None else None for s, k in zip(sides, ("before", "after")))
        there = left is not None and right is not None
        if there:
            row = left.join(right)  # one row each
        else:
            row = (left if left is not None else right).withColumns({f"{x}_{'after' if right is None else 'before'}": F.lit(None).cast(t) for x, t in (("rows", "long"), ("digest", "string"))})
        row = row.select(F.lit(name).alias("entity"), "rows_before", "rows_after", F.lit(False).alias("same") if not there else (F.col("digest_before") == F.col("digest_after")).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out
