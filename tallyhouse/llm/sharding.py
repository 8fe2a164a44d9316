"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get numbers 0..n-1 in a fixed order (a hash bucket of the row, then its id and content), so the numbering depends
on the rows alone, never on files, splits or the cluster. A keyed Feistel network permutes a grid of at least n cells;
cells from n on are walked over until one below n comes up, which makes it a permutation of 0..n-1. The permuted number p
gives ``shard = p mod shards`` and ``slot = p div shards``: counts differ by one at most, slots have no gaps, and
``row_number_of`` computes the row that a shard and slot hold without looking anything up.

All of it is SQL expressions. The only shuffle moves (id, size, checksum), never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rounds of the network; cells of the grid beyond the rows at most.
ROUNDS, WALK = 6, 64


def grid(n: int) -> tuple[int, int]:
    """The sides of a nearly square grid of n cells and at most WALK more."""
    a = max(1, math.isqrt(n))
    while a > WALK and -n % a > WALK:
        a -= 1
    return a, max(1, -(-n // a))


def _steps(n: int) -> int:
    """Walks that always suffice: only the cells beyond n can follow each other."""
    a, b = grid(n)
    return a * b - n


def _forward(x: str, a: int, b: int, seed: int) -> str:
    side = f"if(j % 2 = 0, {a}L, {b}L)"
    state = f"named_struct('l', {x} % {a}L, 'r', {x} div {a}L)"
    step = f"(s, j) -> named_struct('l', s.r, 'r', (s.l + pmod(xxhash64(s.r, j, {seed}), {side})) % {side})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {state}, {step}, s -> s.r * {a}L + s.l)"


def _backward(x: str, a: int, b: int, seed: int) -> str:
    side = f"if(({ROUNDS - 1} - j) % 2 = 0, {a}L, {b}L)"
    state = f"named_struct('l', {x} % {a}L, 'r', {x} div {a}L)"
    mixed = f"pmod(s.r - pmod(xxhash64(s.l, {ROUNDS - 1} - j, {seed}), {side}), {side})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {state}, (s, j) -> named_struct('l', {mixed}, 'r', s.l), s -> s.r * {a}L + s.l)"


def _walked(step, column: str, n: int, seed: int) -> Column:
    a, b = grid(n)
    first = step(column, a, b, seed)
    if not _steps(n):
        return F.expr(first)
    return F.expr(f"aggregate(sequence(1, {_steps(n)}), {first}, (y, i) -> if(y < {n}L, y, {step('y', a, b, seed)}))")


def permuted(column: str, n: int, seed: int = 7) -> Column:
    """The place, 0..n-1, of row number ``column`` after the shuffle."""
    return _walked(_forward, column, n, seed)


def row_number_of(column: str, n: int, seed: int = 7) -> Column:
    """The row number whose place is ``column``: the inverse of ``permuted``."""
    return _walked(_backward, column, n, seed)


def numbered(rows: DataFrame, key: str, content: list[str], buckets: int = 4096) -> DataFrame:
    """Adds ``row_number``, 0..n-1, by (hash bucket, key, content). Rows equal in all of these are interchangeable.

    One shuffle by bucket; the counts of buckets, ``buckets`` rows at most, are broadcast back as offsets.
    """
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, *content), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *content))
    return placed.withColumn("_rank", inside).join(F.broadcast(offsets), "_bucket").withColumn("row_number", F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_offset", "_rank")


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for every row of ``docs``.

    Null texts have size 16 and checksum 0; null ids and repeated rows are rows like any other; further columns are left
    aside; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    facts = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    n = docs.count()
    place = numbered(facts, "doc_id", ["size", "text_crc32"], buckets).withColumn("_place", permuted("row_number", max(n, 1), seed))
    return place.select("doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 by the law ``rows``; a larger count of shards moves rows anywhere, so ``grown_shard`` is null."""
    from tallyhouse.llm.common import table

    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
