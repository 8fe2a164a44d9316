"""Exact top-k inner products, norm-sorted and pruned.

Vectors are laid out by descending length in blocks. A query first meets the block of the longest vectors, which gives it
a threshold: its k-th best score so far. It then goes only to blocks whose longest vector could reach that (length of query
times length of vector), and there only the leading coordinates, after a rotation by the vectors' singular directions, are
multiplied for all; the rest is bounded by the lengths of what is left (Cauchy-Schwarz). Whatever could still reach the
threshold is scored exactly in integers: one by one if that is little, else all of a slice in one product, as doubles hold whole
numbers below 2^53 exactly. Rows without a vector, or with a null or non-finite component, take no part.

Blocks are grouped by levels of length. A block of queries is sent only to the levels that it can reach, and there to each
of a number of parts that follows the level's share of the blocks. Queries and blocks meet in a sort-merge join: nothing that
grows with the input passes through the driver, and a task holds the blocks of one part at a time, HELD at most on average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.common import Scratch, table

#: Queries and vectors in a block; leading coordinates; how many of them a task multiplies at once.
QUERY_BLOCK, BLOCK, LEADING = 512, 2048, 16
QUERY_GROUP, SLICE = 64, 256
#: From this share of a slice on, one product of it all is faster than the products of pairs picked out.
DENSE = 1 / 32
#: Blocks of a part that a task holds while queries pass by.
HELD = 64
#: Levels of length for each doubling. Scores beyond a long's range count as its end.
LEVELS, END = 2, (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of double: floor(scale * x) / scale) and its length, for rows that take part. ``scale`` is a power of two, so v is exact however large x is."""

    def whole(e):
        x = e.cast("double")
        return F.when(F.abs(x) < 2.0**53 / scale, F.floor(x * scale).cast("double") / scale).otherwise(x)  # from there on doubles times the scale are whole

    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~odd
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform("embedding", whole).alias("v"))
    most = F.aggregate("v", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e)))
    part = F.aggregate("v", F.lit(0.0), lambda a, e: a + (e / F.col("most")) * (e / F.col("most")))
    length = F.when(F.col("most") > 0, F.col("most") * F.sqrt(part)).otherwise(0.0)  # no square overflows
    return rows.withColumn("most", most).withColumn("length", length).drop("most")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length at the front, shorter vectors padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def packed(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """Blocks of up to ``size`` rows in the order they come: ids and vectors as bytes, and the longest length."""
    schema = "n int, ids binary, vectors binary, length double"

    def run(batches):
        ids, vectors, norms = [], [], []

        def block(take):
            nonlocal ids, vectors, norms
            i, v, m = np.concatenate(ids), np.concatenate(vectors), np.concatenate(norms)
            ids, vectors, norms = [i[take:]], [v[take:]], [m[take:]]
            columns = [pa.array([len(i[:take])], pa.int32()), *(pa.array([x[:take].tobytes()], pa.binary()) for x in (i, v))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([float(m[:take].max())])], names=["n", "ids", "vectors", "length"])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64))
                vectors.append(_matrix(batch.column("v"), dim))
                norms.append(batch.column("length").to_numpy(zero_copy_only=False))
                while sum(map(len, ids)) >= size:
                    yield block(size)
        if sum(map(len, ids)):
            yield block(size)

    return rows.select("vec_id", "v", "length").mapInArrow(run, schema)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The vectors' singular directions, strongest first, from Gram matrices summed over partitions: dim**2 numbers reach the driver."""

    def run(batches):
        gram = np.zeros((dim, dim))
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            v /= np.maximum(np.abs(v).max(axis=1, keepdims=True, initial=0), 1e-300)  # directions alone matter, and no square overflows
            gram += v.T @ v
        i, j = np.indices((dim, dim))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(gram.ravel())], names=["i", "j", "x"])

    gram = np.zeros((dim, dim))
    for i, j, x in rows.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        gram[i, j] = x
    return np.linalg.eigh(gram)[1][:, ::-1]


def _exact(q: np.ndarray, c: np.ndarray, at: np.ndarray, of: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of rows ``at`` of scale * q and ``of`` of scale * c, as whole numbers; what a long can't hold counts as its end."""
    if not len(at):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] * scale * scale < 2.0**62:
        return np.einsum("ij,ij->i", (q[at] * scale).astype(np.int64), (c[of] * scale).astype(np.int64))
    big = lambda m, rows: {i: [int(x) * scale if abs(x) >= 2.0**53 else int(x * scale) for x in m[i]] for i in set(rows.tolist())}
    big_q, big_c = big(q, at), big(c, of)
    scores = (sum(x * y for x, y in zip(big_q[i], big_c[j])) for i, j in zip(at.tolist(), of.tolist()))
    return np.fromiter((max(-END, min(END, x)) for x in scores), np.int64, len(at))


def _merged(best: tuple, found: tuple, need: np.ndarray, k: int) -> tuple:
    """The k best (query index, id, score) of each query, by score, then smaller id; ``need`` of those with k rises to the last one's score."""
    at, ids, score = (np.concatenate(x) for x in zip(best, found))
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    last = place == k - 1
    need[at[last]] = np.maximum(need[at[last]], score[last])
    return tuple(x[place < k] for x in (at, ids, score))


def best_of(query_ids, queries, block_ids, block, turn, floor, k: int, lead: int, scale: int = 256):
    """Up to k best (query index, id, score) of a block for each query, by score, then smaller id; below ``floor`` left out.

    Queries go in groups and the block, longest vectors first, in slices, so a few MB are held at a time. Each slice's finds
    raise the threshold for the next, and a group is done once no query of it can reach its own with the lengths that are left.
    """
    with np.errstate(over="ignore", invalid="ignore"):  # a bound that overflows prunes nothing
        return _best_of(query_ids, queries, block_ids, block, turn, floor, k, lead, scale)


def _best_of(query_ids, queries, block_ids, block, turn, floor, k: int, lead: int, scale: int):
    out = []
    c_all = block @ turn
    c_length, c_rest = np.linalg.norm(c_all, axis=1), np.linalg.norm(c_all[:, lead:], axis=1)
    longest = np.maximum.accumulate(c_length[::-1])[::-1]
    whole = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * block.shape[1] * scale * scale < 2.0**53
    c_whole = block * scale if whole else None
    for start in range(0, len(queries), QUERY_GROUP):
        ids, vectors = query_ids[start : start + QUERY_GROUP], queries[start : start + QUERY_GROUP]
        q = vectors @ turn
        length, rest = np.linalg.norm(q, axis=1), np.linalg.norm(q[:, lead:], axis=1)
        need = floor[start : start + QUERY_GROUP].astype(np.int64).copy()
        best = (np.zeros(0, np.int64),) * 3  # query, id, score
        for low in range(0, len(block), SLICE):
            high = low + SLICE
            slack = 1e-9 * length * longest[low] + 1e-6 / scale**2
            least = need / float(scale**2)  # bounds are of vectors before the scale
            if (length * longest[low] + slack < least).all():
                break
            bound = q[:, :lead] @ c_all[low:high, :lead].T + np.outer(rest, c_rest[low:high])
            open_ = ~(bound + slack[:, None] < least[:, None])
            if whole and np.count_nonzero(open_) >= DENSE * open_.size:
                scores = (vectors * scale) @ c_whole[low:high].T
                at, of = np.nonzero(open_ & (scores >= need[:, None]))
                score = scores[at, of].astype(np.int64)
                keep = ids[at] != block_ids[of + low]
            else:
                at, of = np.nonzero(open_)
                at, of = (x[ids[at] != block_ids[of + low]] for x in (at, of))
                score = _exact(vectors, block, at, of + low, scale)
                keep = score >= need[at]
            if keep.any():
                best = _merged(best, (at[keep], block_ids[of[keep] + low], score[keep]), need, k)
        out.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, query_block: int = QUERY_BLOCK, block: int = BLOCK, lead: int = LEADING) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other ids, ties to the smaller id.

    ``is_query`` is a column over vec_id. All rows of a query's own id are left out; a repeated row is one more candidate.
    Fewer candidates than k give all of them; no query or no candidate gives no rows. Shorter vectors count as padded with
    zeros. Components of any finite size take part as they are: scores that a long can't hold count as its end.
    """
    scratch = Scratch(vectors.sparkSession)
    spark = scratch.spark
    rows = scratch.write(quantized(vectors, scale), "vectors")
    dim = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()["d"] or 1
    turn = rotation(rows, dim)
    order = [F.col("length").desc(), F.col("vec_id").asc()]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    level = F.floor(F.log2(F.least(F.greatest("length", F.lit(1e-9)), F.lit(1.7e308))) * LEVELS).cast("int")
    blocks = packed(sorted_, block, dim).withColumn("level", level).withColumn("block", F.xxhash64("ids", "vectors"))
    blocks = scratch.write(blocks, "blocks")
    asked = rows.where(is_query).dropDuplicates(["vec_id"]).repartitionByRange(*order).sortWithinPartitions(*order)
    queries = scratch.write(packed(asked, query_block, dim), "queries")
    first = blocks.select("length", "block").orderBy(F.col("length").desc(), "block").first()  # two numbers from each partition, not a block
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = blocks.where(F.col("block") == first["block"]).limit(1).collect()  # one block: its size is a parameter

    def unpack(ids, vectors):
        return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)

    lead_ids, lead_vectors = unpack(longest[0]["ids"], longest[0]["vectors"])
    k_, lead_ = k, min(lead, dim)

    def start(batches):
        """The threshold of each query, from the block of the longest vectors; the least length that any of the block's queries needs."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = unpack(r["ids"], r["vectors"])
                lowest = np.full(len(ids), -END)
                at, _, score = best_of(ids, v, lead_ids, lead_vectors, turn, lowest, k_, lead_, scale)
                full = np.bincount(at, minlength=len(ids)) >= k_
                np.minimum.at(floor := np.full(len(ids), END), at, score)
                floor = np.where(full, floor, lowest)
                most = np.abs(v).max(axis=1, initial=0)
                length = most * np.sqrt(((v / np.maximum(most, 1e-300)[:, None]) ** 2).sum(axis=1))
                need = np.where(length > 0, floor / float(scale**2) / np.maximum(length, 1e-300), np.where(floor <= 0, -1.0, np.inf))
                columns = [pa.array([x], pa.binary()) for x in (r["ids"], r["vectors"], floor.astype(np.int64).tobytes())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([float(need.min())])], names=["ids", "vectors", "floors", "need"])

    started = scratch.write(queries.mapInArrow(start, "ids binary, vectors binary, floors binary, need double"), "started")

    def score(batches):
        """The k best that the blocks following each other hold for a block of queries; each block's finds raise the thresholds for the next."""
        asked, ids, v, need, best = None, None, None, None, ()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best[0]], best[1], best[2])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                r = {f: batch.column(f)[row].as_buffer() for f in ("ids", "vectors", "floors", "other_ids", "other_vectors")}
                if asked != (key := r["ids"].to_pybytes()):
                    if asked is not None:
                        yield out()
                    asked, (ids, v) = key, unpack(key, r["vectors"].to_pybytes())
                    need, best = np.frombuffer(r["floors"], np.int64).copy(), (np.zeros(0, np.int64),) * 3
                other, w = unpack(r["other_ids"], r["other_vectors"])
                best = _merged(best, best_of(ids, v, other, w, turn, need, k_, lead_, scale), need, k_)
        if asked is not None:
            yield out()

    # A few thousand levels at most, whatever the input: a double has no more doublings.
    dealt = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels = [(a, max(min(n, dealt), -(-n // HELD)), m) for a, n, m in blocks.groupBy("level").agg(F.count("*"), F.max("length")).collect()]
    held = F.array(*[F.struct(F.lit(a).alias("level"), F.lit(n).alias("parts"), F.lit(m * (1 + 1e-9)).alias("reach")) for a, n, m in levels])
    parts_of = F.create_map(*[F.lit(x) for a, n, _ in levels for x in (a, n)])
    other = blocks.select("level", F.pmod("block", parts_of[F.col("level")]).cast("int").alias("part"), "length", F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    sent = started.withColumn("to", F.explode(F.filter(held, lambda x: x["reach"] >= F.col("need"))))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1))).withColumn("level", F.col("to.level")).drop("to")
    # Spark takes ``sent`` for as large as ``started``, whose rows it repeats for each part, and would broadcast it.
    met = sent.hint("merge").join(other, ["level", "part"]).where(F.col("length") * (1 + 1e-9) >= F.col("need"))
    found = met.select("ids", "vectors", "floors", "other_ids", "other_vectors").mapInArrow(score, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
