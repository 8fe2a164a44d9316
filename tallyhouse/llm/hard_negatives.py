"""Hard-negative mining with cover trees over norm-augmented vectors.

A candidate gets one more coordinate that brings all candidates to the same length, so that a higher inner product with an anchor
is a smaller distance to it. Rows are laid out by label and by the nearest of some centres fitted on a bounded sample, in blocks
of a bounded number of rows, and each block holds a cover tree: the centres of a level cover all points within the level's
radius and lie further apart than that; a node keeps the exact distance of its farthest point. From it and the distance between
anchor and centre follow an upper and a lower bound of every inner product below the node.

Blocks of anchors meet blocks of candidates, and descend best-first: the node with the highest upper bound is opened next, nodes
that no anchor's window or threshold reaches are skipped, and points of leaves are scored exactly, as whole numbers. The first
descent finds each anchor's positives among its own label; their scores give the windows, and the second finds the highest
scores of other labels in each. What a task has found so far raises the thresholds for its next blocks.
"""

from __future__ import annotations

from collections import OrderedDict
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.common import Scratch, short_batches, table

#: Rows of a block, anchors of a block and how many of them descend together; points of a leaf and how many are scored at once.
BLOCK, ANCHORS, GROUP, LEAF, SCORED = 2048, 256, 64, 32, 256
#: Blocks of a part that a task holds while anchors pass by.
HELD = 64
#: Rows on which the layout's centres are fitted, and centres at most; ratio of the radii of two levels; anchor blocks a task remembers.
SAMPLE, CENTRES, RATIO, REMEMBERED = 2048, 128, 1.3, 32
SCALE, END = 256, (1 << 63) - 1


def labelled(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, v (floor(256 x) / 256, exact in doubles) of rows that take part: nothing null in id, label and vector, all components finite."""

    def whole(e):
        x = e.cast("double")
        return F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)  # from there on doubles times 256 are whole

    odd = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length, shorter vectors padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dim))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Space:
    """The geometry that all blocks share: components over the largest one, and the length to which candidates are brought."""

    def __init__(self, dim: int, most: float, length: float):
        self.dim, self.most, self.length = dim, most or 1.0, length

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return v / self.most

    def augmented(self, v: np.ndarray) -> np.ndarray:
        g = self.scaled(v)
        last = np.sqrt(np.maximum(self.length**2 - (g**2).sum(axis=1), 0.0))
        return np.concatenate([g, last[:, None]], axis=1)

    def product(self, scores: np.ndarray) -> np.ndarray:
        """Scores as inner products of scaled vectors."""
        return scores / float(SCALE * SCALE) / self.most / self.most


def cover_levels(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """For each level, the centre (a point's number) above each point. Centres of a level stay centres below; a new one lies further than the level's radius from all others, and its parent covers it."""
    n = len(points)
    root = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    near = np.linalg.norm(points - points[root], axis=1)
    radius = widest = float(near.max())
    held = np.full(n, root)
    levels, centres, parent = [np.full(n, root)], np.array([root]), {root: root}
    chains = [{root: root}]  # of each level: centre to its parent
    while radius > 1e-9 * max(widest, 1e-300) and np.bincount(held, minlength=n).max() > leaf:
        radius /= RATIO
        before = held.copy()
        held, near = held.copy(), near.copy()
        open_ = np.flatnonzero(near > radius)
        if len(open_) and len(centres) > 1:
            apart = np.sqrt(np.maximum((points[open_] ** 2).sum(axis=1)[:, None] + (points[centres] ** 2).sum(axis=1) - 2 * points[open_] @ points[centres].T, 0))
            at = apart.argmin(axis=1)
            best = apart[np.arange(len(open_)), at]
            got = best <= radius
            held[open_[got]], near[open_[got]] = centres[at[got]], best[got]
            open_ = open_[~got]
        fresh = []
        while len(open_):
            p = int(open_[0])
            apart = np.linalg.norm(points[open_] - points[p], axis=1)
            got = apart <= radius
            held[open_[got]], near[open_[got]] = p, apart[got]
            held[p], near[p] = p, 0.0
            fresh.append(p)
            open_ = open_[~got]
        own = {int(c): int(c) for c in centres} | {p: int(before[p]) for p in fresh}
        chains.append(own)
        centres = np.concatenate([centres, np.array(fresh, int)]) if fresh else centres
    # From the last level up: a point's centre there, then that centre's parents.
    out, at = [], held
    for own in reversed(chains):
        out.append(at)
        up = np.arange(n)
        up[list(own)] = list(own.values())
        at = up[at]
    return out[::-1]


class Tree:
    """Nodes breadth first: centre, exact covering radius, points first..last in ``order``, children low..high (none: a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        levels = cover_levels(points, leaf)
        self.order = np.lexsort(levels[::-1])
        levels = [x[self.order] for x in levels]
        n = len(points)
        todo, nodes = [(0, n, 0, int(levels[0][0]))], []
        for first, last, level, centre in todo:  # grows as it is read
            low = high = 0
            if last - first > leaf:
                while level < len(levels) and (levels[level][first:last] == levels[level][first]).all():
                    level += 1
                if level < len(levels):
                    inside = levels[level][first:last]
                    cuts = [first, *(np.flatnonzero(np.diff(inside)) + 1 + first).tolist(), last]
                    low = len(todo)
                    todo += [(a, b, level + 1, int(levels[level][a])) for a, b in zip(cuts, cuts[1:])]
                    high = len(todo)
            own = points[self.order[first:last]]
            nodes.append((centre, np.linalg.norm(own - points[centre], axis=1).max(), first, last, low, high))
        self.centre, self.radius, self.first, self.last, self.low, self.high = (np.array(x) for x in zip(*nodes))


class Finds:
    """The k best (score, then smaller id) of each anchor and window, and the score that a further one needs."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.need = low.copy()
        self.best = (np.zeros(0, np.int64),) * 3  # anchor * windows + window, score, id

    def add(self, at: np.ndarray, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in zip(self.best, (at * self.low.shape[1] + window, score, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        self.best = tuple(x[place < self.k] for x in (key, score, ids))
        last = place == self.k - 1
        flat = self.need.reshape(-1)
        flat[key[last]] = np.maximum(flat[key[last]], score[last])


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products of 256 * q and 256 * c; what a long can't hold counts as its end."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most * SCALE * SCALE < 2.0**53:
        return ((q * SCALE) @ (c * SCALE).T).astype(np.int64)
    if most * SCALE * SCALE < 2.0**62:
        return (q * SCALE).astype(np.int64) @ (c * SCALE).astype(np.int64).T
    big_q, big_c = ([[int(x) * SCALE if abs(x) >= 2.0**53 else int(x * SCALE) for x in row] for row in m] for m in (q, c))
    return np.array([[max(-END, min(END, sum(a * b for a, b in zip(x, y)))) for y in big_c] for x in big_q], np.int64).reshape(len(q), len(c))


def descend(space: Space, tree: dict, anchors: dict, finds: Finds, rows: slice, same: bool) -> None:
    """Best-first through one block for the anchors ``rows``; ``finds`` holds their windows, counted from the slice's start."""
    q, ids, labels = (anchors[x][rows] for x in ("v", "ids", "labels"))
    g = space.scaled(q)
    length, reach = np.linalg.norm(g, axis=1), space.length
    unit = np.where(length > 0, reach / np.maximum(length, 1e-300), 0.0)
    slack = 1e-9 * length * reach + 1e-12 * space.product(np.float64(1))
    top, bottom = space.product(finds.high.astype(float)), space.product(finds.low.astype(float))
    centres = space.scaled(tree["v"])[tree["centre"]]
    turn = count()

    def bounds(at, nodes):
        """The highest and lowest inner product, by distance and by the difference to the centre's, for anchors by nodes."""
        ip = g[at] @ centres[nodes].T
        r, size = tree["radius"][nodes] + 1e-12 * reach, length[at][:, None]
        apart = np.sqrt(np.maximum(2 * reach**2 - 2 * unit[at][:, None] * ip, 0.0))
        scale = size / max(reach, 1e-300)
        high = np.minimum(scale * (reach**2 - np.maximum(apart - r, 0) ** 2 / 2), ip + size * r)
        low = np.maximum(scale * (reach**2 - np.minimum(apart + r, 2 * reach) ** 2 / 2), ip - size * r)
        return high + slack[at][:, None], low - slack[at][:, None]

    def wanted(at, high, low):
        need = space.product(finds.need[at].astype(float))
        out = np.zeros(high.shape, bool)
        for w in range(need.shape[1]):
            out |= ~(high < need[:, w : w + 1]) & ~(low > top[at, w][:, None])
        return out

    def verify(nodes, at, high, low):
        ask = wanted(at, high, low)
        keep = ask.any(axis=1)
        if not keep.any():
            return
        at, ask = at[keep], ask[keep]
        points = np.concatenate([np.arange(tree["first"][x], tree["last"][x]) for x in nodes])
        sizes = tree["last"][nodes] - tree["first"][nodes]
        score = exact_scores(q[at], tree["v"][points])
        fits = np.repeat(ask, sizes, axis=1) & (ids[at][:, None] != tree["ids"][points]) & ((labels[at][:, None] == tree["labels"][points]) == same)
        new = []
        for w in range(finds.low.shape[1]):
            i, j = np.nonzero(fits & (score >= finds.need[at, w][:, None]) & (score <= finds.high[at, w][:, None]))
            if len(i):
                new.append((at[i], np.full(len(i), w), score[i, j], tree["ids"][points[j]]))
        if new:
            finds.add(*(np.concatenate(x) for x in zip(*new)))

    everyone = np.arange(len(q))
    heap = []

    def offer(nodes, at):
        """Puts nodes on the heap that someone wants; leaves side by side in batches."""
        high, low = bounds(at, nodes)
        ask = wanted(at, high, low)
        peak = np.where(ask, high, -np.inf).max(axis=0)
        alive = np.flatnonzero(peak > -np.inf)
        leaf = tree["low"][nodes] == tree["high"][nodes]
        for x in alive[~leaf[alive]]:
            heappush(heap, (-peak[x], next(turn), nodes[x : x + 1], at[ask[:, x]], None, None))
        batch, points = [], 0
        for x in (order := alive[leaf[alive]][np.argsort(-peak[alive[leaf[alive]]], kind="stable")]):
            batch.append(x)
            points += tree["last"][nodes[x]] - tree["first"][nodes[x]]
            if points >= SCORED or x == order[-1]:
                who = ask[:, batch].any(axis=1)
                heappush(heap, (-peak[batch[0]], next(turn), nodes[batch], at[who], high[np.ix_(who, batch)], low[np.ix_(who, batch)]))
                batch, points = [], 0

    offer(np.array([0]), everyone)
    while heap:
        _, _, nodes, at, high, low = heappop(heap)
        if high is None:
            again = wanted(at, *bounds(at, nodes))[:, 0]
            if again.any():
                offer(np.arange(tree["low"][nodes[0]], tree["high"][nodes[0]]), at[again])
        else:
            verify(nodes, at, high, low)


_BLOCK = "ids binary, labels binary, v binary, centre binary, radius binary, first binary, last binary, low binary, high binary, label_min long, label_max long, longest double"
_TREE = ("centre", "radius", "first", "last", "low", "high")


def candidate_blocks(rows: DataFrame, space: Space, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows in the order they come, each with its cover tree."""

    def make(ids, labels, v):
        tree = Tree(space.augmented(v))
        ids, labels, v = (x[tree.order] for x in (ids, labels, v))
        place = np.empty(len(ids), np.int64)
        place[tree.order] = np.arange(len(ids))
        tree.centre = place[tree.centre]
        arrays = [ids, labels, v, *(getattr(tree, x).astype(float if x == "radius" else np.int64) for x in _TREE)]
        ends = [pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([float(np.linalg.norm(space.scaled(v), axis=1).max())])]
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in arrays), *ends], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"), space.dim)))
                while sum(len(x[0]) for x in held) >= size:
                    parts = [np.concatenate(x) for x in zip(*held)]
                    yield make(*(x[:size] for x in parts))
                    held = [tuple(x[size:] for x in parts)]
        if sum(len(x[0]) for x in held):
            yield make(*(np.concatenate(x) for x in zip(*held)))

    return rows.select("vec_id", "label", "v").mapInArrow(run, _BLOCK)


_ASKED = "q_numbers binary, q_ids binary, q_labels binary, q_v binary, q_low binary, q_high binary, q_label_min long, q_label_max long, q_longest double, q_least double"


def anchor_blocks(anchors: DataFrame, space: Space, size: int, windows: int) -> DataFrame:
    """Blocks of up to ``size`` anchors in the order they come, with the lowest and highest score of each window (arrays low, high); missing windows hold nothing."""

    def make(rows):
        v = np.array([r["v"] + [0.0] * (space.dim - len(r["v"])) for r in rows]).reshape(len(rows), space.dim)
        numbers, ids, labels = (np.array([r[x] for r in rows], np.int64) for x in ("row", "vec_id", "label"))
        low = np.array([r["low"] + [END] * (windows - len(r["low"])) for r in rows], np.int64)
        high = np.array([r["high"] + [-END] * (windows - len(r["high"])) for r in rows], np.int64)
        least = space.product(np.where(low <= high, low, END).min(axis=1).astype(float)).min()
        ends = [pa.array([int(labels.min())]), pa.array([int(labels.max())]), pa.array([float(np.linalg.norm(space.scaled(v), axis=1).max())]), pa.array([float(least)])]
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (numbers, ids, labels, v, low, high)), *ends], names=[x.split()[0] for x in _ASKED.split(", ")])

    def run(batches):
        held = []
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                held += batch.slice(start, size).to_pylist()
                while len(held) >= size:
                    yield make(held[:size])
                    held = held[size:]
        if held:
            yield make(held)

    return anchors.select("row", "vec_id", "label", "v", "low", "high").mapInArrow(run, _ASKED)


def _met(space: Space, k: int, windows: int, same: bool):
    """From pairs of blocks to number, window, vec_id, score: the k best that a task's blocks hold for each anchor and window."""

    def run(batches):
        held: OrderedDict[bytes, tuple] = OrderedDict()

        def out(numbers, finds):
            for start, found in enumerate(finds):
                key, score, ids = found.best
                at, window = np.divmod(key, windows)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at + start * GROUP]), pa.array(window.astype(np.int32)), pa.array(ids), pa.array(score)], names=["number", "window", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                r = {f: batch.column(f)[at].as_buffer() for f in ("ids", "labels", "v", *_TREE, "q_numbers", "q_ids", "q_labels", "q_v", "q_low", "q_high")}
                tree = {x: np.frombuffer(r[x], np.float64 if x in ("v", "radius") else np.int64) for x in ("ids", "labels", "v", *_TREE)}
                tree["v"] = tree["v"].reshape(-1, space.dim)
                anchors = {"ids": np.frombuffer(r["q_ids"], np.int64), "labels": np.frombuffer(r["q_labels"], np.int64), "v": np.frombuffer(r["q_v"], np.float64).reshape(-1, space.dim)}
                key = r["q_numbers"].to_pybytes()
                if key not in held:
                    low, high = (np.frombuffer(r[x].to_pybytes(), np.int64).reshape(-1, windows) for x in ("q_low", "q_high"))
                    held[key] = (np.frombuffer(key, np.int64), [Finds(low[s : s + GROUP], high[s : s + GROUP], k) for s in range(0, len(low), GROUP)])
                    if len(held) > REMEMBERED:
                        yield from out(*held.popitem(last=False)[1])
                held.move_to_end(key)
                with np.errstate(over="ignore", invalid="ignore"):  # a bound that overflows skips nothing
                    for k_, found in enumerate(held[key][1]):
                        descend(space, tree, anchors, found, slice(k_ * GROUP, k_ * GROUP + GROUP), same)
        for done in held.values():
            yield from out(*done)

    return run


def _search(asked: DataFrame, blocks: DataFrame, space: Space, parts: int, k: int, windows: int, same: bool) -> DataFrame:
    """number, window, vec_id, score, rank: the k best of each anchor and window over all blocks."""
    # A part's blocks lie together, and a block of anchors meets them one after another. Spark takes ``q`` for as large as
    # ``asked``, whose rows it repeats for each part, and would broadcast it.
    b = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    q = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if same:
        meets = (F.col("label_min") <= F.col("q_label_max")) & (F.col("label_max") >= F.col("q_label_min"))
    else:
        one = (F.col("label_min") == F.col("label_max")) & (F.col("q_label_min") == F.col("q_label_max")) & (F.col("label_min") == F.col("q_label_min"))
        meets = ~one & ~(F.col("longest") * F.col("q_longest") * (1 + 1e-9) < F.col("q_least"))
    pairs = q.hint("merge").join(b, "part").where(meets).drop("part", "label_min", "label_max", "longest", "q_label_min", "q_label_max", "q_longest", "q_least")
    found = pairs.mapInArrow(_met(space, k, windows, same), "number long, window int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("number", "window").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _sample(rows: DataFrame, total: int) -> DataFrame:
    """The SAMPLE rows of the smallest hashes.

    Each partition sends its first SAMPLE to the driver; where hashes above about four times SAMPLE rows' are left out before,
    those are no more than four times SAMPLE together, however many partitions there are.
    """
    bound = -(1 << 63) + (4 * SAMPLE << 64) // max(total, 1)
    low = rows.where(F.xxhash64("row") < bound) if bound <= END else rows
    return low.orderBy(F.xxhash64("row"), "row").limit(SAMPLE)


def _layout(rows: DataFrame, space: Space, total: int) -> DataFrame:
    """Adds ``node``, the nearest of a cover tree's centres over SAMPLE rows, numbered so that neighbours are near each other. It decides how rows are grouped, nothing else."""
    sample = _sample(rows, total).select("v").collect()
    points = space.augmented(np.array([r["v"] + [0.0] * (space.dim - len(r["v"])) for r in sample]).reshape(len(sample), space.dim))
    levels = cover_levels(points, 8)
    held = [x for x in levels if len(np.unique(x)) <= CENTRES][-1][np.lexsort(levels[::-1])]
    centres = points[held[np.sort(np.unique(held, return_index=True)[1])]]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = space.augmented(_matrix(batch.column("v"), space.dim))
                node = ((centres**2).sum(axis=1) - 2 * p @ centres.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.astype(np.int32))], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(run, "row long, vec_id long, label long, v array<double>, node int")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, least: int = 30, most: int = 90, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a column over vec_id. An anchor's positives are its first rows of the same label; for each, the first k rows
    of other labels whose score lies from ``least`` to ``most`` per cent of the positive's. Higher inner products of floor(256 x)
    come first, ties by smaller id. Rows with a null id, label, vector or component, or a non-finite one, take no part. All rows
    of an anchor's own id are left out; a repeated row is one more candidate, and a repeated anchor counts once (with another
    vector or label it is an anchor of its own). Shorter vectors count as padded with zeros; scores beyond a long's range count
    as its end; further columns are left aside. An empty table, no anchor, or anchors without positives give no rows; a positive
    whose score is below 0 has an empty window.
    """
    scratch = Scratch(vectors.sparkSession)
    spark = scratch.spark
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = scratch.write(labelled(vectors), "rows")
    most_of = F.aggregate("v", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e)))
    dim, largest, total = rows.agg(F.max(F.size("v")), F.max(most_of), F.count("*")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    dim, largest = max(dim, 1), largest or 1.0
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + (e / largest) * (e / largest))
    length = rows.agg(F.max(F.sqrt(square))).first()[0]
    space = Space(dim, largest, length * (1 + 1e-12))
    placed = scratch.write(_layout(rows, space, total), "placed")
    scratch.drop(rows)
    order = ["label", "node", "row"]
    blocks = scratch.write(candidate_blocks(placed.repartitionByRange(*order).sortWithinPartitions(*order), space, block), "blocks")
    anchors = placed.where(is_anchor).dropDuplicates(["vec_id", "label", "v"])
    anchors = scratch.write(anchors, "anchors")
    # Blocks are dealt to no more parts than whole ones would fill, as a part keeps an anchor's finds over all its blocks; a task
    # holds those of one part, so they are HELD at most on average.
    whole = -(-total // block)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), whole), -(-whole // HELD))

    def asked(df, windows, label):
        # Anchors of a block share labels and neighbourhood, so that they need the same blocks of candidates.
        return scratch.write(anchor_blocks(df.repartitionByRange(*order).sortWithinPartitions(*order), space, anchor_block, windows), label)

    with short_batches(spark, 8):  # rows of a MB each
        everything = anchors.withColumn("low", F.array(F.lit(-END))).withColumn("high", F.array(F.lit(END)))
        first = scratch.write(_search(asked(everything, 1, "asked"), blocks, space, parts, positives, 1, True), "positives")
        held = first.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))
        share = "transform(own, p -> (p.score div 100) * {0} + {1}((p.score % 100) * {0} / 100))"  # whole hundreds apart: exact, and nothing overflows
        windowed = anchors.join(held, anchors["row"] == held["number"]).drop("number")
        windowed = windowed.withColumn("low", F.expr(share.format(least, "ceil"))).withColumn("high", F.expr(share.format(most, "floor")))
        second = scratch.write(_search(asked(windowed, positives, "windows"), blocks, space, parts, k, positives, False), "negatives")
    pairs = first.select("number", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = second.select("number", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["number", "window"])
    named = found.join(anchors.select(F.col("row").alias("number"), F.col("vec_id").alias("anchor_id")), "number")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
