"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams. Hashing each n-gram to a bit and XOR-ing the bits gives a parity sketch: equal
n-grams of two documents cancel, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. Documents alike to degree J differ in at most d = (|A| + |B|) (1 - J) / (1 + J) n-grams. By size band, the
sketch is cut into d + 1 + w segments, so at least w + 1 of them agree; a segment in which no n-gram falls says nothing and
gives no key. A document with more than w such segments adds a second layout of segments, then a third, until one leaves
it w at most: of two documents, the one that stops first has a segment there that agrees and isn't empty. Equal segments
are found by one sort.

Copies of a set are one class from the start; classes go by the set's fingerprint, so rows that share an id but not a text
keep apart until ids are asked for. Within a segment's bucket every class first meets the smallest one only; what then still
spans components meets under size and Hamming bounds, by a short sketch first and a long one for what is left. Candidates
are verified on the texts' own n-gram sets, the likeliest of each component first: what joins components on the way needs
no more verification, so texts are read in proportion to the classes, and no link between components is missed.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.common import Scratch, among, map_batches, short_batches, table, texts
from tallyhouse.llm.components import merged

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: 64-bit words of the long dense sketch, at least, and of the short one; bits of a segment of the sparse one; layouts of segments at most.
WORDS, SHORT, SEGMENT_BITS, LAYOUTS = 32, 8, 20, 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; words are what ASCII white space parts, A-Z lowered.

    With fewer than n words all of them are one n-gram; without words the set is empty.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    x = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        x = _mix((x ^ h[k : len(h) - width + 1 + k]) * _MIX1 + np.uint64(k))
    return np.unique(x)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever the order."""
    return tuple(int(x.view(np.int64)) for x in (np.bitwise_xor.reduce(_mix(s + _MIX1)), np.add.reduce(_mix(s ^ _MIX3))))


def dense_sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch: WORDS 64-bit words, doubled until there are two bits for each n-gram, so that it tells large sets apart too."""
    words = WORDS
    while 32 * words < len(s):
        words *= 2
    parity = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The parity sketch of fewer words, from a longer one."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words))


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of two parity sketches, over as many bits as the shorter one has: at most the size of the sets' symmetric difference."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


class Bands:
    """Size bands for a Jaccard bound num/den. Band k holds sizes from start[k] on, up to start[k + 1] left out."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = 1 + 2.5 * (1 - num / den)
        start = [1]
        while start[-1] < 1 << 34:
            start.append(max(start[-1] + 1, int(start[-1] * ratio)))
        self.start = np.array(start)

    def differ(self, total: int) -> int:
        """The most n-grams in which two sets of so many in all may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=4096)
    def segments(self, k: int) -> tuple[int, int]:
        """Segments of band k, and how many empty ones leave a document one that agrees. Sets that meet there may be smaller than the band."""
        low, d = -(-int(self.start[k]) * self.num // self.den), self.differ(2 * int(self.start[k + 1] - 1))
        w = 0
        while w < d + 1:
            empty = (d + 1 + w) * math.exp(-low / (d + 1 + w))
            if w >= empty + 3 * math.sqrt(empty):
                break
            w += 1
        return d + 1 + w, w

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size can meet another as the smaller or the larger."""
        k = int(np.searchsorted(self.start, size, side="right")) - 1
        return [k, *[j for j in (k + 1,) if size * self.den >= self.num * int(self.start[j])]]


def segment_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A 64-bit key for each segment that isn't empty, by band and layout, of the set's sparse parity sketch: a linear digest of the segment's set bits.

    Sets too small to differ from a different one within the bound have no keys: copies are found as classes. In the last
    layout empty segments have keys too, for a set that none of them serves.
    """
    out = []
    for band in bands.of(len(s)):
        if not bands.differ(2 * int(bands.start[band + 1] - 1)):
            continue
        m, spare = bands.segments(band)
        for layout in range(LAYOUTS):
            seed = np.uint64(band + (layout << 32))
            h = _mix(s ^ seed)
            segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            bit = h & np.uint64((1 << SEGMENT_BITS) - 1)
            order = np.argsort(segment, kind="stable")
            steps = np.bitwise_xor.accumulate(_mix((segment[order] << np.uint64(SEGMENT_BITS)) + bit[order] + _MIX1))
            total = np.concatenate([np.zeros(1, np.uint64), steps])
            ends = np.searchsorted(segment[order], np.arange(m + 1))
            digest = total[ends[1:]] ^ total[ends[:-1]]
            keys = _mix(_mix(digest + np.arange(m, dtype=np.uint64) * _MIX2) + seed)
            empty = ends[1:] == ends[:-1]
            last = layout == LAYOUTS - 1
            out.append(keys if last else keys[~empty])
            if empty.sum() <= spare or last:
                break
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def make():
        def step(batch):
            size, one, two, short, sketch = [], [], [], [], []
            for text in texts(batch):
                s = shingle_set(text, n)
                a, b = fingerprint(s)
                long = dense_sketch(s)
                size.append(len(s)), one.append(a), two.append(b), short.append(folded(long, SHORT).view(np.int64)), sketch.append(long.tobytes())
            return [batch.column("doc_id"), size, one, two, short, sketch]

        return step

    schema = "doc_id long, size long, one long, two long, short array<long>, sketch binary"
    return map_batches(docs.select("doc_id", "text"), schema, make)


def _keys(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """key, id (half of the set's fingerprint) of every segment; a copy of a set that the task has lately seen adds none."""

    def run(batches):
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            ids, keys = [], []
            for text in texts(batch):
                s = shingle_set(text, n)
                mark = (len(s), *fingerprint(s))
                if not len(s) or mark in seen:
                    continue
                seen[mark] = None
                if len(seen) > 50_000:
                    seen.popitem(last=False)
                keys.append(segment_keys(s, bands))
                ids.append(np.full(len(keys[-1]), mark[1], np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], names=["key", "id"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "key long, id long")


def _shared(keys: DataFrame) -> DataFrame:
    """key, hub, id: the distinct ids of a key besides its smallest, which is the hub: one sort, read in order, a batch at a time."""

    def run(batches):
        last_key = last_id = last_hub = None
        for batch in batches:
            key, id_ = (batch.column(c).to_numpy() for c in ("key", "id"))
            if not len(key):
                continue
            first = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            new = first | np.concatenate([[id_[0] != last_id], id_[1:] != id_[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            hub = np.where(at >= 0, id_[at], 0 if last_hub is None else last_hub)
            keep = new & ~first
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, hub, id_)], names=["key", "hub", "id"])
            last_key, last_id, last_hub = int(key[-1]), int(id_[-1]), int(hub[-1])

    return keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, hub long, id long")


def _close(bands: Bands) -> Column:
    """Size and Hamming bounds of a pair with columns size_a, size_b and short sketches short_a, short_b."""
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    word = lambda x, i: F.element_at(f"short_{x}", i + 1)
    apart = sum((F.bit_count(word("a", i).bitwiseXOR(word("b", i))) for i in range(SHORT)), F.lit(0))
    return (small * bands.den >= large * bands.num) & (apart * (bands.den + bands.num) <= (small + large) * (bands.den - bands.num))


def _near(pairs: DataFrame, facts: DataFrame, bands: Bands) -> DataFrame:
    """a, b, far: the pairs (a, b) of classes that pass the long sketch, and by how much."""
    total, differ = bands.den + bands.num, bands.den - bands.num

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            sketches = zip(*(batch.column(c) for c in ("sketch_a", "sketch_b")))
            apart = np.array([hamming(*(np.frombuffer(x.as_buffer(), np.uint64) for x in two)) for two in sketches], np.int64)
            keep = pa.array(apart * total <= size * differ)
            rows = batch.select(["a", "b"]).append_column("far", pa.array(apart / size)).filter(keep)
            yield rows

    full = pairs.join(_side(facts, "a", "id", "size", "sketch"), "a").join(_side(facts, "b", "id", "size", "sketch"), "b")
    return full.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, far double")


def _side(rows: DataFrame, x: str, key: str, *columns: str) -> DataFrame:
    """``rows`` as one side of pairs: ``key`` as a or b, the other columns with that letter behind."""
    return rows.select(F.col(key).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])


class _Join:
    """One run of the join: its scratch tables and what each step needs."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.docs, self.n, self.bands, self.scratch = docs.select("doc_id", "text"), n, Bands(num, den), Scratch(docs.sparkSession)

    def bodies(self, classes: DataFrame, ids: DataFrame) -> DataFrame:
        """id (of a class) and a text of it, for the classes named."""
        n = self.n
        named = classes.join(ids, "id", "left_semi").select("id", "rep", "size", "one", "two")
        named = self.scratch.write(named, "named", links=True)  # its size is known from here on
        asked, _ = among(self.scratch, self.docs, "doc_id", named.select("rep"))
        whole = asked.join(named, F.col("doc_id") == F.col("rep")).select("id", "text", "size", "one", "two")

        def own(batches):  # an id may come with several texts
            for batch in batches:
                marks = zip(*(batch.column(c).to_pylist() for c in ("size", "one", "two")))
                sets = (shingle_set(x.as_py() or "", n) for x in batch.column("text"))
                keep = pa.array([(len(s), *fingerprint(s)) == m for s, m in zip(sets, marks)], pa.bool_())
                yield batch.select(["id", "text"]).filter(keep)

        with short_batches(self.scratch.spark, 500):
            return self.scratch.write(whole.mapInArrow(own, "id long, text string").dropDuplicates(["id"]), "bodies")

    def alike(self, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are alike to num/den at least, by their texts. Batches are kept short, as a row holds two whole texts."""
        n, num, den = self.n, self.bands.num, self.bands.den

        def verify(batches):
            @lru_cache(maxsize=64)
            def set_of(text):
                return shingle_set(text, n)

            for batch in batches:
                keep = []
                for x, y in zip(batch.column("text_a"), batch.column("text_b")):
                    s, t = set_of(x.as_py()), set_of(y.as_py())
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both * den >= num * (len(s) + len(t) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        second = bodies.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        both = pairs.select("a", "b").join(_side(bodies, "a", "id", "text"), "a").join(_side(second, "b", "id", "text"), "b")
        with short_batches(self.scratch.spark, 500):
            return self.scratch.write(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "verified")

    def settled(self, classes: DataFrame, components: DataFrame, pairs: DataFrame) -> DataFrame:
        """``components`` after every pair (a, b, far) that is alike is a link.

        Rounds: each component has its nearest few pairs verified, more from round to round, and pairs within a component are
        done. All pairs that still span components at the end have been verified.
        """
        if pairs.isEmpty():
            return components
        scratch, width = self.scratch, 2
        bodies = self.bodies(classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        while True:
            of = (_side(components, x, "id", "comp") for x in "ab")
            apart = scratch.write(pairs.join(next(of), "a").join(next(of), "b").where("comp_a <> comp_b"), "apart", links=True)
            if apart.isEmpty():
                break
            sides = apart.select("a", "b", "far", F.explode(F.array("comp_a", "comp_b")).alias("comp"))
            place = F.row_number().over(Window.partitionBy("comp").orderBy("far", "a", "b"))
            asked = scratch.write(sides.withColumn("place", place).where(F.col("place") <= width).select("a", "b").distinct(), "tried", links=True)
            links = self.alike(asked, bodies)
            components = merged(scratch, components, links)
            rest = scratch.write(apart.select("a", "b", "far").join(asked, ["a", "b"], "left_anti"), "rest", links=True)
            scratch.drop(apart, asked, links, pairs)
            pairs, width = rest, width * 8
        scratch.drop(apart, bodies, pairs)
        scratch.tidy()
        return components


def linked(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``: documents link when their n-gram sets have a Jaccard similarity of num/den at least.

    component_id is the smallest doc_id reachable. A text without words (null, empty, blank) has no n-grams and stays alone;
    rows without doc_id have no component and link nothing; rows with words that repeat an id share one component, whatever
    their texts; further columns are left aside; an empty table gives no rows.
    """
    run = _Join(docs, n, num, den)
    scratch, bands = run.scratch, run.bands
    sets = scratch.write(_sets(docs, n), "sets")
    same = ["one", "two", "size"]
    known = sets.where("doc_id is not null and size > 0").groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.first("short").alias("short"), F.first("sketch").alias("sketch")
    )
    classes = scratch.write(known.withColumn("id", F.monotonically_increasing_id()), "classes")
    shared = scratch.write(_shared(_keys(docs, n, bands)), "shared")
    scratch.tidy()
    marks = shared.select(F.explode(F.array("hub", "id")).alias("one")).distinct()
    facts = scratch.write(classes.join(marks, "one", "left_semi"), "facts", links=True)
    pairs = shared.select(F.col("hub").alias("mark_a"), F.col("id").alias("mark_b")).distinct()

    for x in "ab":
        pairs = pairs.join(_side(facts, x, "id", "one", "size", "short").withColumnRenamed(f"one_{x}", f"mark_{x}"), f"mark_{x}")
    close = scratch.write(pairs.where("a <> b").where(_close(bands)).select("a", "b"), "close", links=True)
    star = scratch.write(_near(close, facts, bands), "star", links=True)
    components = scratch.write(facts.select("id", F.col("id").alias("comp")), "components", links=True)
    components = run.settled(classes, components, star)
    # Buckets that still span components: their members meet each other, hubs apart.
    member = shared.select("key", F.col("id").alias("one")).join(facts.select("one", "id", "size", "short").join(components, "id"), "one")
    mixed = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    member = scratch.write(member.join(mixed, "key").drop("one"), "member", links=True)
    scratch.drop(shared)
    sides = [_side(member, x, "id", "key", "comp", "size", "short").withColumnRenamed(f"key_{x}", "key") for x in "ab"]
    met = sides[0].join(sides[1], "key").where((F.col("comp_a") < F.col("comp_b")) & _close(bands))
    met = scratch.write(met.select("a", "b").distinct(), "met", links=True)
    across = scratch.write(_near(met, facts, bands), "across", links=True)
    components = run.settled(classes, components, across)
    # From classes to ids: rows that repeat an id with several texts join their classes.
    worded = sets.where("doc_id is not null and size > 0").select("doc_id", *same)
    twice = worded.groupBy("doc_id").agg(F.min("one").alias("low"), F.max("one").alias("high")).where("low < high").select("doc_id")
    every = classes.select(*same, "rep", "id").join(components, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    every = scratch.write(every, "every")
    own = worded.join(twice, "doc_id", "left_semi").distinct().join(every, same).select("doc_id", "comp")
    least = own.groupBy("doc_id").agg(F.min("comp").alias("a"))
    bridges = own.join(least, "doc_id").select("a", F.col("comp").alias("b")).where("a < b").distinct()
    bridges = scratch.write(bridges, "bridges", links=True)
    comps = bridges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id"))
    over = merged(scratch, scratch.write(comps, "bridged", links=True), bridges)
    over = over.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    every_ = every.join(over, "comp", "left").select(*same, "rep", F.coalesce("to", "comp").alias("comp"))
    least = every_.groupBy("comp").agg(F.min("rep").alias("least"))
    named = scratch.write(every_.join(least, "comp").select(*same, "least"), "named")
    scratch.drop(classes, facts, components, close, member, met, every, bridges)
    scratch.tidy()
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return sets.select("doc_id", *same).join(named, same, "left").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
