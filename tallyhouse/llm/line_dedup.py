"""Line dedup by deletion neighbourhoods: lines equal, or one word apart, keep their earliest only.

A line is its words; distance counts words put in, left out or replaced. Lines of one distance have a variant in common:
both without word i (replaced), or one of them whole and the other without word i. Each line emits the hash of each such
variant as a key, marked by what it stands for, so that lines under one key are within the bound of each other. Keys are
counted first; only variants under a key that can join two lines come again, meet the earliest line of that key, and the
distance is verified on the words. Both steps aggregate inside tasks, so a key that very many lines share is no hot spot.

Emitting all variants of all lines would write the corpus many times over. One edit leaves the first or the last half of a
line alone, so only lines that share a half with another distinct line emit variants, and only for the other half. Copies
are settled first, by hash. Places are (doc_id, line number); a line goes when an earlier line is equal to it or within
the bound. Blank lines stay, and lines under ``min_words`` go as copies only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Scratch, among, bundled, table, texts

MIN_WORDS = 8
#: The floor of ``op7`` and the pipeline: one word is a quarter of a line at most.
SHORT_WORDS = 4
#: Where a line stands; the order in which the earliest comes first.
PLACE = ("doc_id", "line", "body")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def halves(n: int, min_words: int) -> list[int]:
    """Lengths of the halves by which a line of n words meets lines of n - 1, n and n + 1 words: a power of two for all in [2**q, 2**(q + 1))."""
    if n < min_words:
        return []
    c = 1 << (n.bit_length() - 2)
    return [c, *[c // 2] * (n == 2 * c and n - 1 >= min_words)]


def half_keys(words: list[str], min_words: int) -> list[int]:
    """For each half length the hash of the first and of the last words."""
    out = []
    for c in halves(len(words), min_words):
        for side, part in enumerate((words[:c], words[-c:])):
            out.append(xxhash.xxh3_64_intdigest(" ".join(part), seed=2 * c + side) - (1 << 63))
    return out


def variant_keys(words: list[str], where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their kinds: 0 without word i, of this length; 1 without word i, for lines of one word less; 2 the whole line, for lines of one word more. i runs over ``where``."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    without = sums[where] + (sums[n] - sums[where + 1]) * _B_INVERSE
    size = np.full(1, n, np.uint64)
    replaced = _mix(_mix(without ^ (where.astype(np.uint64) * _A)) ^ (size * np.uint64(4)))
    shorter = _mix(_mix(without) ^ ((size - np.uint64(1)) * np.uint64(4) + np.uint64(1)))
    whole = _mix(_mix(sums[n:]) ^ (size * np.uint64(4) + np.uint64(1)))
    return np.concatenate([replaced, shorter, whole]).view(np.int64), np.repeat(np.array([0, 1, 2], np.int32), [len(where), len(where), 1])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _batch(columns: dict) -> pa.RecordBatch:
    """From name -> (values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], names=list(columns))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with words: 128 bits of hash, its place and half keys."""

    def run(batches):
        for batch in batches:
            one, two, ids, body, number, keys = [], [], [], [], [], []
            for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), texts(batch)):
                for k, line in enumerate(text.split("\n")):
                    if words := line.split():
                        h = xxhash.xxh3_128_intdigest(" ".join(words))
                        one.append((h >> 64) - (1 << 63)), two.append((h & ((1 << 64) - 1)) - (1 << 63))
                        ids.append(doc_id), body.append(mark), number.append(k), keys.append(half_keys(words, min_words))
            if one:
                long = pa.int64()
                yield _batch({"one": (one, long), "two": (two, long), "doc_id": (ids, long), "body": (body, long), "line": (number, pa.int32()), "keys": (keys, pa.list_(long))})

    return docs.mapInArrow(run, "one long, two long, doc_id long, body long, line int, keys array<long>")


def _picked(docs: DataFrame, owing: DataFrame) -> DataFrame:
    """The words of the lines that ``owing`` names, and which of their halves others share."""

    def pick(batches):
        for batch in batches:
            ids, body, number, which, found = [], [], [], [], []
            for doc_id, mark, text, owes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "text", "owing"))):
                parts, wanted = text.split("\n"), {}
                for x in owes:
                    wanted.setdefault(x["line"], []).append(x["which"])
                for k, sides in wanted.items():
                    ids.append(doc_id), body.append(mark), number.append(k), which.append(sides), found.append(" ".join(parts[k].split()))
            int_, long = pa.int32(), pa.int64()
            yield _batch({"doc_id": (ids, long), "line": (number, int_), "body": (body, long), "which": (which, pa.list_(int_)), "words": (found, pa.string())})

    rows = docs.join(owing, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"])
    return rows.mapInArrow(pick, "doc_id long, line int, body long, which array<int>, words string")


def _variants(near: DataFrame, min_words: int) -> DataFrame:
    """key, kind and place of every variant of the lines in ``near``, of the words outside the halves that others share."""

    def out(batch, rows):
        at = pa.array(np.concatenate([r[2] for r in rows]))
        found = [pa.array(np.concatenate([r[k] for r in rows])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*found, *(batch.column(c).take(at) for c in PLACE)], names=["key", "kind", *PLACE])

    def emit(batches):
        for batch in batches:
            rows, held = [], 0
            for k, (which, line) in enumerate(zip(batch.column("which").to_pylist(), batch.column("words").to_pylist())):
                words = line.split(" ")
                free = np.zeros(len(words), bool)
                for x in which:
                    c = halves(len(words), min_words)[x // 2]
                    free[slice(0, len(words) - c) if x % 2 else slice(c, None)] = True
                keys, kinds = variant_keys(words, np.nonzero(free)[0])
                rows.append((keys, kinds, np.full(len(keys), k)))
                held += len(keys)
                if held >= 200_000:
                    yield out(batch, rows)
                    rows, held = [], 0
            if rows:
                yield out(batch, rows)

    return near.mapInArrow(emit, "key long, kind int, doc_id long, line int, body long")


def _near_copies(scratch: Scratch, near: DataFrame, min_words: int) -> DataFrame:
    """The places of lines of ``near`` that have an earlier line one edit away."""
    place, variants = F.struct(*PLACE), _variants(near, min_words)
    seen = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    joins = (F.col("high") == 0) & (F.col("n") > 1) | (F.col("low") < F.col("high"))
    met = scratch.write(seen.where(joins).select("key"), "met", links=True)
    some, _ = among(scratch, variants, "key", met)
    some = scratch.write(some.join(met, "key", "left_semi"), "variants", links=True)
    least = lambda c: F.min(F.when(c, place))
    first = some.groupBy("key").agg(least(F.col("kind") == 2).alias("whole"), least(F.col("kind") != 2).alias("cut"))
    first = scratch.write(first, "earliest", links=True)
    earlier = F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("cut"))
    pairs = some.join(first, "key").select(place.alias("place"), earlier.alias("earlier")).where("earlier < place")
    pairs = scratch.write(pairs.distinct(), "pairs", links=True)
    scratch.drop(met, some, first)
    scratch.tidy()
    said = near.select(place.alias("place"), "words")

    def verify(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("words", "other"))
            yield batch.select(["place"]).filter(pa.array([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b)], pa.bool_()))

    other = said.select(F.col("place").alias("earlier"), F.col("words").alias("other"))
    both = pairs.join(said, "place").join(other, "earlier").select("place", "words", "other")
    close = both.mapInArrow(verify, "place struct<doc_id:long,line:int,body:long>").select("place.*")
    close = scratch.write(close, "close", links=True)
    scratch.drop(pairs)
    return close


def removed_lines(docs: DataFrame, max_edits: int = 1, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, body, lines): for each document the numbers of the lines that go. ``body`` is the text's hash, so that rows of one id and other texts keep apart.

    ``max_edits`` 0 settles copies only.
    """
    if max_edits not in (0, 1):
        raise ValueError("variants are emitted for bounds of 0 and 1")
    scratch = Scratch(docs.sparkSession)
    source = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    lines = scratch.write(_lines(source, min_words), "lines")
    place = F.struct(*PLACE)
    firsts = lines.groupBy("one", "two").agg(F.min(F.struct(*PLACE, "keys")).alias("f"), F.count("*").alias("n"))
    firsts = scratch.write(firsts.select("one", "two", "f.*", "n"), "firsts")
    several = firsts.where("n > 1").select("one", "two", place.alias("first"))
    copies = lines.select("one", "two", place.alias("place")).join(several, ["one", "two"]).where("place > first").select("place.*")
    gone = [scratch.write(copies, "copies")]
    scratch.drop(lines)
    scratch.tidy()
    if max_edits:
        halved = firsts.select(*PLACE, F.posexplode("keys").alias("which", "key"))
        met = halved.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        owing = halved.join(met, "key", "left_semi").groupBy("doc_id", "body").agg(F.collect_list(F.struct("line", "which")).alias("owing"))
        owing = scratch.write(owing, "owing")
        scratch.drop(firsts)
        asked, _ = among(scratch, source, "doc_id", owing.select("doc_id"))
        near = scratch.write(_picked(asked, owing), "near")
        scratch.drop(owing)
        scratch.tidy()
        gone.append(_near_copies(scratch, near, min_words))
        scratch.drop(near)
    every = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
    out = scratch.write(every.groupBy("doc_id", "body").agg(F.collect_set("line").alias("lines")), "removed")
    scratch.drop(firsts, *gone)
    scratch.tidy()
    return out


def deduplicated(docs: DataFrame, max_edits: int = 1, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` left without the lines that go, and n_lines, n_removed behind its columns.

    Every row stays. Rows without id or text keep all they have and take nothing from others; rows that repeat id and text
    keep the same lines; a text whose lines all go is empty. Columns named n_lines or n_removed are replaced. Texts of
    documents that lose nothing aren't shuffled.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = removed_lines(docs, max_edits, min_words)
    rows = bundled(docs.select(*[F.col(f"`{c}`") for c in kept])).withColumn("body", F.xxhash64("text"))
    asked, others = among(Scratch(docs.sparkSession), rows, "doc_id", gone.select("doc_id"))
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "body": "gone_body"})
    asked = asked.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("body") == F.col("gone_body")), "left")
    rows = asked.unionByName(others, allowMissingColumns=True)
    parts = F.split("text", "\n", -1)
    stay = F.filter(parts, lambda _, k: ~F.array_contains("lines", k))
    left = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    count = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    said = rows.select("doc_id", left.alias("text"), "rest", count(parts).alias("n_lines"), count("lines").alias("n_removed"))
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in kept]
    return said.select(*columns, "n_lines", "n_removed")


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document: its lines, how many of them go, and the digest of what is left."""
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=SHORT_WORDS)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
