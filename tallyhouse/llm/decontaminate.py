"""Benchmark decontamination: passages of training documents query a BM25 index of test items.

The index holds for each word its postings: item and weight. A weight is the word's BM25 impact in the item over the sum of
the item's impacts, so a score is the share, from 0 to 1, of an item that a passage covers, and one threshold serves items
of any length. Passages are windows of words, half over each other and long enough that any item lies whole in one. Items
are banded by length, each band with an index and a width of its own, so that a passage is at most four times as long as
an item (or PASSAGE words), whatever other items there are.

Most passages fall to a bound before they are searched. In each item the commonest words are set apart, as many as make up at
most three quarters of the threshold: they are all that an item can get besides its other, essential words. A passage in
which no item gets the rest of the threshold from its essential words can hold none. The others go through block-max WAND:
cursors by item, a pivot where the words' largest weights reach the threshold, and the largest weights of the pivot's block
before it is scored. All items above the threshold come back, and count when the words of the question and of the answer are
both there in order.

The indexes are built from shards of the items, each bounded in bytes, so what is broadcast at once doesn't grow with the
benchmark. Document frequencies, number and mean length are counted once over all items, so scores don't depend on shards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Scratch, among, table, texts

#: Share of an item that a passage has to cover; share of question and answer that has to be there in order.
THRESHOLD, OVERLAP = 0.6, 0.8
#: UTF-8 bytes of items in one index; items in a block; words of a passage at least.
SHARD_BYTES, BLOCK, PASSAGE = 16 << 20, 32, 128
K1, B = 1.2, 0.75

_WORDS = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and of it; a single sentence is cut before its last quarter."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1 and words_of(parts[-1]) and words_of(" ".join(parts[:-1])):
        return words_of(" ".join(parts[:-1])), words_of(parts[-1])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def in_order(part: list[str], passage: list[str]) -> float:
    """The share of ``part`` that is a common subsequence with ``passage``; 1 for no words."""
    if not part:
        return 1.0
    at = {}
    for k, w in enumerate(passage):
        at.setdefault(w, []).append(k)
    ends: list[int] = []  # the least end of a common subsequence of each length
    for w in part:
        for k in reversed(at.get(w, ())):
            j = bisect_left(ends, k)
            ends[j : j + 1] = [k]
    return len(ends) / len(part)


def band(n: int) -> int:
    """The stride for an item of n words: PASSAGE / 2 doubled until the item fits."""
    stride = PASSAGE // 2
    while stride < n:
        stride *= 2
    return stride


class Index:
    """``known``: number of items with words, their mean length, and each word's document frequency, if ``items`` are a part of all."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, known: tuple[int, float, dict[str, int]] | None = None):
        self.ids, bags = [], []
        self.parts = []
        for item_id, text in sorted(items):
            if words := words_of(text):
                self.ids.append(item_id), bags.append(Counter(words)), self.parts.append(question_and_answer(text))
        if known:
            n, mean, df = known
        else:
            n = len(bags)
            df = Counter(w for bag in bags for w in bag)
            mean = sum(sum(bag.values()) for bag in bags) / max(n, 1)
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        for k, bag in enumerate(bags):
            size = sum(bag.values())
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for w, tf in bag.items()}
            total = sum(impact.values())
            for w, x in impact.items():
                at, weight = self.postings.setdefault(w, ([], []))
                at.append(k), weight.append(x / total)
        self.most = {w: max(weight) for w, (_, weight) in self.postings.items()}
        self.block_most: dict[str, dict[int, float]] = {}
        for w, (at, weight) in self.postings.items():
            by = self.block_most.setdefault(w, {})
            for k, x in zip(at, weight):
                by[k // BLOCK] = max(by.get(k // BLOCK, 0.0), x)
        #: Of each item's essential words the postings, and the sum they have to reach.
        self.essential: dict[str, list[tuple[int, float]]] = {}
        self.need = []
        weights: list[list[tuple[int, str, float]]] = [[] for _ in bags]
        for w, (at, weight) in self.postings.items():
            for k, x in zip(at, weight):
                weights[k].append((-df[w], w, x))
        for k, own in enumerate(weights):
            aside = 0.0
            for _, w, x in sorted(own):
                if aside + x <= 0.75 * threshold:
                    aside += x
                else:
                    self.essential.setdefault(w, []).append((k, x))
            self.need.append(threshold - aside - 1e-9)
        self.stride = band(max((sum(bag.values()) for bag in bags), default=0))

    def retrieve(self, words: set[str], threshold: float) -> list[tuple[int, float]]:
        """Item numbers and scores from the threshold on: block-max WAND."""
        threshold -= 1e-9
        cursors = [[self.postings[w][0][0], 0, w] for w in words if w in self.postings]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (item, _, w) in enumerate(cursors):
                bound += self.most[w]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[w].get(block, 0.0) for _, _, w in cursors[: pivot + 1]) < threshold:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
            elif cursors[0][0] == item:
                score = sum(self.postings[w][1][at] for _, at, w in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            left = []
            for k, cursor in enumerate(cursors):
                if k <= pivot and cursor[0] < to:
                    items = self.postings[cursor[2]][0]
                    cursor[1] = bisect_left(items, to, cursor[1])
                    if cursor[1] == len(items):
                        continue
                    cursor[0] = items[cursor[1]]
                left.append(cursor)
            cursors = left
        return found

    def search(self, words: list[str], threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """For each item that the text of these words holds: its best passage's score and the shares of question and answer in it."""
        essential, need, stride = self.essential, self.need, self.stride
        passages: dict[int, set[str]] = {}
        for k, w in enumerate(words):
            if w in essential:
                passages.setdefault(k // stride, set()).add(w)
        found: dict[int, tuple[float, float, float]] = {}
        for k in sorted({*passages, *(p - 1 for p in passages if p)}):
            got: dict[int, float] = {}
            for w in passages.get(k, set()) | passages.get(k + 1, set()):
                for item, x in essential[w]:
                    got[item] = got.get(item, 0.0) + x
            if not any(x >= need[item] for item, x in got.items()):
                continue
            passage = words[k * stride : (k + 2) * stride]
            for item, score in self.retrieve(set(passage), threshold):
                question, answer = (in_order(x, passage) for x in self.parts[item])
                if question >= overlap and answer >= overlap:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, question, answer))
        best: dict[int, tuple[float, float, float]] = {}
        for k, x in found.items():  # items of one id count as one
            best[self.ids[k]] = max(best.get(self.ids[k], x), x)
        return best


class Banded:
    """An index for each band of the items' lengths."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, known: tuple[int, float, dict[str, int]] | None = None):
        by: dict[int, list[tuple[int, str]]] = {}
        for item in items:
            by.setdefault(band(len(words_of(item[1]))), []).append(item)
        self.indexes = [Index(by[k], threshold, known) for k in sorted(by)]

    def search(self, text: str, threshold: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        words = words_of(text)
        found: dict[int, tuple[float, float, float]] = {}
        for index in self.indexes:
            for item, x in index.search(words, threshold, overlap).items():
                found[item] = max(found.get(item, x), x)
        return found


def _indexes(scratch: Scratch, items: DataFrame, threshold: float):
    """An index for each shard of the items, broadcast: about SHARD_BYTES of their texts pass the driver at once. Yields it and whether it is the only one."""
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def run(batches):
        for batch in batches:
            rows = []
            for shard, text in zip(batch.column("shard").to_pylist(), texts(batch)):
                if words := words_of(text):
                    rows += [(shard, None, len(words)), *((shard, w, 1) for w in set(words))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))], names=["shard", "word", "n"])

    placed = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("long"))
    #: A row without word for each item holds its length.
    words = placed.select("shard", "text").mapInArrow(run, "shard long, word string, n long")
    words = scratch.write(words.groupBy("shard", "word").agg(F.sum("n").alias("n"), F.count("*").alias("items")), "item_words")
    n, length = words.where("word is null").agg(F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = words.where("word is not null").groupBy("word").agg(F.sum("items").alias("df"))
    for shard in range(shards):
        own = words.where((F.col("shard") == shard) & F.col("word").isNotNull()).select("word")
        frequency = dict(map(tuple, df.join(own, "word", "left_semi").collect()))
        rows = [tuple(r) for r in placed.where(F.col("shard") == shard).select("item_id", "text").collect()]
        yield scratch.spark.sparkContext.broadcast(Banded(rows, threshold, (n, length / max(n, 1), frequency))), shards == 1
    scratch.drop(words)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question, answer: every document and test item that it holds, once for each row of ``docs``.

    Null or empty texts, and items without words, match nothing; repeated items of one id count as one by the larger
    score; repeated documents give repeated rows; further columns are left aside. Shards of the benchmark are searched one
    after another, each with its own index in memory alone.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select("doc_id", "text").where("text is not null")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question double, answer double"
    parts = []
    for held, only in _indexes(scratch, items, threshold):

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                rows = [(k, item, *x) for k, text in enumerate(texts(batch)) for item, x in index.search(text, threshold, overlap).items()]
                if rows:
                    at, *rest = zip(*rows)
                    columns = [batch.column("doc_id").take(pa.array(at)), pa.array(rest[0], pa.int64()), *map(pa.array, rest[1:])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "question", "answer"])

        found = source.mapInArrow(run, schema)
        if only:
            return found
        parts.append(scratch.write(found, "found"))
        held.destroy()
    return reduce(DataFrame.unionByName, parts)


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; rows of null or empty text stay. With one shard of items nothing is shuffled."""
    scratch, marks = Scratch(docs.sparkSession), []
    one, two = F.xxhash64("text").alias("one"), F.xxhash64(F.lit(2), "text").alias("two")
    for held, only in _indexes(scratch, items, threshold):

        def keep(batches, held=held):
            index = held.value
            for batch in batches:
                yield batch.filter(pa.array([not index.search(x, threshold, overlap) for x in texts(batch)], pa.bool_()))

        def drop(batches, held=held):
            index = held.value
            for batch in batches:
                hit = pa.array([bool(index.search(x, threshold, overlap)) for x in texts(batch)], pa.bool_())
                yield batch.select(["one", "two"]).filter(hit)

        if only:
            return docs.mapInArrow(keep, docs.schema)
        marked = docs.where("text is not null").select(one, two, "text")
        marks.append(scratch.write(marked.mapInArrow(drop, "one long, two long"), "marked"))
        held.destroy()
    gone = scratch.write(reduce(DataFrame.unionByName, marks).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), one.alias("_one"), two.alias("_two"))
    asked, others = among(scratch, rows, "_one", gone.select("one"))
    clean = asked.join(gone, (F.col("_one") == F.col("one")) & (F.col("_two") == F.col("two")), "left_anti").unionByName(others)
    return clean.select("row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question", "answer")])
