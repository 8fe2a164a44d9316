"""Token counts without token ids: pieces are counted once for each distinct pre-token, then joined to pre-token frequencies.

The library writes a space as U+2581, so that sign counts as a space here. The vocabulary's pieces never hold a space after
another character, so merges never cross the start of a run of spaces: the text, with the one space the library puts in
front, can be cut there, and the counts of the parts add up.

One pass gathers the distinct pre-tokens of all texts, and each is given to the library once. The most frequent ones, a fixed
number of short ones, are broadcast: a second pass adds up what they give within each text, and only its other pre-tokens,
with their frequencies, go through a join with the table of all. So the common words, which would be most of the rows and the
hottest keys, are never shuffled, and no text's ids are ever made.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Scratch, table, texts

#: Pre-tokens that are broadcast, and their characters at most: some 10 MB, whatever the input.
COMMON, COMMON_CHARS = 200_000, 32
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 200_000

_PARTS = re.compile(r" +[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Parts of the text without the space that starts each; joined by it, they are the text."""
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in _PARTS.findall(" " + text)]


def piece_counter(model_file: str):
    """From pre-tokens to the number of pieces of each."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def count(words: list[str]) -> list[int]:
        return [len(x) if w else 1 for w, x in zip(words, library.encode(words, num_threads=1))]  # an empty one is a space at the end

    return count


def distinct_pre_tokens(docs: DataFrame) -> DataFrame:
    """word, n: every pre-token of the texts and how often it comes; counts are summed inside tasks first."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in texts(batch):
                held.update(pre_tokens(text))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, model_file: str) -> DataFrame:
    """``words`` (word, n) and the ``pieces`` of each."""

    def run(batches):
        count = piece_counter(model_file)
        for batch in batches:
            found = count(batch.column("word").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["word", "n", "pieces"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, pieces int")


def most_frequent(pieces: DataFrame, common: int) -> dict[str, int]:
    """The pieces of short words from a frequency on: the least bound, in steps of a twelfth, that at most ``common`` words reach. No more than those leave the tasks."""
    short = pieces.where(F.length("word") <= COMMON_CHARS)
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = short.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.col("step").desc()).collect()
    room, least = common, None
    for r in steps:  # a few hundred, whatever the input
        if r["words"] > room:
            break
        room, least = room - r["words"], r["n"]
    if least is None:
        return {}
    return {r["word"]: r["pieces"] for r in short.where(F.col("n") >= least).select("word", "pieces").collect()}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept; further columns are left aside; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(piece_counts(distinct_pre_tokens(docs), model_file), "pieces")
    scratch.tidy()
    held = scratch.spark.sparkContext.broadcast(most_frequent(pieces, common))

    def run(batches):
        get = held.value.get
        for batch in batches:
            n_bytes, known, words, counts, ends = [], [], [], [], [0]
            for text in texts(batch):
                total = 0
                for word, n in Counter(pre_tokens(text)).items():
                    got = get(word)
                    if got is None:
                        words.append(word), counts.append(n)
                    else:
                        total += got * n
                n_bytes.append(len(text.encode())), known.append(total), ends.append(len(words))
            other = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), other)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "known", "other"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, known long, other array<struct<word:string,n:long>>")
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    other = rows.select("row", F.explode("other").alias("x")).select("row", "x.*")
    rest = other.join(pieces.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    counted = rows.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left").withColumn("n_tokens", total)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
