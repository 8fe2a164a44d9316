"""The corpus pipeline: against plain Python over the smallest documents, and each stage on odd rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import decontaminate, line_dedup, ngram_join, quality, registry
from tests.llm.test_operators import DOCS, brute_components

SF = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]


def test_every_query_is_registered():
    assert {int(x[2:].split("_")[0]) for x in registry.queries()} == set(range(1, 14))


def brute_lines(docs):
    """Texts without lines that an earlier one equals, or is one word away from among lines of four words and more."""
    seen, whole, out = [], set(), {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            words = line.split()
            near = len(words) >= line_dedup.SHORT_WORDS and any(line_dedup.within_one(words, x) for x in seen if abs(len(x) - len(words)) < 2)
            gone = words and (tuple(words) in whole or near)
            if words and tuple(words) not in whole:
                whole.add(tuple(words))
                if len(words) >= line_dedup.SHORT_WORDS:
                    seen.append(words)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def brute_held(text, index_of):
    """Whether a window of the text, of twice an item's band, holds an item: scored in full for every item and window."""
    words = decontaminate.words_of(text)
    for index in index_of.indexes:
        for k in range(len(words) // index.stride + 1):
            passage = words[k * index.stride : (k + 2) * index.stride]
            score = {}
            for w in set(passage):
                for item, x in zip(*index.postings.get(w, ([], []))):
                    score[item] = score.get(item, 0.0) + x
            for item, x in score.items():
                if x >= decontaminate.THRESHOLD - 1e-9 and all(decontaminate.in_order(p, passage) >= decontaminate.OVERLAP for p in index.parts[item]):
                    return True
    return False


def test_pipeline_equals_brute_force(spark):
    import tiktoken

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    docs = sorted((r["doc_id"], r["text"] or "") for r in read("documents").collect())
    model = quality.fit(read("documents"), read("labels"))
    good = [(i, t) for i, t in docs if quality.apply_model(np.array([quality.statistics(t)]), model)[0] >= 0.7]
    lines = brute_lines(good)
    kept = [(i, lines[i]) for i, t in good if lines[i] == t or lines[i].strip()]
    groups = brute_components(kept, 5, 4, 5)
    alone = [(i, t) for i, t in kept if groups[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    index = decontaminate.Banded(items, known=brute_counts(items))
    clean = [(i, t) for i, t in alone if not brute_held(t, index)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in clean:
        ids = library.encode_ordinary(t)
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 20 < len(got) < len(docs)


def brute_counts(items):
    bags = [words for _, text in items if text and (words := decontaminate.words_of(text))]
    df = {}
    for words in bags:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    return len(bags), sum(map(len, bags)) / len(bags), df


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of the documents' columns and one more: nulls anywhere, blank and long texts, repeats."""
    good = next(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").collect() if len(r["text"]) > 400)
    r = random.Random(3)
    long = " ".join(r.choice(good.split()) for _ in range(30_000))
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, good, None, None), (None, good, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n ", "en", "b"), (6, long, "en", "b"), (1, "another text of the same id", None, None)]
    return spark.createDataFrame([(*x, len(x[1] or ""), 0.5, 7, 3) for x in rows], DOCS)


@pytest.mark.parametrize("k", range(5))
def test_a_stage_takes_odd_rows(spark, odd, k):
    """Every stage keeps the columns (but the last), and its stated rule for nulls, blanks, repeats and an empty table."""
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, SF)
    empty = stage(spark, odd.limit(0), SF)
    assert empty.count() == 0
    if k < 4:
        assert out.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
    every = sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    if k == 0:
        assert ids.count("1") >= 2 and "None" in ids  # rows of one text stand or fall together
    elif k == 1:
        texts = {(str(r["doc_id"]), r["text"]) for r in out.collect()}
        assert ("3", None) in texts and "2" not in ids and ids.count("1") == 3 and "None" in ids
    elif k == 2:
        assert ids == sorted(x for x in every if x != "2")
    elif k == 3:
        assert ids == every
    else:
        got = {str(r["doc_id"]): r for r in out.where(F.col("doc_id") > 2).collect()}
        assert ids == every and got["3"]["n_tokens"] == got["4"]["n_tokens"] == 0
        assert got["6"]["decoded_sha256"] == hashlib.sha256(odd.where("doc_id = 6").first()["text"].encode()).hexdigest()


def test_repeated_ids_stay_or_go_together(spark):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words), (2, words + " more"), (2, words + " more"), (2, "something else that nobody repeats at all here")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, SF).collect()] == [1]
    assert ngram_join.linked(df).where("component_id = 1").count() == 4


#: Names that operators use inside, or might.
CLASHING = ("id", "gone", "rest", "row", "score", "predicted", "n_removed", "n_lines", "body", "lines", "_body", "_lines", "_bits", "_bucket", "_at", "_hit", "_one", "_two", "one", "two", "hit", "at", "h", "known", "component_id", "least", "size", "rep", "comp", "label", "item_id")


@pytest.mark.parametrize("k", range(4))
def test_a_stage_keeps_the_values_of_all_columns(spark, odd, k, monkeypatch):
    """Columns of any name come out of a stage with the values that they had; with one shard of the benchmark and with several."""
    rows = [(r["doc_id"], r["text"], *[f"{c} {n}" for c in CLASHING]) for n, r in enumerate(odd.collect())]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in CLASHING]]))
    if k == 3:
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", 4000)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns  # there is no n_chars either
    had = {x[2:] for x in rows}
    got = [tuple(r)[2:] for r in out.collect()]
    assert got and set(got) <= had and len(set(got)) == len(got)
