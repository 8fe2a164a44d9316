"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two Markov models of order one over character classes are trained from labelled samples that the corpus itself gives:
what the patterns catch is labelled random, but for assigned values that read like an ordinary word; other words of 10 or
more identifier characters, as far as no pattern touches them and digits stand at the end only, and plain numbers are
labelled ordinary. A key may come from another alphabet than
the patterns' hits, so half of the random model is a uniform draw of letters and digits. A word, or what is left of one
beside a pattern's match, is a secret too when its log-likelihood ratio passes a bound that grows with its length; nothing
else is asked of it. Counting takes one pass over all texts; the counts are summed inside tasks, so what is gathered is a
table bounded by the alphabet squared, whatever the input.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import map_batches, table, texts

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: A run of 20 or more characters, and of 24 or more: the same spans as the open patterns give after short ones are dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words, and parts of them, are scored from so many characters on; one of fewer than ENOUGH needs the evidence of that many.
SHORTEST, ENOUGH = 10, 16
WORD = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
ORDINARY = re.compile(r"[A-Za-z+/_=-]+[0-9]*|[0-9+/_=-]+").fullmatch
KINDS = ("assign", "access", "hex", "markov")

#: Characters of WORD, by class; 0 stands for the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(ALPHABET) + 1
#: How many observations the single characters' shares weigh, where transitions are few.
BACKOFF = 5.0
#: The random model's share that is a uniform draw of letters and digits.
UNIFORM = 0.5
_CODES = np.zeros(256, dtype=np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, SIZE)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of every pattern's matches, by start, then kind as listed."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _steps(word: str) -> np.ndarray:
    """The transitions of a word, each as one number."""
    codes = _CODES[np.frombuffer(word.encode("ascii", "replace"), dtype=np.uint8)]
    return np.concatenate([[0], codes[:-1]]) * SIZE + codes


def other_words(text: str, spans: list, whole: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, word) of long words, or of the long parts of words that no pattern's match covers; ``whole``: only words that none touches."""
    out, k = [], 0
    for m in WORD.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][2] <= at:
            k += 1
        parts, j = [], k
        while j < len(spans) and spans[j][0] < end:
            if spans[j][2] > at:
                parts.append((at, spans[j][0]))
                at = spans[j][2]
            j += 1
        if whole and parts:
            continue
        out.extend((a, b, text[a:b]) for a, b in [*parts, (at, end)] if b - a >= SHORTEST)
    return out


def transition_counts(docs: DataFrame) -> DataFrame:
    """label (0 ordinary, 1 random), step, n over every whole text."""

    def make():
        def step(batch):
            counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
            for text in texts(batch):
                spans = base_spans(text)
                for s in spans:
                    if s[1] or not ORDINARY(s[3]):  # password=changeme is no sample of a random string
                        counts[1] += np.bincount(_steps(s[3]), minlength=SIZE * SIZE)
                for word in (w for _, _, w in other_words(text, spans, whole=True) if ORDINARY(w)):
                    counts[0] += np.bincount(_steps(word), minlength=SIZE * SIZE)
            label, which = np.nonzero(counts)
            return [label, which, counts[label, which]]

        return step

    return map_batches(docs.select("text"), "label int, step int, n long", make).groupBy("label", "step").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """For each transition the log of its likelihood under random over that under ordinary; at most 2 * SIZE**2 rows are gathered.

    A corpus without either kind of sample leaves that model uniform.
    """
    tally = np.zeros((2, SIZE * SIZE))
    for label, which, n in counts.collect():
        tally[label, which] += n
    tally[0] = np.maximum(tally[0] - 1, 0)  # a transition seen once is a key of letters as likely as a word; its own count must not clear it
    tally = tally.reshape(2, SIZE, SIZE)
    single = tally.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    p = (tally + BACKOFF * single[:, None, :]) / (tally.sum(axis=2, keepdims=True) + BACKOFF)
    draw = np.array([c.isalnum() for c in "." + ALPHABET]) / 62
    return (np.log((1 - UNIFORM) * p[1] + UNIFORM * draw) - np.log(p[0])).reshape(-1)


def is_random(word: str, ratio: np.ndarray, bound: float) -> bool:
    """Whether the word's ratio passes ``bound`` a character, counted for ENOUGH characters at least."""
    return ratio[_steps(word)].sum() > bound * max(len(word), ENOUGH)


def secret_spans(docs: DataFrame, ratio: np.ndarray | None = None, bound: float = 0.5) -> DataFrame:
    """doc_id and the ``found`` spans (kind, start, end; code points, end exclusive) of every row's whole text.

    ``ratio`` comes from ``log_ratios``; without it the models are trained on ``docs``. A null or empty text has no spans;
    null ids and repeated rows are kept; further columns are left aside.
    """
    if ratio is None:
        ratio = log_ratios(transition_counts(docs))

    def make():
        def step(batch):
            out = []
            for text in texts(batch):
                spans = base_spans(text)
                extra = []
                for start, end, word in other_words(text, spans):
                    if is_random(word, ratio, bound):
                        extra.append((start, 3, end, word))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in sorted(spans + extra)])
            return [batch.column("doc_id"), out]

        return step

    return map_batches(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:int,end:int>>", make)


def op2(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    as_text = lambda spans: F.array_join(F.transform(spans, one), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "markov")
    counts = [of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
