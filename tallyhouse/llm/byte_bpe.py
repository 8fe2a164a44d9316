"""Byte-level BPE with a rank queue: encoding and decoding whole texts.

Merges of one pre-token come off a queue of buckets, one bucket for each merge rank, holding the places where that merge
can be done. Which buckets have something is kept in a hierarchical bitmap: 64-bit words with a bit for each rank, and above
them one integer with a bit for each word. Finding the lowest rank takes two find-first-set steps however many places wait.
Places go stale when a neighbour is merged first; they are recognised on the way out and skipped. The cost grows with the
length of the pre-token, not with its square. Pre-tokens of a few dozen bytes, where building the queue costs more than it
saves, take the lowest rank off a short list instead; both ways give the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush

import public_tokenizers
from pyspark.sql import DataFrame

from tallyhouse.llm.common import map_batches, table, texts

#: Pre-tokens a worker keeps encoded, in each of two generations.
KEPT = 150_000
#: Bytes from which a pre-token goes through the queue.
QUEUED = 48
_NONE = 1 << 60

#: Spaces that don't stand between two words, and cuts for texts with such.
_LOOSE = re.compile(r" (?:\s|\Z)").search
_CUT = re.compile(r"(?= \S)")
#: What often follows a word.
_ENDS = (".", ",")


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.single = [bytes((x,)) for x in range(256)]
        self.pairs = [[self.ranks.get(bytes((x, y)), _NONE) for y in range(256)] for x in range(256)]
        #: The queue's lower bitmap, a bit for each rank; empty between pre-tokens. The upper one is an int of a bit for each word.
        self.low = [0] * (max(self.tokens) // 64 + 1)
        self.fresh: dict[str, list[int]] = {x: self.merge(x.encode()) for x in _ENDS}
        self.old: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.merge_queued(piece) if len(piece) >= QUEUED else self.merge_listed(piece)

    def merge_listed(self, piece: bytes) -> list[int]:
        """By a list of the parts and one of the ranks with which each would merge with the next: quadratic, so for short ones."""
        ranks, get, pairs = self.ranks, self.ranks.get, self.pairs
        parts = list(map(self.single.__getitem__, piece))
        waits = [pairs[x][y] for x, y in zip(piece, piece[1:])]
        while waits and (rank := min(waits)) != _NONE:
            i = waits.index(rank)
            parts[i] = new = parts[i] + parts.pop(i + 1)
            del waits[i]
            if i < len(waits):
                waits[i] = get(new + parts[i + 1], _NONE)
            if i:
                waits[i - 1] = get(parts[i - 1] + new, _NONE)
        return [ranks[x] for x in parts]

    def merge_queued(self, piece: bytes) -> list[int]:
        """By the rank queue.

        ``after`` and ``before`` link the parts by where they start; ``waits`` holds the rank with which a part and the next
        would merge now: a place whose rank differs from the bucket's is stale. A bucket is one place, or a heap.
        """
        ranks = self.ranks
        get, low, pairs, n = ranks.get, self.low, self.pairs, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waits = [pairs[x][y] for x, y in zip(piece, piece[1:])]
        waits.append(_NONE)
        high, buckets = 0, {}

        def push(rank, place):
            nonlocal high
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = place
                word = rank >> 6
                low[word] |= 1 << (rank & 63)
                high |= 1 << word
            elif held.__class__ is int:
                buckets[rank] = [held, place] if held < place else [place, held]
            else:
                heappush(held, place)

        for place, rank in enumerate(waits):
            if rank != _NONE:
                push(rank, place)
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            held = buckets[rank]
            if held.__class__ is int:
                i, held = held, None
            else:
                i = heappop(held)
            if not held:
                del buckets[rank]
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    high &= high - 1
            if waits[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            waits[j] = _NONE
            if end < n:
                before[end] = i
                waits[i] = new = get(piece[i : after[end]], _NONE)
                if new != _NONE:
                    push(new, i)
            else:
                waits[i] = _NONE
            if i:
                p = before[i]
                waits[p] = new = get(piece[p:end], _NONE)
                if new != _NONE:
                    push(new, p)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text. The pattern always starts a match at the last space before a word, so texts can be cut there: what lies between is looked up whole."""
        out: list[int] = []
        if not text:
            return out
        if _LOOSE(text):
            parts = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))
        fresh, old, get = self.fresh, self.old, self.fresh.get
        for part in parts:
            ids = get(part)
            if ids is None:
                end = None
                if part[-1:] in _ENDS and part[-2:-1].isalpha():  # a match ends where letters do
                    end, part = self.fresh[part[-1]], part[:-1]
                    ids = get(part)
                if ids is None:
                    ids = old.get(part)
                    if ids is None:
                        ids = []
                        for x in self.split(part):
                            ids += self.merge(x.encode())
                    if len(part) <= 64:  # longer ones hardly come again
                        fresh[part] = ids
                        if len(fresh) > KEPT:
                            self.old, self.fresh = fresh, {x: self.merge(x.encode()) for x in _ENDS}
                            fresh, old, get = self.fresh, self.old, self.fresh.get
                if end:
                    out += ids
                    ids = end
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker: what it has encoded serves its later tasks."""
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ``token_ids`` (array of int) for every row; a null or empty text has none."""

    def make():
        bpe = tokenizer(path, pattern)
        return lambda batch: [batch.column("doc_id"), [bpe.encode(x) for x in texts(batch)]]

    return map_batches(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, token_ids array<int>", make)


def decoded(tokens: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ``text`` from ``encoded``'s rows; bytes that aren't UTF-8 become U+FFFD."""

    def make():
        bpe = tokenizer(path, pattern)
        return lambda batch: [batch.column("doc_id"), [bpe.decode(x or []).decode(errors="replace") for x in batch.column("token_ids").to_pylist()]]

    return map_batches(tokens.select("doc_id", "token_ids"), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string", make)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids decoded, without ids leaving the task.

    A null or empty text has no tokens and the digests of nothing; null ids and repeated rows are kept; further columns are
    left aside.
    """

    def make():
        bpe = tokenizer(path, pattern)
        names = [str(x) for x in range(max(bpe.tokens) + 1)]

        def step(batch):
            n, ids_sha, decoded_sha = [], [], []
            for text in texts(batch):
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [batch.column("doc_id"), n, ids_sha, decoded_sha]

        return step

    return map_batches(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op10(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
