"""Packing documents into sequences of a fixed number of tokens: best-two-fit over the histogram of lengths.

A document is its tokens and a closing one. One of more tokens than a sequence has is cut into whole sequences, its first piece
being what is left over. Pieces of one length are interchangeable, so the packing is decided on the number of pieces of each
length, at most ``capacity`` numbers however many documents there are:

* a sequence is filled greedily with the longest pieces that fit;
* if some room is left, its shortest piece gives way to the two unpacked pieces, together longer, that fill the room best;
* the filling so found is a pattern, used as often as the counts of its lengths allow.

A few thousand patterns cover everything. Pieces are numbered within their length, and a pattern takes runs of consecutive
numbers, so each piece finds its sequence and offset by looking its number up. The numbering splits every length into hash
buckets, so a very common length is no single task's work; texts and tokens are never shuffled to pack them.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.byte_bpe import _CUT, _LOOSE
from tallyhouse.llm.common import Scratch, table

#: Parts of a text that a worker keeps encoded, in each of two generations, and their characters at most.
KEPT, KEPT_CHARS = 300_000, 64
#: Buckets in which the pieces of one length are numbered.
BUCKETS = 512


#: Characters on whose classes all libraries agree: parts of these alone are split here, others by the library itself.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
#: A word, marks behind it and one more word on the next line: what most new parts are. Each piece is a match of the pattern.
_SHAPE = re.compile(rf"( ?{_LETTERS})([!-&(-/:-@\[-`{{-~]*)(?:\n({_LETTERS}))?").fullmatch
_PLAIN = re.compile(r"[\t-\r -~\u00a1-\u052f]*").fullmatch


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as themselves, the others as the characters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(others)}


class DocumentTokens:
    """The library's ids of whole texts, as little-endian 32-bit words.

    The pattern of byte-level vocabularies starts a match at the last space before a word, so texts are cut there, and parts seen
    before are looked up. A part that wasn't is split by the pattern, and only pre-tokens that are new go to the library's
    model, each once. Parts with characters on which libraries may differ, texts that hold an added token's string, and texts
    for a vocabulary of another kind go to the library as they are.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as said:
            said = json.load(said)
        before = said.get("pre_tokenizer") or {}
        self.cuts = said["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not said.get("normalizer")
        self.split, self.letters = regex.compile(pattern).findall, byte_letters()
        self.tokenize, self.space = self.library.model.tokenize, chr(self.letters[32])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def pre_token(self, word: str) -> bytes:
        """A match of the pattern: looked up, or by the library's model."""
        if (out := self.fresh.get(word)) is not None:
            return out
        if (out := self.old.get(word)) is None:
            shown = word.replace(" ", self.space) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.tokenize(shown)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:  # longer ones hardly come again
            self.fresh[word] = out
        return out

    def part(self, x: str) -> bytes:
        """A part that isn't known yet."""
        if (out := self.old.get(x)) is not None:
            self.fresh[x] = out
            return out
        if shape := _SHAPE(x):
            word, marks, below = shape.groups()
            out = self.pre_token(word)
            if marks:
                out += self.pre_token(marks)
            if below:
                return out + self.pre_token("\n") + self.pre_token(below)
        elif _PLAIN(x):
            return b"".join(map(self.pre_token, self.split(x)))
        else:
            out = self.whole(x)
        if len(x) <= KEPT_CHARS:
            self.fresh[x] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(x in text for x in self.added):
            return self.whole(text)
        if _LOOSE(text):
            parts = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))
        get = self.fresh.get
        found = list(map(get, parts))
        if None in found:
            for k in [k for k, ids in enumerate(found) if ids is None]:
                ids = get(parts[k])
                found[k] = self.part(parts[k]) if ids is None else ids
            if len(self.fresh) > KEPT:
                self.old, self.fresh = self.fresh, {}
        return b"".join(found)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> DocumentTokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
    return DocumentTokens(path, public_tokenizers.PATTERN)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, closing: int = 0, keep_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and token_ids, if kept): the pieces of every row, in order.

    A null or empty text is its closing token alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["token_ids"] if keep_tokens else [])]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * keep_tokens
    end = np.array([closing], "<u4").tobytes()

    def run(batches):
        encode = tokens_of(tokenizer_file).encode
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for number, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * at : 4 * to]
                    row.append(k), piece.append(number), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                    if keep_tokens:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_tokens:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fits(have: np.ndarray) -> np.ndarray:
    """For each room, the longest length of which there is a piece and that fits; 0 if none does."""
    return np.maximum.accumulate(np.where(have > 0, np.arange(len(have)), 0))


def _fill(have: np.ndarray, room: int) -> list[int]:
    """The longest pieces that fit, one after the other."""
    have, out = have.copy(), []
    while (x := int(_fits(have[: room + 1])[-1])) > 0:
        take = min(int(have[x]), room // x)
        out += [x] * take
        have[x] -= take
        room -= take * x
    return out


def _two_for(have: np.ndarray, shortest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces that together are longer than ``shortest`` and fill ``room``, which has its place too, best; the more alike pair at a tie."""
    best = _fits(have)
    x = np.flatnonzero(have[:room])  # the longer of the two
    other = np.minimum(x, room - x)
    y = best[np.maximum(other, 0)]
    twice = (y == x) & (have[x] < 2)
    y = np.where(twice, best[np.maximum(x - 1, 0)], y)
    total = np.where((y > 0) & (x > 0), x + y, 0)
    if not len(total) or (k := int(total.argmax())) < 0 or total[k] <= shortest:
        return None
    return int(x[k]), int(y[k])


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: pieces of it in one sequence}) until every piece is packed."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out = []
    while have.any():
        greedy = _fill(have, capacity)
        used = dict(zip(*(x.tolist() for x in np.unique(greedy, return_counts=True))))
        room = capacity - sum(greedy)
        drawn = dict(used)  # what must be there for the same choice to be made again, more of a length than is used or not
        if room and len(greedy) > 1:
            left = have.copy()
            for x, n in used.items():
                left[x] -= n
            if pair := _two_for(left, greedy[-1], room + greedy[-1]):
                used[greedy[-1]] -= 1
                for x in pair:
                    used[x] = used.get(x, 0) + 1
                used = {x: n for x, n in used.items() if n}
                drawn = {x: max(used.get(x, 0), drawn.get(x, 0)) for x in {*used, *drawn}}
        times = min((int(have[x]) - drawn[x]) // n + 1 for x, n in used.items())
        out.append((times, used))
        for x, n in used.items():
            have[x] -= times * n
    return out


def runs(found: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Runs of numbers within a length, by (length, first number): length, first number, first sequence, pieces in each sequence, place of the first."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in found:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += n * length
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5


def packed(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, closing: int = 0, keep_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and token_ids, if kept) for every piece of every row.

    Sequences are numbered from 0 without gaps, and so are the places in each. A null or empty text is a piece of its closing
    token; each row is a document of its own, null and repeated ids too; further columns are left aside; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession)
    bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(BUCKETS)).cast("int")
    rows = pieces(docs, tokenizer_file, capacity, closing, keep_tokens)
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", bucket), "pieces")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    length, first, sequence, each, place = runs(patterns(total, capacity))
    keys = length * (1 << 44) + first
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    numbered = rows.withColumn("at", inside).join(starts, ["length", "bucket"]).withColumn("at", F.col("at") + F.col("before") - 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["token_ids"] if keep_tokens else [])]

    def put(batches):
        for batch in batches:
            n, at = (batch.column(c).to_numpy() for c in ("length", "at"))
            k = np.searchsorted(keys, n * (1 << 44) + at, side="right") - 1
            over, rank = np.divmod(at - first[k], each[k])
            new = [pa.array(sequence[k] + over), pa.array(place[k] + rank * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.select(*columns).schema)
    return numbered.select(*columns, "at").mapInArrow(put, schema + ", sequence_id long, offset long")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, token_ids and documents (array of doc_id, piece, offset, length) of rows of ``packed`` that kept their tokens; a sequence's rows are its capacity at most."""
    part = F.struct("offset", "doc_id", "piece", "length", "token_ids")
    whole = packed_pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    spans = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return whole.select("sequence_id", F.flatten(F.col("parts.token_ids")).alias("token_ids"), spans.alias("documents"))


def op12(spark, sf_dir: str) -> DataFrame:
    rows = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
