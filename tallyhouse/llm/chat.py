"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens. Windows are aligned with turns: prefix sums of the
turns' tokens say how many new turns fit behind the system turn, which every window keeps, and behind the last turns of
the window before, repeated within ``history`` tokens. Only new assistant texts are under the loss mask, so each is
learned once. A turn that alone passes the budget gets a window of its own, whole.

Template: ``<<SYS>> text <</SYS>>`` system, ``[INST] text [/INST]`` user, ``<s> text </s>`` assistant, and
``<|role|> text <|end|>`` for any other role, one after another with a line break between. Inside texts every backslash
is doubled and every control string gets a backslash after its first character, so none occurs there, and both undo.

Turns of a conversation are brought together by a sort, not in memory: tasks read them in order and hold one window at a
time, however long the conversation is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import table

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = re.compile(r"\\|<</?SYS>>|\[/?INST\]|</?s>|<\|")
_UNDO = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<<SYS>> (?P<system>.*?) <</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|<\|(?P<role>.*?)\|> (?P<other>.*?) <\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its escaped text starts."""
    if role in MARKS:
        first, last = MARKS[role]
    else:
        first, last = f"<|{escape(role).replace('|>', '|\\>')}|>", "<|end|>"
    return f"{first} {escape(text)} {last}", len(first) + 1


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the escaped text lies, of each turn of a window."""
    out = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        out.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind]), m.start(kind), m.end(kind)))
    return out


@lru_cache(maxsize=2)
def turn_counter(path: str, pattern: str):
    """Tokens of a formatted turn, by the ranks in a file."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(library.encode_ordinary(text))


def windows(turns: Iterator[tuple[str, str]], count, budget: int, history: int) -> Iterator[dict]:
    """The windows of one conversation's turns, holding those of one window at a time.

    The system turn is the first turn, if its role is system; longer than half the budget, it isn't repeated.
    """
    system: tuple | None = None
    pending: list[tuple[str, str, int, int]] = []  # rendered, role, where the text starts, tokens
    past: list[tuple] = []
    number, turn = 0, 0
    prefix = [0]

    def close(n: int) -> dict:
        nonlocal number, past, pending, turn, prefix
        new, kept = pending[:n], [*([system] if system and turn else []), *past]
        text, at, loss = [], 0, []
        for k, (rendered, role, start, _) in enumerate(kept + new):
            if k >= len(kept) and role == "assistant":
                loss.append({"start": at + start, "end": at + len(rendered) - len(MARKS[role][1]) - 1})
            text.append(rendered)
            at += len(rendered) + 1
        out = {"window": number, "first_turn": turn, "n_new": n, "n_repeated": len(kept), "n_tokens": sum(x[3] for x in kept + new), "formatted": "\n".join(text), "loss": loss}
        number, turn = number + 1, turn + n
        past, held = [], 0
        for x in reversed(new):
            held += x[3]
            if held > history or x is system:
                break
            past.insert(0, x)
        pending = pending[n:]
        prefix = [0]
        for x in pending:
            prefix.append(prefix[-1] + x[3])
        return out

    def fitting() -> int:
        """New turns that fit behind what is kept; history goes first if not even one does."""
        nonlocal past
        room = budget - sum(x[3] for x in past) - (system[3] if system and turn else 0)
        n = bisect_right(prefix, room) - 1
        if n < 1 and past:
            past = []
            return fitting()
        return max(n, 1)

    for role, text in turns:
        rendered, start = render(role, text)
        tokens = count(rendered) + 1
        pending.append((rendered, role, start, tokens))
        prefix.append(prefix[-1] + tokens)
        if not turn and len(pending) == 1 and role == "system" and tokens <= budget // 2:
            system = pending[0]
        while pending and (n := fitting()) < len(pending):
            yield close(n)
    while pending:
        yield close(fitting())


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, in order; ties by role, then text. A null role or text counts as an empty one."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Each conversation and an iterator of its turns, read as they come."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, ((role, text) for _, role, text in group)


WINDOW = "conv_id long, window int, first_turn long, n_new int, n_repeated int, n_tokens long, formatted string, loss array<struct<start:int,end:int>>"


def format_windows(conversations: DataFrame, tokens_path: str, pattern: str = public_tokenizers.PATTERN, budget: int = 2048, history: int = 256) -> DataFrame:
    """One row for each window: its formatted text, loss spans in it (code points), and which turns are new.

    All turns take part, with null ids as one conversation; repeated rows are turns of their own; further columns are left
    aside; an empty table gives no windows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    arrow = to_arrow_schema(T._parse_datatype_string(WINDOW))

    def run(batches):
        count, rows, held = turn_counter(tokens_path, pattern), [], 0
        for key, turns in _conversations(batches):
            for w in windows(turns, count, budget, history):
                rows.append({"conv_id": key} | w)
                held += len(w["formatted"])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return _ordered(conversations).mapInArrow(run, WINDOW)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, from their text and spans alone: digests of the new turns and of all text under the loss mask."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    arrow = to_arrow_schema(T._parse_datatype_string(READ))

    def run(batches):
        state, rows = None, []

        def done():
            key, n, turns, chars, loss, size, count = state
            rows.append([key, n, turns.hexdigest(), chars, loss.hexdigest(), size, count])

        for batch in batches:
            for w in batch.to_pylist():
                if state is None or state[0] != w["conv_id"]:
                    if state:
                        done()
                    state = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(w["formatted"])[w["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["formatted"][span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(w["formatted"])
                state[6] += 1
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if state:
            done()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return formatted.mapInArrow(run, READ)


def op4(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7. The windows of a conversation lie in one partition in order, so reading back needs no further shuffle."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_windows(own.unionByName(more), public_tokenizers.path("byte_bpe_50k.tiktoken")))
