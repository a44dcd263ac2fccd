"""Chat formatting in budgeted windows.

A conversation's turns are written with markers; control strings inside roles
and texts are escaped reversibly. Prefix sums of the turns' tokens choose spans
that end at turns: a window holds the system turn, as much of the history before
its span as a limit allows, and the turns of its span while they fit the budget.
The loss mask covers assistant texts of the span; system turns and history are
repeated for context only, so each target counts once.

Rows are dealt by conversation and sorted by turn; each task streams its
conversations turn by turn and holds at most one window and the history, so a
very long conversation takes no more memory than a short one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table, tune
from .encoding import encoder

BUDGET = 1024
HISTORY = 256
#: Control strings of the template and what stands for them, after a backslash, inside roles and texts.
CONTROLS = {"<s>": "o", "</s>": "c", "[INST]": "i", "[/INST]": "j", "<<SYS>>": "a", "<</SYS>>": "z"}
_ESCAPED = re.compile("|".join(re.escape(c) for c in ["\\", *CONTROLS]))
_MARKS = {"\\": "\\", **{v: k for k, v in CONTROLS.items()}}
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)

SCHEMA = "conv_id long, window int, text string, first_turn int, last_turn int, history_turns int, system boolean, tokens int, loss array<struct<start:int,end:int>>, over_budget boolean"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + ("\\" if m[0] == "\\" else CONTROLS[m[0]]), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _MARKS[m[1]], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The marked turn and where its text begins."""
    head = f"<s>[INST]{escape(role)}[/INST]"
    return f"{head}{escape(text)}</s>", len(head)


def parse(window: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(window)]


class Windows:
    """Cuts one conversation's turns, fed in order, into windows."""

    def __init__(self, conv_id, budget: int, history: int, count: Callable[[str], int]):
        self.conv_id, self.budget, self.limit, self.count = conv_id, budget, history, count
        self.system: tuple[str, int] | None = None
        self.history: list[tuple[str, int]] = []  # (marked turn, tokens) before the span
        self.span: list[tuple[str, int, int, bool, int]] = []  # (marked, start of the text, tokens, is a target, turn number)
        self.prefix = [0]  # sums of the span's tokens
        self.window = self.turn = 0

    def add(self, role: str, text: str) -> list[tuple]:
        marked, start = format_turn(role, text)
        tokens = self.count(marked)
        out = []
        repeated = self.system[1] if self.system and self.span and self.span[0][4] > 0 else 0  # the first span holds the system turn itself
        room = self.budget - repeated - sum(n for _, n in self.history)
        # The span ends before the turn that would pass the room; a lone turn of more tokens is a window over the budget.
        if self.span and bisect_right(self.prefix, room - tokens) < len(self.prefix):
            out.append(self.close())
        while not self.span and self.history and tokens + (self.system[1] if self.system else 0) + sum(n for _, n in self.history) > self.budget:
            self.history.pop(0)  # the oldest gives way to the turn that opens the span
        self.span.append((marked, start, tokens, role == "assistant", self.turn))
        self.prefix.append(self.prefix[-1] + tokens)
        if role == "system" and self.turn == 0:
            self.system = (marked, tokens)
        self.turn += 1
        return out

    def close(self) -> tuple:
        first = self.span[0][4]
        repeat_system = self.system is not None and first > 0
        parts = ([self.system[0]] if repeat_system else []) + [m for m, _ in self.history]
        at, loss = sum(map(len, parts)), []
        for marked, start, _, target, _ in self.span:
            if target:
                loss.append({"start": at + start, "end": at + len(marked) - len("</s>")})
            at += len(marked)
        tokens = (self.system[1] if repeat_system else 0) + sum(n for _, n in self.history) + self.prefix[-1]
        row = (self.conv_id, self.window, "".join(parts) + "".join(s[0] for s in self.span), first, self.span[-1][4], len(self.history), repeat_system, tokens, loss, tokens > self.budget)
        # The last turns of what came before, while they fit the history's limit, and leave half the budget.
        recent, left = [], min(self.limit, self.budget // 2)
        for marked, n in [(s[0], s[2]) for s in reversed(self.span) if not (s[4] == 0 and self.system)] + list(reversed(self.history)):
            if n > left:
                break
            recent.append((marked, n))
            left -= n
        self.history = recent[::-1]
        self.span, self.prefix = [], [0]
        self.window += 1
        return row


def format_chat(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """turns: ``conv_id, turn, role, text`` → one row for each window, in order within a conversation:
    its ``text``, the turns of its span, how many turns of history and whether the
    system turn is repeated, ``tokens``, and ``loss``: the spans (code points) of
    the targets, escaped as they stand.

    A null text or role is an empty one; rows of a null conv_id are one
    conversation. Turns come by number (null first), then role, then text; rows
    that repeat a number are turns each. The system turn is a first turn of that
    role. A turn that with the system turn is over the budget is a
    window of its own, marked over_budget, never cut. ``tokens`` are those of
    the window's marked turns, each encoded by itself. Very long texts and
    conversations are streamed turn by turn. Other columns are not read, so their
    names can't clash; an empty table gives no rows.
    """
    tune(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)

        def count(marked: str) -> int:
            return len(encode.raw(marked)) // 4

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), _LOSS, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "window", "text", "first_turn", "last_turn", "history_turns", "system", "tokens", "loss", "over_budget"])

        now, rows = None, []
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        rows.append(now.close())
                    now = Windows(conv_id, budget, history, count)
                rows += now.add(role, text)
            if rows:
                yield pack(rows)
                rows = []
        if now is not None:
            yield pack([now.close()])

    empty = F.lit("")
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lean(run), SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """For each conversation, from its windows' texts alone: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``. Needs the windows in order, as ``format_chat`` returns them; streams them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # conv_id, turns, digest of turns, characters and digest of the loss, formatted characters

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([state[0]], pa.int64()), "n_turns": [state[1]], "turns_sha256": [state[2].hexdigest()], "loss_chars": [state[3]], "loss_sha256": [state[4].hexdigest()], "formatted_chars": [state[5]]})

        for batch in batches:
            for conv_id, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != state[0]:
                    if state is not None:
                        yield done()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "replace"))
                state[5] += len(text)
        if state is not None:
            yield done()

    chosen = windows.select("conv_id", "text", (F.col("history_turns") + F.col("system").cast("int")).alias("repeated"), "loss")
    return chosen.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


#: None: digests over all turns of a conversation could be SQL, but ``formatted_chars`` depends on the windows, which only the tokenizer's counts decide.
ORACLE_SQL = None
