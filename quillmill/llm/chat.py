"""Chat formatting: conversations as token windows within a budget.

Each turn is rendered with its role and encoded whole by a public byte-level BPE. Prefix sums of
the turns' tokens choose the spans: a window holds the system turn, then at most HISTORY tokens
of the turns before, repeated, then as many new turns as fit BUDGET, all aligned to turns. The
assistant's new turns are the targets; what is repeated is masked, so each assistant token is a
target exactly once over all windows of a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import bound_batches, table
from quillmill.llm.tokens import TOKENIZER, encoder

BUDGET, HISTORY = 1024, 256
#: The share of a window that a system turn leaves to the others, at least: one part in so many.
ROOM = 16
TARGET, SYSTEM = "assistant", "system"


def render(role: str | None, text: str | None) -> str:
    return f"<|{role or 'unknown'}|>\n{text or ''}\n<|end|>\n"


@dataclass
class Window:
    """Turns first..end are new; history..first are repeated. part: the tokens of an overlong turn, else None."""

    history: int
    first: int
    end: int
    part: tuple[int, int] | None = None


def windows(lengths: list[int], head: int, budget: int, history: int) -> Iterator[Window]:
    """Spans over turns of these token lengths, beside a head of so many tokens; the head is below budget."""
    total = np.r_[0, np.cumsum(lengths)]
    room, a, n = budget - head, 0, len(lengths)
    while a < n:
        if lengths[a] > room:
            for at in range(0, lengths[a], room):
                yield Window(a, a, a + 1, (at, min(at + room, lengths[a])))
            a += 1
            continue
        # As much history as its limit and the next turn's room allow.
        h = int(np.searchsorted(total, total[a] - min(history, room - lengths[a])))
        e = int(np.searchsorted(total, total[h] + room, "right")) - 1
        yield Window(h, a, e)
        a = e


def _format(path: str, budget: int, history: int):
    least = max(1, budget // ROOM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = ["conv_id", "window", "history_turn", "first_turn", "end_turn", "input_ids", "target_starts", "target_lengths"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for b in batches:
            out = []
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                roles = [t["role"] for t in turns]
                ids = enc.encode_ordinary_batch([render(t["role"], t["text"]) for t in turns], num_threads=1)
                head = ids[0][: budget - least] if roles[0] == SYSTEM else []
                cut = len(head) < len(ids[0])  # what a head has no room for goes on as an ordinary turn
                skip = 1 if head and not cut else 0
                body, who = ids[skip:], roles[skip:]
                if head and cut:
                    body[0] = ids[0][len(head) :]
                spans = list(windows([len(t) for t in body], len(head), budget, history)) or [Window(0, 0, 0)]
                for i, w in enumerate(spans):
                    seq, starts, lens = list(head), [], []
                    for t in range(w.history, w.end):
                        piece = body[t] if w.part is None else body[t][w.part[0] : w.part[1]]
                        if t >= w.first and who[t] == TARGET:
                            starts.append(len(seq))
                            lens.append(len(piece))
                        seq += piece
                    out.append((conv, i, w.history + skip, w.first + skip, w.end + skip, seq, starts, lens))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a window of turns (conv_id, turn, role, text, ...).

    conv_id, window (from 0), history_turn, first_turn, end_turn (places in the conversation's
    order: repeated turns, then new ones, end excluded), input_ids, and the targets' starts and
    lengths in them. Turns go by turn (null last), then role and text. Defined results: a null
    role is "unknown" and no target; a null text is empty; repeated rows are turns each; a turn
    beyond the room of a window is cut into windows of its own, in full; a leading system turn
    heads every window, whole if it leaves a 16th of the window (ROOM), else its beginning of that length does
    and the rest of it follows once as an ordinary turn, in full; a conversation of a system turn alone has one window, without targets, or those of the rest;
    rows of a null conv_id have no conversation in common, so each is one of its own; an empty table gives an empty
    result; other columns play no part.
    """
    if budget < 2 or history < 0:
        raise ValueError("the budget must hold a token of head and body each")
    t = F.struct(F.col("turn").isNull().alias("n"), "turn", "role", "text")
    rows = bound_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), t.alias("t"))
    convs = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))).select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    schema = "conv_id long, window int, history_turn int, first_turn int, end_turn int, input_ids array<int>, target_starts array<int>, target_lengths array<int>"
    return convs.mapInArrow(_format(tokenizer, budget, history), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
