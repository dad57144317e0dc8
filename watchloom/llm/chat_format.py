"""Chat logs as events, folded to final messages and rendered with a reversible template.

The log has one row per event: conversation, message, ``seq`` and a kind. A ``delta`` appends its text to the
message, an ``edit`` replaces the text so far, a ``regenerate`` discards it and starts again with its own text. The
log is partitioned by conversation, sorted by message and sequence and folded in one streaming pass, which
holds one message at a time, however long a conversation is. Rows of one message share its key (turn,
role, tie); messages are ordered by turn (null first), role, tie. A null role or text counts as empty; an event of
an unknown kind counts as a delta. Messages without a conversation id are one conversation. Rows that repeat are messages each, a message may be of any
length, other columns play no part, and an empty table gives no rows.

Template of a message: ``<|turn|>role<|says|>text<|end|>`` and a line feed. Every control string in a
role or text, one of the template's own or of other common ones, gets a backslash behind its first
character; where backslashes stand there already, one more is added. So the text is read back exactly. The loss
mask covers the text between ``<|says|>`` and ``<|end|>`` of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's marks, and what is escaped in texts.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?INST\]|/?s>|/?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?INST\]|/?s>|/?SYS>>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted message, and where its text starts and ends in it."""
    head = f"{TURN}{escape(role)}{SAYS}"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    if not piece.startswith(TURN) or not piece.endswith(END + "\n"):
        raise ValueError("not a formatted message")
    role, text = piece[len(TURN) : -len(END) - 1].split(SAYS)
    return unescape(role), unescape(text)


def events_from_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log in which each finished message arrives in two deltas."""
    body = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(body) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("delta").alias("kind"), F.substring(body, F.lit(1), half).alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.substring(body, half + 1, F.length(body)).alias("text")),
    )
    keyed = messages.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.concat(F.md5(body), F.format_string("%020d", F.monotonically_increasing_id())).alias("tie"), parts.alias("e"),
    )
    return keyed.select("conv_id", "turn", "role", "tie", F.explode("e").alias("e")).select("conv_id", "turn", "role", "tie", "e.seq", "e.kind", "e.text")


def format_messages(events: DataFrame) -> DataFrame:
    """``conv_id, place, formatted, loss_start, loss_end`` per message: a conversation is its pieces in order.

    The loss span is null for messages that the model doesn't learn. Pieces of a conversation
    come in order within a partition.
    """
    log = events.select("conv_id", "turn", "role", "tie", "seq", "kind", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie", "seq")
    schema = "conv_id long, place long, formatted string, loss_start int, loss_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text, place = None, [], -1
        out: list[tuple] = []

        def close() -> None:
            piece, start, end = render(key[2], "".join(text))
            learn = key[2] == "assistant"
            out.append((key[0], place, piece, start if learn else None, end if learn else None))

        for batch in batches:
            for conv, turn, role, tie, _, kind, part in zip(*(c.to_pylist() for c in batch.columns)):
                now = (conv, turn, role or "", tie)
                if now != key:
                    if key is not None:
                        close()
                    place = place + 1 if key is not None and key[0] == conv else 0
                    key, text = now, []
                if kind in ("edit", "regenerate"):
                    text.clear()
                text.append(part or "")
            yield _rows(out)
            out.clear()
        if key is not None:
            close()
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["conv_id", "place", "formatted", "loss_start", "loss_end"])

    return log.mapInArrow(run, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted pieces alone; a partition holds conversations whole and in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        out: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, whole = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole))

        for batch in batches:
            for conv, place, piece, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(piece[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(piece)
            yield _rows(out)
            out.clear()
        if state is not None:
            close()
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return pieces.mapInArrow(run, schema)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
