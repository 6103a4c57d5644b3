"""Chat formatting from an event log.

The log has a row for each event of a conversation: ``start`` opens a message, ``delta`` appends to it, ``edit`` replaces its
text, ``regenerate`` clears it so that later deltas write it anew. Events are dealt out by conversation, sorted by message
and sequence, and folded as they stream by: a task holds one message at a time, never a conversation, so a conversation
with a third of all rows needs no more memory than any other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import arrow_batch, arrow_rows, save
from callweave.session import ship_package

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"  # the role whose text is under the loss mask
LOG = "conv_id long, msg long, seq long, op string, role string, text string"
PARTS = "conv_id bigint, part bigint, formatted string, loss_start bigint, loss_end bigint"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
BATCH_CHARS = 1 << 22  # characters of formatted text handed on at a time

#: In texts and roles ``\`` is written twice and a bar after ``<`` gets one before it, so no control string is left.
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_as_log(turns: DataFrame) -> DataFrame:
    """A table of finished turns (``conv_id, turn, role, text``) as a log of ``start`` events."""
    return turns.select(
        "conv_id", F.col("turn").alias("msg"), F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("op"), "role", "text"
    )


def turns_as_streamed(turns: DataFrame, piece: int = 120) -> DataFrame:
    """A log that ends in the given turns, as a service that streams its answers would have written it.

    By a hash of conversation and turn, a message is written at once, streamed in pieces of ``piece`` characters, written with an
    error and edited, or streamed, given up and regenerated. Where several rows share conversation and turn, which of them an
    event belongs to could not be told, so these are written at once.
    """
    key = ["conv_id", "turn"]
    shared = save(turns.groupBy(*key).count().where("count > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "shared")
    whole = F.lit(False)
    if shared.take(1):
        same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        turns = turns.join(shared.withColumn("is_shared", F.lit(True)).hint("merge"), same, "left")
        whole = F.col("is_shared").isNotNull()
    text = F.coalesce("text", F.lit(""))
    event = lambda op, said: F.struct(F.lit(op).alias("op"), said.alias("text"))
    cuts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(piece))
    deltas = F.transform(cuts, lambda at: event("delta", F.substring(text, at + 1, F.lit(piece))))
    wrong = F.concat(F.reverse(F.substring(text, 1, piece)), F.lit("<|im_end|> \u2026"))
    empty, way = F.lit(""), F.pmod(F.xxhash64(*key), F.lit(4))
    events = (
        F.when(whole | (way == 0), F.array(event("start", text)))
        .when(way == 1, F.concat(F.array(event("start", empty)), deltas))
        .when(way == 2, F.array(event("start", wrong), event("delta", wrong), event("edit", text)))
        .otherwise(F.concat(F.array(event("start", empty), event("delta", wrong), event("regenerate", empty)), deltas))
    )
    told = turns.select("conv_id", F.col("turn").alias("msg"), "role", F.posexplode(events).alias("seq", "event"))
    return told.select("conv_id", "msg", F.col("seq").cast("bigint").alias("seq"), "event.op", "role", "event.text")


def format_conversations(log: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_start, loss_end``: a row for each final message, in order within a conversation.

    A conversation's text is its parts joined by ``part``; the loss mask is a span of code points of the part, null where
    nothing is learned. ``log`` has the columns of ``LOG``; others are ignored. Events of one message are applied by ``seq``; each
    ``start`` opens a message of its own, so two starts with one ``msg`` are two messages. Events that agree in ``msg`` and
    ``seq`` are ordered by op, role and text, nulls first. An event for a message that was not opened opens it with the
    role of the event. An unknown op is ignored. A null text is empty, a null role is empty, a null ``msg`` comes first, and
    all rows with a null ``conv_id`` are one conversation. An empty log gives no rows.
    """
    ship_package(log.sparkSession)
    start_first = F.col("op") != "start"
    order = ["conv_id", "msg", "seq", start_first, "op", "role", "text"]
    dealt = log.select([f.split()[0] for f in LOG.split(", ")]).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_format_batches, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of whole conversations, taken from what ``format_conversations`` returned, row by row in its order."""
    return parts.mapInArrow(_digest_batches, DIGEST)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, message, part, out, size = object(), None, 0, [], 0

    def close() -> None:
        nonlocal message, part, size
        if message is not None:
            out.append((conv, part, *render(message[1], "".join(message[2]))))
            size += len(out[-1][2])
            message, part = None, part + 1

    for conv_id, msg, _, op, role, text in arrow_rows(batches):
        if conv_id != conv:
            close()
            conv, part = conv_id, 0
        if op == "start" or message is None or message[0] != msg:
            if op not in ("start", "delta", "edit", "regenerate"):
                continue
            close()
            message = (msg, role or "", [])
        if op == "edit" or op == "regenerate":
            message[2].clear()
        if op in ("start", "delta", "edit"):
            message[2].append(text or "")
        if size > BATCH_CHARS:
            yield arrow_batch(out, PARTS)
            out, size = [], 0
    close()
    if out:
        yield arrow_batch(out, PARTS)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """One message in the template, and the span of its text if it is learned."""
    body = escape(text)
    # a newline in a role would end it early
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    span = (len(head), len(head) + len(body)) if role == LEARNED else (None, None)
    return f"{head}{body}{END}\n", *span


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered message."""
    if not formatted.startswith(START) or not formatted.endswith(END + "\n"):
        raise ValueError("not a rendered message")
    inner = formatted[len(START) : -len(END) - 1]
    head = re.match(r"(?:[^\\\n]|\\.)*\n", inner, re.DOTALL)
    return unescape(head[0][:-1]), unescape(inner[head.end() :])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, out = object(), None, []

    def close() -> None:
        if state is not None:
            n, turns, chars, loss, total = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    for conv_id, _, formatted, start, end in arrow_rows(batches):
        if conv_id != conv:
            close()
            conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if len(out) >= 4096:
                yield arrow_batch(out, DIGEST)
                out = []
        role, text = parse(formatted)
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode())
        if start is not None:
            learned = unescape(formatted[start:end])
            state[2] += len(learned)
            state[3].update(learned.encode())
        state[4] += len(formatted)
    close()
    if out:
        yield arrow_batch(out, DIGEST)
