"""Chat formatting from event logs: partition by conversation, sort by sequence, fold, render.

An event log has the columns (conv_id, seq, message, role, kind, text). The kinds:

- ``delta``: appends text to the message, which it begins if need be;
- ``edit``: replaces what the message has so far;
- ``regenerate``: empties the message and drops every message that began after it;
- ``delete``: drops the message, until a later event begins it anew.

Messages stand in the order in which they began. Rows are partitioned by conversation and sorted by
sequence by Spark; each task folds its sorted stream event by event, with the state of one
conversation in memory, whatever its number of events.

Defined cases: events of a null conversation are dropped; a null message number, kind or unknown kind
is ignored; a null seq comes first; a null text counts as empty and a null role as the message's
first role, 'user' if it never had one; events alike in seq are ordered by message, kind and text, and
rows repeated whole count once; a conversation whose messages are all gone gives no row; other columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = ("conv_id", "seq", "message", "kind", "text", "role")


class Fold:
    """The state of one conversation."""

    def __init__(self) -> None:
        self.messages: dict[int, list] = {}  # number -> [role, parts]; the order is that of the beginnings

    def apply(self, message: int | None, kind: str | None, text: str | None, role: str | None) -> None:
        if message is None:
            return
        if kind == "delete":
            self.messages.pop(message, None)
            return
        if kind not in ("delta", "edit", "regenerate"):
            return
        now = self.messages.setdefault(message, [role, []])
        now[0] = now[0] or role
        if kind == "delta":
            now[1].append(text or "")
        else:
            now[1] = [text or ""] if kind == "edit" else []
        if kind == "regenerate":
            numbers = list(self.messages)
            for later in numbers[numbers.index(message) + 1 :]:
                del self.messages[later]

    def final(self) -> list[tuple[str, str]]:
        return [(role or "user", "".join(parts)) for role, parts in self.messages.values()]


def render(messages: list[tuple[str, str]]) -> str:
    """The messages in one text: each begins with its role and ends with a marker, both on their line."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in messages)


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, fold, last, ready = None, Fold(), None, []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([c for c, _ in ready], pa.int64()), pa.array([len(m) for _, m in ready], pa.int32()), pa.array([render(m) for _, m in ready], pa.string())]
        ready.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_messages", "chat"])

    for batch in batches:
        for event in zip(*(batch.column(f).to_pylist() for f in _FIELDS)):
            if event == last:
                continue
            last = event
            if event[0] != conv:
                if messages := fold.final():
                    ready.append((conv, messages))
                conv, fold = event[0], Fold()
            fold.apply(*event[2:])
        if len(ready) >= 256:
            yield flush()
    if messages := fold.final():
        ready.append((conv, messages))
    yield flush()


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, chat): a row for each conversation that has messages in the end."""
    kinds = {"conv_id": "long", "seq": "long", "message": "long"}
    rows = events.select(*(F.col(f).cast(kinds.get(f, "string")).alias(f) for f in _FIELDS)).where("conv_id is not null")
    return rows.repartition("conv_id").sortWithinPartitions(*_FIELDS).mapInArrow(_fold_batches, "conv_id long, n_messages int, chat string")


def log_of(turns: DataFrame, chunk: int = 40) -> DataFrame:
    """An event log that ends in the given turns (conv_id, turn, role, text), as a chat service would have written it.

    Texts come in deltas of ``chunk`` characters. Every third turn was first written otherwise and then
    edited before its last delta; every fifth was begun, answered, and regenerated. Turns stand 2^32 apart
    in the sequence, more than any text has deltas; turn numbers are expected within 2^30 either way. Rows
    with a null conv_id, turn or text give no events; other columns are never read.
    """
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("message"), "role", "text").where("conv_id is not null and message is not null and text is not null")
    t = t.withColumn("n", F.ceil(F.length("text") / chunk).cast("int")).withColumn("deltas", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.substring("text", (i - 1) * chunk + 1, F.lit(chunk)))).otherwise(F.array(F.lit(""))))
    event = lambda seq, kind, text, message="message", role="role": F.struct(seq.cast("long").alias("seq"), F.col(message).alias("message") if isinstance(message, str) else message.alias("message"), F.lit(kind).alias("kind"), text.alias("text"), F.col(role).alias("role") if isinstance(role, str) else role.alias("role"))
    base = F.col("message") * (1 << 32)
    plain = F.transform("deltas", lambda d, i: event(base + 100 + i, "delta", d))
    edited = F.concat(F.array(event(base + 50, "delta", F.lit("first draft")), event(base + 51, "edit", F.element_at("deltas", 1))), F.transform(F.slice("deltas", 2, F.greatest(F.size("deltas") - 1, F.lit(0))), lambda d, i: event(base + 100 + i, "delta", d)))
    again = F.concat(F.array(event(base + 10, "delta", F.lit("to be thrown away")), event(base + 11, "delta", F.lit("an answer to it"), F.col("message") + (1 << 40), F.lit("user")), event(base + 12, "regenerate", F.lit(""))), plain)
    events = F.when(F.col("message") % 5 == 4, again).when(F.col("message") % 3 == 2, edited).otherwise(plain)
    return t.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
