"""Conversations from event logs, formatted with a turn template and a loss mask.

A log holds ``conv_id, turn, seq, event, role, text``. ``turn`` is the place of a message
in its conversation, ``seq`` the order of events of that message: ``message`` starts a
message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` starts its
text over. Events that come without a start make a message of their own. The log is
partitioned by conversation and turn, so that a conversation with most of the rows is
still folded by many tasks, sorted, and folded with one message in memory.

Every message is rendered as ``<turn>### role: text</turn>`` and a line feed. A backslash
or a control string within a text gets a backslash in front, and so does a colon within a
role; ``read_back`` takes that away again. The loss mask covers the escaped text of
``assistant`` messages.

NULL text, role or event count as empty text, empty role and ``message``. NULL ids form
one conversation, NULL turns come first. Events of one place and sequence number come in
the order message, regenerate, edit, delta, any other, then by role and text; repeated
messages stay repeated. Extra columns are left out. A text of any
length is one message; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

# The template's control strings.
OPEN, HEAD, CLOSE = "<turn>", "### ", "</turn>"
_CONTROLS = re.compile(r"\\|<turn>|</turn>|### ")
_ROLE_CONTROLS = re.compile(r"\\|<turn>|</turn>|### |:")
_ESCAPED = re.compile(r"\\(\\|<turn>|</turn>|### |:)")
LEARNED = "assistant"
# The events of a log, in the order in which those of one sequence number are taken.
EVENTS = ("message", "regenerate", "edit", "delta")
DELTAS, SHORTEST = 12, 40  # most deltas that a table's text is streamed in, and least characters of each


def escape(text: str, controls: re.Pattern = _CONTROLS) -> str:
    return controls.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """A message in the template, and where its loss mask begins and ends."""
    head = f"{OPEN}{HEAD}{escape(role, _ROLE_CONTROLS)}: "
    body = escape(text)
    begin, end = (len(head), len(head) + len(body)) if role == LEARNED else (None, None)
    return f"{head}{body}{CLOSE}\n", begin, end


_RENDERED = re.compile(r"<turn>### ((?:[^\\:]|\\.)*?): (.*)</turn>\n", re.DOTALL)


def read_back(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    found = _RENDERED.fullmatch(rendered)
    if found is None:
        raise ValueError("not a rendered message")
    return unescape(found[1]), unescape(found[2])


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events to messages ``(conv_id, turn, part, role, text)``."""
    place, part, role, texts = None, 0, "", []
    for conv, turn, event, by, text in rows:
        event, by, text = event or "message", by or "", text or ""
        if place != (conv, turn) or event == "message":
            if place is not None:
                yield (*place, part, role, "".join(texts))
            part = part + 1 if place == (conv, turn) else 0
            place, role, texts = (conv, turn), by, []
        if event in ("edit", "regenerate"):
            texts = []
        role = by or role
        texts.append(text)
    if place is not None:
        yield (*place, part, role, "".join(texts))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, str))
        if weight > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def formatted(log: DataFrame) -> DataFrame:
    """Rendered messages ``conv_id, turn, part, rendered, loss_begin, loss_end`` of an event log."""
    named = [F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), *[F.col(c).cast("string") for c in ("event", "role", "text")]]
    events = log.select(*named, F.col("seq").cast("bigint").alias("seq"))
    named_event = F.coalesce("event", F.lit(EVENTS[0]))
    order = F.coalesce(*[F.when(named_event == e, k) for k, e in enumerate(EVENTS)], F.lit(len(EVENTS)))
    events = events.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", order, "role", "text").drop("seq")
    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("rendered", pa.string()), ("loss_begin", pa.int64()), ("loss_end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = _fold(_values(batches))
        return _batches(((conv, turn, part, *render(role, text)) for conv, turn, part, role, text in messages), pa.schema(fields))

    return map_batches(events, run, "conv_id bigint, turn bigint, part bigint, rendered string, loss_begin bigint, loss_end bigint")


def as_log(conversations: DataFrame) -> DataFrame:
    """A table of whole messages ``(conv_id, turn, role, text)`` as the log of how they could have been written.

    By a checksum of its place a message is one event, or a start that is streamed in deltas,
    or a draft that an edit or a regeneration replaces before the rest is streamed. Messages of
    one place follow each other by role and text; extra columns are left out.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 4).alias("way"))
    ordinal = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    wide = F.greatest(F.lit(SHORTEST), F.ceil(F.length("text") / DELTAS)).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.col("wide")), lambda at: F.substring(F.col("text"), at, F.col("wide")))

    def event(name: str, said: Column, by: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("event"), (F.lit(None).cast("string") if by is None else by).alias("role"), said.alias("text"))

    first, deltas = F.element_at("pieces", 1), F.transform(F.slice("pieces", 2, DELTAS), lambda x: event("delta", x))
    draft = F.array(event("message", F.reverse(first), F.col("role")), event("delta", F.lit("draft")))
    events = (
        F.when(F.col("way") == 0, F.array(event("message", F.col("text"), F.col("role"))))
        .when(F.col("way") == 1, F.concat(F.array(event("message", first, F.col("role"))), deltas))
        .when(F.col("way") == 2, F.concat(draft, F.array(event("edit", first)), deltas))
        .otherwise(F.concat(draft, F.array(event("regenerate", F.lit(None).cast("string")), event("delta", first)), deltas))
    )
    cut = rows.withColumns({"ordinal": ordinal.cast("bigint"), "wide": wide}).withColumn("pieces", pieces)
    told = cut.select("conv_id", "turn", "ordinal", F.posexplode(events).alias("step", "told"))
    return told.select("conv_id", "turn", (F.col("ordinal") * (2 * DELTAS) + F.col("step")).alias("seq"), "told.event", "told.role", "told.text")


def digests(messages: DataFrame) -> DataFrame:
    """What reads back from rendered messages, per conversation; digests grow message by message."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, started, turns, loss, n, learned, chars = None, False, None, None, 0, 0, 0
        for conv, rendered, begin, end in rows:
            if not started or conv != current:
                if started:
                    yield current, n, turns.hexdigest(), learned, loss.hexdigest(), chars
                current, started, turns, loss, n, learned, chars = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = read_back(rendered)
            turns.update(f"{role}\n{text}\n".encode())
            n, chars = n + 1, chars + len(rendered)
            if begin is not None:
                under = unescape(rendered[begin:end])
                learned += len(under)
                loss.update(under.encode())
        if started:
            yield current, n, turns.hexdigest(), learned, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(summed(_values(batches)), pa.schema(fields))

    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_batches(ordered.select("conv_id", "rendered", "loss_begin", "loss_end"), run, schema)
