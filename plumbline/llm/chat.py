"""Training text from chat logs: conversations are rebuilt from events, then rendered with a loss mask.

An event is ``(conv_id, seq, kind, message_id, role, text)``:

* ``message`` opens a message with a role and text; ``start`` opens one whose text is streamed;
* ``delta`` adds text to its message;
* ``edit`` replaces what its message has said so far;
* ``regenerate`` empties its message and takes back every message opened after it.

Events are partitioned by conversation and sorted by sequence. Windows settle which events still count, and Python
only joins the text of those, one turn after another. A long conversation comes out in parts of about ``PART``
characters, so no worker holds more than one part and one turn.

A rendered turn is ``<|role|>``, a line break, the text, ``<|end|>`` and a line break. In roles and texts a backslash
goes before every backslash, and parts ``<|`` and ``|>``; dropping each backslash before a character gives them back.

Defined results: a null text or role is empty. Events whose message was never opened are left out, as are second
openings of a message. Equal sequence numbers are ordered by kind of event (openings first), then by text. Null
conversation ids form one conversation. A conversation whose messages are all taken back has no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import partitions, pick, small_batches, type_of

PART = 1_000_000
OPENING = ("message", "start")
LEARNED = "assistant"
_TURN = re.compile(r"<\|((?:[^\\|]|\\.|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")


def unescaped(text: str) -> str:
    return _BACK.sub(r"\1", text)


def rendered_turn(role: str, text: str) -> tuple[str, int, int]:
    """``(turn, start, end)``: the turn, and where its text stands in it."""
    head = f"<|{escaped(role)}|>\n"
    body = escaped(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn, read back."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def log_of(conversations: DataFrame, delta: int = 400) -> DataFrame:
    """The event log that a table of finished turns comes from: assistants stream, the others post.

    Turns are ordered by ``turn``, null first, then role and text.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumns(
        {c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("message_id", number)
    opening = F.array(F.struct(
        F.lit(0).alias("step"), F.when(F.col("role") == LEARNED, "start").otherwise("message").alias("kind"),
        F.when(F.col("role") == LEARNED, "").otherwise(F.col("text")).alias("text")))
    starts = F.sequence(F.lit(1), F.char_length("text"), F.lit(delta))
    streamed = F.when((F.col("role") == LEARNED) & (F.char_length("text") > 0), F.transform(
        starts, lambda at, i: F.struct((i + 1).alias("step"), F.lit("delta").alias("kind"),
                                       F.substring(F.col("text"), at, F.lit(delta)).alias("text")))
    ).otherwise(F.array().cast("array<struct<step:int,kind:string,text:string>>"))
    events = rows.select("conv_id", "message_id", "role", F.explode(F.concat(opening, streamed)).alias("e"))
    return events.select("conv_id", (F.col("message_id") * (1 << 31) + F.col("e.step")).alias("seq"), "e.kind",
                         "message_id", "role", "e.text")


def live_events(events: DataFrame) -> DataFrame:
    """``(conv_id, open_seq, message_id, role, seq, text)``: the pieces of text that final messages are made of.

    One shuffle, by conversation; every window after it uses that partitioning.
    """
    rows = pick(events, "conv_id", "seq", "kind", "message_id", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.repartition(partitions(events.sparkSession), "conv_id")
    rank = F.when(F.col("kind").isin(*OPENING), 0).otherwise(1)
    rows = rows.withColumn("at", F.struct(F.col("seq").alias("seq"), rank.alias("rank"), F.col("kind").alias("kind"), F.col("text").alias("t")))
    message = Window.partitionBy("conv_id", "message_id")
    opening = F.when(F.col("kind").isin(*OPENING), F.col("at"))
    rows = rows.withColumn("opened", F.min(opening).over(message)).filter(F.col("opened").isNotNull())
    rows = rows.filter(~F.col("kind").isin(*OPENING) | (F.col("at") == F.col("opened"))).filter(F.col("at") >= F.col("opened"))
    # From the end of the log backwards: the earliest opening that a later event goes back to.
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    back_to = F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later)
    rows = rows.withColumn("taken_back", F.when(F.col("at") == F.col("opened"), F.coalesce(back_to < F.col("opened"), F.lit(False))))
    rows = rows.withColumn("taken_back", F.max("taken_back").over(message)).filter(~F.col("taken_back"))
    fresh = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(message)
    role = F.max(F.when(F.col("at") == F.col("opened"), F.coalesce("role", F.lit("")))).over(message)
    rows = rows.withColumns({"fresh": fresh, "own_role": role}).filter(F.col("at") >= F.col("fresh"))
    text = F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text"))
    return rows.select("conv_id", F.col("opened.seq").alias("open_seq"), "message_id", F.col("own_role").alias("role"),
                       "seq", F.col("at.rank").alias("rank"), text.alias("text"))


def formatted(events: DataFrame, part: int = PART) -> DataFrame:
    """``(conv_id, part, formatted, n_turns, loss array<struct<start, end>>)``: conversations rendered turn by turn.

    Parts of a conversation follow each other in one partition; they break between turns. ``loss`` marks the text of
    assistants in the characters of the part.
    """
    small_batches(events.sparkSession, 2000)
    kind = type_of(events, "conv_id")
    rows = live_events(events).sortWithinPartitions("conv_id", "open_seq", "message_id", "seq", "rank", "text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, size, turns, loss = None, 0, 0, [], []
        message, role, pieces = None, "", []
        ready: list[tuple] = []
        conv_kind = None

        def end_message() -> None:
            nonlocal message, pieces, size
            if message is not None:
                turn, a, b = rendered_turn(role, "".join(pieces))
                if role == LEARNED:
                    loss.append({"start": size + a, "end": size + b})
                turns.append(turn)
                size += len(turn)
            message, pieces = None, []

        def end_part() -> None:
            nonlocal number, size, turns, loss
            if turns:
                ready.append((conv[0], number, "".join(turns), len(turns), loss))
            number, size, turns, loss = number + 1, 0, [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (conv_kind, pa.int32(), pa.string(), pa.int32(), span), strict=True)],
                names=["conv_id", "part", "formatted", "n_turns", "loss"])

        for batch in batches:
            conv_kind = batch.schema.field(0).type
            for conv_id, open_seq, message_id, own_role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != (conv_id,) or message != (open_seq, message_id):
                    end_message()
                if conv != (conv_id,):
                    end_part()
                    conv, number = (conv_id,), 0
                elif size >= part:
                    end_part()
                    if len(ready) >= 4:
                        yield out()
                message, role = (open_seq, message_id), own_role
                pieces.append(text)
            if ready:
                yield out()
        end_message()
        end_part()
        if ready:
            yield out()

    chosen = rows.select("conv_id", "open_seq", "message_id", "role", "text")
    return chosen.mapInArrow(
        run, f"conv_id {kind}, part int, formatted string, n_turns int, loss array<struct<start:int,end:int>>")


def read_back(rendered: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from rendered parts alone.

    Turns are parsed out of the text, learned text is cut out by the loss mask, and digests run over the parts of a
    conversation in order; the rows must come as ``formatted`` leaves them.
    """
    kind = type_of(rendered, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        conv_kind = pa.int64()

        def closed(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*[(c, n, t.hexdigest(), k, s.hexdigest(), f) for c, n, t, k, s, f in rows], strict=True)
            kinds = (conv_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            conv_kind, done = batch.schema.field(0).type, []
            for conv_id, part, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or part == 0:
                    done += [held] if held else []
                    held = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    held[1] += 1
                    held[2].update(f"{role}\n{said}\n".encode())
                for mark in loss:
                    learned = unescaped(text[mark["start"] : mark["end"]])
                    held[3] += len(learned)
                    held[4].update(learned.encode())
                held[5] += len(text)
            if done:
                yield closed(done)
        if held:
            yield closed([held])

    return rendered.select("conv_id", "part", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
