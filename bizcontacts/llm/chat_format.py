"""Chat formatting from event logs: fold streamed events into messages, then render them.

A log row is (conv_id, msg, seq, kind, role, text). Kinds: ``start`` opens a message, ``delta``
appends, ``edit`` replaces the text so far, ``regenerate`` discards it so that the deltas that
follow rebuild it. Logs are dealt by conversation and sorted by message and sequence; the fold then
streams over them and holds one message at a time. The template marks turns by lines and escapes
with a backslash whatever could be read as a mark, so a rendered text parses back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import ship

EVENTS = "conv_id long, msg long, seq long, kind string, role string, text string"
RENDERED = "conv_id long, part long, text string, loss array<struct<start:long,end:long>>"
PART_CHARS = 1 << 20
CLOSE = "</turn>"
MARKS = re.compile(r"\\|###|</turn>")
UNMARK = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^\\\n:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)
LOSS_ROLE = "assistant"
# columns of ``conversation_events`` that tell rows of one turn number apart
TIE = ("tie_text", "tie_row")


def escape(text: str) -> str:
    return MARKS.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\:#\n]", lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return UNMARK.sub(r"\1", text)


def conversation_events(turns: DataFrame) -> DataFrame:
    """Log of a table of finished turns (conv_id, turn, role, text): a start and one delta each, and the columns ``TIE``.

    Rows with a repeated turn number, equal ones included, stay messages of their own, in the order of
    role and text. Null role or text is empty.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("msg"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                     F.monotonically_increasing_id().alias("tie_row"))
    delta = F.struct(F.lit(1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.col("text").alias("text"))
    start = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text"))
    # a start names its text and row too, so that rows of one turn number sort apart as whole messages
    return t.select("conv_id", "msg", F.col("text").alias("tie_text"), "tie_row", "role",
                    F.explode(F.array(start, delta)).alias("e")) \
        .select("conv_id", "msg", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "role",
                F.col("e.text").alias("text"), *TIE)


def render_chats(events: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Rendered conversations (conv_id, part, text, loss): parts of about a million characters.

    ``loss`` holds the code-point spans of assistant text within the part. A message is opened by
    ``start``, or by its first event where the log lacks it; null kinds count as deltas, null texts
    and roles as empty; events of equal sequence are ordered by kind and text, with ``start`` first.
    Rows without a conversation id form one conversation with a null id. No log, no rows. Extra columns are not read
    but those named by ``tie``, which separate messages of equal number.
    """
    ship(events.sparkSession)
    e = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("msg").cast("long").alias("msg"),
        F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(f"_tie{k}") for k, c in enumerate(tie)])
    e = e.withColumn("_first", (F.col("kind") != "start").cast("int"))
    # the role is part of the order only to tell messages of equal number apart
    by_tie = ["role", *[f"_tie{k}" for k in range(len(tie))]] if tie else []
    e = (e.repartition("conv_id")
         .sortWithinPartitions("conv_id", "msg", *by_tie, "seq", "_first", "kind", "text"))

    def fold(batches):
        conv, message, role, text = None, None, "", []
        part, chars, out, spans = 0, 0, [], []
        opened = tied = False

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(out)], pa.string()),
                 pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["conv_id", "part", "text", "loss"])

        def close():
            nonlocal chars
            body = escape("".join(text))
            head = f"### {escape_role(role)}: "
            if role == LOSS_ROLE:
                spans.append({"start": chars + len(head), "end": chars + len(head) + len(body)})
            out.append(f"{head}{body}{CLOSE}\n")
            chars += len(out[-1])

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "msg", "kind", "role", "text")]
            for c, m, kind, who, said in zip(*cols, strict=True):
                fresh = not opened or c != conv or m != message
                if not fresh and tied and kind == "start":  # the next message of an equal number
                    fresh = True
                if fresh:
                    if opened:
                        close()
                        if c != conv or chars >= PART_CHARS:
                            yield emit()
                            part, chars, out, spans = (part + 1 if c == conv else 0), 0, [], []
                    conv, message, role, text = c, m, who, []
                    opened, tied = True, bool(by_tie)
                if kind in ("edit", "regenerate"):
                    text = []
                if who and not role:
                    role = who
                if kind != "regenerate":
                    text.append(said)
        if opened:
            close()
            yield emit()

    return e.mapInArrow(fold, RENDERED)


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a rendered part; the span covers the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"not a rendered turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def chat_digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, from rendered parts: turn count, hashes of turns and of loss text, lengths.

    Parts stream by in order, so even a very long conversation is never held whole.
    """
    ship(rendered.sparkSession)
    r = rendered.select("conv_id", "part", "text", "loss").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "part")

    def digest(batches):
        conv, state = None, None

        def emit():
            n, turns, loss, loss_chars, chars = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]),
                 pa.array([loss_chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        yield emit()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                text = row["text"]
                for role, said, _, _ in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    said = unescape(text[span["start"]:span["end"]])
                    state[2].update(said.encode("utf-8", "surrogatepass"))
                    state[3] += len(said)
                state[4] += len(text)
        if state is not None:
            yield emit()

    return r.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")
