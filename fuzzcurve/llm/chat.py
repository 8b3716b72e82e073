"""Operator 7: chat formatting by event-sourced reconstruction.

A log has events of conversations: ``start`` opens a message with a role,
``delta`` adds text to it, ``edit`` replaces its text, ``regenerate`` empties
it to be streamed again and drops what came after it, ``delete`` removes it.
Events are dealt by conversation, sorted, and folded one by one into the
final messages; then the conversation is rendered.

The template is ``<|turn|>role NEWLINE text<|end|> NEWLINE``. Control strings
inside roles and texts get a backslash after their first character and a
backslash is doubled, so nothing that a message says can close a turn, and
reading back restores it. Loss spans (code points of the rendered string)
cover the texts of assistant turns.

Null texts and roles are empty. Events of unknown kinds, or for messages
that are not open, change nothing. Ties in the order are settled by message
and part. Rows that repeat a turn are turns of their own. A conversation is
one row of the result, so it is folded by one task, from a stream: only its
final messages are held, and time is linear in its events. An empty log gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped, read

TURN, END = "<|turn|>", "<|end|>"
#: Strings that must not stand in a message as they are.
CONTROL = (TURN, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
EVENTS = "conv_id long, seq long, message long, part int, kind string, role string, text string"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def fold(messages: dict, order: list, kind: str, message, role: str | None, text: str | None) -> None:
    """One event's effect on the messages (in order of their start: key -> [role, texts, place]).

    ``order`` lists the keys by place, deleted ones too: what comes after a
    message is its tail, so each message is looked at once more at most.
    """
    if kind == "start":
        if message in messages:
            messages[message][:2] = role or "", [text or ""]
        else:
            messages[message] = [role or "", [text or ""], len(order)]
            order.append(message)
    elif message in messages:
        if kind == "delta":
            messages[message][1].append(text or "")
        elif kind == "edit":
            messages[message][1] = [text or ""]
        elif kind == "regenerate":
            messages[message][1] = []
            tail = messages[message][2] + 1
            for later in order[tail:]:
                messages.pop(later, None)
            del order[tail:]
        elif kind == "delete":
            del messages[message]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and where its loss spans begin and end."""
    out, at, begin, end = [], 0, [], []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}\n".replace("\n", "\\n", escape(role).count("\n")), escape(text)
        out += [head, body, END, "\n"]
        at += len(head)
        if role == "assistant":
            begin.append(at)
            end.append(at + len(body))
        at += len(body) + len(END) + 1
    return "".join(out), begin, end


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(TURN) : line], flags=re.S), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def format_log(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_begin, loss_end) for each conversation of ``events`` (see EVENTS)."""

    def run(batches):
        none = object()
        last, messages, order = none, {}, []

        def row(conv):
            text, begin, end = render([(role, "".join(parts)) for role, parts, _ in messages.values()])
            return conv, text, begin, end

        def send(rows):
            types = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["conv_id", "formatted", "loss_begin", "loss_end"])

        for b in batches:
            rows = []
            for conv, message, kind, role, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                if last is none or conv != last:
                    if last is not none:
                        rows.append(row(last))
                    last, messages, order = conv, {}, []
                fold(messages, order, kind, message, role, text)
            if rows:
                yield send(rows)
        if last is not none:
            yield send([row(last)])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq", "tie", "message", "part") if "tie" in events.columns else events.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq", "message", "part")
    return mapped(ordered.select("conv_id", "message", "kind", "role", "text"), run, "conv_id long, formatted string, loss_begin array<int>, loss_end array<int>")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of finished turns (conv_id, turn, role, text), as a streaming front end would have written it.

    An assistant's turn is started, streamed once with its halves the wrong
    way round, regenerated and streamed again in two deltas; a user's turn is
    started, typed in part and edited to its text; others come in two deltas.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = (F.length(text) / 2).cast("int")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("message"), F.col("role").cast("string").alias("role"), text.alias("text"), half.alias("half"))
    head, tail, none = F.substring("text", F.lit(1), F.col("half")), F.substring("text", F.col("half") + 1, F.length("text")), F.lit(None)

    def log(*events):
        return F.array(*[F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text")) for part, (kind, role, text) in enumerate(events)])

    start, streamed = ("start", F.col("role"), none), [("delta", none, head), ("delta", none, tail)]
    parts = F.when(F.col("role") == "assistant", log(start, *reversed(streamed), ("regenerate", none, none), *streamed)).when(F.col("role") == "user", log(start, streamed[0], ("edit", none, F.col("text")))).otherwise(log(start, *streamed))
    return rows.select("conv_id", "seq", "tie", "message", F.explode(parts).alias("e")).select("conv_id", "seq", "tie", "message", "e.*")


def _digest(batches):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for b in batches:
        rows = []
        for conv, formatted, begin, end in zip(*(b.column(i).to_pylist() for i in range(4))):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[a:z]) for a, z in zip(begin, end))
            rows.append((conv, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss), len(formatted)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def op7_chat(spark, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return mapped(format_log(events_of(rows)), _digest, shape)
